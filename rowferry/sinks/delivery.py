"""What a sink reports, and the sending of calls from inside a task."""

from __future__ import annotations

import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ..operators.replies import NOT_FOUND_CODES

# (http method, url, body, headers, timeout) -> (status or None if unreachable, body)
Transport = Callable[[str, str, str, dict, float], "tuple[int | None, str]"]

SKIPPED = "skipped"  # the op of a create that was sent before, and the outcome of such a call


class DeliveryError(Exception):
    """The destination refused or could not be reached."""


@dataclass(frozen=True)
class Delivered:
    """Records written, calls not found and failed; ``unconfirmed`` records were sent in a list whose
    answer does not name them, ``skipped`` creates were left out because an earlier run got them through."""

    written: int = 0
    not_found: int = 0
    failed: int = 0
    error: str | None = None
    unconfirmed: int = 0
    skipped: int = 0


@dataclass(frozen=True)
class Destination:
    """Type, entity and address of a CRM; the secret stays in the job's options."""

    type: str
    entity: str
    url: str
    token: str
    timeout: float = 30.0

    def request(self, op: str, method: str | None) -> tuple[str, str, dict]:
        """(http method, url, headers) of one call."""
        base, headers = self.url.rstrip("/"), {"Content-Type": "application/json"}
        if self.type == "bitrix24":
            return "POST", f"{base}/rest/{self.token.strip('/')}/{method}", headers
        headers["Authorization"] = f"Bearer {self.token}"
        return ("PATCH" if op == "update" else "POST"), f"{base}/api/v4/{self.entity}", headers


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    """A redirected POST would arrive as a GET and could pass for written."""

    def redirect_request(self, *args):
        return None


def http_transport(method: str, url: str, body: str, headers: dict, timeout: float) -> tuple[int | None, str]:
    request = urllib.request.Request(url, data=body.encode(), headers=headers, method=method)
    try:
        with urllib.request.build_opener(_NoRedirects).open(request, timeout=timeout) as response:
            return response.status, response.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")
    except (OSError, http.client.HTTPException) as error:  # the latter: a cut-off body, a bad status line
        return None, str(error) or type(error).__name__


@dataclass(frozen=True)
class Verdict:
    """``accepted``: the places, in the call, of the records that are known to be written."""

    outcome: str
    items: int = 0
    error: str | None = None
    accepted: tuple[int, ...] = ()


def _echoed_places(echoed: list, sent: list) -> tuple[int, ...]:
    """Which of the sent items an answer names: by the id of an update, or by the request id of a create,
    which is the item's place unless the item carries one."""
    places = {}
    for i, item in enumerate(sent):
        told = item.get("id"), item.get("request_id", i)
        places.setdefault(("request", str(told[1])), i)
        if told[0] is not None:
            places.setdefault(("id", str(told[0])), i)
    found = set()
    for item in echoed:
        if not isinstance(item, dict):
            continue
        for key in (("id", str(item.get("id"))), ("request", str(item.get("request_id")))):
            if key in places:
                found.add(places[key])
                break
    return tuple(sorted(found))


def judge(destination: Destination, status: int | None, body: str, payload: str = "{}") -> Verdict:
    """What one response says: the rule of ``classify_responses`` for the one place that has to
    decide inside the task whether to go on, and for lists which records it confirms."""
    if status is None:
        return Verdict("failed", error=f"could not reach {destination.type}: {body}")
    # Only a single record can be "not found" and skipped; for a list the entity itself is missing.
    lost = "not_found" if destination.type == "bitrix24" else "failed"
    if status == 404:
        return Verdict(lost, error="no such entity (HTTP 404)")
    if status in (401, 403):
        return Verdict("failed", error=f"credentials rejected (HTTP {status})")
    if 300 <= status <= 599:
        return Verdict("failed", error=f"HTTP {status}: {body[:300]}")
    try:
        reply = json.loads(body)
    except ValueError:
        return Verdict("failed", error="response is not JSON")
    if destination.type == "bitrix24":
        if isinstance(reply, dict) and "error" in reply:
            text = str(reply.get("error_description", reply["error"]))
            return Verdict(lost if reply["error"] in NOT_FOUND_CODES else "failed", error=text)
        return Verdict("written", 1, accepted=(0,))
    embedded = reply.get("_embedded") if isinstance(reply, dict) else None
    echoed = embedded.get(destination.entity) if isinstance(embedded, dict) else None
    if not isinstance(echoed, list):
        return Verdict("failed", error=f"response names no {destination.entity}")
    sent = json.loads(payload)
    sent = sent if isinstance(sent, list) else []
    if len(echoed) >= len(sent):
        return Verdict("written", len(echoed), accepted=tuple(range(len(sent))))
    accepted = _echoed_places(echoed, sent)
    return Verdict("partial", len(echoed), f"{len(echoed)} of {len(sent)} records confirmed", accepted)


def send_all(
    destination: Destination, transport: Transport, calls: Iterable[tuple[list | None, str, str | None, str, bool]]
) -> Iterator[tuple]:
    """Send calls one after another; after the first failure the rest is not tried.

    Calls are (keys, op, method, payload, unsendable), results (keys, op, outcome,
    items, error, unconfirmed). The keys of a result are those of the records that are known
    to be written, or all of them if nothing was; only these must never be sent again. A call marked
    as skipped is counted and not sent.
    """
    stopped = False
    for keys, op, method, payload, unsendable in calls:
        if op == SKIPPED:
            yield None, op, SKIPPED, len(keys), None, 0
            continue
        if stopped:
            yield keys, op, "not_sent", 0, None, 0
            continue
        if unsendable:
            found = Verdict("failed", error="a field holds NaN or infinity, which JSON cannot carry")
        else:
            verb, url, headers = destination.request(op, method)
            status, body = transport(verb, url, payload, headers, destination.timeout)
            found = judge(destination, status, body, payload)
        stopped = found.outcome == "failed"
        unconfirmed = 0
        if found.outcome == "partial":
            unconfirmed = len(json.loads(payload)) - found.items
            keys = None if keys is None else [keys[i] for i in found.accepted]
        yield keys, op, found.outcome, found.items, found.error, unconfirmed
