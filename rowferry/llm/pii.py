"""Personal data: plain formats always, other writings by boosted trees over candidates.

Base spans follow fixed formats (mail address, IPv4 address, payment card, phone number with
a plus). Besides, generators of high recall propose overlapping spans: every stretch of neighbouring
groups of digits that has a fitting number of digits, and everything around an "at" sign, written out or not.
Boosted trees, one ensemble per kind, judge a proposal by its format (digits, groups, separators, check
digits) and its surroundings (neighbouring characters, digits nearby, telling words). Proposals
whose score reaches the kind's threshold are taken, best first, where they overlap nothing taken before.

Labels come from the documents themselves, not from a list: base spans of all different texts are
positive, as they stand and written in ways the base formats do not know; proposals beside base spans,
cut-off or overlong ones, and spans with broken check digits or parts are negative; a proposal without
a base span that passes its kind's checks is unknown and left out. The thresholds are
calibrated on documents the trees have not seen. Trees and thresholds are learned from all such rows by sums
over tasks; none is left out. Scoring is row by row: no shuffle.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import boosted_trees

KINDS = ("email", "ip", "card", "phone")
BATCH_ROWS = 1 << 14
SCORE_PARTS = 1 << 10  # parts of a unit of log odds that thresholds tell apart
PRECISION = 0.97  # on unseen documents, at the threshold of a kind
LEAST_SCORE = 0.9  # no threshold lies lower
SIDE = 40  # characters of context

Span = tuple[str, int, int]

# ---- base formats ----

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if i % 2 == 0 else (2 * value - 9 if value > 4 else 2 * value)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[Span]:
    """By the @ signs, since looking for the part before one from every place on is quadratic in long words."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """All spans of the fixed formats, by start, then kind. Linear in the text."""
    found = list(_emails(text))
    if _DIGITS.search(text):
        for chain in _DOTTED.finditer(text):
            parts = list(_DIGITS.finditer(text, chain.start(), chain.end()))
            for i in range(0, len(parts) - 3, 4):
                if all(_small(p.group()) for p in parts[i : i + 4]):
                    found.append(("ip", parts[i].start(), parts[i + 3].end()))
        for match in _CARD.finditer(text):
            if match.end() - match.start() >= 14:
                digits = _only_digits(match.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", match.start(), match.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m.group())) <= 15]
    return sorted(found, key=_order)


def _order(span: Span):
    return span[1], KINDS.index(span[0]), span[2]


# ---- proposals ----

_CHAIN = re.compile(r"[0-9]++(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|[ \xa0().\-/]{1,3})[0-9]++)*+")
_AT = re.compile(r"\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?|[@＠]|\sat\s", re.IGNORECASE)
_MAY_PROPOSE = "(?i)[0-9@＠]|[^a-z]at[^a-z]"  # of every text with proposals
_DOT = r"(?:\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\.|\sdot\s)"
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}+")
_NEXT_LABEL = re.compile(_DOT + r"[A-Za-z0-9-]{1,63}+", re.IGNORECASE)


def _numeric(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 4:
            continue
        groups = [m.span() for m in _DIGITS.finditer(text, chain.start(), chain.end())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                end = groups[j][1]
                if j - i == 3 and all(b - a <= 3 for a, b in groups[i : j + 1]):
                    yield "ip", start, end
                if digits >= 13:
                    yield "card", start, end
                if 7 <= digits <= 15:
                    before = text[max(0, start - 2) : start]
                    lead = 2 if before == "+(" else 1 if before[-1:] in ("+", "(") else 0
                    yield "phone", start - lead, end


def _addresses(text: str) -> Iterator[Span]:
    for mark in _AT.finditer(text):
        start = mark.start()
        while start > 0 and mark.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        label = _LABEL.match(text, mark.end())
        if start == mark.start() or not label:
            continue
        end, labels = label.end(), 1
        if not mark.group().isspace() and not mark.group().strip().isalpha():
            yield "email", start, end
        while labels < 6 and (more := _NEXT_LABEL.match(text, end)):
            end, labels = more.end(), labels + 1
            yield "email", start, end


def proposals(text: str) -> list[Span]:
    """Candidate spans of all kinds; they overlap each other. Linear in the text."""
    found = list(_addresses(text))
    found += _numeric(text)
    return found


# ---- features ----

# Words that tell what a number or address is; fixed values.
_CUES = (
    re.compile(r"mail|contact|write|schreib|écri|correo", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|address|adresse|dirección", re.IGNORECASE),
    re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.IGNORECASE),
    re.compile(r"phone|tel|call|fax|mobile|anruf|appel|llam", re.IGNORECASE),
    re.compile(r"order|invoice|isbn|version|date|page|id\b|no\b|nr\b", re.IGNORECASE),
)
_CONTINUES_BEFORE = re.compile(r"[0-9][ \xa0().\-/+]{0,3}$")
_CONTINUES_AFTER = re.compile(r"[ \xa0().\-/]{0,3}[0-9]")


def _separators(inside: str) -> list[str]:
    return [s for s in _DIGITS.split(inside)[1:-1] if s]


def _class(character: str) -> int:
    if not character or character.isspace():
        return 0
    return 2 if character.isdigit() else 1 if character.isalpha() else 3


def features(text: str, span: Span) -> list[float]:
    """Of one proposal: its format, then its surroundings."""
    _, start, end = span
    inside, before, after = text[start:end], text[max(0, start - SIDE) : start], text[end : end + SIDE]
    groups = _DIGITS.findall(inside)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    labels = re.split(_DOT, inside, flags=re.IGNORECASE)
    between = _separators(inside)
    marks = [inside.count(c) for c in " \xa0-./(+[@"]
    return [
        len(inside), len(digits), len(groups), sizes[0], sizes[-1], min(sizes), max(sizes), len(set(sizes)), len(set(digits)),
        sum(c.isalpha() for c in inside), *marks, len(between), len(set(between)), max(map(len, between), default=0),
        bool(digits) and luhn(digits), len(groups) == 4 and all(map(_small, groups)), digits[:1] == "0", int(digits[:1] or 0),
        digits[:2] == "00", len(labels), len(labels[-1]), labels[-1].isalpha(), "at" in inside.lower(), "dot" in inside.lower(),
        _class(before[-1:]), _class(after[:1]), bool(_CONTINUES_BEFORE.search(before)), bool(_CONTINUES_AFTER.match(after)),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        *(len(cue.findall(before)) for cue in _CUES), *(bool(cue.search(after)) for cue in _CUES),
    ]


# ---- training rows ----


def _passes(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a proposal meets the checks of its kind, in whatever writing."""
    digits = _only_digits(text[start:end])
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return len(set(_separators(text[start:end]))) == 1 and all(map(_small, _DIGITS.findall(text[start:end])))
    if kind == "phone":
        return 10 <= len(digits) <= 15 and text[start] == "+"
    return "." in text[start:end] and "@" in text[start:end]


def _grouped(digits: str, sizes: Iterable[int], separator: str) -> str:
    parts, at = [], 0
    for size in sizes:
        parts.append(digits[at : at + size])
        at += size
    return separator.join(p for p in [*parts, digits[at:]] if p)


def _rewritten(kind: str, written: str, choice: random.Random) -> list[tuple[str, bool]]:
    """(writing, whether it still is personal data): other writings of a base span, and broken ones.
    A writing may have copies of the span side by side, divided by a line feed here."""
    digits = _only_digits(written)
    if kind == "email":
        local, _, domain = written.partition("@")
        out = []
        for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("＠", "."), ("(at)", "."), (" [at] ", " [dot] ")):
            out.append((f"{local}{at}{domain.replace('.', dot)}", True))
        label = domain.partition(".")[0]
        numbers = [str(choice.randrange(1000)) for _ in range(3)]
        out += [(f"{local} at {dot.join(numbers[:n])}", False) for dot in (".", "[.]", " (dot) ") for n in (2, 3)]
        return out + [(f"{local}@{label}", False), (f"{local} at {label}", False), (f"{local} at {label} dot", False)]
    if kind == "ip":
        parts = _DIGITS.findall(written)
        wrong = parts.copy()
        wrong[choice.randrange(4)] = str(choice.randint(256, 999))
        marks = ("[.]", "(.)", "[dot]", "(dot)")
        decimal = ".".join([*parts, str(choice.randrange(100))])
        return [(m.join(parts), True) for m in marks] + [(choice.choice(marks).join(wrong), False), (".".join(wrong), False), ("-".join(parts), False), ("/".join(parts), False), (" ".join(parts), False), (f"0.{decimal}", False)]
    if kind == "card":
        at = choice.randrange(len(digits))
        wrong = digits[:at] + str((int(digits[at]) + choice.randint(1, 9)) % 10) + digits[at + 1 :]
        out = []
        for value, good in ((digits, True), (wrong, luhn(wrong))):
            out += [(_grouped(value, (4, 4, 4), mark), good) for mark in (".", "/", "  ", "\xa0")]
            out += [(value, good), (f"{value}\n{value}", good)]
        return out
    local = digits[-10:]
    out = [(written.removeprefix("+"), True), (f"00{digits}", True), (f"00 {_grouped(digits, (len(digits) - 10, 3, 3), ' ')}", True)]
    out += [(f"({local[:3]}) {local[3:6]}-{local[6:]}", True), (f"+{_grouped(digits, (len(digits) - 10, 3, 3), '/')}", True)]
    out += [(_grouped(local, (3, 3), mark), True) for mark in ("-", ".", "/", " ")] if len(digits) > 10 else []
    year, month, day = choice.randint(1900, 2040), choice.randint(1, 12), choice.randint(1, 28)
    out += [(f"{year}{mark}{month:02d}{mark}{day:02d}", False) for mark in "-./"] + [(f"{day}.{month}.{year}", False)]
    out += [(f"{year}-{month:02d}-{day:02d} {choice.randrange(24):02d}", False), (f"{year}-{year + 7}", False)]
    out += [(str(choice.randrange(10 ** (n - 1), 10**n)), False) for n in (7, 8, 9, 10, 11, 12, 13)]
    out += [(f"{choice.randrange(1, 999)}.{choice.randrange(10**6, 10**9)}", False), (f"{choice.randrange(10, 99)}.{choice.randrange(100, 999)}.{choice.randrange(100, 999)}", False)]
    out += [(_grouped(f"978{choice.randrange(10**9, 10**10)}", (3, 1, 2, 6), "-"), False)]
    return out


def _snippet_rows(before: str, writing: str, good: bool, after: str, kind: str) -> Iterator[tuple[str, bool, list[float]]]:
    """Proposals on one rewritten span: its exact place is the label, all others that touch it are negative, of any kind."""
    pieces, spans, text = writing.split("\n"), [], before
    for i, piece in enumerate(pieces):
        text += " " if i else ""
        spans.append((len(text), len(text) + len(piece)))
        text += piece
    low, high = spans[0][0], spans[-1][1]
    text += after
    for span in proposals(text):
        if span[1] < high and low < span[2]:
            yield span[0], good and span[0] == kind and span[1:] in spans, features(text, span)


def _touched(starts: dict[str, list[Span]], span: Span) -> list[str]:
    """The kinds of the base spans that overlap a span; those of a kind, in order, do not overlap each other."""
    out = []
    for kind, own in starts.items():
        at = bisect_left(own, span[2], key=lambda s: s[1])
        if at and own[at - 1][2] > span[1]:
            out.append(kind)
    return out


def training_rows(text: str) -> Iterator[tuple[str, bool, list[float]]]:
    """(kind, label, features) made of one document. Linear in the text."""
    base = base_spans(text)
    own = set(base)
    by_kind = {kind: [span for span in base if span[0] == kind] for kind in KINDS}
    choice = random.Random(zlib.crc32(text.encode()))
    for span in proposals(text):
        if span in own:
            yield span[0], True, features(text, span)
            continue
        touched = _touched(by_kind, span)
        if touched or not _passes(text, *span):
            # What lies on a base span of another kind says nothing about its own.
            if not touched or span[0] in touched:
                yield span[0], False, features(text, span)
    for kind, start, end in base:
        before, after = text[max(0, start - SIDE) : start], text[end : end + SIDE]
        for writing, good in _rewritten(kind, text[start:end], choice):
            yield from _snippet_rows(before, writing, good, after, kind)


# ---- model ----


@dataclass(frozen=True)
class PiiModel:
    """Ensembles and thresholds of the kinds that could be learned; ``figures`` has precision and recall at the
    threshold on the documents that were kept out of the training."""

    trees: dict[str, boosted_trees.BoostedTrees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    figures: dict[str, tuple[float, float]] = field(default_factory=dict)

    def scores(self, kinds: list[str], x: np.ndarray) -> np.ndarray:
        out, names = np.zeros(len(x)), np.array(kinds)
        for kind, trees in self.trees.items():
            mine = np.flatnonzero(names == kind)
            if len(mine):
                out[mine] = trees.scores(x[mine])
        return out


def _threshold(score: np.ndarray, n: np.ndarray, yes: np.ndarray) -> tuple[float, float, float] | None:
    """(lowest threshold from ``LEAST_SCORE`` on that holds ``PRECISION``, precision, recall), one false positive more than
    seen counted in; of ``n`` rows with each score ``yes`` are right. Scores differ and fall."""
    right, taken = np.cumsum(yes), np.cumsum(n)
    fits = np.flatnonzero((score >= LEAST_SCORE) & (right / (taken + 1) >= PRECISION))
    if not len(fits):
        return None
    at = fits[-1]
    # Halfway to the next lower score: unseen documents score a little lower than the last one taken.
    below = score[at + 1] if at + 1 < len(score) else 0.0
    return max(LEAST_SCORE, float(score[at] + below) / 2), float(right[at] / taken[at]), float(right[at] / max(1, right[-1]))


def _calibration(rows: DataFrame, trees: dict[int, boosted_trees.BoostedTrees]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind (score, rows, right ones) from the highest score on, of log odds rounded to ``SCORE_PARTS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, models = np.zeros(batch.num_rows, dtype=np.int64), batch.column("model").to_numpy()
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), dtype="<u2").reshape(batch.num_rows, -1).astype(float)
            for model, mine in trees.items():
                rows = np.flatnonzero(models == model)
                if len(rows):
                    place[rows] = np.rint(mine.totals(x[rows]) * SCORE_PARTS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("label"), batch.column("n"), pa.array(place)], ["model", "label", "n", "place"])

    scored = rows.select("model", "label", "n", "features").where(F.col("model").isin(list(trees)))
    counts = scored.mapInArrow(run, "model int, label boolean, n bigint, place bigint").groupBy("model", "place")
    counts = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("yes"))
    model, place, n, yes = (column.to_numpy() for column in counts.orderBy(F.desc("place")).toArrow().columns)
    score = 1 / (1 + np.exp(-place / SCORE_PARTS))
    return {m: (score[model == m], n[model == m], yes[model == m]) for m in trees}


def fit(rows: DataFrame) -> PiiModel:
    """From (model: place in ``KINDS``, label, aside: kept out for calibration, features, n: number of such rows). A kind without
    both labels, or whose threshold cannot hold the precision, is not learned: nothing is added to its base spans."""
    model = PiiModel()
    trees = boosted_trees.fit_table(rows.where("NOT aside").select("model", "label", "n", "features"))
    for at, counts in (_calibration(rows.where("aside"), trees) if trees else {}).items():
        found = _threshold(*counts) if counts[2].sum() else None
        if found:
            kind = KINDS[at]
            model.trees[kind], model.thresholds[kind], model.figures[kind] = trees[at], found[0], found[1:]
    return model


def train(docs: DataFrame, text: str = "text") -> PiiModel:
    """The model of all different texts with proposals, whole. Equal rows of features are counted, written once and
    stay in the tasks: sums over them go to the driver, which the table's size does not change. A quarter of the texts
    calibrates the thresholds."""

    def telling(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(proposals(text)) for text in batch.column(0).to_pylist()], pa.bool_()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["model", "label", "aside", "features"])

        found = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, label, values in training_rows(text):
                    found.append((KINDS.index(kind), label, key % 4 == 0, np.array(values, dtype="<u2").tobytes()))
                    if len(found) == BATCH_ROWS:
                        yield packed(found)
                        found = []
        if found:
            yield packed(found)

    texts = docs.select(F.col(text).alias("text")).where(F.col("text").rlike(_MAY_PROPOSE)).mapInArrow(telling, "text string").distinct()
    rows = texts.select(F.xxhash64("text"), "text").mapInArrow(run, "model int, label boolean, aside boolean, features binary")
    return fit(stage(rows.groupBy("model", "label", "aside", "features").agg(F.count(F.lit(1)).alias("n")), "pii-rows"))


def _added(base: list[Span], found: list[tuple[float, Span]]) -> list[Span]:
    """Spans that overlap neither a base span nor one taken before; best score first, then the longest."""
    taken, out = sorted((start, end) for _, start, end in base), []
    for _, span in sorted(found, key=lambda f: (-f[0], f[1][1] - f[1][2], _order(f[1]))):
        at = bisect_left(taken, (span[2], 0))
        # Base spans of different kinds may overlap each other: look back as far as ends may reach.
        if any(end > span[1] for _, end in taken[max(0, at - len(KINDS)) : at]):
            continue
        insort(taken, (span[1], span[2]))
        out.append(span)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_FOUND = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(docs: DataFrame, model: PiiModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, text, base, added: lists of (kind, start, end, score) by start, then kind.

    Places count code points, ``end`` is exclusive. The score of a base span is 1. A null text
    is an empty one and has no spans. Repeated rows and null ids are rows like others; other columns are not read.
    No shuffle; an empty table gives an empty result. A model without kinds adds nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text)
                base.append([(*span, 1.0) for span in own])
                starts = sorted((s, e) for _, s, e in own)
                open_ = [p for p in proposals(text) if p[0] in model.trees and not _covered(starts, p)]
                if open_:
                    scores = model.scores([p[0] for p in open_], np.array([features(text, p) for p in open_], dtype=float))
                    good = [(float(s), p) for s, p in zip(scores, open_) if s >= model.thresholds[p[0]]]
                    of = {p: s for s, p in good}
                    added.append([(*p, of[p]) for p in sorted(_added(own, good), key=_order)])
                else:
                    added.append([])
            listed = [pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans] for spans in each], pa.list_(_SPAN)) for each in (base, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *listed], ["doc_id", "text", "base", "added"])

    return rows.mapInArrow(run, f"doc_id bigint, text string, base {_FOUND}, added {_FOUND}")


def _covered(starts: list[tuple[int, int]], span: Span) -> bool:
    """Whether a span overlaps a base span."""
    at = bisect_left(starts, (span[2], 0))
    return any(end > span[1] for _, end in starts[max(0, at - len(KINDS)) : at])


def redacted(found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind; where spans overlap, the union is replaced by the first one's."""
    kinds = {kind: mark.format(kind.upper()) for kind in KINDS}

    @F.pandas_udf("string")
    def cut(text, base, added):
        out = []
        for value, *lists in zip(text, base, added):
            parts, at = [], 0
            for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for spans in lists for s in spans):
                if start >= at:
                    parts += (value[at:start], kinds[kind])
                at = max(at, end)
            out.append("".join([*parts, value[at:]]))
        return type(text)(out, dtype=object)

    return found.select("doc_id", cut("text", "base", "added").alias("text"))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of the kind), base_sha256, spans (all, joined as text), n_added."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    place = F.create_map(*(x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))))
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], place[s["kind"]].alias("at"), s["end"], s["kind"]))
    own = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(own, lambda k: k == F.lit(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(keyed)).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )
