"""WARC archives: a writer that stays on Spark's file sink, and a splittable reader.

Reader: a gzip member can only begin at the gzip magic, so the archive is read
through Spark's text source with the magic as the record delimiter. Each task
scans a byte range of a file (whatever the store), owns the candidates whose
magic lies in its range and reads the last one to its end. A candidate is a
record if its first inflated bytes are a WARC header; the magic may also
occur inside compressed data, so a member that has not ended yet goes on with the
next candidate, and so does a candidate that is too short to tell. If such a member
also crosses a range, its parts are joined by a second, small step (usually over no rows), each member by itself.

Writer: one gzip member per record, written with the text sink. The sink adds a
line separator after each row; the last byte of a member is the highest byte
of its uncompressed size, 0 below 16 MiB, so the separator is that byte. Larger
records are followed by an empty member, which ends with 0 as well.

File names: Spark inflates files that end in ``.gz`` itself, and one task each;
give archives another name (the writer's end in ``.txt``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"
MIN_REVISIT_BYTES = 0
CHUNK_BYTES = 8 << 20  # of an Arrow batch that goes back to Spark

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One uncompressed record. A revisit holds the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {RECORD_ID.format('' if refers_to is None else refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member_bytes(record: bytes) -> bytes:
    """A gzip member whose last byte is 0."""
    member = gzip.compress(record, compresslevel=5, mtime=0)
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row of (page_id, url, html) below ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the
    smallest page_id is a response, the others revisit it; null ids come last, and
    rows that repeat the response's id and payload are responses too. A null html is
    an empty payload; a null url has no target line. Other columns are not read.

    The smallest id per payload is aggregated before the shuffle. The join with it
    deals the rows by payload; Spark's adaptive skew join splits a payload that
    many pages share.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id"))
    firsts = rows.groupBy("sha").agg(first.getField("page_id").alias("first_id"))
    marked = rows.join(firsts, "sha").select(
        "page_id",
        "url",
        "payload",
        "first_id",
        ((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, first_id, revisit in zip(*(column.to_pylist() for column in batch.columns)):
                out.append(member_bytes(record_bytes(page_id, url, payload, first_id, revisit, date))[:-1])
                size += len(out[-1])
                if size > CHUNK_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["member"])

    # A cast keeps the bytes as they are.
    text = marked.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    text.write.option("lineSep", "\u0000").text(path)


# kind: record; tail: candidates, by number, of a member that goes on behind the range; head: what comes before the range's first record.
_PARSED = (
    "kind string, path string, start bigint, number bigint, record_type string, record_id string, refers_to string, url string, "
    "payload_bytes bigint, payload_digest string, payload binary, error string"
)
_ARROW = pa.schema(
    [(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (f.split() for f in _PARSED.split(", "))]
)


def parse_record(data: bytes, payloads: bool) -> dict:
    """The fields of one inflated record, checked against its lengths and digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = {
        "kind": "record",
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "refers_to": fields.get("warc-refers-to"),
        "url": fields.get("warc-target-uri"),
        "payload_digest": digest,
    }
    length = fields.get("content-length", "")
    if not gap or not length.isdigit() or len(rest) < int(length):
        return row | {"error": "the record is shorter than it says"}
    block = rest[: int(length)]
    if "application/http" not in fields.get("content-type", ""):
        return row | {"payload_bytes": len(block), "payload": block if payloads else None}
    http, _, payload = block.partition(b"\r\n\r\n")
    if row["record_type"] == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return row | {"payload_bytes": int(told[1]) if told else None}
    row |= {"payload_bytes": len(payload), "payload": payload if payloads else None}
    return row if digest in (None, payload_digest(payload)) else row | {"error": "the payload does not fit its digest"}


def _begins(data: bytes) -> bool | None:
    """Whether a candidate inflates to the beginning of a WARC record, or to nothing (an empty member).

    None if it is too short to tell: the first bytes of a member come only after its code tables.
    """
    inflater = zlib.decompressobj(31)
    try:
        first = inflater.decompress(data, 16)
    except zlib.error:
        return False
    if first.startswith(b"WARC/") or (not first and inflater.eof):
        return True
    return None if b"WARC/".startswith(first) and not inflater.eof else False


class _Member:
    """A member that is being inflated, candidate by candidate."""

    def __init__(self):
        self.inflater, self.out, self.raw = zlib.decompressobj(31), [], []

    def feed(self, data: bytes) -> bool:
        """Whether the member has ended. Raises zlib.error if the data can't belong to it."""
        self.out.append(self.inflater.decompress(data))
        self.raw.append(data)
        return self.inflater.eof


class _Chain:
    """Candidates in file order, joined to members.

    Gives ("begins", b""), ("record", all its bytes), ("broken", b"") and ("nothing", a candidate at which
    no record begins).
    """

    def __init__(self):
        self.member, self.held = None, []  # held: candidates that are too short to tell

    def add(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        coming = [data]
        while coming:
            data = coming.pop(0)
            if self.member is None:
                self.held.append(data)
                data = b"".join(self.held)
                if (begins := _begins(data)) is None:
                    continue
                first, *rest = self.held
                self.held = []
                if not begins:
                    coming = rest + coming
                    yield "nothing", first
                    continue
                self.member, first = _Member(), True
                yield "begins", b""
            else:
                first = False
            try:
                if self.member.feed(data):
                    whole, self.member = b"".join(self.member.out), None
                    if whole:
                        yield "record", whole
            except zlib.error:
                self.member = None
                yield "broken", b""
                if not first:  # it may begin a member of its own
                    coming.insert(0, data)

    def unfinished(self) -> list[bytes]:
        return [b"".join(self.member.raw)] if self.member is not None else self.held

    def finish(self) -> Iterator[tuple[str, bytes]]:
        """What is left when no more candidates come."""
        while self.unfinished():
            if self.member is not None:
                self.member = None
                yield "broken", b""
            else:
                first, *rest = self.held
                self.held = []
                yield "nothing", first
                for data in rest:
                    yield from self.add(data)


_ERRORS = {"broken": "the member is broken or has no end", "nothing": "no record begins here"}


def _record(event: str, data: bytes, payloads: bool) -> dict:
    return parse_record(data, payloads) if event == "record" else {"kind": "record", "error": _ERRORS[event]}


def _records(candidates: Iterable[tuple[str, int, bytes]], payloads: bool) -> Iterator[dict]:
    """Rows of the candidates (path, start of the range, bytes from the magic on), in file order."""
    here, chain, seen, heads = None, _Chain(), False, 0

    def unfinished():
        at = {"path": here[0], "start": here[1]} if here else {}
        for i, data in enumerate(chain.unfinished()):
            # Before the first record of a range, they may as well belong to a member of an earlier one.
            yield {"kind": "tail" if seen else "head", "number": i if seen else heads + i, "payload": data} | at

    for path, start, data in candidates:
        if (path, start) != here:
            yield from unfinished()
            here, chain, seen, heads = (path, start), _Chain(), False, 0
        at = {"path": path, "start": start}
        for event, found in chain.add(data):
            if event == "begins":
                seen = True
            elif event == "nothing" and not seen:
                yield {"kind": "head", "number": heads, "payload": found} | at
                heads += 1
            else:
                yield _record(event, found, payloads) | at
    yield from unfinished()


def _batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += 200 + len(row.get("payload") or b"")
        if size > CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(chunk, schema=_ARROW)
            chunk, size = [], 0
    yield pa.RecordBatch.from_pylist(chunk, schema=_ARROW)


def _by_member(parts: DataFrame) -> DataFrame:
    """Parts with ``member``: the range whose tail begins the member that a part may belong to, -1 without one.

    A tail belongs to its own range, heads to the latest range before theirs that has a tail. Only
    ranges are put in order per file (a row for each that has parts), not the bytes of parts.
    """
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        parts.groupBy("path", "start").agg(F.bool_or(F.col("kind") == "tail").alias("tailed"))
        .select("path", "start", F.max(F.when(F.col("tailed"), F.col("start"))).over(earlier).alias("earlier"))
    )
    member = F.when(F.col("kind") == "tail", F.col("start")).otherwise(F.coalesce("earlier", F.lit(-1)))
    return parts.join(ranges, ["path", "start"]).withColumn("member", member).drop("earlier")


def _joined(parts: pa.Table, payloads: bool) -> pa.Table:
    """The members of one file, or of one tail and its heads, that cross ranges. A range has at most one tail, after its heads."""
    rows, chain = [], _Chain()
    order = sorted(parts.to_pylist(), key=lambda r: (r["start"], r["kind"] == "tail", r["number"]))
    for part in [*order, None]:
        events = []
        if part is None or (part["kind"] == "tail" and part["number"] == 0):
            events += chain.finish()
        if part is not None:
            at = {"path": part["path"], "start": part["start"]}
            events += chain.add(part["payload"])
        rows += [_record(event, data, payloads) | at for event, data in events if event != "begins"]
    return pa.Table.from_pylist(rows, schema=_ARROW)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record below ``path``: record_type, record_id, refers_to, url,
    payload_bytes, payload_digest, payload (null unless asked for), path, error.

    What is broken or no record gives a row with an ``error``; empty members
    give none. The parsed rows are staged, so the archives are read once.
    """
    lines = (
        spark.read.option("lineSep", MAGIC.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("data"),
        )
    )

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def candidates():
            before = None
            for batch in batches:
                for path, start, data in zip(*(column.to_pylist() for column in batch.columns)):
                    # What a file has before its first magic comes as its first line.
                    preamble, before = start == 0 and before != path, path
                    if not preamble:
                        yield path, start, MAGIC + data

        return _batches(_records(candidates(), payloads))

    parsed = stage(lines.mapInArrow(parse, _PARSED), "warc-records")
    fields = ["record_type", "record_id", "refers_to", "url", "payload_bytes", "payload_digest", "payload", "path", "error"]
    parts = _by_member(parsed.where("kind <> 'record'"))
    crossing = parts.groupBy("path", "member").applyInArrow(lambda rows: _joined(rows, payloads), _PARSED)
    return parsed.where("kind = 'record'").union(crossing).select(*fields)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records written by ``write_warc``.

    A record with an error fails the job: its page would be missing.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1).try_cast("bigint")
    broken = F.raise_error(F.concat(F.lit("broken record in "), F.coalesce("path", F.lit("?")), F.lit(": "), "error"))
    return records.where(F.when(F.col("error").isNull(), True).otherwise(broken.cast("boolean"))).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), s AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
         min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)
         for i in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM s
"""
