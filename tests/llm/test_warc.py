from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from rowferry.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", None),
    (3, None, "<p>same</p>"),
    (4, "http://a/\r\nx: y", ""),
    (5, "http://a/5", "<p>é 日本</p>" * 50),
    (5, "http://a/5", "<p>é 日本</p>" * 50),
    (None, "http://a/6", "<p>same</p>"),
    (None, "http://a/7", "<p>no id</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, 1, 2, 3) for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, sha int, payload int, member int")


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def expected(rows, min_bytes=0):
    first: dict[bytes, int] = {}
    for ident, _, html in rows:
        payload = (html or "").encode()
        if ident is not None:
            first[payload] = min(ident, first.get(payload, ident))
    out = []
    for ident, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = len(payload) >= min_bytes and ident != first.get(payload)
        out.append((ident, len(payload), digest, "revisit" if revisit else "response", first.get(payload) if revisit else None))
    return sorted(out, key=key)


def round_trip(spark, pages, path, **options):
    warc.write_warc(pages, path, **options)
    return sorted((tuple(r) for r in warc.page_records(warc.read_warc(spark, path)).collect()), key=key)


def test_pages_come_back(spark, pages, tmp_path):
    assert round_trip(spark, pages, str(tmp_path / "w")) == expected(PAGES)


def test_small_payloads_may_be_responses(spark, pages, tmp_path):
    assert round_trip(spark, pages, str(tmp_path / "w"), min_bytes=12) == expected(PAGES, 12)


def test_no_pages(spark, pages, tmp_path):
    assert round_trip(spark, pages.limit(0), str(tmp_path / "w")) == []


def test_payloads_and_urls(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path).collect()
    assert all(r["error"] is None for r in records)
    payloads = {bytes(r["payload"]).decode() for r in records if r["record_type"] == "response"}
    assert payloads == {"<p>same</p>", "", "<p>é 日本</p>" * 50, "<p>no id</p>"}
    assert "http://a/%0D%0Ax:%20y" in {r["url"] for r in records}


def test_archives_are_plain_gzip(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)


def _archive(path, payloads, stored=False):
    with open(path, "wb") as out:
        for i, payload in enumerate(payloads):
            record = warc.record_bytes(i, f"http://a/{i}", payload, None, False, "2024-01-01T00:00:00Z")
            out.write(gzip.compress(record, 0 if stored else 6, mtime=0))


@pytest.mark.parametrize("split", [700, 4096, 1 << 20])
def test_byte_ranges_and_false_magic(spark, tmp_path, split):
    # Stored members carry the magic and whole gzip members inside their payload, across any range.
    random.seed(split)
    inner = gzip.compress(b"WARC-like text, but no record", mtime=0)
    payloads = [
        bytes(random.randrange(256) for _ in range(random.randrange(1500))) + warc.MAGIC * random.randrange(3) + inner * random.randrange(3)
        for _ in range(60)
    ]
    folder = tmp_path / "w"
    folder.mkdir()
    _archive(folder / "one.warc", payloads, stored=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        records = warc.read_warc(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(bytes(r["payload"]) for r in records if r["error"] is None) == sorted(payloads)
    assert not [r["error"] for r in records if r["error"]]


def _cut(archive, starts, random_, chance):
    """Candidates as a chance magic would cut them, dealt to ranges that begin anywhere."""
    cuts = sorted({*starts, *(s + random_.randrange(1, 140) for s in starts if random_.random() < chance), len(archive)})
    cuts = [c for c in cuts if c <= len(archive)]
    out, start = [], 0
    for a, b in zip(cuts, cuts[1:]):
        start = a if random_.random() < 0.4 else start
        out.append(("f", start, archive[a:b]))
    return out


@pytest.mark.parametrize("chance", [0.3, 1.0])
def test_magic_before_the_header_is_told(chance):
    # The first bytes of a compressed member come only after its code tables: a magic in there cuts before it can be told.
    random_ = random.Random(int(chance * 10))
    payloads = [" ".join(random_.choices(["one", "two", "three", "é", "<p>"], k=random_.randrange(60))).encode() for _ in range(80)]
    archive, starts = b"", []
    for i, payload in enumerate(payloads):
        starts.append(len(archive))
        archive += warc.member_bytes(warc.record_bytes(i, "u", payload, None, False, "2024-01-01T00:00:00Z"))
    for _ in range(30):
        rows = list(warc._records(_cut(archive, starts, random_, chance), True))
        parts = pa.Table.from_pylist([r for r in rows if r["kind"] != "record"], schema=warc._ARROW)
        found = [r for r in rows if r["kind"] == "record"] + warc._joined(parts, True).to_pylist()
        assert [r["error"] for r in found if r.get("error")] == []
        assert sorted(r["payload"] for r in found) == sorted(payloads)


def test_parts_of_each_member_are_joined_apart(spark):
    random_ = random.Random(5)
    members, parts = [], []
    for file in ("f", "g"):
        archive, starts = b"", []
        for i in range(60):
            payload = bytes(random_.randrange(256) for _ in range(random_.randrange(400))) + warc.MAGIC * 3
            starts.append(len(archive))
            archive += warc.member_bytes(warc.record_bytes(i, "u", payload, None, False, "2024-01-01T00:00:00Z"))
        cut = [(file, start, data) for _, start, data in _cut(archive, starts, random_, 0.8)]
        parts += [r for r in warc._records(cut, True) if r["kind"] != "record"]
    table = pa.Table.from_pylist(parts, schema=warc._ARROW)
    dealt = warc._by_member(spark.createDataFrame(table.to_pandas(), warc._PARSED).repartition(7)).toPandas()
    assert len(dealt) == len(parts)
    for _, rows in dealt.groupby(["path", "member"]):
        # Groups are small: one tail at most, and the heads up to the next one.
        assert rows[rows.kind == "tail"].start.nunique() <= 1
        members += warc._joined(pa.Table.from_pandas(rows[[f.name for f in warc._ARROW]], schema=warc._ARROW, preserve_index=False), True).to_pylist()
    whole = [r for file in ("f", "g") for r in warc._joined(table.filter(pa.compute.equal(table["path"], file)), True).to_pylist()]
    key = lambda r: (r["path"], r["start"], r["record_id"] or "", r["error"] or "")
    assert len(whole) > 20 and sorted(members, key=key) == sorted(whole, key=key)


def test_a_member_with_the_magic_in_its_head(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    _archive(folder / "one.warc", [b"one" * 100, b"two" * 100])
    data = (folder / "one.warc").read_bytes()
    # The name of a file stands before the compressed data (flag 8).
    named = data[:3] + b"\x08" + data[4:10] + b"name" + warc.MAGIC + b"name\0" + data[10:]
    (folder / "one.warc").write_bytes(named)
    records = warc.read_warc(spark, str(folder)).collect()
    assert [r["error"] for r in records] == [None, None]
    assert sorted(r["page_id"] for r in warc.page_records(warc.read_warc(spark, str(folder))).collect()) == [0, 1]


def test_pages_of_broken_members_fail(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    _archive(folder / "a.warc", [b"one" * 100, b"two" * 100])
    (folder / "a.warc").write_bytes((folder / "a.warc").read_bytes()[:-20])
    with pytest.raises(Exception, match="broken record in"):
        warc.page_records(warc.read_warc(spark, str(folder))).count()


def test_broken_members_are_reported(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    _archive(folder / "a.warc", [b"one" * 100, b"two" * 100])
    data = (folder / "a.warc").read_bytes()
    (folder / "b.warc").write_bytes(b"junk before" + data[:-20])
    records = warc.read_warc(spark, str(folder)).collect()
    assert sum(r["error"] is None for r in records) == 3 and sum(r["error"] is not None for r in records) == 1


def test_large_members_end_with_zero():
    assert warc.member_bytes(bytes(17 << 20))[-1] == 0
    assert gzip.decompress(warc.member_bytes(b"x" * (17 << 20))) == b"x" * (17 << 20)


def test_a_payload_of_a_third_of_all_pages(spark, tmp_path):
    df = spark.range(900).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("html"),
    )
    found = round_trip(spark, df, str(tmp_path / "w"))
    assert sum(r[3] == "revisit" for r in found) == 299 and {r[4] for r in found if r[3] == "revisit"} == {0}
