"""Best-fit packing of tokenised documents into sequences (best-two-fit).

Documents of equal length are interchangeable, so the bins are worked out on
the histogram of lengths (one number per length, 2048 at most) and the
documents only look up their place:

1. Tasks tokenise the documents and number those of each length, per task.
2. The histogram goes to the driver, which fills bins greedily, longest first,
   and then exchanges a bin's smallest document for the two unpacked ones
   that fill its gap best. A bin that can be repeated is written down once, with
   the number of its repeats, so the plan stays as small as the histogram however
   many documents there are.
3. Each document finds its bin by length and number. Nothing is gathered by
   length: a length that a third of all documents share is spread like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .byte_bpe import END_ID, ByteBpe

CAPACITY = 2048
BATCH_ROWS = 1 << 16

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("part", pa.int32()), ("number", pa.int64())]
)


def cuts(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document, and its end: all full but perhaps the first."""
    first = length % capacity or capacity
    return [0, *range(first, length + 1, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number), staged: ``number``
    counts the pieces of one length within ``part``, the task that wrote them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = ByteBpe(tokenizer_path), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], dtype="<u4").tobytes()
        rows = []
        for batch in batches:
            texts = (value or "" for value in batch.column(1).to_pylist())
            for ident, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts)):
                ids += end
                bounds = cuts(len(ids) // 4, capacity)
                view = memoryview(ids)
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((ident, k, a, b - a, zlib.crc32(view[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    columns = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return stage(columns.mapInArrow(run, _PIECES), "pieces")


class _Lengths:
    """The unpacked documents: how many there are of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = [0] * (capacity + 1)
        for length, n in counts.items():
            self.count[length] = n
        self.present = sorted(length for length, n in counts.items() if n)

    def longest(self, limit: int) -> int:
        """The longest length of at most ``limit``, 0 if there is none."""
        i = bisect_right(self.present, limit)
        return self.present[i - 1] if i else 0

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.present.remove(length)

    def give(self, length: int) -> None:
        if not self.count[length]:
            self.present.insert(bisect_right(self.present, length), length)
        self.count[length] += 1

    def best_two(self, gap: int) -> tuple[int, int]:
        """Two documents, the sum of whose lengths comes closest to ``gap`` from below."""
        best, i, j = (0, 0), 0, bisect_right(self.present, gap) - 1
        while i <= j:
            a, b = self.present[i], self.present[j]
            if a + b > gap or (i == j and self.count[a] < 2):
                j -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
                if a + b == gap:
                    break
            i += 1
        return best


def _one_bin(left: _Lengths, capacity: int) -> list[int]:
    """The lengths of the next bin; they are taken from ``left``."""
    bin_, gap = [], capacity
    while length := left.longest(gap):
        n = min(left.count[length], gap // length)
        left.take(length, n)
        bin_ += [length] * n
        gap -= n * length
    # The smallest document makes room for two others, as long as that fills the bin better.
    while gap:
        smallest = min(bin_)
        two = left.best_two(gap + smallest)
        if sum(two) <= smallest:
            break
        for length in two:
            left.take(length, 1)
        left.give(smallest)
        bin_.remove(smallest)
        bin_ += two
        gap += smallest - sum(two)
    return bin_


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of one bin), for all documents of a histogram."""
    left, bins = _Lengths(counts, capacity), []
    while left.present:
        bin_ = _one_bin(left, capacity)
        # The same bin as often as there are documents for it.
        need = Counter(bin_)
        more = min(left.count[length] // n for length, n in need.items())
        for length, n in need.items():
            if more:
                left.take(length, n * more)
        bins.append((1 + more, bin_))
    return bins


def _places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first sequence, documents per bin, offset of the first of them)."""
    taken, rows, sequence = Counter(), [], 0
    for repeats, bin_ in bins:
        offset = 0
        for length, n in sorted(Counter(bin_).items(), reverse=True):
            rows.append((length, taken[length], taken[length] + n * repeats, sequence, n, offset))
            taken[length] += n * repeats
            offset += n * length
        sequence += repeats
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and an end token; only one longer than
    ``capacity`` is cut, into full pieces, of which the first may be shorter. A null
    text is an empty one (one end token). Rows that repeat an id are packed
    each for itself; null ids are kept. Other columns are not read. An empty table
    gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    pieces = token_pieces(docs, tokenizer_path, capacity, doc_id, text)
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(pack_lengths(histogram, capacity))
    plan = spark.createDataFrame(places, "length bigint, low bigint, high bigint, sequence bigint, per_bin bigint, at bigint")
    # Numbers per task become numbers of the whole table.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    shifts = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.join(shifts, ["part", "length"]).withColumn("number", F.col("number") + F.col("shift"))
    # A few rows per length, bounded by the capacity.
    inside = (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")) & (numbered["length"] == plan["length"])
    place = F.col("number") - F.col("low")
    return numbered.join(F.broadcast(plan), inside).select(
        "doc_id",
        "piece",
        "start",
        numbered["length"],
        "ids_crc32",
        (F.col("sequence") + F.floor(place / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + place % F.col("per_bin") * numbered["length"]).cast("bigint").alias("offset"),
    )
