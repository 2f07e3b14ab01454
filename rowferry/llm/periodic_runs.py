"""Runs: maximal stretches of words that repeat with a period.

Every run of smallest period q contains, for one of the two orders of the symbols, a Lyndon word
of length q that is the longest one from its first place. So each place gives two
candidates: the distance to the next smaller suffix, by rank in a suffix tree read upwards
and downwards. A candidate is extended to the right by the longest common extension of its
two ends in the tree of the text, to the left in the tree of its reversal; both are
lowest common ancestors found in constant time. If it reaches two periods it is a run.

The trees are built per stretch that can hold a run at all. All words of a run stand in it
twice or more, so a word that occurs once in a stretch ends it there, and what is shorter than the
shortest run wanted drops out; that is repeated a few rounds, by counting, for a whole block of
documents. Prose falls to pieces at its rare words. Nothing is lost by it: what remains, however long, goes
through the trees as a whole.

One document is one row of one task; memory is about 1.2 KB per word of its longest stretch that remains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suffix_tree import SuffixTree

SHORTEST = 12  # words of a run
CUT_ROUNDS = 8
BLOCK_BYTES = 1 << 22  # of text that is split into words at a time
_WORDS = r"[\x20\x09-\x0D]+"


def _next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one the next one of a smaller rank; the empty suffix has the smallest."""
    order = ranks.tolist()
    size = len(order) - 1
    out, open_ = [0] * size, [size]
    for i in range(size - 1, -1, -1):
        rank = order[i]
        while order[open_[-1]] > rank:
            open_.pop()
        out[i] = open_[-1]
        open_.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(symbols: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) of all runs of at least ``shortest`` symbols, by start, then period."""
    size = len(symbols)
    if size < max(2, shortest):
        return np.empty((0, 3), dtype=np.int64)
    numbers = np.unique(symbols, return_inverse=True)[1].reshape(-1) + 1
    tree = SuffixTree(numbers)
    places = np.arange(size)
    periods = [_next_smaller(tree.ranks(descending)) - places for descending in (False, True)]
    places = np.concatenate([places, places[periods[0] != periods[1]]])
    period = np.concatenate([periods[0], periods[1][periods[0] != periods[1]]])
    room = 2 * period <= size
    place, period = places[room], period[room]
    right = tree.extensions(place, place + period)
    del tree
    left = SuffixTree(numbers[::-1]).extensions(size - place, size - place - period)
    length = left + period + right
    found = np.stack([place - left, length, period], axis=1)[length >= np.maximum(shortest, 2 * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(document: np.ndarray, word: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that can hold runs; ``document`` ascends."""
    place = np.arange(len(word))
    owner = document
    for _ in range(CUT_ROUNDS):
        if not len(place):
            break
        # Words of one stretch are neighbours of one document.
        new = np.ones(len(place), dtype=bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(owner) != 0)
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch) >= max(shortest, 2)
        _, key, times = np.unique(stretch * (int(word.max()) + 1) + word[place], return_inverse=True, return_counts=True)
        stay = long[stretch] & (times[key] > 1)
        if stay.all():
            break
        place, owner = place[stay], owner[stay]
    if not len(place):
        return []
    new = np.ones(len(place), dtype=bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(owner) != 0)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(place))
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(first, end) if b - a >= shortest]


def _block(texts: pa.Array, shortest: int) -> Iterator[tuple[int, list, str]]:
    """(words, runs, collapsed text) of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    # Blanks at the ends of a text leave empty words.
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, owner = words.filter(pa.array(filled)), owner[filled]
    counts = np.bincount(owner, minlength=len(lists))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    plain = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ").to_pylist()
    found: dict[int, list[tuple[int, int, int]]] = {}
    if len(words):
        number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        for first, end in stretches(owner, number, shortest):
            i = int(owner[first])
            moved = runs_of(number[first:end], shortest) + [first - offsets[i], 0, 0]
            found.setdefault(i, []).extend(map(tuple, moved.tolist()))
    for i, text in enumerate(plain):
        runs = sorted(found.get(i, ()), key=lambda r: (r[0], r[2]))
        if runs:
            marks = np.zeros(counts[i] + 1, dtype=np.int64)
            for start, length, period in runs:
                marks[start + period] += 1
                marks[start + length] -= 1
            kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0) + offsets[i]
            text = " ".join(words.take(pa.array(kept)).to_pylist())
        yield int(counts[i]), runs, text


_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_OUT_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``BLOCK_BYTES``; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield texts.slice(first, end - first)
        first = end


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, runs, collapsed.

    Words are what stands between blanks (space, tab, line breaks). ``runs`` lists (start, length, period), start
    counted in words from 0, by start, then period: all stretches with a smallest period q whose length
    is at least ``shortest`` and 2 q, and which no neighbouring word extends. ``collapsed`` is the text
    without the words that any run contains after its first q, joined by one space. A null
    text is an empty one: no words, no runs, an empty text. Repeated rows and null ids are rows like
    others; other columns are not read. No shuffle; an empty table gives an empty result.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(1)):
                counts, runs, collapsed = zip(*_block(texts, shortest))
                listed = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(counts, pa.int64()),
                    pa.array(listed, pa.list_(_OUT_RUN)),
                    pa.array(collapsed, pa.string()),
                ]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, collapsed string")


def with_repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), every tenth document (by the CRC of its id) with a periodic tail, made of its own words.

    With h = crc32(id), g = h / 10 and n words, from word a = g % n on the p = 1 + (n - a) / (3 + g % 8)
    words from there repeat up to the end. Rows without an id stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), _WORDS), lambda w: w != "")
    g, n = F.floor(h / 10).cast("int"), F.size(words)
    a = g % n
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col(text)).alias("text")
    )


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def run_digests(found: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` as doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without
    one) as start, length, period, exponent_milli, and the digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", longest)
    period = -F.col("best.p")
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        period.alias("period"),
        F.floor(F.col("best.l") * 1000 / period).cast("bigint").alias("exponent_milli"),
        _digest(listed).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
