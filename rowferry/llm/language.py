"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted on
labelled documents and then frozen. The code length of a byte is that of the longest
known context that has seen it; on the way there each context that has not costs an escape
(method C: of n occurrences with d distinct followers a follower seen c times has c / (n + d),
the escape d / (n + d)). Behind the empty context all 256 bytes are equally likely. The language
with the shortest code of the whole text wins.

With frozen counts the cost of a byte depends on the ``ORDER`` bytes before it only, so a text
is a sequence of windows of ``ORDER + 1`` bytes; the costs of windows are worked out for
many at a time and remembered, in double precision, in a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = 4
UNKNOWN = "und"
SAMPLE_DOCS = 400  # per language: the bound of the training sample
SAMPLE_BYTES = 1 << 16  # a longer document is not taken into the sample
SAMPLE_TOTAL = 1 << 28  # bytes of all languages together
LOOKED_AT = 3 * SAMPLE_DOCS  # per language: about so many rows with small hashes are looked at first
TABLE_COSTS = 1 << 22  # remembered costs, of all languages together
BLOCK_BYTES = 1 << 21
WINDOWS_AT_ONCE = 1 << 16  # looked up together: temporary arrays are a few times this size
_MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(text: bytes, order: int = ORDER) -> np.ndarray:
    """One number per byte: the byte (lowest) and the ``order`` bytes before it; before the text there are zeros."""
    data = np.frombuffer(bytes(order) + text, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k : k + len(text)]
    return out


@dataclass
class _Level:
    """Of one context length: costs in bits of known (context, byte) pairs, and of the escape of known contexts."""

    pairs: np.ndarray
    pair_bits: np.ndarray
    contexts: np.ndarray
    escape_bits: np.ndarray


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of the wanted keys in sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class ContextTree:
    """The frozen statistics of one language."""

    def __init__(self, texts: Iterable[bytes], order: int = ORDER):
        every = [windows(text, order) for text in texts]
        seen, counts = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        self.levels = []
        for length in range(order, -1, -1):
            mask = np.uint64((1 << (8 * (length + 1))) - 1)
            pairs, where = np.unique(seen & mask, return_inverse=True)
            times = np.bincount(where, weights=counts, minlength=len(pairs))
            contexts, of = np.unique(pairs >> np.uint64(8), return_inverse=True)
            total = np.bincount(of, weights=times, minlength=len(contexts))
            distinct = np.bincount(of, minlength=len(contexts))
            self.levels.append(
                _Level(pairs, -np.log2(times / (total + distinct)[of]), contexts, -np.log2(distinct / (total + distinct)))
            )

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each window's last byte."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for length, level in zip(range(len(self.levels) - 1, -1, -1), self.levels):
            mask = np.uint64((1 << (8 * (length + 1))) - 1)
            pair = keys[open_] & mask
            place, found = _lookup(level.pairs, pair)
            out[open_[found]] += level.pair_bits[place[found]]
            open_, pair = open_[~found], pair[~found]
            place, known = _lookup(level.contexts, pair >> np.uint64(8))
            out[open_[known]] += level.escape_bits[place[known]]
        out[open_] += 8.0
        return out


class LanguageModel:
    """Trees of all languages, and the table of remembered windows."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.languages = order, sorted(samples)
        self.trees = [ContextTree(samples[language], order) for language in self.languages]
        self._keys = None

    def __getstate__(self):
        return self.__dict__ | {"_keys": None, "_costs": None}

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([tree.bits(keys) for tree in self.trees], axis=1)

    def window_costs(self, keys: np.ndarray) -> np.ndarray:
        """(windows, languages): bits."""
        if self._keys is None:
            # As many slots as keep the table at its size, a power of two.
            table_bits = max(TABLE_COSTS // len(self.languages), 2).bit_length() - 1
            self._shift = np.uint64(64 - table_bits)
            # No window of a text is all ones: its last byte would not be UTF-8.
            self._keys = np.full(1 << table_bits, ~np.uint64(0))
            self._costs = np.zeros((1 << table_bits, len(self.languages)))
        costs = np.empty((len(keys), len(self.languages)))
        for at in range(0, len(keys), WINDOWS_AT_ONCE):
            self._look_up(keys[at : at + WINDOWS_AT_ONCE], costs[at : at + WINDOWS_AT_ONCE])
        return costs

    def _look_up(self, keys: np.ndarray, costs: np.ndarray) -> None:
        """Fills in ``costs`` from the table; windows that are not in it are worked out and remembered."""
        slot = ((keys * _MIX) >> self._shift).astype(np.int64)
        hit = self._keys[slot] == keys
        np.take(self._costs, slot, axis=0, out=costs)
        if not hit.all():
            missing, where = np.unique(keys[~hit], return_inverse=True)
            bits = self._bits(missing)
            costs[~hit] = bits[where]
            place = ((missing * _MIX) >> self._shift).astype(np.int64)
            self._keys[place], self._costs[place] = missing, bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each whole text. Sums are in double precision."""
        total = np.zeros((len(texts), len(self.languages)))
        block, owner, size = [], [], 0

        def flush():
            nonlocal block, owner, size
            if block:
                costs = self.window_costs(np.concatenate(block))
                starts = np.cumsum([0, *map(len, block[:-1])])
                np.add.at(total, owner, np.add.reduceat(costs, starts, axis=0))
            block, owner, size = [], [], 0

        for i, text in enumerate(texts):
            for at in range(0, len(text), BLOCK_BYTES):
                lead = text[max(0, at - self.order) : at]
                block.append(windows(lead + text[at : at + BLOCK_BYTES], self.order)[len(lead) :])
                owner.append(i)
                size += len(block[-1])
                if size >= BLOCK_BYTES:
                    flush()
        flush()
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language with the shortest code (of equal ones the first by name), and its posterior
        probability if all languages are equally likely beforehand."""
        bits = self.code_lengths(texts)
        if not len(texts):
            return [], []
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return [self.languages[i] for i in best], (1 / odds).tolist()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of the training; false for a null id, which is not trained on either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(rows: DataFrame, labelled: dict[str, int]) -> dict[str, list[int]]:
    """Ids of the sample per language, those with the smallest hashes first.

    Tasks first leave out what lies above a hash below which some ``LOOKED_AT`` of a language's rows are
    expected, so few rows of a language meet. Where too few of them are usable, that language is looked at
    again with a higher hash, in the end with all its rows; what is chosen does not depend on it.
    """
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen: dict[str, list[int]] = {}
    wanted, open_ = LOOKED_AT, labelled
    while open_:
        highest = {name: min((1 << 63) - 1, (wanted << 64) // n - (1 << 63)) for name, n in open_.items()}
        entries = [F.lit(value) for entry in highest.items() for value in entry]
        few = (
            rows.withColumn("hash", F.xxhash64("doc_id"))
            .where(F.col("hash") <= F.element_at(F.create_map(*entries), F.col("lang")))
            # Of a repeated id one row is left, before the shuffle.
            .groupBy("lang", "hash", "doc_id").agg(F.max(F.octet_length("text")).alias("size"))
            .withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= SAMPLE_DOCS)
        )
        found: dict[str, list[tuple[int, int, int]]] = {name: [] for name in open_}
        for row in few.select("lang", "n", "doc_id", "size").collect():
            found[row["lang"]].append((row["n"], row["doc_id"], row["size"]))
        for name, places in found.items():
            budget = SAMPLE_TOTAL // len(labelled)
            chosen[name] = []
            for _, doc_id, size in sorted(places):
                budget -= size
                if chosen[name] and budget < 0:
                    break
                chosen[name].append(doc_id)
        open_ = {n: open_[n] for n in open_ if len(found[n]) < SAMPLE_DOCS and highest[n] < (1 << 63) - 1}
        wanted *= 16
    return chosen


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER) -> LanguageModel:
    """The model of the labelled documents that are not held out.

    A sample of ``SAMPLE_DOCS`` documents per language (those with the smallest hash of the id) of at
    most ``SAMPLE_BYTES`` each goes to the driver, of many languages fewer, so that all together have
    ``SAMPLE_TOTAL`` bytes (but one document per language); that bounds the model, whatever the table's
    size. Texts without a letter are not trained on. Without labels there are no languages.
    """
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    rows = labelled.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"\p{L}"))
    # Ids first: only the chosen texts leave their partitions. The counts read no texts.
    counts = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    ids = sorted({doc_id for of_language in _sampled(rows, counts).values() for doc_id in of_language})
    samples: dict[str, list[bytes]] = {}
    # One row per id, however often the table repeats it.
    once = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    for (row,) in once.orderBy("doc_id").select("row").collect() if ids else []:
        samples.setdefault(row["lang"], []).append(row["text"].encode())
    return LanguageModel(samples, order)


_OUT = "doc_id bigint, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score. Only the text decides.

    A text that is null, empty or has no letter is ``und`` with score 0, and so is every text
    if the model has no language. Other columns are not read. No shuffle; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
        F.when(lettered, F.col(text).cast("binary")).alias("text"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [i for i, value in enumerate(texts) if value is not None] if model.languages else []
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, name, score in zip(known, *model.predict([texts[i] for i in known])):
                names[i], scores[i] = name, score
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, _OUT)


MIN_SCORE = 0.5


def accepted(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose language is told, all columns as they are.

    Rejected: texts without a letter, and those for which no language is more likely than all
    others together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts):
        model = shared.value
        if not model.languages:
            return texts.isna() & False
        known = texts.notna()
        _, scores = model.predict([value.encode() for value in texts[known]])
        out = known.copy()
        out[known] = np.array(scores) >= MIN_SCORE
        return out

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.where(told(F.when(lettered, F.col(text))))
