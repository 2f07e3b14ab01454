"""Gradient boosting of small trees for a yes-or-no question, on a table of features in memory or a table of Spark's.

Features are cut into at most ``BINS`` bins at quantiles; each tree is grown level by level on
histograms of first and second derivatives of the logistic loss. All trees have the same depth, so a whole
ensemble is three arrays and many rows are scored at once.

Of a table of Spark's (``fit_table``) only such sums leave the tasks: counts of values for the quantiles, and one histogram per
task and level. Derivatives are summed as whole numbers, so a model does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

BINS = 32
VALUES = 1 << 16  # features of a table are whole numbers below
UNIT = 1 << 20  # derivatives are counted in parts of it
KEPT = 10  # trees, after which the totals of all rows are written down


@dataclass(frozen=True)
class BoostedTrees:
    """Node i of a tree has the children 2i+1 (value <= cut) and 2i+2; the last level are the leaves."""

    prior: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # the same shape
    leaf: np.ndarray  # (trees, 2**depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of "yes" per row."""
        return 1 / (1 + np.exp(-self.totals(x)))

    def totals(self, x: np.ndarray) -> np.ndarray:
        """Its log odds."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            total += self.leaf[t][node - inner]
        return total


def _splits(left: list[np.ndarray], weight: float, cuts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(node, feature, bin) of the nodes worth a split, from sums of both derivatives (node, feature, up to a bin)."""
    all_g, all_h = left[0][:, :, -1:], left[1][:, :, -1:]
    right = [all_g - left[0], all_h - left[1]]
    gain = left[0] ** 2 / (left[1] + weight) + right[0] ** 2 / (right[1] + weight) - all_g**2 / (all_h + weight)
    for i, b in enumerate(gain.reshape(len(gain), -1).argmax(axis=1)):
        f, at = divmod(int(b), BINS)
        if gain[i, f, at] > 1e-9 and at < len(cuts[f]):
            yield i, f, at


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, weight: float = 1.0) -> BoostedTrees:
    """``x`` (rows, features), ``y`` 0 or 1. ``weight`` is the L2 penalty of leaves. Deterministic."""
    rows, columns = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(columns)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(columns)], axis=1)  # value <= cuts[b]: bin <= b
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    total = np.full(rows, prior)
    inner = (1 << depth) - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    places = binned + np.arange(columns) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = (places + (node - first)[:, None] * (columns * BINS)).ravel()
            size = width * columns * BINS
            left = [
                np.bincount(key, np.repeat(v, columns), size).reshape(width, columns, BINS).cumsum(axis=2) for v in (g, h)
            ]
            for i, f, at in _splits(left, weight, cuts):
                feature[t, first + i], cut[t, first + i] = f, cuts[f][at]
            node = 2 * node + 1 + (x[np.arange(rows), feature[t][node]] > cut[t][node])
        sums = [np.bincount(node - inner, v, inner + 1) for v in (g, h)]
        leaf[t] = -rate * sums[0] / (sums[1] + weight)
        total += leaf[t][node - inner]
    return BoostedTrees(prior, feature, cut, leaf)


# ---- on a table ----


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _per_model(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    models = batch.column("model").to_numpy()
    for model in np.unique(models):
        yield int(model), batch.filter(pa.array(models == model))


def _quantiles(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Per model the cuts of each feature, exactly those of all rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, mine in _per_model(batch):
                x = _matrix(mine.column("features"), "<u2").astype(np.int64)
                columns = x.shape[1]
                found, place = np.unique(x + np.arange(columns) * VALUES, return_inverse=True)
                n = np.bincount(place.ravel(), np.repeat(mine.column("n").to_numpy(), columns), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(found), pa.int32()), pa.array(found), pa.array(n)], ["model", "place", "n"])

    counts = rows.mapInArrow(count, "model int, place bigint, n bigint").groupBy("model", "place").agg(F.sum("n").alias("n"))
    model, place, n = (column.to_numpy() for column in counts.orderBy("model", "place").toArrow().columns)
    out: dict[int, list[np.ndarray]] = {}
    for m in np.unique(model):
        mine, of = place[model == m], n[model == m]
        feature = mine // VALUES
        out[int(m)] = []
        for f in range(int(feature.max()) + 1):
            upto = np.cumsum(of[feature == f])
            ranks = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1))
            out[int(m)].append(np.unique(mine[feature == f][np.searchsorted(upto, ranks, side="right")] % VALUES).astype(float))
    return out


def _binned(rows: DataFrame, cuts: dict[int, list[np.ndarray]], priors: dict[int, float]) -> DataFrame:
    """Rows by the bins of their features; equal ones are one row with their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, mine in _per_model(batch):
                if model not in priors:
                    continue
                x = _matrix(mine.column("features"), "<u2")
                bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts[model])], axis=1).astype(np.uint8)
                packed = pa.array([row.tobytes() for row in bins], pa.binary())
                yield pa.RecordBatch.from_arrays([mine.column("model"), mine.column("label"), mine.column("n"), packed], ["model", "label", "n", "bins"])

    binned = rows.select("model", "label", "n", "features").mapInArrow(run, "model int, label boolean, n bigint, bins binary")
    prior = F.element_at(F.create_map(*(F.lit(x) for pair in priors.items() for x in pair)), F.col("model"))
    return stage(binned.groupBy("model", "label", "bins").agg(F.sum("n").alias("n")).withColumn("total", prior), "bins")


@dataclass
class _Growing:
    """The trees so far with cuts by bin, the last one up to some level."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def nodes(self, t: int, levels: int, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            node = 2 * node + 1 + (bins[rows, self.feature[t][node]] > self.cut[t][node])
        return node

    def added(self, first: int, end: int, bins: np.ndarray) -> np.ndarray:
        inner, depth = self.feature.shape[1], self.leaf.shape[1].bit_length() - 1
        return sum((self.leaf[t][self.nodes(t, depth, bins) - inner] for t in range(first, end)), np.zeros(len(bins)))


def _histograms(rows: DataFrame, models: dict[int, _Growing], written: int, t: int, level: int, columns: int) -> dict[int, np.ndarray]:
    """Per model the sums of both derivatives (2, nodes of the level, features, bins)."""
    first, width = (1 << level) - 1, 1 << level
    size = width * columns * BINS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {model: np.zeros((2, size)) for model in models}
        for batch in batches:
            for model, mine in _per_model(batch):
                bins = _matrix(mine.column("bins"), "u1")
                y = np.asarray(mine.column("label").to_pylist(), dtype=float)
                n = mine.column("n").to_numpy()
                p = 1 / (1 + np.exp(-(mine.column("total").to_numpy() + models[model].added(written, t, bins))))
                node = models[model].nodes(t, level, bins)
                key = (bins + np.arange(columns) * BINS + (node - first)[:, None] * (columns * BINS)).ravel()
                for i, v in enumerate((p - y, p * (1 - p))):
                    sums[model][i] += np.bincount(key, np.repeat(np.rint(v * UNIT) * n, columns), size)
        names, values = list(sums), [v.tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(values, pa.binary())], ["model", "sums"])

    out = {model: np.zeros((2, width, columns, BINS)) for model in models}
    for model, sums in rows.mapInArrow(run, "model int, sums binary").collect():
        out[model] += np.frombuffer(sums).reshape(2, width, columns, BINS)
    return {model: sums / UNIT for model, sums in out.items()}


def _written_down(rows: DataFrame, models: dict[int, _Growing], first: int, end: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, mine in _per_model(batch):
                total = mine.column("total").to_numpy() + models[model].added(first, end, _matrix(mine.column("bins"), "u1"))
                yield mine.set_column(mine.schema.get_field_index("total"), "total", pa.array(total))

    return stage(rows.mapInArrow(run, rows.schema), "totals")


def fit_table(rows: DataFrame, trees: int = 60, depth: int = 3, rate: float = 0.2, weight: float = 1.0) -> dict[int, BoostedTrees]:
    """One ensemble per ``model`` from all rows (model int, label boolean, n bigint, features binary): ``n`` equal rows with
    little-endian unsigned 16-bit features. A model without both labels is left out. ``rows`` is read twice."""
    priors = {}
    known = rows.groupBy("model").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("yes"))
    for model, n, yes in sorted(known.collect()):
        if 0 < yes < n:
            share = float(np.clip(yes / n, 1e-3, 1 - 1e-3))
            priors[model] = float(np.log(share / (1 - share)))
    if not priors:
        return {}
    cuts = _quantiles(rows)
    columns = len(next(iter(cuts.values())))
    table, inner, written = _binned(rows, cuts, priors), (1 << depth) - 1, 0
    models = {m: _Growing(np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS), np.zeros((trees, inner + 1))) for m in priors}
    for t in range(trees):
        if t - written == KEPT:
            table, written = _written_down(table, models, written, t), t
        for level in range(depth):
            for model, sums in _histograms(table, models, written, t, level, columns).items():
                growing, left, first = models[model], [*sums.cumsum(axis=3)], (1 << level) - 1
                for i, f, at in _splits(left, weight, cuts[model]):
                    growing.feature[t, first + i], growing.cut[t, first + i] = f, at
                if level == depth - 1:
                    for i in range(1 << level):
                        f, at = growing.feature[t, first + i], min(growing.cut[t, first + i], BINS - 1)
                        (low_g, all_g), (low_h, all_h) = ((v[i, f, at], v[i, f, -1]) for v in left)
                        growing.leaf[t, 2 * i] = -rate * low_g / (low_h + weight)
                        growing.leaf[t, 2 * i + 1] = -rate * (all_g - low_g) / (all_h - low_h + weight)
    out = {}
    for model, growing in models.items():
        ends = [np.append(c, np.full(BINS + 1 - len(c), np.inf)) for c in cuts[model]]
        cut = np.array([[ends[f][b] for f, b in zip(*tree)] for tree in zip(growing.feature, growing.cut)])
        out[model] = BoostedTrees(priors[model], growing.feature, cut, growing.leaf)
    return out
