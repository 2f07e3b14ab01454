"""Scoring rows against a goal and keeping the ones that reach a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.replies import unit_interval
from ..spec import DEFAULT_THRESHOLD

# Fixed value: rows per call of a scorer.
BATCH_SIZE = 15
# Fixed value: what a row without a judgement is told to be.
NOT_SCORED = "(not scored by the model)"
NO_FEATURES = "not scored: a feature is missing"
# Fixed value: example rows in a summary.
SUMMARY_EXAMPLES = 5

# A scorer takes the rows of one batch and returns (local index, score, reason)
# for the ones it judged.
Scorer = Callable[[list[dict]], Iterable[tuple[int, float, str]]]


def score_batches(df: DataFrame, scorer: Scorer, batch_size: int = BATCH_SIZE) -> DataFrame:
    """``df`` with ``score`` and ``reason``, judged by a caller-given function.

    Rows reach the scorer in slices of ``batch_size`` inside each partition;
    nothing is shuffled. A row the scorer leaves out keeps score 0.0, an index
    outside the batch is ignored, the last judgement of a row counts. An
    exception of the scorer fails the job.
    """

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        records = rows.to_pylist()
        scores, reasons = [0.0] * len(records), [NOT_SCORED] * len(records)
        for start in range(0, len(records), batch_size):
            batch = records[start : start + batch_size]
            for index, score, reason in scorer(batch):
                if 0 <= index < len(batch):
                    scores[start + index] = max(0.0, min(1.0, float(score)))
                    reasons[start + index] = (reason or "").strip()
        judged = rows.append_column("score", pa.array(scores, pa.float64()))
        yield from judged.append_column("reason", pa.array(reasons, pa.string())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Less than one batch of rows waits for the next Arrow batch.
        waiting: list[pa.RecordBatch] = []
        for arrived in batches:
            rows = pa.Table.from_batches([*waiting, arrived])
            full = rows.num_rows - rows.num_rows % batch_size
            if full:
                yield from judge(rows.slice(0, full))
            waiting = rows.slice(full).to_batches()
        if waiting:
            yield from judge(pa.Table.from_batches(waiting))

    # Arrow, not pandas: the row's own columns pass through untouched.
    added = [T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def score_weighted(df: DataFrame, weights: Sequence[tuple[Column, float]], reason: Column | None = None) -> DataFrame:
    """Strategy "scoring": a weighted sum of expressions, clamped to 0..1."""
    total = F.lit(0.0)
    for value, weight in weights:
        total = total + F.coalesce(value.cast("double"), F.lit(0.0)) * F.lit(float(weight))
    return df.withColumn("score", unit_interval(total)).withColumn("reason", reason if reason is not None else F.lit(""))


def score_rule(df: DataFrame, rule: str | Column) -> DataFrame:
    """Strategy "rule_based": 1.0 where the boolean expression holds, else 0.0."""
    condition = F.expr(rule) if isinstance(rule, str) else rule
    text = rule if isinstance(rule, str) else "rule"
    return df.withColumn("score", F.when(condition, 1.0).otherwise(0.0)).withColumn(
        "reason", F.when(condition, F.lit(f"matches {text}")).otherwise(F.lit(""))
    )


def score_cluster(
    df: DataFrame, features: str | Sequence[str], like: Column, clusters: int = 4, seed: int = 42, max_iter: int = 20
) -> DataFrame:
    """Strategy "clustering": 1.0 for the cluster that holds most rows ``like`` the segment.

    ``features`` is an array column or a list of numeric columns; ``like`` marks
    known members of the segment. Distances are compared in ``pyspark.ml``
    KMeans, which aggregates per partition; the driver sees the centres only.
    Rows that lack a feature (null or not finite) shape no cluster and get 0.0.
    """
    values = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    finite = F.coalesce(F.forall("_values", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    vectors = df.withColumn("_values", values).withColumn("_whole", finite & (F.size("_values") > 0)).withColumn(
        "_features", F.when(F.col("_whole"), array_to_vector("_values"))
    )
    whole = vectors.where("_whole")
    if whole.isEmpty():
        return df.withColumn("score", F.lit(0.0)).withColumn("reason", F.lit(NO_FEATURES))
    model = KMeans(k=clusters, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="_cluster").fit(whole)
    # Rows without features are placed like the first complete one; what comes of it is not used.
    stand_in = array_to_vector(F.array(*(F.lit(float(x)) for x in model.clusterCenters()[0])))
    placed = model.transform(vectors.withColumn("_features", F.coalesce("_features", stand_in)))
    # As many rows as clusters.
    segment = (
        placed.where("_whole").groupBy("_cluster")
        .agg(F.avg(F.when(like, 1.0).otherwise(0.0)).alias("share"))
        .orderBy(F.desc("share"), "_cluster")
        .first()
    )
    target = -1 if segment is None else segment["_cluster"]
    inside = F.col("_whole") & (F.col("_cluster") == target)
    return (
        placed.withColumn("score", F.when(inside, 1.0).otherwise(0.0))
        .withColumn("reason", F.when(F.col("_whole"), F.concat(F.lit("cluster "), F.col("_cluster").cast("string"))).otherwise(NO_FEATURES))
        .drop("_values", "_whole", "_features", "_cluster")
    )


def clamp(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, unit_interval(F.col(column).cast("double")))


def fill_missing(rows: DataFrame, scores: DataFrame, *key: str) -> DataFrame:
    """Every row with its score; the ones nobody judged get 0.0 and say so."""
    judged = scores.select(*key, "score", "reason", F.lit(True).alias("_judged"))
    joined = rows.join(judged, list(key), "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn(
        "reason", F.when(F.col("_judged"), F.coalesce("reason", F.lit(""))).otherwise(F.lit(NOT_SCORED))
    ).drop("_judged")


def select_rows(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Rows at or above the threshold."""
    return scored.where(F.col("score") >= threshold)


def top_examples(scored: DataFrame, threshold: float, *key: str) -> DataFrame:
    """The best selected rows, cut first and then only those with a reason."""
    best = select_rows(scored, threshold).orderBy(F.desc("score"), *key).limit(SUMMARY_EXAMPLES)
    return best.where(F.col("reason") != "")


def selection_counts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows_considered"),
        F.count_if(F.col("score") >= threshold).alias("rows_selected"),
    )


def selection_summary(scored: DataFrame, threshold: float, key: str) -> DataFrame:
    """One row: counts and the text of the summary with up to five examples.

    The wording of its lines is fixed.
    """
    head = selection_counts(scored, threshold).select(
        F.lit(0).alias("place"),
        F.lit(None).cast("double").alias("score"),
        F.format_string(
            f"Selected %d of %d rows considered (threshold {threshold:.2f}).",
            F.col("rows_selected"),
            F.col("rows_considered"),
        ).alias("line"),
        "rows_considered",
        "rows_selected",
        F.lit(None).cast(scored.schema[key].dataType).alias("k"),
    )
    examples = top_examples(scored, threshold, key).select(
        F.lit(1).alias("place"),
        "score",
        F.format_string("- row %s (score %.2f): %s", F.col(key).cast("string"), F.col("score"), F.col("reason")).alias("line"),
        F.lit(None).cast("bigint").alias("rows_considered"),
        F.lit(None).cast("bigint").alias("rows_selected"),
        F.col(key).alias("k"),
    )
    # Six rows at most meet here.
    lines = F.sort_array(F.collect_list(F.struct("place", (-F.col("score")).alias("s"), "k", "line")))
    return head.unionByName(examples).agg(
        F.max("rows_considered").alias("rows_considered"),
        F.max("rows_selected").alias("rows_selected"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"),
    )


def runnable_agents(agents: DataFrame) -> DataFrame:
    """Agents with a plan that are no drafts, and the rule each will apply."""
    rule = F.col("plan.selection_rule")
    return agents.where((F.col("status") != "draft") & F.col("plan").isNotNull()).withColumn(
        "rule_in_force", F.when(rule.isNotNull() & (rule != ""), rule).otherwise(F.col("goal"))
    )
