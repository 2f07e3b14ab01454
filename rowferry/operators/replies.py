"""Tables of model and server replies to tables of checked values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions.text import strip
from ..spec import STRATEGIES
from .selection import BATCH_SIZE, NOT_SCORED

# Error codes of a Bitrix24 body that mean "no such entity or method".
NOT_FOUND_CODES = ("ERROR_METHOD_NOT_FOUND", "NOT_FOUND")


def parse_scores(replies: DataFrame, reply: str = "reply", batch_len: str | None = None) -> DataFrame:
    """One row per row of each batch: (…, row_index, score, reason).

    ``batch_len`` names the column with the number of rows in the batch
    (default 15 for all). Everything happens inside the row of the reply, as
    array functions over at most one batch; there is no shuffle. An item
    counts if it is an object with a numeric index inside the batch and a
    score that is a number or absent; the last item of an index wins; rows
    without an item get 0.0.
    """
    length = F.col(batch_len).cast("int") if batch_len else F.lit(BATCH_SIZE)
    names = ("index", "score", "reason")
    found = R.objects(R.decode(F.col(reply)), "$.scores", *names)
    looked_at = F.transform(found, lambda x: F.struct(*[R.opened(x[n]).alias(n) for n in names]))

    def judge(x: Column) -> Column:
        score = F.when(x["score"]["k"].isNull(), F.lit(0.0)).otherwise(R.as_real(x["score"]))
        return F.struct(R.as_integer(x["index"]).alias("i"), score.alias("s"), x["reason"].alias("r"))

    judged = F.filter(F.transform(looked_at, judge), lambda x: x["i"].isNotNull() & x["s"].isNotNull())

    def last(items: Column, i: Column) -> Column:
        # The items are the last ones first; place 0 of an index that is not there gives null.
        at = F.array_position(items["index"], i.cast("bigint")) - 1
        return F.struct(i.alias("i"), F.get(items["item"], at.cast("int")).alias("item"))

    def place(x: Column) -> Column:
        scored = x["item"].isNotNull()
        return F.struct(
            x["i"].alias("row_index"),
            F.when(scored, R.unit_interval(x["item"]["s"])).otherwise(F.lit(0.0)).alias("score"),
            F.when(scored, R.as_words(x["item"]["r"])).otherwise(F.lit(NOT_SCORED)).alias("reason"),
        )

    # An empty batch has no rows; sequence(0, -1) would count down.
    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    # The one-element arrays make the judged items, and then their indices, lambda variables:
    # worked out once per reply, not once per row of the batch.
    looked_up = F.transform(
        F.array(F.reverse(judged)), lambda items: F.struct(F.transform(items, lambda x: x["i"]).alias("index"), items.alias("item"))
    )
    rows = F.transform(looked_up, lambda items: F.transform(F.transform(places, lambda i: last(items, i)), place))
    # The outer form of inline keeps Catalyst from deriving a "not empty" filter,
    # which would parse every reply a second time.
    return (
        replies.withColumn("_rows", F.get(rows, 0))
        .drop(reply)
        .select("*", F.inline_outer("_rows"))
        .drop("_rows")
        .where(F.col("row_index").isNotNull())
    )


def parse_plan(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(…, strategy, reasoning, selection_rule, recommended_threshold, next_actions, error).

    A reply that cannot be used has its reason in ``error`` and nulls beside it.
    """
    names = ("strategy", "reasoning", "selection_rule", "recommended_threshold", "next_actions")
    keep = [c for c in replies.columns if c != reply]
    parsed = (
        replies.withColumn("_v", R.decode(F.col(reply)))
        .select(*keep, F.col("_v").isNotNull().alias("_json"), R.members(F.col("_v"), *names).alias("_o"))
        .select(*keep, "_json", F.col("_o").isNotNull().alias("_object"), *[R.opened(F.col("_o")[n]).alias(f"_{n}") for n in names])
        .select(
            *keep,
            "_json",
            "_object",
            R.text_only(F.col("_strategy")).alias("_strategy"),
            R.as_words(F.col("_reasoning")).alias("_reasoning"),
            R.as_words(F.col("_selection_rule")).alias("_rule"),
            F.when(~R.missing(F.col("_recommended_threshold")), R.as_real(F.col("_recommended_threshold"))).alias("_threshold"),
            F.transform(R.elements(F.col("_next_actions")["v"]), R.opened).alias("_actions"),
        )
        .withColumn("_actions", F.filter(F.transform("_actions", R.as_text), lambda t: strip(t) != ""))
        .withColumn(
            "error",
            F.when(~F.col("_json"), "not valid JSON")
            .when(~F.col("_object"), "not a JSON object")
            .when((F.col("_reasoning") == "") | (F.col("_rule") == ""), "missing reasoning or selection rule"),
        )
    )
    out = {
        "strategy": F.when(F.col("_strategy").isin(*STRATEGIES), F.col("_strategy")).otherwise(F.lit("scoring")),
        "reasoning": F.col("_reasoning"),
        "selection_rule": F.col("_rule"),
        "recommended_threshold": F.when(F.col("_threshold").isNotNull(), R.unit_interval(F.col("_threshold"))),
        "next_actions": F.col("_actions"),
    }
    usable = F.col("error").isNull()
    return parsed.select(*keep, *[F.when(usable, c).alias(n) for n, c in out.items()], "error")


def parse_pairs(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(…, pos, source_field, destination_field, confidence), one row per proposed pair.

    Names must be text. Confidence is 0.5 if absent or no number, else
    clamped to 0..1.
    """
    names = ("source_field", "destination_field", "confidence")
    keep = [c for c in replies.columns if c != reply]
    found = R.objects(R.decode(F.col(reply)), "$.pairs", *names)
    # Outer: no filter is derived that would parse the reply again.
    items = replies.select(*keep, F.posexplode_outer(found).alias("pos", "_p")).where(F.col("_p").isNotNull())
    looked_at = items.select(*keep, "pos", *[R.opened(F.col("_p")[n]).alias(n) for n in names])
    confidence = F.coalesce(R.as_real(F.col("confidence")), F.lit(0.5))
    return looked_at.select(
        *keep,
        "pos",
        R.text_only(F.col("source_field")).alias("source_field"),
        R.text_only(F.col("destination_field")).alias("destination_field"),
        R.unit_interval(confidence).alias("confidence"),
    )


def classify_responses(responses: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """Responses with ``outcome`` (written, not_found, failed) and the ``reason`` of a failure.

    ``status`` is the HTTP status, null if there was no answer at all.
    """
    names = ("error", "error_description")
    code, text = F.col(status), F.col(body)
    said = (
        # The body of an error status is shown, not read.
        responses.withColumn("_v", F.when(code.isNull() | ~code.between(300, 599), R.parse(text)))
        .withColumn("_o", R.members(F.col("_v"), *names))
        .withColumn("_json", F.col("_v").isNotNull())
        .withColumn("_error", R.opened(F.col("_o")["error"]))
        .withColumn("_described", R.opened(F.col("_o")["error_description"]))
        .withColumn("_code", R.text_only(F.col("_error")))
    )
    has_error = F.col("_error")["k"].isNotNull()
    words = lambda o: F.when(o["k"] == "STRING", F.try_variant_get(o["v"], "$", "string")).otherwise(F.to_json(o["v"]))
    outcome = (
        F.when(code.isNull(), "failed")
        .when(code == 404, "not_found")
        .when(code.between(300, 599), "failed")
        .when(~F.col("_json"), "failed")
        .when(has_error & F.coalesce(F.col("_code").isin(*NOT_FOUND_CODES), F.lit(False)), "not_found")
        .when(has_error, "failed")
        .otherwise("written")
    )
    reason = (
        F.when(code.isNull(), "unreachable")
        .when(code == 404, "no such entity (HTTP 404)")
        .when(code.isin(401, 403), F.concat(F.lit("credentials rejected (HTTP "), code.cast("string"), F.lit(")")))
        .when(
            code.between(300, 599),
            F.concat(F.lit("HTTP "), code.cast("string"), F.lit(": "), F.substring(F.coalesce(text, F.lit("")), 1, 300)),
        )
        .when(~F.col("_json"), "response is not JSON")
        .when(has_error & F.col("_described")["k"].isNotNull(), words(F.col("_described")))
        .when(has_error, words(F.col("_error")))
    )
    return said.select(*responses.columns, outcome.alias("outcome"), reason.alias("reason"))


def echoed_items(body: Column, entity: str) -> Column:
    """How many records an AmoCRM batch reply lists as written."""
    listed = F.try_variant_get(R.parse(body), f"$._embedded.{entity}", "array<variant>")
    return F.coalesce(F.size(listed), F.lit(0))
