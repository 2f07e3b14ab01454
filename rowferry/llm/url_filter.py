"""URL filter in DataFrame functions only: host rules, else logistic regression
on hashed character n-grams of host and path.

The model is fitted once on a small labelled URL table (a parameter; it is
taken whole, in one partition, so that the fit is repeatable) and then applied row by
row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import string
from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 18
GRAM_SIZES = (3, 4)
BLOCKED_WEIGHT = 3.0  # of a blocked url in the training, against 1 of an allowed one

# (verdict, host and path): fits the host and all its subdomains if the path starts so.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

# The default labelled table: names as they are typical of unwanted and of ordinary hosts.
_UNWANTED = (
    "casino-royal casino-slots online-casino best-bets sports-bets bets-now cheap-meds cheap-pills-online "
    "pills-shop buy-pills adult-chat adult-video xxx-adult spam-links link-spam spam-mailer ads-server "
    "ads-click click-track ad-tracker track-pixel free-spins free-casino win-money lottery-win"
).split()
_ORDINARY = (
    "garden kitchen weather history museum library school science travel forum news recipes music books "
    "nature sport theatre health cycling photo town council river mountain thornton western internet other "
    "another thing nation motion reading winter"
).split()
_SYLLABLES = "ba ren to mi ther sol kan ist lor ve ing ha th on".split()
_SCHEMES, _PREFIXES, _DOMAINS, _LANGS = ("http", "https"), ("", "www.", "blog.", "m."), ("com", "net", "org"), ("en", "fr", "de", "es")
_TAILS = ("", "/", ".html", "?page=2", "?utm_source=feed", "#top")


def default_labels(spark: SparkSession) -> DataFrame:
    """(url, blocked): the names above, and pairs of syllables as names of any kind, under each prefix and domain.

    Only names tell the classes apart; the many ordinary ones make a name without telling
    parts an ordinary one.
    """
    ordinary = _ORDINARY + [a + b for a in _SYLLABLES for b in _SYLLABLES]
    rows = []
    for label, names in ((1.0, _UNWANTED), (0.0, ordinary)):
        for i, name in enumerate(names):
            for k, (prefix, domain) in enumerate(product(_PREFIXES, _DOMAINS)):
                scheme, lang, tail = _SCHEMES[(i + k) % 2], _LANGS[(i + k) % 4], _TAILS[(i + k) % 6]
                rows.append((f"{scheme}://{prefix}{name}.example.{domain}/{lang}/{(12 * i + k) * 37 % 9973}{tail}", label))
    return spark.createDataFrame(rows, "url string, blocked double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _first_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones, a blocking one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _grams(mark: str, text: Column) -> list[Column]:
    # Over an array of characters: taking substrings by position is quadratic in long urls.
    letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    return [
        F.when(
            F.size(letters) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(letters) - (n - 1)),
                lambda i, n=n: F.concat(F.lit(mark), F.array_join(F.slice(letters, i, n), "")),
            ),
        ).otherwise(F.array().cast("array<string>"))
        for n in GRAM_SIZES
    ]


def _features(df: DataFrame, host: Column, path: Column) -> DataFrame:
    grams = F.concat(*_grams("h", host), *_grams("p", path))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashing.transform(df.withColumn("_grams", grams)).drop("_grams")


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """The model of (url, blocked 0 or 1). Rows without a label are left out; both classes must be there."""
    rows = labelled.select("url", F.col("blocked").cast("double").alias("blocked")).where("blocked IS NOT NULL").coalesce(1)
    blocked, total = rows.agg(F.sum("blocked"), F.count("blocked")).first()
    if not total or not 0 < blocked < total:
        raise ValueError("the labelled table needs urls of both classes")
    weighted = rows.withColumn("_weight", F.when(F.col("blocked") == 1, BLOCKED_WEIGHT).otherwise(1.0))
    trainer = LogisticRegression(
        featuresCol="_features", labelCol="blocked", weightCol="_weight", regParam=0.0003, maxIter=100, standardization=False
    )
    return trainer.fit(_features(weighted, *host_and_path(F.col("url"))))


def judge_urls(
    pages: DataFrame, model: LogisticRegressionModel, rules=RULES, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per row: page_id, host, path, rule (null if none fits), verdict (allow or block), score.

    ``score`` is the model's probability of "block"; it decides (0.5 or more
    blocks) where no rule fits. A null url, or one without ``://``, has an empty
    host and path and is judged by the model like any other. Other columns
    are not read. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    model = model.copy({model.predictionCol: "_prediction", model.probabilityCol: "_probability", model.rawPredictionCol: "_raw"})
    scored = model.transform(_features(parts, F.col("host"), F.col("path")))
    rule, verdict = _first_rule(rules, F.col("host"), F.col("path"))
    return scored.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_prediction") == 1, "block").otherwise("allow")).alias("verdict"),
        F.try_element_at(vector_to_array(F.col("_probability")), F.lit(2)).alias("score"),
    )
