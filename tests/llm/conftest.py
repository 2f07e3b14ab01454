from __future__ import annotations

import pytest

# Names that operators use inside; tables may have them as well.
CLASHING = ["norm", "salt", "prefix", "size", "place", "node", "shard", "slot", "class", "bands", "bucket", "text_sha256", "part", "number", "length", "vec", "d"]

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))

ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, "The  quick brown\nfox jumps over the lazy dog and runs away.", "en", "a"),
    (4, "The  quick brown\nfox jumps over the lazy dog and runs away.", "en", "a"),
    (None, "An id is missing here, and so is everything else.", None, None),
    (5, "   \t\n ", "de", "b"),
    (6, "123 456 %%% 789", "fr", "b"),
    (7, LONG, "en", "b"),
    (8, "Ünïcödé ▁ text 日本語 😀 é́", "de", "b"),
    (9, "two words", "en", "a"),
    (10, "THE QUICK brown fox jumps over the lazy dog and runs away.", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*row, *([7] * len(CLASHING))) for row in ODD]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df):
    return [tuple(row) for row in df.collect()]
