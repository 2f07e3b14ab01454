"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import staging_path
from . import ann, bit_kmeans, exact_dedup, html_text, language, near_dedup, packing, periodic_runs, pieces, pii, sharding, url_filter, warc
from .tables import table


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), shards=40)


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, folder, "embeddings"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = staging_path(spark, "archives")
    warc.write_warc(table(spark, folder, "pages"), archives)
    return warc.page_records(warc.read_warc(spark, archives, payloads=False))


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.train(docs))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    model = url_filter.fit(url_filter.default_labels(spark))
    return url_filter.judge_urls(table(spark, folder, "pages"), model)


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return bit_kmeans.with_inertia(bit_kmeans.cluster(table(spark, folder, "embeddings"), k=40, rounds=5))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_repetition(table(spark, folder, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.span_digests(pii.find_pii(docs, pii.train(docs)))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_html_text": op2_html_text,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_neighbours": op5_neighbours,
    "op6_warc": op6_warc,
    "op7_pieces": op7_pieces,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_near_dedup": op10_near_dedup,
    "op11_centroids": op11_centroids,
    "op12_runs": op12_runs,
    "op13_pii": op13_pii,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE.strip(),
    "op6_warc": warc.ORACLE.strip(),
    "op10_near_dedup": near_dedup.ORACLE.strip(),
    "op11_centroids": bit_kmeans.oracle(),
}
