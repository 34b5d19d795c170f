"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmart.llm import (
    collocations,
    inner_product,
    language,
    licenses,
    mixing,
    near_dups,
    neighbours,
    packing,
    pieces,
    pii,
    repeats,
    resampling,
    secret_links,
)
from driftmart.llm.common import table


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"))


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


def op5_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    return secret_links.scan(table(spark, folder, "documents"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language.identify(documents, language.fit(documents))


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"))


def op10_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    return inner_product.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_pack(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"))
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", digest, "sequence_id", "offset")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_neighbours": op3_neighbours,
    "op4_personal_data": op4_personal_data,
    "op5_secret_links": op5_secret_links,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_repeats": op8_repeats,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_inner_products": op10_inner_products,
    "op11_resample": op11_resample,
    "op12_collocations": op12_collocations,
    "op13_pack": op13_pack,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op5_secret_links": secret_links.ORACLE,
    "op10_inner_products": inner_product.ORACLE,
    "op11_resample": resampling.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
