"""CSV and Parquet in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmart.functions.expressions import name, named, nan_to_null
from driftmart.sources.schemas import TABLES


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    return df.selectExpr(
        *[
            named(nan_to_null(f.name), f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else name(f.name)
            for f in df.schema
        ]
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated file(s) with a header.

    The schema is given, so no extra pass infers it. A header that disagrees with
    the schema fails. A malformed value fails as soon as its column is read (columns
    that no query reads are not parsed); ``quality.load_check`` reads them all.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .option("nanValue", "NaN")
    )
    return clean_numbers(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_numbers(spark.read.parquet(path))


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """stations, measurements and events from ``<folder>/<table>.csv``."""
    return {
        name: read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema)
        for name, schema in TABLES.items()
    }


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """One folder of CSV part files, each with a header; nothing is pulled together.

    ``compression`` is one of Spark's codecs, as ``gzip``, which runs at its fastest level; a mart then
    takes less than half the space. A compressed part is read by one task.
    """
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    if compression:
        writer = writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    writer.csv(path)


def write_parquet(
    df: DataFrame,
    path: str,
    cluster_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Parquet sorted within each file by ``cluster_by``.

    Sorting lets row-group statistics skip data for a filter on those columns
    without one directory per value.
    """
    rows = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    rows.write.mode(mode).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, path: str, key: str, order: Sequence[str], buckets: int, mode: str = "errorifexists"
) -> DataFrame:
    """A table of the session's catalog, stored under ``path`` and bucketed by ``key``.

    Rows are dealt by the key first, so that each bucket is one file. Joins, groups and windows
    whose keys hold ``key`` then need no exchange between tables of as many buckets.
    """
    rows = df.repartition(buckets, F.col(f"`{key}`"))
    writer = rows.write.mode(mode).option("path", path).bucketBy(buckets, key).sortBy(*order)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make tables available to ``spark.sql`` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
