"""Load checks: row counts, table profiles, grain duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGED = (T.NumericType, T.DateType)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name and number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def table_profile(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Shape and date range per table, from one aggregation each.

    ``tables`` maps a name to the table and its date column.
    """
    profiles = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(date).alias("min_date"),
            F.max(date).alias("max_date"),
        ).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            "min_date",
            "max_date",
        )
        for name, (df, date) in tables.items()
    ]
    return reduce(DataFrame.unionByName, profiles)


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types; read from the plan, no job runs."""
    return df.dtypes


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def _number(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DateType):
        column = F.unix_date(column)
    return column.cast("double") if isinstance(field.dataType, RANGED) else F.lit(None).cast("double")


def load_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Type, rows, values present and range per table and column.

    Reads, hence parses, every value. Ranges are numbers: those of dates count days since
    1970-01-01, those of other types are NULL.
    """

    def check(table: str, df: DataFrame) -> DataFrame:
        columns = [
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.count(F.lit(1)).alias("row_count"),
                F.count(F.col(f"`{field.name}`")).alias("present"),
                F.min(_number(field)).alias("smallest"),
                F.max(_number(field)).alias("largest"),
            )
            for field in df.schema
        ]
        return df.agg(F.array(*columns).alias("columns")).select(
            F.lit(table).alias("table_name"), F.inline("columns")
        )

    return reduce(DataFrame.unionByName, [check(table, df) for table, df in tables.items()])


class ObservedLoad:
    """The figures of ``load_check``, collected while other work reads the tables.

    ``watch`` returns a table to be read in place of the given one. Once a job has read it to
    its end, ``check`` has its figures, without another pass. Use a watched table in one job:
    figures are those of the first. A stage that runs again after a loss may be counted twice.
    """

    def __init__(self) -> None:
        self._seen: dict[str, tuple[T.StructType, Observation]] = {}

    def watch(self, table: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._seen[table] = (df.schema, seen)
        metrics = [F.count(F.lit(1)).alias("row_count")]
        for k, field in enumerate(df.schema):
            metrics += [
                F.count(F.col(f"`{field.name}`")).alias(f"present_{k}"),
                F.min(_number(field)).alias(f"smallest_{k}"),
                F.max(_number(field)).alias(f"largest_{k}"),
            ]
        return df.observe(seen, *metrics)

    def check(self, spark: SparkSession) -> DataFrame:
        rows = [
            (table, f.name, f.dataType.simpleString(), seen.get["row_count"], *[seen.get[f"{m}_{k}"] for m in ("present", "smallest", "largest")])
            for table, (schema, seen) in self._seen.items()
            for k, f in enumerate(schema)
        ]
        return spark.createDataFrame(
            rows, "table_name string, column_name string, data_type string, row_count long, present long, smallest double, largest double"
        )


def saved_profile(spark: SparkSession, tables: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``table_profile`` of Parquet folders from their footers; no data page is read.

    ``tables`` maps a name to the path and a column whose range is wanted: a number or a date
    that some row of each file has. The scan needs the newer Parquet reader, which a session
    of its own switches on; the caller's session keeps its settings.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return table_profile({table: (own.read.parquet(path), column) for table, (path, column) in tables.items()})


def grain_duplicates(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """All rows whose grain values occur more than once.

    Counting first combines map-side and leaves only the repeated keys; the rows
    are then fetched by a semi join, which adaptive execution can broadcast or
    split. A window count would drag every row of a hot key into one task.
    """
    repeated = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*grain)
    rows, keys = df.alias("rows"), repeated.alias("keys")
    same_key = [F.col(f"rows.{g}").eqNullSafe(F.col(f"keys.{g}")) for g in grain]
    return rows.join(keys, same_key, "left_semi")


def require_unique(df: DataFrame, grain: Sequence[str]) -> None:
    """Fail if a grain value occurs more than once; runs a job that reads the grain columns."""
    repeated = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    example = repeated.first()
    if example is not None:
        raise ValueError(f"{tuple(grain)} is not unique, e.g. {tuple(example)[:-1]}: {example.n} rows")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
