"""The three input tables, taken from a TPC-H-like star schema.

Mapping: a supplier is a station, its order lines are the readings, and the
orders of the customer with the same key are its events. Every row of
``lineitem`` and ``orders`` is used. The station key is a column of both fact
tables, so no fact is joined to a dimension and the mart grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmart.spec import STATION_MODE

# Every mapped measure holds exactly two decimals.
SPEC = STATION_MODE.with_decimals(pressure=2, flow=2, temperature=2, vibration=2, duration=2)
STATION_SPEC = SPEC.per_entity()


@dataclass(frozen=True)
class Tables:
    stations: DataFrame
    measurements: DataFrame
    events: DataFrame


# Known schemas spare the reader a job that opens a footer to infer them.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stations(spark: SparkSession, folder: str) -> DataFrame:
    supplier = _table(spark, folder, "supplier")
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("station_id"),
            F.col("s_name").alias("station_name"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("station_type"),
            F.lit(None).cast("int").alias("launch_year"),  # no counterpart
        )
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS measurement_id",
        "l_suppkey AS station_id",
        "cast(l_shipdate AS DATE) AS measurement_date",
        "l_returnflag AS mode",
        "l_extendedprice AS pressure",
        "l_quantity AS flow",
        "l_discount AS temperature",
        "l_tax AS vibration",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").selectExpr(
        "o_orderkey AS event_id",
        "o_custkey AS station_id",
        "cast(o_orderdate AS DATE) AS event_date",
        "o_orderstatus AS event_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'"
        " WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity",
        "o_totalprice AS duration_hours",
    )


def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(stations(spark, folder), measurements(spark, folder), events(spark, folder))
