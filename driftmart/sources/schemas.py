"""Schemas of the three input tables (fixed values: names, order, types)."""

from __future__ import annotations

from pyspark.sql import types as T

STATIONS = T.StructType(
    [
        T.StructField("station_id", T.LongType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("station_type", T.StringType()),
        T.StructField("launch_year", T.IntegerType()),
    ]
)

MEASUREMENTS = T.StructType(
    [
        T.StructField("measurement_id", T.LongType()),
        T.StructField("station_id", T.LongType()),
        T.StructField("measurement_date", T.DateType()),
        T.StructField("mode", T.StringType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("flow", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("vibration", T.DoubleType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("station_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("duration_hours", T.DoubleType()),
    ]
)

TABLES = {"stations": STATIONS, "measurements": MEASUREMENTS, "events": EVENTS}
