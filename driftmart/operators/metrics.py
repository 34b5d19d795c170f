"""Readings to one row per period and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmart.functions.expressions import mean_from, mean_of, month_start, name, named, present, sum_of
from driftmart.spec import STATION_MODE, MonitoringSpec


def monthly_metrics(readings: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Average of every metric and number of readings per month and series.

    Sums and counts combine map-side, so a station that owns a third of all
    readings sends no more rows per map task than it has (month, mode) cells.
    """
    return readings.groupBy(
        F.expr(month_start(spec.reading_date)).alias(spec.period), *spec.series_keys
    ).agg(
        *[F.expr(mean_of(m, readings.schema[m.name].dataType)).alias(spec.avg(m.name)) for m in spec.metrics],
        F.count(F.lit(1)).alias("obs_count"),
    )


def monthly_sums(readings: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Sum and number of readings of every metric per month and series, for ``monthly_from_sums``."""
    aggregates = []
    for m in spec.metrics:
        data_type = readings.schema[m.name].dataType
        aggregates.append(named(sum_of(m, data_type), f"sum_{m.name}"))
        aggregates.append(named(f"count({present(m, data_type)})", f"count_{m.name}"))
    return readings.groupBy(
        F.expr(month_start(spec.reading_date)).alias(spec.period), *spec.series_keys
    ).agg(*map(F.expr, aggregates), F.count(F.lit(1)).alias("obs_count"))


def monthly_from_sums(sums: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """The rows of ``monthly_metrics`` from saved sums, of the same grain or of one with modes."""
    if spec.mode is None:
        totals = [c for c in sums.columns if c == "obs_count" or c.startswith(("sum_", "count_"))]
        sums = sums.groupBy(*spec.grain).agg(*[F.sum(c).alias(c) for c in totals])
    return sums.selectExpr(
        *map(name, spec.grain),
        *[
            named(mean_from(m, name(f"sum_{m.name}"), name(f"count_{m.name}")), spec.avg(m.name))
            for m in spec.metrics
        ],
        "obs_count",
    )
