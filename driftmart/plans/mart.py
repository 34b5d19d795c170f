"""Whole pipelines: from raw tables to the monitoring mart and the model table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmart.operators.events import (
    enrich_with_events,
    event_flags,
    event_monthly,
    has_event_flags,
)
from driftmart.operators.features import change_features, window_features
from driftmart.operators.metrics import monthly_metrics
from driftmart.operators.signals import monitoring_status, signal_count, signal_flags
from driftmart.spec import STATION, STATION_MODE, MonitoringSpec

# Wide rows of the mart take about 2 kB each in the sorts of a comparison of two of them.
READINGS_PER_PARTITION = 200_000
EVENT_STATES = ("has_events", "has_critical_events")


def by_entity(df: DataFrame, spec: MonitoringSpec, partitions: int | None = None) -> DataFrame:
    """Distribute a pre-aggregated table by entity.

    One exchange then serves the windows over (entity, mode), the event join on
    (entity, period) and the LEAD over entity. It moves aggregated rows only:
    at most months x modes per entity, however many readings an entity has.

    Adaptive execution merges partitions by the bytes of these narrow rows. Where wide
    rows are sorted after the windows, give ``partitions``, see ``partitions_for``.
    """
    return df.repartition(*([partitions] if partitions else []), F.col(spec.entity))


def partitions_for(readings: DataFrame) -> int:
    """Partitions that hold at most ``READINGS_PER_PARTITION`` rows of the mart on average.

    Readings are counted, as the mart has no more rows than they are; from Parquet the count
    takes the footers only. Never fewer than the session's shuffle partitions, as Spark would
    exchange once more for a join that has fewer.
    """
    conf = readings.sparkSession.conf
    usual = conf.get("spark.sql.shuffle.partitions")
    least = max(int(usual), int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", usual)))
    return max(least, -(-readings.count() // READINGS_PER_PARTITION))


def monthly(
    readings: DataFrame, spec: MonitoringSpec = STATION_MODE, partitions: int | None = None
) -> DataFrame:
    return by_entity(monthly_metrics(readings, spec), spec, partitions)


def monthly_events(
    events: DataFrame,
    spec: MonitoringSpec = STATION_MODE,
    with_duration: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Event metrics distributed like the mart, so that the join moves this narrow side only."""
    return by_entity(event_monthly(events, spec, with_duration), spec, partitions)


def flagged(metrics: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Features, deviations and flags on top of monthly metrics."""
    return signal_flags(change_features(window_features(metrics, spec), spec), spec)


def with_status(metrics: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    return monitoring_status(signal_count(flagged(metrics, spec), spec))


def monitoring_core(readings: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Features, flags, signal count and status; no events."""
    return with_status(monthly(readings, spec), spec).select(*spec.core_columns)


def monitoring_mart(
    readings: DataFrame,
    events: DataFrame,
    spec: MonitoringSpec = STATION_MODE,
    partitions: int | None = None,
) -> DataFrame:
    """The full mart: one row per month, station and mode.

    Events are joined to the monthly metrics, before the windows widen the rows:
    a sort-merge join then sorts 8 columns instead of 44. Where a query reads no
    event column Catalyst drops the join, the event side being unique on its key.
    """
    return mart_of(
        monthly(readings, spec, partitions), monthly_events(events, spec, partitions=partitions), spec
    )


def mart_of(
    metrics: DataFrame, event_months: DataFrame, spec: MonitoringSpec = STATION_MODE
) -> DataFrame:
    """The mart from monthly metrics and event metrics, both distributed by entity."""
    enriched = enrich_with_events(metrics, event_months, spec)
    return event_flags(with_status(enriched, spec)).select(*spec.mart_columns)


def ml_ready(readings: DataFrame, events: DataFrame, spec: MonitoringSpec = STATION) -> DataFrame:
    """Station-month mart plus next-month event targets.

    The target is taken from the next month present; the last month of a station
    has none. It shares the sort of the other windows.
    """
    return ml_ready_of(
        monthly(readings, spec), monthly_events(events, spec, with_duration=False), spec
    )


def ml_ready_of(
    metrics: DataFrame, event_months: DataFrame, spec: MonitoringSpec = STATION
) -> DataFrame:
    """The model table from monthly metrics and event metrics, both distributed by entity."""
    enriched = has_event_flags(enrich_with_events(metrics, event_months, spec))
    following = Window.partitionBy(*spec.series_keys).orderBy(spec.period)
    with_targets = enriched.withColumns(
        {f"{c}_next_month": F.lead(c).over(following) for c in EVENT_STATES}
    )
    return with_status(with_targets, spec).select(
        *spec.core_columns,
        "event_count",
        "critical_event_count",
        *EVENT_STATES,
        *[f"{c}_next_month" for c in EVENT_STATES],
    )
