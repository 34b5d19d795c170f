"""Questions asked of the finished mart.

Reports end in ``orderBy(...).limit(n)``, which Spark runs as a distributed
top-k (TakeOrderedAndProject). Rates come from exact integer sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmart.functions.expressions import share_of
from driftmart.spec import BAD_STATUSES, STATION_MODE, MonitoringSpec


def _top(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def bad_status_rate(
    mart: DataFrame, spec: MonitoringSpec = STATION_MODE, limit: int | None = 5
) -> DataFrame:
    """Series with the highest share of bad-status months that had events."""
    rates = mart.groupBy(*spec.series_keys).agg(
        F.sum("anomaly_or_critical_with_events").alias("anomaly_or_critical_event_months"),
        F.count(F.lit(1)).alias("total_months"),
        F.expr(share_of("anomaly_or_critical_with_events")).alias("anomaly_or_critical_rate"),
    )
    return _top(rates, _bad_status_order(spec), limit)


def _bad_status_order(spec: MonitoringSpec) -> list[Column]:
    return [
        F.desc("anomaly_or_critical_rate"),
        F.desc("anomaly_or_critical_event_months"),
        *[F.asc(k) for k in reversed(spec.series_keys)],
    ]


def critical_events_by_entity(
    mart: DataFrame, spec: MonitoringSpec = STATION_MODE, limit: int | None = 5
) -> DataFrame:
    """Entities with most critical events.

    Event counts repeat on every mode row of a month, so a month is first
    reduced to its maximum and only then summed.
    """
    per_month = mart.groupBy(*spec.event_grain).agg(
        F.max("critical_event_count").alias("critical_event_count")
    )
    totals = per_month.groupBy(spec.entity).agg(
        F.sum("critical_event_count").alias("total_critical_events")
    )
    return _top(totals, [F.desc("total_critical_events"), F.asc(spec.entity)], limit)


def mode_overlap_rate(
    mart: DataFrame, spec: MonitoringSpec = STATION_MODE, limit: int | None = 5
) -> DataFrame:
    """Share of rows per mode that carry both a signal and an event."""
    rates = mart.groupBy(spec.mode).agg(
        F.sum("problematic_with_events").alias("problematic_with_events_months"),
        F.count(F.lit(1)).alias("total_rows"),
        F.expr(share_of("problematic_with_events")).alias("problematic_with_events_rate"),
    )
    return _top(rates, _overlap_order(spec), limit)


def _overlap_order(spec: MonitoringSpec) -> list[Column]:
    return [F.desc("problematic_with_events_rate"), F.desc("problematic_with_events_months"), F.asc(spec.mode)]


def value_counts(df: DataFrame, column: str, name: str = "row_count") -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), F.asc(column))


def status_distribution(mart: DataFrame) -> DataFrame:
    return value_counts(mart, "monitoring_status")


def signal_totals(mart: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Number of rows that raised each flag."""
    return mart.agg(*[F.sum(flag).alias(name) for flag, name in _signal_names(spec).items()])


def _signal_names(spec: MonitoringSpec) -> dict[str, str]:
    names = {}
    for m in spec.flagged:
        names[spec.prev_flag(m)] = f"large_{m}_prev"
        names[spec.rolling_flag(m)] = f"large_{m}_rolling"
        names[spec.baseline_flag(m)] = f"{m}_anomaly_prev"
    return {flag: names[flag] for flag in spec.flag_columns}


def overlap_counts(mart: DataFrame) -> DataFrame:
    """How many rows have events, signals, a bad status, and their overlaps."""
    events = F.col("event_count") > 0
    signals = F.col("signal_count") > 0
    bad = F.col("monitoring_status").isin(*BAD_STATUSES)
    return mart.agg(
        F.count_if(events).alias("rows_with_events"),
        F.count_if(signals).alias("rows_with_signals"),
        F.count_if(signals & events).alias("rows_with_signals_and_events"),
        F.count_if(bad).alias("rows_with_bad_status"),
        F.count_if(bad & events).alias("rows_with_bad_status_and_events"),
    )


# ---- several reports from one scan -------------------------------------------------


def report_totals(mart: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Counts per series and status, from which ``reports_of`` adds up its reports.

    One scan that combines map-side. Grouping sets would multiply every row by the number of
    reports before that; these totals have a row per series and status and are rolled up.
    """
    events, signals = F.col("event_count") > 0, F.col("signal_count") > 0
    return mart.groupBy(*spec.series_keys, "monitoring_status").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("anomaly_or_critical_with_events").alias("bad_with_events"),
        F.sum("problematic_with_events").alias("problematic_with_events"),
        F.count_if(events).alias("rows_with_events"),
        F.count_if(signals).alias("rows_with_signals"),
        F.count_if(signals & events).alias("rows_with_signals_and_events"),
        *[F.sum(flag).alias(flag) for flag in spec.flag_columns],
    )


def reports_of(
    totals: DataFrame, spec: MonitoringSpec = STATION_MODE, limit: int | None = 5
) -> dict[str, DataFrame]:
    """Five reports from (saved) totals, the same rows as from the mart itself."""

    def rate(column: str) -> Column:
        return F.sum(column).cast("double") / F.sum("row_count")

    by_series = totals.groupBy(*spec.series_keys).agg(
        F.sum("bad_with_events").alias("anomaly_or_critical_event_months"),
        F.sum("row_count").alias("total_months"),
        rate("bad_with_events").alias("anomaly_or_critical_rate"),
    )
    by_mode = totals.groupBy(spec.mode).agg(
        F.sum("problematic_with_events").alias("problematic_with_events_months"),
        F.sum("row_count").alias("total_rows"),
        rate("problematic_with_events").alias("problematic_with_events_rate"),
    )
    by_status = totals.groupBy("monitoring_status").agg(F.sum("row_count").alias("row_count"))
    bad = F.col("monitoring_status").isin(*BAD_STATUSES)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0).cast("long"))

    return {
        "bad_status_rate": _top(by_series, _bad_status_order(spec), limit),
        "mode_overlap_rate": _top(by_mode, _overlap_order(spec), limit),
        "status_distribution": by_status.orderBy(F.desc("row_count"), F.asc("monitoring_status")),
        "signal_totals": totals.agg(*[F.sum(flag).alias(name) for flag, name in _signal_names(spec).items()]),
        "overlap_counts": totals.agg(
            *[total(F.col(c)).alias(c) for c in ("rows_with_events", "rows_with_signals", "rows_with_signals_and_events")],
            total(F.when(bad, F.col("row_count"))).alias("rows_with_bad_status"),
            total(F.when(bad, F.col("rows_with_events"))).alias("rows_with_bad_status_and_events"),
        ),
    }


def diagnostics(
    mart: DataFrame, spec: MonitoringSpec = STATION_MODE, entity: int | str | None = None
) -> DataFrame:
    """The columns needed to see why a row has its status, for one entity or for all.

    The entity is the partition key of every window and join below, so Catalyst
    moves the filter into the scan.
    """
    rows = mart if entity is None else mart.where(F.col(spec.entity) == F.lit(entity))
    result = rows.select(
        *spec.grain,
        "signal_count",
        "monitoring_status",
        "event_count",
        "critical_event_count",
        *[f"{m}_pct_change" for m in spec.flagged],
        *[f"{m}_vs_baseline_pct" for m in spec.flagged],
    )
    # All entities together stay unordered: a total order costs another pass over the mart.
    return result if entity is None else result.orderBy(spec.period, *reversed(spec.series_keys))
