"""Event log to monthly event metrics, and their join to the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmart.functions.expressions import flag, mean_of, month_start, name, named, text
from driftmart.spec import BAD_STATUSES, STATION_MODE, MonitoringSpec


def event_monthly(
    events: DataFrame, spec: MonitoringSpec = STATION_MODE, with_duration: bool = True
) -> DataFrame:
    """Events, critical events and mean duration per month and entity."""
    is_critical = flag(f"{name(spec.severity)} = {text(spec.critical_severity)}")
    aggregates = [
        named("count(1)", "event_count"),
        named(f"sum({is_critical})", "critical_event_count"),
    ]
    if with_duration:
        aggregates.append(named(mean_of(spec.duration, events.schema[spec.duration.name].dataType), "avg_event_duration"))
    return events.groupBy(
        F.expr(month_start(spec.event_date)).alias(spec.period), spec.entity
    ).agg(*map(F.expr, aggregates))


def enrich_with_events(
    mart: DataFrame,
    monthly_events: DataFrame,
    spec: MonitoringSpec = STATION_MODE,
    indicator: str | None = None,
) -> DataFrame:
    """Left join on (entity, period): event metrics repeat on every mode row.

    The event side is unique on the key, so the join cannot multiply rows.
    No broadcast hint: adaptive execution measures the event side and broadcasts
    it only below the configured threshold. ``indicator`` names an optional
    column telling ``both`` from ``left_only`` rows.
    """
    keys = [spec.entity, spec.period]
    carried = [c for c in monthly_events.columns if c not in keys]
    right = monthly_events
    if indicator:
        right = right.withColumn(indicator, F.lit("both"))
        carried.append(indicator)
    missing = {"event_count": "0L", "critical_event_count": "0L", indicator: "'left_only'"}
    joined = mart.join(right, keys, "left")
    return joined.selectExpr(
        *map(name, mart.columns),
        *[
            named(f"coalesce({name(c)}, {missing[c]})", c) if c in missing else name(c)
            for c in carried
        ],
    )


def has_event_flags(enriched: DataFrame) -> DataFrame:
    return enriched.selectExpr(
        "*",
        named(flag("event_count > 0"), "has_events"),
        named(flag("critical_event_count > 0"), "has_critical_events"),
    )


def event_flags(enriched: DataFrame) -> DataFrame:
    """Event presence, and its coincidence with signals and with a bad status."""
    bad = ", ".join(f"'{status}'" for status in BAD_STATUSES)
    return has_event_flags(enriched).selectExpr(
        "*",
        named(flag("signal_count > 0 AND event_count > 0"), "problematic_with_events"),
        named(
            flag(f"monitoring_status IN ({bad}) AND event_count > 0"),
            "anomaly_or_critical_with_events",
        ),
    )
