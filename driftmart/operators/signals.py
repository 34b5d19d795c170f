"""Threshold flags, signal count and status."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftmart.functions.expressions import flag, name, named, reaches
from driftmart.spec import (
    METRIC_STATUS_BASELINE,
    METRIC_STATUS_DEFAULT,
    METRIC_STATUS_PREV,
    METRIC_STATUS_ROLLING,
    STATION_MODE,
    STATUS_ABOVE,
    STATUS_BY_SIGNALS,
    MonitoringSpec,
)


def signal_flags(changes: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """One 0/1 flag per flagged metric and reference value; thresholds are inclusive."""
    rules = (
        (spec.prev_flag, "{}_pct_change", spec.prev_threshold),
        (spec.rolling_flag, "{}_vs_rolling_pct", spec.rolling_threshold),
        (spec.baseline_flag, "{}_vs_baseline_pct", spec.baseline_threshold),
    )
    return changes.selectExpr(
        "*",
        *[
            named(flag(reaches(ratio.format(m), threshold)), column(m))
            for column, ratio, threshold in rules
            for m in spec.flagged
        ],
    )


def signal_count(flags: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    return flags.selectExpr("*", named(" + ".join(map(name, spec.flag_columns)), "signal_count"))


def monitoring_status(counted: DataFrame) -> DataFrame:
    levels = " ".join(f"WHEN {n} THEN '{status}'" for n, status in STATUS_BY_SIGNALS.items())
    status = f"CASE signal_count {levels} ELSE '{STATUS_ABOVE}' END"
    return counted.selectExpr("*", named(status, "monitoring_status"))


def metric_status(flags: DataFrame, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """Strongest finding per flagged metric: baseline, then rolling, then previous."""

    def status(m: str) -> str:
        return (
            f"CASE WHEN {name(spec.baseline_flag(m))} = 1 THEN '{METRIC_STATUS_BASELINE}'"
            f" WHEN {name(spec.rolling_flag(m))} = 1 THEN '{METRIC_STATUS_ROLLING}'"
            f" WHEN {name(spec.prev_flag(m))} = 1 THEN '{METRIC_STATUS_PREV}'"
            f" ELSE '{METRIC_STATUS_DEFAULT}' END"
        )

    return flags.selectExpr("*", *[named(status(m), spec.metric_status(m)) for m in spec.flagged])
