"""Plot-ready time series with marker columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmart.functions.expressions import flag, name, named
from driftmart.spec import STATION_MODE, MonitoringSpec

MARKERS = {
    "is_signal_point": "signal_count",
    "is_event_point": "event_count",
    "is_critical_event_point": "critical_event_count",
}


def monitoring_series(
    mart: DataFrame,
    metric: str,
    spec: MonitoringSpec = STATION_MODE,
    entity: int | str | None = None,
    mode: str | None = None,
    with_baseline: bool = True,
    with_rolling: bool = True,
    markers: tuple[str, ...] = (),
    ordered: bool | None = None,
) -> DataFrame:
    """Value, rolling mean and baseline of a metric over time.

    One slice if entity and mode are given, otherwise every series. Markers are
    0/1 columns for the points to highlight. Rows are ordered for one entity; all series
    together are ordered on request only, as a total order costs another pass.
    """
    rows = mart
    if entity is not None:
        rows = rows.where(F.col(spec.entity) == F.lit(entity))
    if mode is not None:
        rows = rows.where(F.col(spec.mode) == F.lit(mode))
    result = rows.selectExpr(
        *map(name, (*spec.series_keys, spec.period, spec.avg(metric))),
        *([name(spec.rolling(metric))] if with_rolling else []),
        *([name(spec.baseline(metric))] if with_baseline else []),
        *[named(flag(f"{MARKERS[marker]} > 0"), marker) for marker in markers],
    )
    if ordered or (ordered is None and entity is not None):
        return result.orderBy(*spec.series_keys, spec.period)
    return result
