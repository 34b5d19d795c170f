"""What to monitor: keys, metrics, windows and thresholds of a monitoring mart.

Every operator takes a :class:`MonitoringSpec`, so the same plan serves any
(entity, mode, date, metrics) data set. Result column names are derived here and
nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Metric:
    """A measured column.

    ``decimals`` says that the readings carry at most that many decimal places.
    They are then summed as whole units, so an average no longer depends on the
    order in which tasks deliver their partial sums (a retried or re-planned
    stage gives the same bits). Leave it ``None`` for free floating-point data.
    """

    name: str
    decimals: int | None = None


# Metric names and the order in which the result tables list them.
PRESSURE_FLOW_TEMPERATURE_VIBRATION = (
    Metric("pressure"),
    Metric("flow"),
    Metric("temperature"),
    Metric("vibration"),
)
FLAGGED = ("pressure", "flow")
FEATURE_BLOCK_ORDER = ("pressure", "flow", "vibration", "temperature")

# Signal count -> status.
STATUS_BY_SIGNALS = {0: "stable", 1: "warning", 2: "anomaly", 3: "anomaly"}
STATUS_ABOVE = "critical"
BAD_STATUSES = ("anomaly", "critical")

# Status of one metric, strongest evidence first.
METRIC_STATUS_BASELINE = "anomaly_vs_baseline"
METRIC_STATUS_ROLLING = "large_shift_vs_rolling"
METRIC_STATUS_PREV = "large_shift_vs_prev"
METRIC_STATUS_DEFAULT = "normal"


@dataclass(frozen=True)
class MonitoringSpec:
    entity: str = "station_id"
    mode: str | None = "mode"
    period: str = "month_start"
    reading_date: str = "measurement_date"
    metrics: tuple[Metric, ...] = PRESSURE_FLOW_TEMPERATURE_VIBRATION
    flagged: tuple[str, ...] = FLAGGED
    feature_order: tuple[str, ...] = FEATURE_BLOCK_ORDER
    window: int = 3
    prev_threshold: float = 0.10
    rolling_threshold: float = 0.10
    baseline_threshold: float = 0.15
    event_date: str = "event_date"
    severity: str = "severity"
    critical_severity: str = "critical"
    duration: Metric = Metric("duration_hours")

    def __post_init__(self) -> None:
        names = {m.name for m in self.metrics}
        if not set(self.flagged) <= names:
            raise ValueError(f"flagged metrics {self.flagged} are not all in {sorted(names)}")
        if set(self.feature_order) != names:
            raise ValueError("feature_order must list every metric once")
        if self.window < 1:
            raise ValueError("window must be at least 1")

    # ---- grains -------------------------------------------------------
    @property
    def series_keys(self) -> tuple[str, ...]:
        """One time series per value of these keys."""
        return (self.entity,) if self.mode is None else (self.entity, self.mode)

    @property
    def grain(self) -> tuple[str, ...]:
        return (self.period, *self.series_keys)

    @property
    def event_grain(self) -> tuple[str, ...]:
        return (self.period, self.entity)

    def per_entity(self) -> "MonitoringSpec":
        """The same rules at the (period, entity) grain, all modes together."""
        return replace(self, mode=None)

    def with_decimals(self, duration: int | None = None, **decimals: int) -> "MonitoringSpec":
        """Declare the decimal places of some metrics."""
        return replace(
            self,
            metrics=tuple(replace(m, decimals=decimals.get(m.name, m.decimals)) for m in self.metrics),
            duration=replace(self.duration, decimals=duration if duration is not None else self.duration.decimals),
        )

    # ---- column names -------------------------------------------------
    @property
    def metric_names(self) -> tuple[str, ...]:
        return tuple(m.name for m in self.metrics)

    def avg(self, metric: str) -> str:
        return f"avg_{metric}"

    def prev(self, metric: str) -> str:
        return f"prev_avg_{metric}"

    def rolling(self, metric: str) -> str:
        return f"rolling_avg_{metric}_{self.window}"

    def baseline(self, metric: str) -> str:
        return f"baseline_avg_{metric}_{self.window}_prev"

    def prev_flag(self, metric: str) -> str:
        return f"is_large_{metric}_shift_prev"

    def rolling_flag(self, metric: str) -> str:
        return f"is_large_{metric}_shift_rolling"

    def baseline_flag(self, metric: str) -> str:
        return f"is_{metric}_anomaly_{self.window}_prev"

    def metric_status(self, metric: str) -> str:
        return f"{metric}_monitoring_status"

    # ---- column blocks, in result order -------------------------------
    @property
    def monthly_columns(self) -> tuple[str, ...]:
        return (*self.grain, *map(self.avg, self.metric_names), "obs_count")

    @property
    def feature_columns(self) -> tuple[str, ...]:
        return tuple(
            name(m) for name in (self.prev, self.rolling, self.baseline) for m in self.feature_order
        )

    @property
    def change_columns(self) -> tuple[str, ...]:
        prev = tuple(f"{m}_{kind}_change" for m in self.metric_names for kind in ("abs", "pct"))
        deviations = tuple(
            f"{m}_vs_{ref}_{kind}"
            for ref in ("rolling", "baseline")
            for kind in ("diff", "pct")
            for m in self.flagged
        )
        return prev + deviations

    @property
    def flag_columns(self) -> tuple[str, ...]:
        return tuple(
            name(m) for name in (self.prev_flag, self.rolling_flag, self.baseline_flag) for m in self.flagged
        )

    @property
    def core_columns(self) -> tuple[str, ...]:
        """Columns of the monitoring mart before events are joined."""
        return (
            *self.monthly_columns,
            *self.feature_columns,
            *self.change_columns,
            *self.flag_columns,
            "signal_count",
            "monitoring_status",
        )

    @property
    def mart_columns(self) -> tuple[str, ...]:
        return (
            *self.core_columns,
            "event_count",
            "critical_event_count",
            "avg_event_duration",
            "has_events",
            "has_critical_events",
            "problematic_with_events",
            "anomaly_or_critical_with_events",
        )

    @property
    def model_features(self) -> tuple[str, ...]:
        """Inputs of the next-period event model, in model order."""
        metrics = self.metric_names
        return (
            *map(self.avg, metrics),
            "obs_count",
            *map(self.prev, metrics),
            *map(self.rolling, metrics),
            *map(self.baseline, metrics),
            *(f"{m}_{kind}_change" for m in metrics for kind in ("abs", "pct")),
            *(
                f"{m}_vs_{ref}_{kind}"
                for ref in ("rolling", "baseline")
                for m in self.flagged
                for kind in ("diff", "pct")
            ),
            *self.flag_columns,
            "signal_count",
        )


STATION_MODE = MonitoringSpec()
STATION = STATION_MODE.per_entity()
