"""The same marts as ANSI SQL text.

A second formulation of the same spec: ``reconcile`` compares its result with the
DataFrame plans, and because the text uses only common SQL it also runs on other
engines. Thresholds and status rules come from the spec here as well; ``oracle`` states
its own.
"""

from __future__ import annotations

from driftmart.spec import (
    BAD_STATUSES,
    STATION,
    STATION_MODE,
    STATUS_ABOVE,
    STATUS_BY_SIGNALS,
    Metric,
    MonitoringSpec,
)


def _list(items) -> str:
    return ",\n    ".join(items)


def _month(column: str) -> str:
    return f"CAST(date_trunc('month', {column}) AS DATE)"


def _mean(metric: Metric) -> str:
    """NaN is missing. Exact for declared decimals: the sum is a decimal, divided once."""
    value = f"NULLIF({metric.name}, CAST('NaN' AS DOUBLE))"
    if metric.decimals is None:
        return f"AVG({value})"
    exact = f"SUM(CAST({value} AS DECIMAL(18, {metric.decimals})))"
    return f"CAST({exact} AS DOUBLE) / NULLIF(COUNT({value}), 0)"


def _ratio(value: str, base: str) -> str:
    return f"({value} - {base}) / NULLIF({base}, 0)"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def monthly_sql(readings: str, spec: MonitoringSpec = STATION_MODE) -> str:
    keys = [f"{_month(spec.reading_date)} AS {spec.period}", *spec.series_keys]
    means = [f"{_mean(m)} AS {spec.avg(m.name)}" for m in spec.metrics]
    return (
        f"SELECT {_list([*keys, *means, 'COUNT(*) AS obs_count'])}\n"
        f"FROM {readings}\n"
        f"GROUP BY {', '.join([_month(spec.reading_date), *spec.series_keys])}"
    )


def window_sql(source: str, spec: MonitoringSpec = STATION_MODE) -> str:
    n = spec.window
    columns = [
        *(f"LAG({spec.avg(m)}) OVER history AS {spec.prev(m)}" for m in spec.feature_order),
        *(f"AVG({spec.avg(m)}) OVER recent AS {spec.rolling(m)}" for m in spec.feature_order),
        *(f"AVG({spec.avg(m)}) OVER earlier AS {spec.baseline(m)}" for m in spec.feature_order),
    ]
    series = f"PARTITION BY {', '.join(spec.series_keys)} ORDER BY {spec.period}"
    return (
        f"SELECT *, {_list(columns)}\nFROM {source}\n"
        f"WINDOW history AS ({series}),\n"
        f"  recent AS ({series} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW),\n"
        f"  earlier AS ({series} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    )


def change_sql(source: str, spec: MonitoringSpec = STATION_MODE) -> str:
    formulas = {}
    for m in spec.metric_names:
        formulas[f"{m}_abs_change"] = f"{spec.avg(m)} - {spec.prev(m)}"
        formulas[f"{m}_pct_change"] = _ratio(spec.avg(m), spec.prev(m))
    for m in spec.flagged:
        for ref, name in (("rolling", spec.rolling(m)), ("baseline", spec.baseline(m))):
            formulas[f"{m}_vs_{ref}_diff"] = f"{spec.avg(m)} - {name}"
            formulas[f"{m}_vs_{ref}_pct"] = _ratio(spec.avg(m), name)
    columns = [f"{formulas[c]} AS {c}" for c in spec.change_columns]
    return f"SELECT *, {_list(columns)}\nFROM {source}"


def flag_sql(source: str, spec: MonitoringSpec = STATION_MODE) -> str:
    rules = {}
    for m in spec.flagged:
        rules[spec.prev_flag(m)] = (f"{m}_pct_change", spec.prev_threshold)
        rules[spec.rolling_flag(m)] = (f"{m}_vs_rolling_pct", spec.rolling_threshold)
        rules[spec.baseline_flag(m)] = (f"{m}_vs_baseline_pct", spec.baseline_threshold)
    columns = [
        f"{_flag(f'ABS({rules[c][0]}) >= CAST({rules[c][1]!r} AS DOUBLE)')} AS {c}"
        for c in spec.flag_columns
    ]
    return f"SELECT *, {_list(columns)}\nFROM {source}"


def status_sql(source: str, spec: MonitoringSpec = STATION_MODE) -> str:
    signals = " + ".join(spec.flag_columns)
    cases = " ".join(f"WHEN {n} THEN '{status}'" for n, status in STATUS_BY_SIGNALS.items())
    return (
        f"SELECT *, CASE signal_count {cases} ELSE '{STATUS_ABOVE}' END AS monitoring_status\n"
        f"FROM (SELECT *, {signals} AS signal_count FROM {source}) counted"
    )


def event_monthly_sql(
    events: str, spec: MonitoringSpec = STATION_MODE, with_duration: bool = True
) -> str:
    month = _month(spec.event_date)
    critical = f"SUM({_flag(f'{spec.severity} = {_quoted([spec.critical_severity])}')})"
    columns = [
        f"{month} AS {spec.period}",
        spec.entity,
        "COUNT(*) AS event_count",
        f"CAST({critical} AS BIGINT) AS critical_event_count",
    ]
    if with_duration:
        columns.append(f"{_mean(spec.duration)} AS avg_event_duration")
    return f"SELECT {_list(columns)}\nFROM {events}\nGROUP BY {month}, {spec.entity}"


def _core_ctes(readings: str, spec: MonitoringSpec) -> list[tuple[str, str]]:
    return [
        ("monthly", monthly_sql(readings, spec)),
        ("windowed", window_sql("monthly", spec)),
        ("changed", change_sql("windowed", spec)),
        ("marked", flag_sql("changed", spec)),
        ("core", status_sql("marked", spec)),
    ]


def _event_ctes(events: str, spec: MonitoringSpec, with_duration: bool) -> list[tuple[str, str]]:
    match = " AND ".join(f"core.{k} = event_months.{k}" for k in spec.event_grain)
    columns = [
        "core.*",
        "COALESCE(event_months.event_count, 0) AS event_count",
        "COALESCE(event_months.critical_event_count, 0) AS critical_event_count",
        *(["event_months.avg_event_duration"] if with_duration else []),
    ]
    return [
        ("event_months", event_monthly_sql(events, spec, with_duration)),
        ("enriched", f"SELECT {_list(columns)}\nFROM core LEFT JOIN event_months ON {match}"),
    ]


def with_query(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in ctes) + "\n" + final


HAS_FLAGS = (
    f"{_flag('event_count > 0')} AS has_events",
    f"{_flag('critical_event_count > 0')} AS has_critical_events",
)


def mart_ctes(
    readings: str, events: str, spec: MonitoringSpec = STATION_MODE
) -> list[tuple[str, str]]:
    """Common table expressions up to ``mart``, for use under further queries."""
    flags = [
        *HAS_FLAGS,
        f"{_flag('signal_count > 0 AND event_count > 0')} AS problematic_with_events",
        f"{_flag(f'monitoring_status IN ({_quoted(BAD_STATUSES)}) AND event_count > 0')}"
        " AS anomaly_or_critical_with_events",
    ]
    return [
        *_core_ctes(readings, spec),
        *_event_ctes(events, spec, with_duration=True),
        ("mart", f"SELECT *, {_list(flags)}\nFROM enriched"),
    ]


def ml_ctes(readings: str, events: str, spec: MonitoringSpec = STATION) -> list[tuple[str, str]]:
    order = f"(PARTITION BY {', '.join(spec.series_keys)} ORDER BY {spec.period})"
    targets = [
        f"LEAD({c}) OVER {order} AS {c}_next_month" for c in ("has_events", "has_critical_events")
    ]
    return [
        *_core_ctes(readings, spec),
        *_event_ctes(events, spec, with_duration=False),
        ("station_months", f"SELECT *, {_list(HAS_FLAGS)}\nFROM enriched"),
        ("ml_ready", f"SELECT *, {_list(targets)}\nFROM station_months"),
    ]


def monitoring_mart_sql(
    readings: str = "measurements", events: str = "events", spec: MonitoringSpec = STATION_MODE
) -> str:
    return with_query(mart_ctes(readings, events, spec), "SELECT * FROM mart")


def ml_ready_sql(
    readings: str = "measurements", events: str = "events", spec: MonitoringSpec = STATION
) -> str:
    return with_query(ml_ctes(readings, events, spec), "SELECT * FROM ml_ready")
