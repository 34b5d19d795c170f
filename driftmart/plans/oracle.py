"""For each query, SQL that computes the same result on another engine."""

from __future__ import annotations

from driftmart.functions.expressions import ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE
from driftmart.ml.baseline import TARGET, TRAIN_SHARE
from driftmart.plans import ansi
from driftmart.plans.queries import OTHER_SLICE, SLICE, STATION
from driftmart.spec import Metric, MonitoringSpec

# Fixed values, stated here once more so that a wrong one in the package's own spec shows.
SPEC = MonitoringSpec(
    entity="station_id",
    mode="mode",
    period="month_start",
    reading_date="measurement_date",
    metrics=(Metric("pressure", 2), Metric("flow", 2), Metric("temperature", 2), Metric("vibration", 2)),
    flagged=("pressure", "flow"),
    feature_order=("pressure", "flow", "vibration", "temperature"),
    window=3,
    prev_threshold=0.10,
    rolling_threshold=0.10,
    baseline_threshold=0.15,
    event_date="event_date",
    severity="severity",
    critical_severity="critical",
    duration=Metric("duration_hours", 2),
)
STATION_SPEC = SPEC.per_entity()
CORE = """SELECT *, CASE WHEN signal_count = 0 THEN 'stable' WHEN signal_count = 1 THEN 'warning'
  WHEN signal_count IN (2, 3) THEN 'anomaly' ELSE 'critical' END AS monitoring_status
FROM (SELECT *, is_large_pressure_shift_prev + is_large_flow_shift_prev + is_large_pressure_shift_rolling
  + is_large_flow_shift_rolling + is_pressure_anomaly_3_prev + is_flow_anomaly_3_prev AS signal_count
  FROM marked) counted"""
FINAL = """SELECT *, CASE WHEN event_count > 0 THEN 1 ELSE 0 END AS has_events,
  CASE WHEN critical_event_count > 0 THEN 1 ELSE 0 END AS has_critical_events,
  CASE WHEN signal_count > 0 AND event_count > 0 THEN 1 ELSE 0 END AS problematic_with_events,
  CASE WHEN monitoring_status IN ('anomaly', 'critical') AND event_count > 0 THEN 1 ELSE 0 END
    AS anomaly_or_critical_with_events
FROM enriched"""
FEATURES = """avg_pressure avg_flow avg_temperature avg_vibration obs_count
prev_avg_pressure prev_avg_flow prev_avg_temperature prev_avg_vibration
rolling_avg_pressure_3 rolling_avg_flow_3 rolling_avg_temperature_3 rolling_avg_vibration_3
baseline_avg_pressure_3_prev baseline_avg_flow_3_prev baseline_avg_temperature_3_prev baseline_avg_vibration_3_prev
pressure_abs_change pressure_pct_change flow_abs_change flow_pct_change
temperature_abs_change temperature_pct_change vibration_abs_change vibration_pct_change
pressure_vs_rolling_diff pressure_vs_rolling_pct flow_vs_rolling_diff flow_vs_rolling_pct
pressure_vs_baseline_diff pressure_vs_baseline_pct flow_vs_baseline_diff flow_vs_baseline_pct
is_large_pressure_shift_prev is_large_flow_shift_prev is_large_pressure_shift_rolling is_large_flow_shift_rolling
is_pressure_anomaly_3_prev is_flow_anomaly_3_prev signal_count""".split()

STATIONS = """SELECT s_suppkey AS station_id, s_name AS station_name, r_name AS region, n_name AS station_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

MEASUREMENTS = """SELECT l_orderkey * 8 + l_linenumber AS measurement_id, l_suppkey AS station_id,
  CAST(l_shipdate AS DATE) AS measurement_date, l_returnflag AS mode, l_extendedprice AS pressure,
  l_quantity AS flow, l_discount AS temperature, l_tax AS vibration
FROM lineitem"""

EVENTS = """SELECT o_orderkey AS event_id, o_custkey AS station_id, CAST(o_orderdate AS DATE) AS event_date,
  o_orderstatus AS event_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
    WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  o_totalprice AS duration_hours
FROM orders"""

SOURCES = [("mon_stations", STATIONS), ("mon_measurements", MEASUREMENTS), ("mon_events", EVENTS)]
STATED = {"core": CORE, "mart": FINAL}


def _stated(ctes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The common layers, with status rules as stated above."""
    return [(name, STATED.get(name, body)) for name, body in ctes]


MART = [*SOURCES, *_stated(ansi.mart_ctes("mon_measurements", "mon_events", SPEC))]
ML = [*SOURCES, *_stated(ansi.ml_ctes("mon_measurements", "mon_events", STATION_SPEC))]

GRAIN = ", ".join(SPEC.grain)


def _mart(final: str, *more: tuple[str, str]) -> str:
    return ansi.with_query([*MART, *more], final)


def _ml(final: str, *more: tuple[str, str]) -> str:
    return ansi.with_query([*ML, *more], final)


def _metric_status() -> str:
    def case(m: str) -> str:
        return (
            f"CASE WHEN is_{m}_anomaly_3_prev = 1 THEN 'anomaly_vs_baseline'"
            f" WHEN is_large_{m}_shift_rolling = 1 THEN 'large_shift_vs_rolling'"
            f" WHEN is_large_{m}_shift_prev = 1 THEN 'large_shift_vs_prev'"
            f" ELSE 'normal' END AS {m}_monitoring_status"
        )

    return _mart(f"SELECT {GRAIN}, {', '.join(map(case, SPEC.flagged))} FROM marked")


# ---- reconciliation -----------------------------------------------------------

VALUE_COLUMNS = [c for c in SPEC.mart_columns if c not in SPEC.grain]


def _altered() -> str:
    changes = {
        "month_start": "CASE WHEN monitoring_status = 'stable'"
        " THEN CAST(month_start + INTERVAL 100 YEAR AS DATE) ELSE month_start END",
        "avg_flow": "CASE WHEN mode = 'A' THEN avg_flow * CAST(1.000001 AS DOUBLE) ELSE avg_flow END",
        "avg_pressure": "CASE WHEN mode = 'R' THEN avg_pressure * CAST(1.001 AS DOUBLE) ELSE avg_pressure END",
        "monitoring_status": "CASE WHEN has_events = 1 THEN upper(monitoring_status) ELSE monitoring_status END",
        "avg_event_duration": "CASE WHEN monitoring_status <> 'critical' THEN avg_event_duration END",
    }
    columns = ", ".join(f"{changes.get(c, c)} AS {c}" for c in SPEC.mart_columns)
    return f"SELECT {columns} FROM mart WHERE monitoring_status <> 'warning'"


def _pairs() -> str:
    keys = ", ".join(f"COALESCE(a.{k}, b.{k}) AS {k}" for k in SPEC.grain)
    match = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in SPEC.grain)
    values = ", ".join(f"a.{c} AS {c}_pd, b.{c} AS {c}_sql" for c in VALUE_COLUMNS)
    return (
        f"SELECT {keys}, {values}, CASE WHEN a.obs_count IS NULL THEN 'right_only'"
        " WHEN b.obs_count IS NULL THEN 'left_only' ELSE 'both' END AS merge_flag\n"
        f"FROM mart a FULL JOIN altered b ON {match}"
    )


def _checks() -> str:
    def check(c: str) -> str:
        same = f"{c}_pd IS NOT DISTINCT FROM {c}_sql"
        if c == "monitoring_status":
            return f"{same} AS {c}_check"
        near = f"ABS({c}_pd - {c}_sql) <= {ABSOLUTE_TOLERANCE} + {RELATIVE_TOLERANCE} * ABS({c}_sql)"
        return f"({same} OR COALESCE({near}, FALSE)) AS {c}_check"

    checks = ", ".join(map(check, VALUE_COLUMNS))
    return f"SELECT {GRAIN}, merge_flag, {checks} FROM pairs WHERE merge_flag = 'both'"


ALL_CHECKS = " AND ".join(f"{c}_check" for c in VALUE_COLUMNS)
RECONCILE = [
    ("altered", _altered()),
    ("pairs", _pairs()),
    ("checked", _checks()),
    ("verdicts", f"SELECT *, {ALL_CHECKS} AS is_match FROM checked"),
]


def _reconcile(final: str) -> str:
    return _mart(final, *RECONCILE)


def _by_column() -> str:
    return _reconcile(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE NOT {c}_check) AS mismatch_count FROM checked"
            for c in VALUE_COLUMNS
        )
    )


# ---- prediction ---------------------------------------------------------------

COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (TARGET, *FEATURES))
SPLIT = [
    ("cases", f"SELECT * FROM ml_ready WHERE {COMPLETE}"),
    ("months", "SELECT month_start, ROW_NUMBER() OVER (ORDER BY month_start) AS n,"
     " COUNT(*) OVER () AS total FROM (SELECT DISTINCT month_start FROM cases) d"),
    ("split_cases", "SELECT cases.*, CASE WHEN n <= FLOOR(total * CAST("
     f"{TRAIN_SHARE} AS DOUBLE)) THEN 'train' ELSE 'test' END AS split"
     " FROM cases JOIN months ON cases.month_start = months.month_start"),
]


def _slice(metric: str, columns: list[str], entity=None, mode=None) -> str:
    where = f" WHERE station_id = {entity} AND mode = '{mode}'" if mode else ""
    markers = {
        "is_signal_point": "signal_count",
        "is_event_point": "event_count",
        "is_critical_event_point": "critical_event_count",
    }
    names = {"rolling": SPEC.rolling(metric), "baseline": SPEC.baseline(metric)}
    chosen = [
        f"CASE WHEN {markers[c]} > 0 THEN 1 ELSE 0 END AS {c}" if c in markers else names[c]
        for c in columns
    ]
    return _mart(f"SELECT station_id, mode, month_start, avg_{metric}, {', '.join(chosen)} FROM mart{where}")


DIAGNOSTICS = (
    "SELECT month_start, station_id, mode, signal_count, monitoring_status, event_count, critical_event_count,"
    " pressure_pct_change, flow_pct_change, pressure_vs_baseline_pct, flow_vs_baseline_pct FROM mart"
)
BAD_RATE = (
    "SELECT station_id, mode,"
    " CAST(SUM(anomaly_or_critical_with_events) AS BIGINT) AS anomaly_or_critical_event_months,"
    " COUNT(*) AS total_months,"
    " CAST(SUM(anomaly_or_critical_with_events) AS DOUBLE) / COUNT(*) AS anomaly_or_critical_rate"
    " FROM mart GROUP BY station_id, mode"
)
CRITICAL_TOTALS = (
    "SELECT station_id, CAST(SUM(n) AS BIGINT) AS total_critical_events FROM"
    " (SELECT station_id, month_start, MAX(critical_event_count) AS n FROM mart GROUP BY 1, 2) m GROUP BY station_id"
)
COUNT_ALL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM mon_{t}"
    for t in ("stations", "measurements", "events")
)


# The columns of the three raw tables. The test tables have no launch year.
RAW_COLUMNS = {
    "stations": ("station_id", "station_name", "region", "station_type", "launch_year"),
    "measurements": (
        "measurement_id", "station_id", "measurement_date", "mode", "pressure", "flow", "temperature", "vibration",
    ),
    "events": ("event_id", "station_id", "event_date", "event_type", "severity", "duration_hours"),
}
RAW_TYPES = {
    **dict.fromkeys(("station_id", "measurement_id", "event_id"), "bigint"),
    **dict.fromkeys(("measurement_date", "event_date"), "date"),
    **dict.fromkeys(("pressure", "flow", "temperature", "vibration", "duration_hours"), "double"),
    "launch_year": "int",
}


def _load_check(table: str, column: str) -> str:
    kind = RAW_TYPES.get(column, "string")
    value = "NULL" if column == "launch_year" or kind == "string" else column
    value = f"({column} - DATE '1970-01-01')" if kind == "date" else value
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type, COUNT(*) AS row_count,"
        f" {'0' if column == 'launch_year' else f'COUNT({column})'} AS present,"
        f" CAST(MIN({value}) AS DOUBLE) AS smallest, CAST(MAX({value}) AS DOUBLE) AS largest FROM mon_{table}"
    )


LOAD_CHECK = " UNION ALL ".join(
    _load_check(table, column) for table, columns in RAW_COLUMNS.items() for column in columns
)
# Outcomes of the forecast that has_events stays as it is, on the test rows.
PERSISTENCE = (
    "outcomes",
    " SELECT COUNT(*) AS n, " + ", ".join(
        f"COUNT(*) FILTER (WHERE {TARGET} = {truth} AND has_events = {guess}) AS {cell}"
        for cell, truth, guess in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ) + " FROM split_cases WHERE split = 'test'",
)


def _ratio(part: str, whole: str) -> str:
    return f"COALESCE(CAST({part} AS DOUBLE) / NULLIF({whole}, 0), 0)"


# Queries that reach the rows of another one in another way.
SAME_ROWS = {
    "mart_kept_up": "monitoring_mart",
    "ml_ready_kept_up": "ml_ready",
    "reconcile_saved_summary": "reconcile_summary",
    "reconcile_saved_mismatches": "reconcile_mismatches",
    "reconcile_saved_by_column": "reconcile_by_column",
    "csv_observed_check": "csv_load_check",
}


def oracle_sql() -> dict[str, str]:
    sql = _oracle_sql()
    return sql | {name: sql[other] for name, other in SAME_ROWS.items()}


def _oracle_sql() -> dict[str, str]:
    sums = {
        SPEC.prev_flag: "large_{}_prev",
        SPEC.rolling_flag: "large_{}_rolling",
        SPEC.baseline_flag: "{}_anomaly_prev",
    }
    totals = ", ".join(
        f"CAST(SUM({flag(m)}) AS BIGINT) AS {name.format(m)}" for flag, name in sums.items() for m in SPEC.flagged
    )
    features = ", ".join(FEATURES)
    return {
        "row_counts": ansi.with_query(SOURCES, COUNT_ALL),
        "csv_load_check": ansi.with_query(SOURCES, LOAD_CHECK),
        "csv_load_row_counts": ansi.with_query(SOURCES, COUNT_ALL),
        "table_profile": ansi.with_query(
            SOURCES,
            "SELECT 'measurements' AS table_name, COUNT(*) AS row_count, 8 AS column_count,"
            " MIN(measurement_date) AS min_date, MAX(measurement_date) AS max_date FROM mon_measurements UNION ALL"
            " SELECT 'events', COUNT(*), 6, MIN(event_date), MAX(event_date) FROM mon_events",
        ),
        "saved_profile": " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, COUNT(*) AS row_count, {columns} AS column_count,"
            f" MIN(month_start) AS min_date, MAX(month_start) AS max_date FROM ({rows})"
            for table, columns, rows in (
                ("monitoring", 51, _mart("SELECT * FROM mart")),
                ("ml_ready", 49, _ml("SELECT * FROM ml_ready")),
            )
        ),
        "measurements_head": ansi.with_query(
            SOURCES, "SELECT * FROM mon_measurements ORDER BY measurement_id LIMIT 3"
        ),
        "monthly_head": _mart("SELECT * FROM monthly ORDER BY station_id, mode, month_start LIMIT 3"),
        "csv_mart_roundtrip": _mart("SELECT * FROM mart"),
        "parquet_ml_roundtrip": _ml("SELECT * FROM ml_ready"),
        "grain_duplicates": ansi.with_query(
            SOURCES,
            "SELECT m.* FROM mon_measurements m JOIN (SELECT station_id, measurement_date, mode"
            " FROM mon_measurements GROUP BY 1, 2, 3 HAVING COUNT(*) > 1) d ON m.station_id = d.station_id"
            " AND m.measurement_date = d.measurement_date AND m.mode = d.mode",
        ),
        "distinct_months": _mart("SELECT DISTINCT month_start FROM monthly"),
        "monthly_metrics": _mart("SELECT * FROM monthly"),
        "station_month_metrics": _ml("SELECT * FROM monthly"),
        "window_features": _mart("SELECT * FROM windowed"),
        "station_window_features": _ml("SELECT * FROM windowed"),
        "change_features": _mart(f"SELECT {GRAIN}, {', '.join(SPEC.change_columns)} FROM changed"),
        "signal_flags": _mart(f"SELECT {GRAIN}, {', '.join(SPEC.flag_columns)} FROM marked"),
        "signal_status": _mart(f"SELECT {GRAIN}, signal_count, monitoring_status FROM core"),
        "metric_status": _metric_status(),
        "monitoring_core": _mart("SELECT * FROM core"),
        "event_monthly": _mart("SELECT * FROM event_months"),
        "event_monthly_counts": _ml("SELECT * FROM event_months"),
        "event_enrichment": _mart(
            "SELECT monthly.*, COALESCE(e.event_count, 0) AS event_count,"
            " COALESCE(e.critical_event_count, 0) AS critical_event_count, e.avg_event_duration,"
            " CASE WHEN e.station_id IS NULL THEN 'left_only' ELSE 'both' END AS row_origin"
            " FROM monthly LEFT JOIN event_months e"
            " ON monthly.station_id = e.station_id AND monthly.month_start = e.month_start"
        ),
        "monitoring_mart": _mart("SELECT * FROM mart"),
        "bad_status_rate_topk": _mart(
            f"{BAD_RATE} ORDER BY anomaly_or_critical_rate DESC, anomaly_or_critical_event_months DESC,"
            " mode, station_id LIMIT 5"
        ),
        "bad_status_rate_all": _mart(BAD_RATE),
        "critical_events_topk": _mart(
            f"{CRITICAL_TOTALS} ORDER BY total_critical_events DESC, station_id LIMIT 5"
        ),
        "critical_events_all": _mart(CRITICAL_TOTALS),
        "mode_overlap_rate": _mart(
            "SELECT mode, CAST(SUM(problematic_with_events) AS BIGINT) AS problematic_with_events_months,"
            " COUNT(*) AS total_rows,"
            " CAST(SUM(problematic_with_events) AS DOUBLE) / COUNT(*) AS problematic_with_events_rate"
            " FROM mart GROUP BY mode ORDER BY 4 DESC, 2 DESC, 1 LIMIT 5"
        ),
        "status_distribution": _mart(
            "SELECT monitoring_status, COUNT(*) AS row_count FROM mart GROUP BY monitoring_status"
        ),
        "signal_totals": _mart(f"SELECT {totals} FROM mart"),
        "overlap_counts": _mart(
            "SELECT COUNT(*) FILTER (WHERE event_count > 0) AS rows_with_events,"
            " COUNT(*) FILTER (WHERE signal_count > 0) AS rows_with_signals,"
            " COUNT(*) FILTER (WHERE signal_count > 0 AND event_count > 0) AS rows_with_signals_and_events,"
            " COUNT(*) FILTER (WHERE signal_count >= 2) AS rows_with_bad_status,"
            " COUNT(*) FILTER (WHERE signal_count >= 2 AND event_count > 0) AS rows_with_bad_status_and_events"
            " FROM mart"
        ),
        "station_diagnostics": _mart(f"{DIAGNOSTICS} WHERE station_id = {STATION}"),
        "all_station_diagnostics": _mart(DIAGNOSTICS),
        "pressure_trend": _slice("pressure", ["rolling", "baseline"]),
        "pressure_signal_points": _slice("pressure", ["rolling", "is_signal_point"]),
        "pressure_event_points": _slice("pressure", ["rolling", "is_event_point", "is_critical_event_point"]),
        "pressure_slice": _slice(
            "pressure", ["rolling", "baseline", "is_event_point", "is_signal_point"], **SLICE
        ),
        "flow_slice": _slice(
            "flow", ["rolling", "baseline", "is_event_point", "is_signal_point"], **OTHER_SLICE
        ),
        "reconcile_implementations": _mart(
            "SELECT COUNT(*) AS rows_matched, CAST(0 AS BIGINT) AS left_only_rows,"
            " CAST(0 AS BIGINT) AS right_only_rows, CAST(0 AS BIGINT) AS mismatch_rows FROM mart"
        ),
        "reconcile_summary": _reconcile(
            "SELECT COUNT(*) FILTER (WHERE merge_flag = 'both') AS rows_matched,"
            " COUNT(*) FILTER (WHERE merge_flag = 'left_only') AS left_only_rows,"
            " COUNT(*) FILTER (WHERE merge_flag = 'right_only') AS right_only_rows,"
            " (SELECT COUNT(*) FROM verdicts WHERE NOT is_match) AS mismatch_rows FROM pairs"
        ),
        "reconcile_origins": _reconcile("SELECT merge_flag, COUNT(*) AS row_count FROM pairs GROUP BY merge_flag"),
        "reconcile_inner_origins": _reconcile(
            "SELECT merge_flag, COUNT(*) AS row_count FROM pairs WHERE merge_flag = 'both' GROUP BY merge_flag"
        ),
        "reconcile_mismatches": _reconcile("SELECT * FROM verdicts WHERE NOT is_match"),
        "reconcile_mismatch_origins": _reconcile(
            "SELECT merge_flag, COUNT(*) AS row_count FROM verdicts WHERE NOT is_match GROUP BY merge_flag"
        ),
        "reconcile_by_column": _by_column(),
        "ml_ready": _ml("SELECT * FROM ml_ready"),
        "report_totals": _mart(
            "SELECT station_id, mode, monitoring_status, COUNT(*) AS row_count,"
            " COUNT(*) FILTER (WHERE signal_count >= 2 AND event_count > 0) AS bad_with_events,"
            " COUNT(*) FILTER (WHERE signal_count > 0 AND event_count > 0) AS problematic_with_events,"
            " COUNT(*) FILTER (WHERE event_count > 0) AS rows_with_events,"
            " COUNT(*) FILTER (WHERE signal_count > 0) AS rows_with_signals,"
            " COUNT(*) FILTER (WHERE signal_count > 0 AND event_count > 0) AS rows_with_signals_and_events, "
            + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in SPEC.flag_columns)
            + " FROM mart GROUP BY station_id, mode, monitoring_status"
        ),
        "ml_complete_cases": _ml(f"SELECT month_start, station_id, {features}, {TARGET} FROM cases", *SPLIT),
        "ml_time_split": _ml("SELECT month_start, station_id, split FROM split_cases", *SPLIT),
        "ml_split_summary": _ml(
            "SELECT split, COUNT(*) AS row_count, 49 AS column_count, MIN(month_start) AS first_month,"
            " MAX(month_start) AS last_month FROM split_cases GROUP BY split",
            *SPLIT,
        ),
        "ml_persistence_metrics": _ml(
            f"SELECT {_ratio('tp + tn', 'n')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision,"
            f" {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM outcomes",
            *SPLIT,
            PERSISTENCE,
        ),
        "ml_persistence_confusion": _ml(
            " UNION ALL ".join(
                f"SELECT {truth} AS truth, {guess} AS prediction, {cell} AS row_count FROM outcomes"
                for cell, truth, guess in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
            ),
            *SPLIT,
            PERSISTENCE,
        ),
        "ml_test_truth": _ml(
            f"SELECT {TARGET} AS truth, COUNT(*) AS row_count, MIN(month_start) AS first_month,"
            f" MAX(month_start) AS last_month FROM split_cases WHERE split = 'test' GROUP BY {TARGET}",
            *SPLIT,
        ),
        "ml_fit_check": " UNION ALL ".join(f"SELECT '{c}' AS feature, TRUE AS is_stationary" for c in FEATURES),
    }
