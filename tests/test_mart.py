import math
from datetime import date

import pytest
from tables import by_month, events, readings

from driftmart import STATION, STATION_MODE, ml_ready, monitoring_core, monitoring_mart
from driftmart.operators.metrics import monthly_metrics
from driftmart.operators.signals import metric_status
from driftmart.plans import mart as plans
from driftmart.sources.files import clean_numbers

PRESSURE = [  # April is absent, June averages zero
    ("2024-01-10", 100.0),
    ("2024-02-10", 110.0),
    ("2024-03-10", 110.0),
    ("2024-05-10", 90.0),
    ("2024-06-10", 0.0),
    ("2024-07-10", 10.0),
]


def one_series(spark, flow=None):
    return readings(spark, [(1, d, "normal", p, p if flow is None else flow) for d, p in PRESSURE])


def approx(rows):
    return [tuple(v if v is None else pytest.approx(v, rel=1e-5) for v in row) for row in rows]


def test_hand_computed_features(spark):
    core = monitoring_core(one_series(spark, flow=5.0))
    values = by_month(
        core,
        "prev_avg_pressure",
        "rolling_avg_pressure_3",
        "baseline_avg_pressure_3_prev",
        "pressure_pct_change",
        "pressure_vs_rolling_pct",
        "pressure_vs_baseline_pct",
    )
    assert values == approx(
        [
            (None, 100, None, None, 0, None),
            (100, 105, 100, 0.1, 0.047619, 0.1),
            (110, 106.66667, 105, 0, 0.03125, 0.047619),
            (110, 103.33333, 106.66667, -0.181818, -0.129032, -0.15625),
            (90, 66.66667, 103.33333, -1, -1, -1),
            (0, 33.33333, 66.66667, None, -0.7, -0.85),
        ]
    )


def test_hand_computed_signals(spark):
    constant = by_month(
        monitoring_core(one_series(spark, flow=5.0)),
        "is_large_pressure_shift_prev",
        "is_large_pressure_shift_rolling",
        "is_pressure_anomaly_3_prev",
        "signal_count",
        "monitoring_status",
    )
    assert constant == [
        (0, 0, 0, 0, "stable"),
        (1, 0, 0, 1, "warning"),
        (0, 0, 0, 0, "stable"),
        (1, 1, 1, 3, "anomaly"),
        (1, 1, 1, 3, "anomaly"),
        (0, 1, 1, 2, "anomaly"),
    ]
    equal = by_month(monitoring_core(one_series(spark)), "signal_count", "monitoring_status")
    assert equal == [
        (0, "stable"),
        (2, "anomaly"),
        (0, "stable"),
        (6, "critical"),
        (6, "critical"),
        (4, "critical"),
    ]


def test_metric_status_priority(spark):
    flags = plans.flagged(plans.monthly(one_series(spark, flow=5.0)))
    statuses = by_month(metric_status(flags), "pressure_monitoring_status", "flow_monitoring_status")
    assert [s for s, _ in statuses] == [
        "normal",
        "large_shift_vs_prev",
        "normal",
        "anomaly_vs_baseline",
        "anomaly_vs_baseline",
        "anomaly_vs_baseline",
    ]
    assert {f for _, f in statuses} == {"normal"}


def test_rolling_status_outranks_previous(spark):
    rows = [("2024-01-01", 100.0), ("2024-02-01", 100.0), ("2024-03-01", 119.0), ("2024-04-01", 92.0)]
    flags = plans.flagged(plans.monthly(readings(spark, [(1, d, "n", p, 1.0) for d, p in rows])))
    last = by_month(metric_status(flags), "pressure_monitoring_status")[-1][0]
    assert last == "large_shift_vs_rolling"


def test_columns_and_types(spark):
    mart = monitoring_mart(one_series(spark), events(spark, [(1, "2024-01-05", "low", 2.0)]))
    assert len(mart.columns) == 51
    assert tuple(mart.columns) == STATION_MODE.mart_columns
    types = dict(mart.dtypes)
    assert types["month_start"] == "date"
    assert types["obs_count"] == types["event_count"] == types["critical_event_count"] == "bigint"
    assert types["signal_count"] == types["has_events"] == "int"
    assert len(ml_ready(one_series(spark), events(spark, [])).columns) == 49
    assert len(STATION.model_features) == len(set(STATION.model_features)) == 40


def test_events_join_and_flags(spark):
    log = [
        (1, "2024-02-01", "critical", 4.0),
        (1, "2024-02-20", "low", 2.0),
        (1, "2024-02-21", "low", 3.0),
        (1, "2024-03-02", "high", 1.0),
        (1, "2024-04-05", "critical", 9.0),  # a month without readings
        (2, "2024-02-05", "critical", 9.0),  # a station without readings
    ]
    two_modes = one_series(spark, flow=5.0).unionByName(
        readings(spark, [(1, "2024-02-03", "peak", 50.0, 5.0)])
    )
    mart = monitoring_mart(two_modes, events(spark, log))
    assert mart.count() == 7
    rows = {(str(r.month_start), r["mode"]): r for r in mart.collect()}
    for mode in ("normal", "peak"):  # event columns repeat on every mode row
        r = rows["2024-02-01", mode]
        assert (r.event_count, r.critical_event_count, r.avg_event_duration) == (3, 1, 3.0)
        assert (r.has_events, r.has_critical_events) == (1, 1)
    assert rows["2024-02-01", "normal"].problematic_with_events == 1
    assert rows["2024-02-01", "peak"].problematic_with_events == 0
    assert rows["2024-02-01", "normal"].anomaly_or_critical_with_events == 0
    quiet = rows["2024-01-01", "normal"]
    assert (quiet.event_count, quiet.critical_event_count, quiet.avg_event_duration) == (0, 0, None)
    march = rows["2024-03-01", "normal"]
    assert (march.has_events, march.has_critical_events, march.problematic_with_events) == (1, 0, 0)


def test_targets_take_the_next_month_present(spark):
    log = events(spark, [(1, "2024-03-01", "low", 1.0), (1, "2024-05-01", "critical", 1.0)])
    table = ml_ready(one_series(spark), log)
    assert by_month(table, "has_events_next_month", "has_critical_events_next_month") == [
        (0, 0),
        (1, 0),
        (1, 1),
        (0, 0),
        (0, 0),
        (None, None),
    ]


def test_modes_and_stations_are_separate_series(spark):
    table = readings(
        spark,
        [
            (1, "2024-01-01", "a", 1.0, 1.0),
            (1, "2024-02-01", "b", 5.0, 1.0),
            (2, "2024-02-01", "a", 9.0, 1.0),
        ],
    )
    assert [r.prev_avg_pressure for r in monitoring_core(table).collect()] == [None] * 3
    by_station = monitoring_core(table, STATION).where("station_id = 1")
    assert by_month(by_station, "prev_avg_pressure") == [(None,), (1.0,)]


def test_averages_are_not_weighted_across_months(spark):
    rows = [(1, "2024-01-01", "a", 10.0, 1.0)] + [
        (1, f"2024-02-{d:02d}", "a", 40.0, 1.0) for d in range(1, 10)
    ]
    last = by_month(monitoring_core(readings(spark, rows)), "obs_count", "rolling_avg_pressure_3")[-1]
    assert last == (9, 25.0)


def test_missing_readings(spark):
    table = readings(
        spark,
        [
            (1, "2024-01-01", "a", float("nan"), 1.0),
            (1, "2024-01-02", "a", 4.0, 1.0),
            (1, "2024-02-01", "a", None, 1.0),
            (None, "2024-01-01", "a", 2.0, 1.0),
        ],
    )
    core = monitoring_core(clean_numbers(table))
    assert by_month(core.where("station_id = 1"), "avg_pressure", "obs_count", "signal_count") == [
        (4.0, 2, 0),
        (None, 1, 0),
    ]
    assert core.where("station_id IS NULL").count() == 1


def test_declared_decimals_make_sums_exact(spark):
    prices = [0.1, 0.2, 0.3, 1e9 + 0.7, -1e9]
    table = readings(spark, [(1, f"2024-01-0{i + 1}", "a", p, 1.0) for i, p in enumerate(prices)])
    exact = STATION_MODE.with_decimals(pressure=2)
    results = {
        monthly_metrics(part, exact).first()["avg_pressure"]
        for part in (table.repartition(1), table.repartition(5), table.orderBy("pressure"))
    }
    assert results == {1.3 / 5}
    assert not math.isnan(monthly_metrics(table).first()["avg_pressure"])


def test_thresholds_are_parameters(spark):
    from dataclasses import replace

    strict = replace(STATION_MODE, prev_threshold=0.5, rolling_threshold=0.5, baseline_threshold=0.5)
    counts = by_month(monitoring_core(one_series(spark, flow=5.0), strict), "signal_count")
    assert [c for (c,) in counts] == [0, 0, 0, 0, 3, 2]


def test_month_bucket(spark):
    monthly = monthly_metrics(
        readings(spark, [(1, "2024-02-29", "a", 1.0, 1.0), (1, "2024-02-01", "a", 3.0, 1.0)])
    )
    assert [(r.month_start, r.avg_pressure) for r in monthly.collect()] == [(date(2024, 2, 1), 2.0)]


@pytest.mark.parametrize("decimals", [None, 2])
def test_nan_reading_counts_as_missing(spark, decimals):
    spec = STATION_MODE if decimals is None else STATION_MODE.with_decimals(pressure=decimals)
    rows = readings(spark, [(1, "2024-01-10", "normal", float("nan"), 1.0), (1, "2024-01-11", "normal", 5.0, 1.0)])
    assert monthly_metrics(rows, spec).first()["avg_pressure"] == 5.0
    assert monitoring_mart(rows, events(spark, []), spec).first()["avg_pressure"] == 5.0


def test_reading_off_the_declared_grid_fails(spark):
    rows = readings(spark, [(1, "2024-01-10", "normal", 0.004, 1.0)])
    with pytest.raises(Exception, match="pressure has more than 2 decimals"):
        monthly_metrics(rows, STATION_MODE.with_decimals(pressure=2)).collect()
    assert monthly_metrics(rows, STATION_MODE.with_decimals(pressure=3)).first()["avg_pressure"] == 0.004
