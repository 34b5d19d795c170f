import pytest
from tables import events, readings

from driftmart import STATION_MODE, monitoring_mart
from driftmart.operators import analysis, quality, series


@pytest.fixture(scope="module")
def mart(spark):
    rows = []
    for station, factor in ((1, 2.0), (2, 1.0)):
        for mode in ("normal", "repair"):
            for month in range(1, 7):
                jump = factor if month % 2 else 1.0
                rows.append((station, f"2024-{month:02d}-05", mode, 100.0 * jump, 10.0))
    log = [
        (1, "2024-03-01", "critical", 1.0),
        (1, "2024-03-09", "critical", 3.0),
        (1, "2024-04-01", "critical", 1.0),
        (2, "2024-05-01", "critical", 1.0),
        (2, "2024-05-02", "low", 1.0),
    ]
    return monitoring_mart(readings(spark, rows), events(spark, log)).cache()


def test_critical_events_are_not_multiplied_by_modes(mart):
    assert [tuple(r) for r in analysis.critical_events_by_entity(mart).collect()] == [(1, 3), (2, 1)]


def test_bad_status_rate(mart):
    rows = [tuple(r) for r in analysis.bad_status_rate(mart).collect()]
    assert rows == [
        (1, "normal", 2, 6, pytest.approx(1 / 3, abs=1e-15)),
        (1, "repair", 2, 6, pytest.approx(1 / 3, abs=1e-15)),
        (2, "normal", 0, 6, 0.0),
        (2, "repair", 0, 6, 0.0),
    ]
    assert len(analysis.bad_status_rate(mart, limit=1).collect()) == 1


def test_mode_overlap_rate(mart):
    assert [tuple(r) for r in analysis.mode_overlap_rate(mart).collect()] == [
        ("normal", 2, 12, 2 / 12),
        ("repair", 2, 12, 2 / 12),
    ]


def test_distribution_is_sorted_and_complete(mart):
    rows = [tuple(r) for r in analysis.status_distribution(mart).collect()]
    assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sum(n for _, n in rows) == mart.count() == 24


def test_totals_agree_with_signal_counts(mart):
    totals = analysis.signal_totals(mart).first()
    assert sum(totals) == mart.selectExpr("sum(signal_count)").first()[0]
    assert totals.large_flow_prev == totals.flow_anomaly_prev == 0


def test_overlaps_are_consistent(mart):
    o = analysis.overlap_counts(mart).first()
    assert o.rows_with_events == 6
    assert o.rows_with_signals_and_events <= min(o.rows_with_events, o.rows_with_signals)
    assert o.rows_with_signals == mart.where("monitoring_status <> 'stable'").count()
    assert o.rows_with_bad_status == mart.where("signal_count > 1").count()


def test_diagnostics(mart):
    one = analysis.diagnostics(mart, entity=1).collect()
    assert {r.station_id for r in one} == {1} and len(one) == 12
    assert [(r.month_start, r["mode"]) for r in one] == sorted((r.month_start, r["mode"]) for r in one)
    assert len(one[0]) == 11
    assert analysis.diagnostics(mart).count() == 24


def test_series(mart):
    points = series.monitoring_series(
        mart, "pressure", entity=1, mode="repair", markers=tuple(series.MARKERS)
    ).collect()
    assert len(points) == 6
    march = points[2]
    assert (march.is_signal_point, march.is_event_point, march.is_critical_event_point) == (1, 1, 1)
    assert (points[0].is_signal_point, points[0].is_event_point) == (0, 0)
    assert series.monitoring_series(mart, "flow").count() == 24
    assert "rolling_avg_flow_3" not in series.monitoring_series(mart, "flow", with_rolling=False).columns


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b")], "k int, m string")
    found = quality.grain_duplicates(df, ["k", "m"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a"), (1, "a"), (None, "b"), (None, "b")]
    assert quality.grain_duplicates(df.distinct(), ["k", "m"]).count() == 0


def test_unique_grain_is_required(spark, mart):
    quality.require_unique(mart, STATION_MODE.grain)
    with pytest.raises(ValueError, match="not unique"):
        quality.require_unique(mart.unionByName(mart.where("station_id = 1")), STATION_MODE.grain)


def test_counts_profile_head(spark, mart):
    counts = quality.row_counts({"mart": mart, "half": mart.where("station_id = 1")})
    assert {tuple(r) for r in counts.collect()} == {("mart", 24), ("half", 12)}
    profile = quality.table_profile({"mart": (mart, "month_start")}).first()
    assert (profile.row_count, profile.column_count) == (24, 51)
    assert (str(profile.min_date), str(profile.max_date)) == ("2024-01-01", "2024-06-01")
    first = quality.head(mart, 3, *STATION_MODE.series_keys, "month_start").collect()
    assert [str(r.month_start) for r in first] == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert dict(quality.column_types(mart))["month_start"] == "date"


def test_reports_from_one_scan_equal_the_direct_ones(spark, mart):
    totals = analysis.report_totals(mart)
    direct = {
        "bad_status_rate": analysis.bad_status_rate(mart),
        "mode_overlap_rate": analysis.mode_overlap_rate(mart),
        "status_distribution": analysis.status_distribution(mart),
        "signal_totals": analysis.signal_totals(mart),
        "overlap_counts": analysis.overlap_counts(mart),
    }
    found = analysis.reports_of(totals)
    assert list(found) == list(direct)
    for name, expected in direct.items():
        assert found[name].columns == expected.columns
        assert found[name].dtypes == expected.dtypes
        assert found[name].collect() == expected.collect()
    nothing = mart.where("station_id = 99")
    empty = analysis.reports_of(analysis.report_totals(nothing))
    assert empty["overlap_counts"].first() == analysis.overlap_counts(nothing).first()
    assert empty["signal_totals"].first() == analysis.signal_totals(nothing).first()
