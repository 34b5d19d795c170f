import pytest
from tables import events, readings

from driftmart.operators import quality, reconcile
from driftmart.operators.events import enrich_with_events
from driftmart.plans import ansi, mart, pipeline
from driftmart.sources.files import read_csv, register_views
from driftmart.spec import STATION


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (s, f"2024-{m:02d}-{d:02d}", mode, 100.0 + 37 * ((s * m * d) % 7), 10.0 + (m * d) % 5, 20.0 + d, 0.5 * m)
        for s in (1, 2, 3)
        for m in (1, 2, 3, 5, 6, 7)
        for d, mode in ((1, "normal"), (2, "normal"), (3, "repair"))
    ]
    log = [
        (s, f"2024-{m:02d}-11", sev, 1.5 * m)
        for s, m, sev in ((1, 2, "low"), (1, 2, "critical"), (2, 6, "high"), (4, 1, "critical"))
    ]
    return {"measurements": readings(spark, rows), "events": events(spark, log)}


@pytest.fixture(scope="module")
def saved(tables, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("marts"))
    return target, pipeline.build(tables, target, csv=True)


def test_saved_marts(spark, saved):
    target, frames = saved
    assert frames["monitoring"].count() == 3 * 6 * 2
    assert frames["ml_ready"].count() == 3 * 6
    exported = read_csv(spark, f"{target}/monitoring.csv", frames["monitoring"].schema)
    assert sorted(map(str, exported.collect())) == sorted(map(str, frames["monitoring"].collect()))


def test_marts_from_saved_sums_equal_the_direct_ones(spark, tables, saved):
    readings, log = tables["measurements"], tables["events"]
    for name, direct in (("monitoring", mart.monitoring_mart(readings, log)), ("ml_ready", mart.ml_ready(readings, log))):
        assert saved[1][name].columns == direct.columns
        keys = [c for c in ("station_id", "mode", "month_start") if c in direct.columns]
        mine, theirs = (df.orderBy(*keys).collect() for df in (saved[1][name], direct))
        for a, b in zip(mine, theirs, strict=True):
            # sums of sums may differ in the last bit
            assert all(x == y or x == pytest.approx(y, rel=1e-12) for x, y in zip(a, b, strict=True))


def test_saved_sums_hold_every_reading_and_event(spark, tables, saved):
    sums = spark.read.parquet(f"{saved[0]}/monthly_sums")
    assert sums.agg({"obs_count": "sum"}).first()[0] == tables["measurements"].count()
    assert spark.read.parquet(f"{saved[0]}/event_months").agg({"event_count": "sum"}).first()[0] == 4


def test_nan_is_missing_in_both_formulations(spark):
    nan = float("nan")
    rows = [(1, "2024-01-01", "normal", 1.0, nan, 3.0, 4.0), (1, "2024-01-02", "normal", 2.0, 5.0, nan, 4.0)]
    tables = {"measurements": readings(spark, rows), "events": events(spark, [(1, "2024-01-05", "low", nan)])}
    frames = [mart.monitoring_mart(tables["measurements"], tables["events"]), pipeline.mart_by_sql(spark, tables)]
    for frame in frames:
        row = frame.first()
        assert (row.avg_pressure, row.avg_flow, row.avg_temperature) == (1.5, 5.0, 3.0)
        assert (row.avg_event_duration, row.event_count, row.signal_count) == (None, 1, 0)


def test_mismatch_detail(spark, tables, saved):
    altered = saved[1]["monitoring"].selectExpr(
        *[
            "CASE WHEN station_id = 1 THEN avg_flow + 1 ELSE avg_flow END AS avg_flow" if c == "avg_flow" else c
            for c in saved[1]["monitoring"].columns
        ]
    )
    detail = pipeline.mismatches(spark, altered, tables)
    assert detail["mismatches"].count() == 12
    worst = detail["mismatches_by_column"].first()
    assert (worst.column_name, worst.mismatch_count) == ("avg_flow", 12)
    assert [tuple(r) for r in detail["origins"].collect()] == [("both", 36)]


def test_second_formulation_agrees(spark, tables, saved):
    assert tuple(pipeline.verify(spark, saved[1]["monitoring"], tables).first()) == (36, 0, 0, 0)


def test_sql_over_views(spark, tables):
    register_views(tables)
    by_sql = spark.sql(ansi.ml_ready_sql())
    by_frame = mart.ml_ready(tables["measurements"], tables["events"])
    assert set(by_sql.columns) == set(by_frame.columns)
    columns = by_frame.columns
    assert by_sql.select(columns).exceptAll(by_frame).count() == 0 == by_frame.exceptAll(by_sql.select(columns)).count()
    counts = spark.sql(
        f"WITH m AS ({ansi.monitoring_mart_sql()}) SELECT count(*) FILTER (WHERE event_count > 0) AS n,"
        " avg(has_events::double) AS share FROM m"
    ).first()
    assert (counts.n, counts.share) == (4, pytest.approx(4 / 36))


def test_reports(saved):
    results = {name: df.collect() for name, df in pipeline.reports(saved[1]["monitoring"]).items()}
    assert results["grain_duplicates"] == []
    assert results["critical_events"][0].total_critical_events == 1
    assert sum(r.row_count for r in results["status_distribution"]) == 36
    assert len(results["diagnostics"]) == len(results["pressure_series"]) == len(results["flow_series"]) == 36


def test_existing_results_are_not_overwritten(tables, saved):
    with pytest.raises(Exception, match="already exists"):
        pipeline.build(tables, saved[0])


def test_station_grain_has_no_mode(tables):
    assert "mode" not in mart.ml_ready(tables["measurements"], tables["events"], STATION).columns


def test_reports_scan_the_mart_twice(spark, saved):
    """Once for the totals of five reports, once for the critical events; the rest is per row."""
    results = pipeline.reports(saved[1]["monitoring"])
    for name in ("bad_status_rate", "mode_overlap_rate", "status_distribution", "signal_totals", "overlap_counts"):
        plan = results[name]._jdf.queryExecution().executedPlan().toString()
        assert "report-totals" in plan or "avg_pressure" not in plan
        assert "month_start" not in plan


def test_profile_from_footers_reads_no_rows(spark, saved):
    folders = {name: (f"{saved[0]}/{name}", "month_start") for name in ("monitoring", "ml_ready")}
    found = quality.saved_profile(spark, folders)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*), MIN(month_start), MAX(month_start)]") == 2
    direct = quality.table_profile({name: (saved[1][name], "month_start") for name in folders})
    assert sorted(found.collect()) == sorted(direct.collect())
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_load_check_without_another_pass(spark, tables, tmp_path):
    load = quality.ObservedLoad()
    watched = {name: load.watch(name, tables[name]) for name in ("measurements", "events")}
    pipeline.build(watched, str(tmp_path))
    assert sorted(map(str, load.check(spark).collect())) == sorted(map(str, quality.load_check(tables).collect()))


def test_bucketed_tables_join_without_an_exchange(spark, tables, saved, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pipeline.build_bucketed(tables, str(tmp_path), buckets=4, prefix="test_bucketed_")
        for name, df in found.items():
            expected = saved[1][name]
            assert sorted(map(str, df.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
        stored = {name: spark.table(f"test_bucketed_{name}") for name in ("monthly_sums", "event_months")}
        marts = pipeline.bucketed_marts(stored["monthly_sums"], stored["event_months"])
        against_itself = reconcile.merged(
            found["monitoring"], marts["monitoring"], ("month_start", "station_id", "mode"), never_null=("station_id",)
        )
        with_events = enrich_with_events(
            found["monitoring"].select("month_start", "station_id", "mode"), stored["event_months"]
        )
        for df in (*marts.values(), against_itself, with_events):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert tuple(reconcile.summary(against_itself).first()) == (36, 0, 0, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("monthly_sums", "event_months", "monitoring", "ml_ready"):
            spark.sql(f"DROP TABLE IF EXISTS test_bucketed_{name}")
