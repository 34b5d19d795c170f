"""Figures measured independently, at a coarser mapping: a station is a nation."""

import pytest

from driftmart.operators import analysis
from driftmart.operators.quality import row_counts
from driftmart.plans import mart
from driftmart.sources import star


@pytest.fixture(scope="module")
def core(spark, medium):
    nations = spark.read.parquet(f"{medium}/supplier.parquet").selectExpr(
        "s_suppkey AS station_id", "s_nationkey"
    )
    readings = (
        star.measurements(spark, medium)
        .join(nations, "station_id")
        .withColumn("station_id", nations["s_nationkey"])
        .drop("s_nationkey")
    )
    return mart.monitoring_core(readings, star.SPEC).cache()


def test_rows_and_statuses(core):
    assert core.count() == 6145
    assert dict(map(tuple, analysis.status_distribution(core).collect())) == {
        "stable": 366,
        "warning": 590,
        "anomaly": 1938,
        "critical": 3251,
    }


def test_signal_totals(core):
    # previous, rolling, baseline; pressure and flow each
    assert tuple(analysis.signal_totals(core, star.SPEC).first()) == (4357, 4381, 3347, 3277, 3264, 3087)


def test_rows_per_mode(core):
    assert {r["mode"]: r["count"] for r in core.groupBy("mode").count().collect()} == {
        "A": 2047,
        "N": 2055,
        "R": 2043,
    }


def test_gaps_are_present(core):
    previous = "lag(month_start) OVER (PARTITION BY station_id, mode ORDER BY month_start)"
    gaps = core.selectExpr("month_start", f"{previous} AS p").where("p <> add_months(month_start, -1)")
    assert gaps.count() == 48


def test_invariants_of_the_full_mart(spark, medium):
    t = star.tables(spark, medium)
    full = mart.monitoring_mart(t.measurements, t.events, star.SPEC).cache()
    rows = full.count()
    assert rows == 22454
    assert sum(r.row_count for r in analysis.status_distribution(full).collect()) == rows
    modes = analysis.mode_overlap_rate(full, star.SPEC).collect()
    assert sum(r.total_rows for r in modes) == rows
    overlaps = analysis.overlap_counts(full).first()
    assert overlaps.rows_with_events == 2554
    both = sum(r.problematic_with_events_months for r in modes)
    assert both == overlaps.rows_with_signals_and_events
    assert both <= min(overlaps.rows_with_events, overlaps.rows_with_signals)
    totals = analysis.signal_totals(full, star.SPEC).first()
    assert sum(totals) == full.selectExpr("sum(signal_count)").first()[0]
    readings = row_counts({"m": t.measurements}).first().row_count
    assert full.selectExpr("sum(obs_count)").first()[0] == readings == 60000
