"""The plans are the ones meant for large data."""

import re

import pytest

import __spark_entry__ as contract

from driftmart.plans import mart
from driftmart.plans.queries import REGISTRY
from driftmart.sources import star

EAGER = {"saved_profile", "csv_observed_check", "mart_kept_up", "ml_ready_kept_up", "reconcile_saved_summary", "reconcile_saved_mismatches", "reconcile_saved_by_column"} | { "csv_load_row_counts", "csv_load_check", "csv_mart_roundtrip", "parquet_ml_roundtrip"} | {
    "ml_predictions",
    "ml_metrics",
    "ml_confusion",
    "ml_test_truth",
    "ml_fit_check",
}


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(spark, folder, name):
    return contract.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


def hash_exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - EAGER))
def test_no_cross_join_no_python(no_broadcast, small, name):
    plan = plan_of(no_broadcast, small, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "InPandas"):
        assert operator not in plan


def test_mart_moves_twice_and_sorts_narrow_rows(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "monitoring_mart")
    keys = [re.sub(r"#\d+L?", "", k) for k in hash_exchanges(plan)]
    assert sorted(keys) == [
        "_groupingexpression, station_id",
        "_groupingexpression, station_id, mode",
        "station_id",
        "station_id",
    ]
    assert plan.count("+- Window [") == 1
    assert plan.index("Window [") < plan.index("SortMergeJoin")


def test_model_table_window_reuses_the_join_order(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "ml_ready")
    assert plan.count("Sort [") == 2  # one per join side, none for the window
    assert len(hash_exchanges(plan)) == 4


def test_comparison_keeps_the_distribution_of_the_marts(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "reconcile_summary")
    top = plan[: plan.index("Window [")]
    assert "SortMergeJoin" in top and "hashpartitioning" not in top


def test_split_runs_no_window_twice(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "ml_time_split")
    assert "Window [" not in plan and "Join" not in plan


def test_aggregation_combines_before_the_shuffle(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "monthly_metrics")
    assert "partial_sum" in plan and plan.count("Exchange") == 1


def test_station_filter_reaches_both_scans(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "station_diagnostics")
    assert "EqualTo(l_suppkey,7)" in plan and "EqualTo(o_custkey,7)" in plan


def test_unused_inputs_are_not_read(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "status_distribution")
    assert "orders" not in plan and "Join" not in plan
    assert "l_discount" not in plan and "l_tax" not in plan and "l_quantity" in plan


def test_reports_are_top_k(no_broadcast, small):
    for name in ("bad_status_rate_topk", "critical_events_topk", "mode_overlap_rate", "monthly_head"):
        assert "TakeOrderedAndProject" in plan_of(no_broadcast, small, name)


def test_duplicates_are_found_without_a_window(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "grain_duplicates")
    assert "Window" not in plan and "LeftSemi" in plan


def test_mart_from_sql_text_moves_no_wide_row(no_broadcast, small):
    plan = plan_of(no_broadcast, small, "reconcile_implementations")
    keys = [re.sub(r"#\d+L?", "", k) for k in hash_exchanges(plan)]
    assert keys.count("station_id") == 4 and len(keys) == 8
    assert all("_groupingexpression" in k for k in keys if k != "station_id")
    assert "hashpartitioning" not in plan[: plan.index("Window [")]


def test_partitions_of_wide_rows_are_not_merged(no_broadcast, small):
    spark = no_broadcast
    assert mart.partitions_for(spark.range(20 * mart.READINGS_PER_PARTITION + 1)) == 21
    assert mart.partitions_for(spark.range(5)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = mart.monitoring_mart(star.measurements(spark, small), star.events(spark, small), star.SPEC, partitions=19)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(station_id#\d+L?, 19\)", plan)) == 2 and len(hash_exchanges(plan)) == 4
    assert dealt.rdd.getNumPartitions() == 19


@pytest.mark.parametrize("name", ["reconcile_saved_mismatches", "reconcile_saved_by_column", "reconcile_saved_summary"])
def test_saved_comparison_moves_only_the_keys_that_differ(no_broadcast, small, name):
    plan = plan_of(no_broadcast, small, name)
    keys = hash_exchanges(plan)
    assert keys and all("_wanted_station_id" in k for k in keys)
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize(
    "name", ["reconcile_summary", "reconcile_mismatches", "reconcile_mismatch_origins", "reconcile_by_column"]
)
def test_partitions_of_a_comparison_grow_with_the_readings(no_broadcast, small, monkeypatch, name):
    readings = star.measurements(no_broadcast, small).count()
    monkeypatch.setattr(mart, "READINGS_PER_PARTITION", readings // 20)
    plan = plan_of(no_broadcast, small, name)
    dealt = {int(n) for n in re.findall(r"Exchange hashpartitioning\(station_id#\d+L?, (\d+)\)", plan)}
    assert dealt == {-(-readings // (readings // 20))} and min(dealt) >= 20
