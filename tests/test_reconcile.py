import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmart.operators import reconcile

NAN, INF = float("nan"), float("inf")
PAIRS = [
    (1.0, 1.0),
    (1.0, None),
    (None, None),
    (NAN, NAN),
    (NAN, 1.0),
    (1.0, NAN),
    (100.0, 100.0 + 1e-3 - 1e-9),
    (100.0, 100.0 + 1.002e-3),
    (1e-9, 0.0),
    (2e-8, 0.0),
    (INF, INF),
    (INF, -INF),
    (1.0, INF),
    (INF, 1.0),
    (0.0, -0.0),
]


@pytest.fixture(scope="module")
def frame(spark):
    schema = "k int, value double, n bigint, label string"
    left = [(i, a, 5, "x") for i, (a, _) in enumerate(PAIRS)] + [(900, 1.0, 1, "left"), (None, 1.0, 1, "null")]
    right = [(i, b, 5, "x") for i, (_, b) in enumerate(PAIRS)] + [(901, 1.0, 1, "right"), (None, 1.0, 2, None)]
    return reconcile.merged(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]
    )


def test_tolerance_matches_numpy(frame):
    checks = {r.k: r.value_check for r in reconcile.checked(frame).collect() if r.k is not None}
    as_float = lambda v: NAN if v is None else v
    for i, (a, b) in enumerate(PAIRS):
        expected = bool(np.isclose(as_float(a), as_float(b), equal_nan=True))
        assert checks[i] is expected, (a, b)


def test_origins(frame):
    assert {tuple(r) for r in reconcile.origin_counts(frame).collect()} == {
        ("both", len(PAIRS) + 1),
        ("left_only", 1),
        ("right_only", 1),
    }


def test_missing_keys_match_and_labels_compare_exactly(frame):
    row = reconcile.checked(frame).where("k IS NULL").first()
    assert (row.value_check, row.n_check, row.label_check, row.is_match) == (True, False, False, False)


def test_summary_and_columns_agree(frame):
    checks = reconcile.checked(frame)
    wrong = reconcile.mismatches(checks).count()
    summary = reconcile.summary(frame).first()
    assert tuple(summary) == (len(PAIRS) + 1, 1, 1, wrong)
    by_column = [tuple(r) for r in reconcile.mismatches_by_column(checks).collect()]
    assert by_column == [("value", wrong - 1), ("label", 1), ("n", 1)]


def test_inner_comparison_keeps_matched_rows_only(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, v double")
    right = spark.createDataFrame([(2, 1.0), (3, 1.0)], "k int, v double")
    rows = reconcile.merged(left, right, ["k"], how="inner").collect()
    assert [(r.k, r.merge_flag) for r in rows] == [(2, "both")]


def test_value_columns_named_like_a_side_are_compared(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "k int, a double, b double")
    other = df.selectExpr("k", "a", "b + 1 AS b", "1 AS extra")
    checks = reconcile.checked(reconcile.merged(df, other, ["k"]))
    assert [tuple(r) for r in reconcile.mismatches_by_column(checks).collect()] == [("b", 1), ("a", 0)]


def test_staged_comparison_equals_the_direct_one(spark, frame):
    schema = "k int, value double, n bigint, label string"
    left = [(i, a, 5, "x") for i, (a, _) in enumerate(PAIRS)] + [(900, 1.0, 1, "left"), (None, 1.0, 1, "null")]
    right = [(i, b, 5, "x") for i, (_, b) in enumerate(PAIRS)] + [(901, 1.0, 1, "right"), (None, 1.0, 2, None)]
    other = spark.createDataFrame(right, schema).withColumn("n", F.col("n").cast("int"))
    both = reconcile.staged(spark.createDataFrame(left, schema), other, ["k"])
    checks = reconcile.checked(frame)
    direct = [
        (reconcile.summary(frame), both.summary()),
        (reconcile.origin_counts(frame), both.origins()),
        (reconcile.mismatches_by_column(checks), both.mismatches_by_column()),
        (reconcile.mismatches(checks), both.mismatches()),
    ]
    for theirs, mine in direct:
        assert theirs.columns == mine.columns
        assert sorted(map(str, theirs.collect())) == sorted(map(str, mine.collect()))


def test_which_values_are_null_is_part_of_the_digest(spark):
    left = spark.createDataFrame([(1, None, 5.0)], "k int, a double, b double")
    right = spark.createDataFrame([(1, 5.0, None)], "k int, a double, b double")
    assert reconcile.narrow_pairs(left, right, ["k"]).first().differs is True
    assert reconcile.narrow_pairs(left, left, ["k"]).first().differs is False


def test_equal_results_move_no_wide_column(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS k", *[f"id * {i} AS wide_{i}" for i in range(30)])
    for side in ("left", "right"):
        rows.write.parquet(f"{tmp_path}/{side}")
    left, right = (spark.read.parquet(f"{tmp_path}/{side}") for side in ("left", "right"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = reconcile.staged(left, right, ["k"], never_null=("k",))
        narrow = reconcile.narrow_pairs(left, right, ["k"], never_null=("k",))
        plan = narrow._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if "Exchange" in x or "Sort [" in x or "Join [" in x]
        assert len(moved) == 5 and not any("wide" in x for x in moved)
        above = plan[: plan.index("Exchange")]
        assert "wide" not in above
        assert tuple(both.summary().first()) == (1000, 0, 0, 0)
        detail = both.mismatches()._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" not in detail.replace("LocalRelation", "")
        changed = right.withColumn("wide_7", F.when(F.col("k") == 5, -1).otherwise(F.col("wide_7")))
        found = reconcile.staged(left, changed, ["k"], never_null=("k",))
        assert [r.k for r in found.mismatches().collect()] == [5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_differing_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    for side in ("left", "right"):
        rows.write.parquet(f"{tmp_path}/{side}")
    left, right = (spark.read.parquet(f"{tmp_path}/{side}") for side in ("left", "right"))
    changed = right.withColumn("v", F.when(F.col("k") < 50, -1).otherwise(F.col("v")))

    def joins(limit):
        monkeypatch.setattr(reconcile, "BROADCAST_ROWS", limit)
        both = reconcile.staged(left, changed, ["k"], never_null=("k",))
        assert both.mismatches().count() == 50
        plan = both.detail._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"(\w+Join) [^\n]*LeftSemi", plan)

    assert joins(50) == ["BroadcastHashJoin"] * 2
    assert joins(49) == ["SortMergeJoin"] * 2
