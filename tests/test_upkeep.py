"""Marts kept up by month equal marts built at once, and only the months concerned are touched."""

import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import events, readings

from driftmart.plans import mart, upkeep
from driftmart.spec import STATION, STATION_MODE

MONTHS = [date(2023 + k // 12, k % 12 + 1, 1) for k in range(16)]


@pytest.fixture(scope="module")
def raw(spark):
    """Stations with gaps of months, modes that come and go, a station that starts late."""
    rng = np.random.default_rng(11)
    rows, log = [], []
    for station in range(1, 7):
        for k, month in enumerate(MONTHS):
            for mode in ("normal", "peak", "repair"):
                if station == 6 and k < 13 or station == 2 and 5 < k < 12 or rng.random() < 0.3:
                    continue
                for day in (3, 17):
                    rows.append((station, month.replace(day=day).isoformat(), mode, *map(float, rng.integers(50, 99, 4))))
            if rng.random() < 0.4:
                log.append((station, month.replace(day=9).isoformat(), str(rng.choice(["low", "critical"])), 2.5))
    return {"measurements": readings(spark, rows).cache(), "events": events(spark, log).cache()}


def without(tables, months):
    return {
        "measurements": tables["measurements"].where(~F.trunc("measurement_date", "month").isin(months)),
        "events": tables["events"].where(~F.trunc("event_date", "month").isin(months)),
    }


def rows_of(df):
    return sorted(map(str, df.collect()))


def assert_equals_full_build(spark, target, tables):
    full = {
        "monitoring": mart.monitoring_mart(tables["measurements"], tables["events"]),
        "ml_ready": mart.ml_ready(tables["measurements"], tables["events"]),
    }
    for name, expected in full.items():
        found = upkeep.read(spark, target, name)
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows_of(found.select(expected.columns)) == rows_of(expected)


@pytest.mark.parametrize(
    "late",
    [[MONTHS[15]], [MONTHS[14], MONTHS[15]], [MONTHS[7]], [MONTHS[0]], [MONTHS[2], MONTHS[9]]],
    ids=["last", "last two", "amid", "first", "two amid"],
)
def test_late_months(spark, raw, tmp_path, late):
    target = str(tmp_path)
    upkeep.build(without(raw, late), target)
    upkeep.refresh(spark, target, raw, late)
    assert_equals_full_build(spark, target, raw)


def test_months_one_by_one_corrected_and_emptied(spark, raw, tmp_path):
    target = str(tmp_path)
    upkeep.build(without(raw, MONTHS[10:]), target)
    for month in MONTHS[10:]:
        upkeep.refresh(spark, target, raw, [month])
    assert_equals_full_build(spark, target, raw)

    changed = dict(raw)
    changed["measurements"] = raw["measurements"].withColumn(
        "pressure", F.when(F.col("measurement_date") < "2023-05-01", F.col("pressure") * 3).otherwise(F.col("pressure"))
    )
    changed = without(changed, [MONTHS[12]])
    given = [*MONTHS[:4], MONTHS[12]]
    upkeep.refresh(spark, target, changed, given)
    assert_equals_full_build(spark, target, changed)
    upkeep.refresh(spark, target, changed, given)  # again, as after a failed run
    assert_equals_full_build(spark, target, changed)


def test_only_events_of_a_month_change(spark, raw, tmp_path):
    target = str(tmp_path)
    upkeep.build(raw, target)
    changed = {**raw, "events": without(raw, [MONTHS[6]])["events"]}
    upkeep.refresh(spark, target, changed, [MONTHS[6]])
    assert_equals_full_build(spark, target, changed)


def test_a_new_month_touches_few_months(spark, raw, tmp_path):
    # Without gaps: the new month, its predecessor for the target, and the windows' reach.
    dense = {
        "measurements": raw["measurements"].where("station_id = 1").unionByName(
            readings(spark, [(1, m.isoformat(), "peak", 1.0, 2.0) for m in MONTHS])
        ).withColumn("mode", F.lit("peak")),
        "events": raw["events"],
    }
    target = str(tmp_path)
    upkeep.build(without(dense, MONTHS[15:]), target)
    reach = upkeep.refresh(spark, target, dense, MONTHS[15:])
    assert reach["monitoring"] == upkeep.Reach((MONTHS[15],), tuple(MONTHS[12:16]))
    assert reach["ml_ready"] == upkeep.Reach(tuple(MONTHS[14:16]), tuple(MONTHS[11:16]))
    assert_equals_full_build(spark, target, dense)
    # The months needed prune partitions, and the given months reach the scan of raw readings.
    sums = upkeep.read(spark, target, upkeep.SUMS).where(F.col("month_start").isin(list(reach["monitoring"].read)))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month_start", plan)
    read = {r[0] for r in sums.select(F.regexp_extract(F.input_file_name(), "month_start=([0-9-]+)", 1)).distinct().collect()}
    assert read == {m.isoformat() for m in MONTHS[12:16]}


def test_bad_months_and_none(spark, raw, tmp_path):
    with pytest.raises(ValueError, match="first day"):
        upkeep.refresh(spark, str(tmp_path), raw, [date(2023, 1, 2)])
    assert upkeep.refresh(spark, str(tmp_path), raw, []) == {}
    assert STATION.mode is None and STATION_MODE.mode


@pytest.mark.parametrize("kept", ["monitoring", "ml_ready"])
def test_one_mart_alone(spark, raw, tmp_path, kept):
    target = str(tmp_path)
    assert list(upkeep.build(without(raw, MONTHS[7:8]), target, marts=[kept])) == [kept]
    assert list(upkeep.refresh(spark, target, raw, MONTHS[7:8])) == [kept]
    other = ({"monitoring", "ml_ready"} - {kept}).pop()
    assert (tmp_path / kept).exists() and not (tmp_path / other).exists()
    full = getattr(mart, {"monitoring": "monitoring_mart"}.get(kept, kept))(raw["measurements"], raw["events"])
    assert rows_of(upkeep.read(spark, target, kept).select(full.columns)) == rows_of(full)
    with pytest.raises(ValueError, match="marts are"):
        upkeep.build(raw, f"{target}/none", marts=["else"])


@pytest.mark.parametrize("back, ahead", [(3, 0), (3, 1), (1, 3), (0, 0)])
def test_months_concerned_are_looked_up_from_the_months_given(spark, back, ahead):
    rng = np.random.default_rng(5)
    given = [MONTHS[0], MONTHS[6], MONTHS[7], MONTHS[15]]
    rows = [(i, [m for m in MONTHS if rng.random() < 0.5]) for i in range(60)]
    expected = {
        i: {m for k, m in enumerate(months) if set(given) & set(months[max(k - back, 0) : k + ahead + 1])}
        for i, months in rows
    }
    found = spark.createDataFrame(rows, "id int, months array<date>").select(
        "id", upkeep._concerned("months", F.array(*map(F.lit, given)), back, ahead).alias("found")
    )
    assert {r.id: set(r.found) for r in found.collect()} == expected
    # Per month of a series nothing is evaluated but the search for the months given.
    assert "arrays_overlap" not in found._jdf.queryExecution().optimizedPlan().toString()
