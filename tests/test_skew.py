"""A third of all rows under one key: results stay whole, shuffled rows stay bounded."""

import numpy as np
import pandas as pd
import pytest

from driftmart import monitoring_mart
from driftmart.operators.quality import grain_duplicates
from driftmart.plans.mart import monthly
from driftmart.sources.schemas import EVENTS, MEASUREMENTS

ROWS = 30_000


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(11)
    hot = np.arange(ROWS) % 3 == 0
    days = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 360, ROWS), unit="D")
    readings = pd.DataFrame(
        {
            "measurement_id": np.arange(ROWS),
            "station_id": np.where(hot, 1, rng.integers(2, 60, ROWS)),
            "measurement_date": days.date,
            "mode": np.where(hot, "normal", rng.choice(["normal", "peak", "repair"], ROWS)),
            "pressure": rng.normal(100, 25, ROWS),
            "flow": rng.normal(50, 20, ROWS),
            "temperature": rng.normal(20, 3, ROWS),
            "vibration": rng.normal(1, 0.2, ROWS),
        }
    )
    n = 3_000
    log = pd.DataFrame(
        {
            "event_id": np.arange(n),
            "station_id": np.where(np.arange(n) % 3 == 0, 1, rng.integers(2, 80, n)),
            "event_date": (pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 360, n), unit="D")).date,
            "event_type": "maintenance",
            "severity": rng.choice(["low", "critical"], n, p=[0.9, 0.1]),
            "duration_hours": rng.uniform(1, 9, n),
        }
    )
    return readings, log


def brute_force(readings, log):
    """Row by row, from the definitions."""
    month = lambda s: pd.to_datetime(s).dt.to_period("M").dt.to_timestamp().dt.date
    cells = readings.assign(month=month(readings.measurement_date)).groupby(["station_id", "mode", "month"])
    table = {key: (g.pressure.mean(), g.flow.mean(), len(g)) for key, g in cells}
    counts = log.assign(month=month(log.event_date)).groupby(["station_id", "month"]).size().to_dict()
    result, history = {}, {}
    for (station, mode, when), (pressure, flow, n) in sorted(table.items()):
        past = history.setdefault((station, mode), [])
        signals = 0
        for i, value in enumerate((pressure, flow)):
            before = [p[i] for p in past]
            references = [(before[-1:], 0.10), (before[-2:] + [value], 0.10), (before[-3:], 0.15)]
            for window, threshold in references:
                if window:
                    base = sum(window) / len(window)
                    signals += abs((value - base) / base) >= threshold
        past.append((pressure, flow))
        result[station, mode, when] = (n, signals, counts.get((station, when), 0))
    return result


def test_mart_under_skew(spark, raw):
    readings, log = raw
    mart = monitoring_mart(
        spark.createDataFrame(readings, MEASUREMENTS), spark.createDataFrame(log, EVENTS)
    )
    mine = {
        (r.station_id, r["mode"], r.month_start): (r.obs_count, r.signal_count, r.event_count)
        for r in mart.collect()
    }
    assert mine == brute_force(readings, log)


def test_hot_station_is_small_after_aggregation(spark, raw):
    table = monthly(spark.createDataFrame(raw[0], MEASUREMENTS))
    largest = table.groupBy("station_id").count().agg({"count": "max"}).first()[0]
    assert largest <= 12 * 3


def test_hot_duplicate_key(spark, raw):
    readings = raw[0]
    found = grain_duplicates(spark.createDataFrame(readings, MEASUREMENTS), ["station_id", "mode"])
    expected = readings[readings.duplicated(["station_id", "mode"], keep=False)]
    assert sorted(r.measurement_id for r in found.select("measurement_id").collect()) == sorted(
        expected.measurement_id
    )
