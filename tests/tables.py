"""Small hand-written tables."""

from datetime import date

from driftmart.sources.schemas import EVENTS, MEASUREMENTS


def readings(spark, rows):
    """rows: (station, date, mode, pressure, flow[, temperature, vibration])"""
    full = [
        (i, r[0], date.fromisoformat(r[1]), *r[2:5], *(r[5:] or (1.0, 1.0)))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, MEASUREMENTS)


def events(spark, rows):
    """rows: (station, date, severity, duration)"""
    full = [
        (i, s, date.fromisoformat(d), "maintenance", severity, duration)
        for i, (s, d, severity, duration) in enumerate(rows)
    ]
    return spark.createDataFrame(full, EVENTS)


def by_month(df, *columns):
    return [tuple(r) for r in df.orderBy("month_start").select(*columns).collect()]
