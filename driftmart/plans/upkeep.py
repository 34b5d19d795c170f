"""Saved marts kept up month by month.

All tables are partitioned by month. ``refresh`` takes the complete readings and events of some
months, new, corrected or emptied, and gives the same marts as a full build would, while it
reads and writes only the months concerned:

- a row's windows reach back over the last rows *present* of its series, not over calendar
  months, and the target of the model table looks one row ahead. Which months that concerns
  follows from one small table, the months present per series;
- the monthly sums of the given months are replaced, then each mart's concerned months are
  computed from the sums and event months they need, and replaced by dynamic overwrite.

The months given, concerned and needed come to the driver, as many as the calendar has. After a
failed run, the same call again completes it: the months per series are written last, and every
step before replaces whole months. Readings and events without a date belong to no month and
are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftmart.functions.expressions import name
from driftmart.operators.events import event_monthly
from driftmart.operators.metrics import monthly_from_sums, monthly_sums
from driftmart.plans import mart
from driftmart.plans.pipeline import EVENT_MONTHS, ML_READY, MONITORING, SUMS
from driftmart.spec import STATION_MODE, MonitoringSpec

# Months present per series, in two slots written in turn, as a table that is read cannot be replaced.
SERIES = "series_months"
SLOTS = 2
MARTS = (MONITORING, ML_READY)


@dataclass(frozen=True)
class Reach:
    """Months that a refresh replaces in a mart, and those it reads for that."""

    written: tuple[date, ...]
    read: tuple[date, ...]


def _path(target: str, table: str) -> str:
    return f"{target.rstrip('/')}/{table}"


def read(spark: SparkSession, target: str, table: str, spec: MonitoringSpec = STATION_MODE) -> DataFrame:
    """A saved table with its columns in the usual order."""
    df = spark.read.parquet(_path(target, table))
    columns = {
        SUMS: [*spec.grain, *[c for c in df.columns if c not in spec.grain]],
        EVENT_MONTHS: [*spec.event_grain, *[c for c in df.columns if c not in spec.event_grain]],
        MONITORING: spec.mart_columns,
        ML_READY: [*spec.event_grain, *[c for c in df.columns if c not in spec.event_grain]],
    }[table]
    return df.select(*columns)


def _write(
    df: DataFrame, target: str, table: str, keys: Iterable[str], spec: MonitoringSpec, mode: str, replace: str = "static"
) -> None:
    """Partitions by month; rebalancing makes files of the advisory size whatever a month's size."""
    rows = df.hint("rebalance", spec.period).sortWithinPartitions(spec.period, *keys)
    writer = rows.write.mode(mode).partitionBy(spec.period).option("partitionOverwriteMode", replace)
    writer.parquet(_path(target, table))


def _replace(
    df: DataFrame, target: str, table: str, keys: Iterable[str], months: Iterable[date], spec: MonitoringSpec
) -> None:
    """Exactly ``months`` of a table become the rows of ``df``; months without rows are emptied."""
    seen = Observation()
    observed = df.observe(seen, F.collect_set(spec.period).alias("months"))
    _write(observed, target, table, keys, spec, "overwrite", "dynamic")
    gone = set(months) - set(seen.get["months"])
    empty = df.sparkSession.createDataFrame([], df.drop(spec.period).schema)
    for month in sorted(gone):
        empty.write.mode("overwrite").parquet(f"{_path(target, table)}/{spec.period}={month.isoformat()}")


def _of_months(df: DataFrame, date_column: str, months: Iterable[date]) -> DataFrame:
    """Rows dated in the months, as ranges that reach the scan."""
    ranges = [
        f"({name(date_column)} >= DATE'{m.isoformat()}' AND {name(date_column)} < add_months(DATE'{m.isoformat()}', 1))"
        for m in sorted(set(months))
    ]
    return df.where(" OR ".join(ranges) if ranges else "false")


def _inputs(sums: DataFrame, events: DataFrame, grain: MonitoringSpec):
    if grain.mode is None:
        events = events.drop("avg_event_duration")
    return mart.by_entity(monthly_from_sums(sums, grain), grain), mart.by_entity(events, grain), grain


def _present(sums: DataFrame, spec: MonitoringSpec, column: str) -> DataFrame:
    return sums.groupBy(*spec.series_keys).agg(F.array_sort(F.collect_list(spec.period)).alias(column))


def _save_series(series: DataFrame, target: str, version: int, marts: tuple[str, ...]) -> None:
    path = f"{_path(target, SERIES)}/slot={version % SLOTS}"
    marked = series.withColumns({"version": F.lit(version), "marts": F.lit(",".join(marts))})
    marked.write.mode("overwrite").parquet(path)


def _series(spark: SparkSession, target: str) -> tuple[DataFrame, int, tuple[str, ...]]:
    """The months per series, their version, and the marts kept."""
    saved = spark.read.parquet(_path(target, SERIES))
    if "marts" not in saved.columns:
        saved = saved.withColumn("marts", F.lit(",".join(MARTS)))
    version, marts = saved.agg(F.max("version"), F.max("marts")).first()
    version, marts = version or 0, tuple(marts.split(",")) if marts else MARTS
    current = saved.where((F.col("slot") == version % SLOTS) & (F.col("version") == version))
    return current.drop("slot", "version", "marts"), version, marts


def _named(marts: Iterable[str]) -> tuple[str, ...]:
    wanted = set(marts)
    if not wanted or wanted - set(MARTS):
        raise ValueError(f"marts are some of {', '.join(MARTS)}")
    return tuple(table for table in MARTS if table in wanted)


def _plan(table: str, spec: MonitoringSpec) -> tuple[MonitoringSpec, int, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Grain of a mart, rows it looks ahead, and its rows from sums and event months."""
    if table == MONITORING:
        return spec, 0, lambda sums, events: mart.mart_of(*_inputs(sums, events, spec))
    stations = spec.per_entity()
    return stations, 1, lambda sums, events: mart.ml_ready_of(*_inputs(sums, events, stations))


def build(
    tables: Mapping[str, DataFrame],
    target: str,
    spec: MonitoringSpec = STATION_MODE,
    mode: str = "errorifexists",
    marts: Iterable[str] = MARTS,
) -> dict[str, DataFrame]:
    """The marts from all readings and events, saved by month for ``refresh``, which keeps up those in ``marts``."""
    marts = _named(marts)
    spark = tables["measurements"].sparkSession
    dated = {
        "measurements": tables["measurements"].where(F.col(spec.reading_date).isNotNull()),
        "events": tables["events"].where(F.col(spec.event_date).isNotNull()),
    }
    _write(monthly_sums(dated["measurements"], spec), target, SUMS, spec.series_keys, spec, mode)
    _write(event_monthly(dated["events"], spec), target, EVENT_MONTHS, [spec.entity], spec, mode)
    sums, events = read(spark, target, SUMS, spec), read(spark, target, EVENT_MONTHS, spec)
    for table in marts:
        grain, _, compute = _plan(table, spec)
        _write(compute(sums, events), target, table, grain.series_keys, spec, mode)
    _save_series(_present(sums, spec, "months"), target, 0, marts)
    return {table: read(spark, target, table, spec) for table in marts}


def _concerned(months: str, given: Column, back: int, ahead: int) -> Column:
    """Months of a series with one of ``given`` among the ``back`` rows before, itself, and ``ahead`` rows after.

    Looked up from the months given, a run of rows around each, so that the work per series does
    not grow with the rows a given month is far from. Runs may overlap.
    """
    sequence = F.col(months)

    def around(month: Column) -> Column:
        place = F.array_position(sequence, month).cast("int")
        first = F.greatest(place - F.lit(ahead), F.lit(1))
        run = F.slice(sequence, first, place + F.lit(back) + 1 - first)
        return F.when(place > 0, run).otherwise(F.array().cast("array<date>"))

    return F.flatten(F.transform(given, around))


def _months(series: DataFrame, *columns: Column) -> set[date]:
    found = series.select(F.explode(F.concat(*columns)).alias("month")).distinct()
    return {r.month for r in found.collect()}


def _reach(series: DataFrame, given: set[date], spec: MonitoringSpec, ahead: int) -> Reach:
    """What a change of ``given`` concerns, over the rows before (``old``) and after it (``new``)."""

    def lit(months: set[date]) -> Column:
        return F.array(*[F.lit(m) for m in sorted(months)]).cast("array<date>")

    changed = _months(series, *[_concerned(c, lit(given), spec.window, ahead) for c in ("old", "new")]) | given
    # Rows to replace need the rows their windows reach, and the next one for the target.
    needed = _months(series, _concerned("new", lit(changed), ahead, spec.window)) | changed
    return Reach(tuple(sorted(changed)), tuple(sorted(needed)))


def refresh(
    spark: SparkSession,
    target: str,
    tables: Mapping[str, DataFrame],
    months: Iterable[date],
    spec: MonitoringSpec = STATION_MODE,
) -> dict[str, Reach]:
    """Replace the data of ``months`` (first days) in the saved marts.

    ``tables`` hold all readings and events of these months; rows of other months are ignored.
    """
    given = set(months)
    if any(m.day != 1 for m in given):
        raise ValueError("months are given by their first day")
    if not given:
        return {}
    readings = _of_months(tables["measurements"], spec.reading_date, given)
    log = _of_months(tables["events"], spec.event_date, given)
    _replace(monthly_sums(readings, spec), target, SUMS, spec.series_keys, given, spec)
    _replace(event_monthly(log, spec), target, EVENT_MONTHS, [spec.entity], given, spec)
    sums, events = read(spark, target, SUMS, spec), read(spark, target, EVENT_MONTHS, spec)

    old, version, marts = _series(spark, target)
    # One row per series: months present before and after.
    fresh = _present(sums.where(F.col(spec.period).isin(sorted(given))), spec, "fresh")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in spec.series_keys]
    none = F.array().cast("array<date>")
    kept = F.array_except(F.coalesce("o.months", none), F.array(*[F.lit(m) for m in sorted(given)]))
    joined = old.alias("o").join(fresh.alias("f"), same, "full")
    series = joined.select(
        *[F.coalesce(f"o.{k}", f"f.{k}").alias(k) for k in spec.series_keys],
        F.coalesce("o.months", none).alias("old"),
        F.array_sort(F.array_union(kept, F.coalesce("f.fresh", none))).alias("new"),
    )
    by_station = series.groupBy(spec.entity).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("old", "new")]
    )
    reached = {}
    for table in marts:
        grain, ahead, compute = _plan(table, spec)
        reach = reached[table] = _reach(series if grain is spec else by_station, given, grain, ahead)
        window = F.col(spec.period).isin(list(reach.read))
        changed = compute(sums.where(window), events.where(window)).where(F.col(spec.period).isin(list(reach.written)))
        _replace(changed, target, table, grain.series_keys, reach.written, spec)
    _save_series(series.select(*spec.series_keys, F.col("new").alias("months")).where(F.size("months") > 0), target, version + 1, marts)
    return reached
