"""Raw files to saved marts, and every report over the saved marts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from driftmart.functions.expressions import name
from driftmart.ml import baseline
from driftmart.operators import analysis, quality, reconcile, series
from driftmart.operators.events import event_monthly
from driftmart.operators.metrics import monthly_from_sums, monthly_sums
from driftmart.plans import ansi, mart
from driftmart.session import shared_folder
from driftmart.sources import files
from driftmart.spec import STATION, STATION_MODE, MonitoringSpec

MONITORING, ML_READY = "monitoring", "ml_ready"
SUMS, EVENT_MONTHS = "monthly_sums", "event_months"
CASES, MODEL, PREDICTIONS = "model_cases", "model", "predictions"


def build(
    tables: Mapping[str, DataFrame],
    target: str,
    spec: MonitoringSpec = STATION_MODE,
    csv: bool = False,
    mode: str = "errorifexists",
) -> dict[str, DataFrame]:
    """Compute both marts once, save them, and return the saved tables.

    Raw readings and events are read once: their monthly sums are saved beside the marts,
    and both marts are built from them. Reports then read the few mart columns they need
    instead of repeating the aggregation and the windows. Files are sorted by series, so a
    filter on a station skips row groups. After a failed run, start again with ``overwrite``.
    """
    stations = spec.per_entity()

    def save(name: str, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        path = f"{target.rstrip('/')}/{name}"
        files.write_parquet(df, path, cluster_by=keys, mode=mode)
        return df.sparkSession.read.parquet(path)

    sums = save(SUMS, monthly_sums(tables["measurements"], spec), (*spec.series_keys, spec.period))
    event_months = save(
        EVENT_MONTHS, event_monthly(tables["events"], spec), (spec.entity, spec.period)
    )

    def inputs(grain: MonitoringSpec, events: DataFrame) -> tuple[DataFrame, DataFrame, MonitoringSpec]:
        return mart.by_entity(monthly_from_sums(sums, grain), grain), mart.by_entity(events, grain), grain

    marts = {
        MONITORING: (mart.mart_of(*inputs(spec, event_months)), spec),
        ML_READY: (mart.ml_ready_of(*inputs(stations, event_months.drop("avg_event_duration"))), stations),
    }
    saved = {}
    for name, (df, grain) in marts.items():
        saved[name] = save(name, df, (*grain.series_keys, grain.period))
        if csv:
            files.write_csv(saved[name], f"{target.rstrip('/')}/{name}.csv", mode=mode)
    return saved


def build_bucketed(
    tables: Mapping[str, DataFrame],
    target: str,
    buckets: int,
    spec: MonitoringSpec = STATION_MODE,
    prefix: str = "driftmart_",
    mode: str = "errorifexists",
) -> dict[str, DataFrame]:
    """As ``build``, but as catalog tables bucketed by station: after the sums, nothing is exchanged.

    The sums and event months are dealt by station once, when they are saved. Both marts, their
    windows, joins and targets, and later joins of the saved tables on the station keep that
    distribution. Choose ``buckets`` so that a bucket of the mart fits a task.
    """
    stations = spec.per_entity()

    def save(table: str, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        path = f"{target.rstrip('/')}/{table}"
        return files.write_bucketed(df, f"{prefix}{table}", path, spec.entity, keys, buckets, mode)

    sums = save(SUMS, monthly_sums(tables["measurements"], spec), (*spec.series_keys, spec.period))
    event_months = save(EVENT_MONTHS, event_monthly(tables["events"], spec), (spec.entity, spec.period))
    marts = bucketed_marts(sums, event_months, spec)
    keys = {MONITORING: (*spec.series_keys, spec.period), ML_READY: (*stations.series_keys, spec.period)}
    return {table: save(table, df, keys[table]) for table, df in marts.items()}


def bucketed_marts(
    sums: DataFrame, event_months: DataFrame, spec: MonitoringSpec = STATION_MODE
) -> dict[str, DataFrame]:
    """Both marts from sums and event months that are distributed by station already."""
    stations = spec.per_entity()
    without_duration = event_months.drop("avg_event_duration")
    return {
        MONITORING: mart.mart_of(monthly_from_sums(sums, spec), event_months, spec),
        ML_READY: mart.ml_ready_of(monthly_from_sums(sums, stations), without_duration, stations),
    }


def model(
    ml_ready: DataFrame, spec: MonitoringSpec = STATION, target: str | None = None, mode: str = "errorifexists"
) -> dict[str, DataFrame]:
    """Fit the baseline once on a saved model table: split, predictions and scores of the test months.

    With ``target`` the model and the predictions are saved there, and the scores read the
    saved predictions; ``score`` applies the saved model to other rows.
    """
    cases = baseline.complete_cases(ml_ready, spec=spec)
    if target is not None:
        folder = target.rstrip("/")
        files.write_parquet(cases, f"{folder}/{CASES}", cluster_by=(spec.period,), mode=mode)
        cases = ml_ready.sparkSession.read.parquet(f"{folder}/{CASES}")
    fitted = baseline.fit_baseline(ml_ready, spec=spec, cases=cases)
    predictions = fitted.test_predictions()
    if target is not None:
        fitted.model.save(ml_ready.sparkSession, f"{folder}/{MODEL}", mode)
        files.write_parquet(predictions, f"{folder}/{PREDICTIONS}", cluster_by=spec.series_keys, mode=mode)
        predictions = ml_ready.sparkSession.read.parquet(f"{folder}/{PREDICTIONS}")
    return {
        "split_summary": baseline.split_summary(fitted.split_cases, spec),
        "predictions": predictions,
        "metrics": baseline.classification_metrics(predictions),
        "confusion_matrix": baseline.confusion_matrix(predictions),
    }


def score(spark: SparkSession, target: str, rows: DataFrame) -> DataFrame:
    """``rows`` of a model table with prediction and probability of the model saved under ``target``."""
    return baseline.Model.load(spark, f"{target.rstrip('/')}/{MODEL}").predict(rows)


def reports(monitoring: DataFrame, spec: MonitoringSpec = STATION_MODE) -> dict[str, DataFrame]:
    """The analysis and diagnostic tables of a saved mart.

    Five of them are added up from totals that one scan writes to the shared folder.
    """
    path = shared_folder(monitoring.sparkSession, "report-totals")
    analysis.report_totals(monitoring, spec).write.parquet(path)
    return {
        **analysis.reports_of(monitoring.sparkSession.read.parquet(path), spec),
        "critical_events": analysis.critical_events_by_entity(monitoring, spec),
        "grain_duplicates": quality.grain_duplicates(monitoring, spec.grain),
        "diagnostics": analysis.diagnostics(monitoring, spec),
        **{
            f"{m}_series": series.monitoring_series(monitoring, m, spec, markers=tuple(series.MARKERS))
            for m in spec.flagged
        },
    }


def mart_by_sql(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    spec: MonitoringSpec = STATION_MODE,
    partitions: int | None = None,
) -> DataFrame:
    """The monitoring mart from its SQL formulation.

    Hints deal its two aggregates by entity, as ``mart.by_entity`` does, so that the windows,
    the event join and a later join of marts move no wide row.
    """
    hint = f"/*+ REPARTITION({f'{partitions}, ' if partitions else ''}{name(spec.entity)}) */"
    ctes = [
        (cte, f"SELECT {hint} * FROM (\n{body}\n) grouped" if cte in ("monthly", "event_months") else body)
        for cte, body in ansi.mart_ctes("{readings}", "{log}", spec)
    ]
    return spark.sql(
        ansi.with_query(ctes, "SELECT * FROM mart"),
        readings=tables["measurements"],
        log=tables["events"],
    )


def verify(
    spark: SparkSession,
    monitoring: DataFrame,
    tables: Mapping[str, DataFrame],
    spec: MonitoringSpec = STATION_MODE,
) -> DataFrame:
    """Reconcile a saved mart with the SQL formulation; all columns, one summary row.

    A repeated grain would pair every copy with every copy, so it is an error.
    """
    quality.require_unique(monitoring, spec.grain)
    return _against_sql(spark, monitoring, tables, spec).summary()


def mismatches(
    spark: SparkSession,
    monitoring: DataFrame,
    tables: Mapping[str, DataFrame],
    spec: MonitoringSpec = STATION_MODE,
) -> dict[str, DataFrame]:
    """Where ``verify`` finds differences: rows by origin, the mismatching rows, counts by column."""
    quality.require_unique(monitoring, spec.grain)
    comparison = _against_sql(spark, monitoring, tables, spec)
    return {
        "origins": comparison.origins(),
        "mismatches": comparison.mismatches(),
        "mismatches_by_column": comparison.mismatches_by_column(),
    }


def _against_sql(spark, monitoring, tables, spec):
    """Keys and digests first; the SQL formulation runs a second time only if rows differ."""
    return reconcile.staged(
        monitoring, mart_by_sql(spark, tables, spec), spec.grain, never_null=(spec.entity,)
    )
