"""Next-month event prediction: complete cases, time split, balanced logistic regression."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmart.functions.expressions import name
from driftmart.ml import newton
from driftmart.session import shared_folder
from driftmart.spec import STATION, MonitoringSpec

# Target, share of months used for training, inverse penalty.
TARGET = "has_events_next_month"
TRAIN_SHARE = 0.8
INVERSE_PENALTY = 1.0

# Training rows a task holds: fewer tasks per pass, as a fit makes many passes.
ROWS_PER_TASK = 200_000


def complete_cases(
    ml_table: DataFrame, target: str = TARGET, spec: MonitoringSpec = STATION
) -> DataFrame:
    """Rows with target and every feature present; integer target."""
    rows = ml_table.na.drop(subset=[target, *spec.model_features])
    return rows.withColumn(target, F.col(target).cast("int"))


def saved_cases(
    ml_table: DataFrame, target: str = TARGET, spec: MonitoringSpec = STATION
) -> DataFrame:
    """The complete cases, written once to the shared folder and read back.

    Split and fit read them several times; the joins and windows behind them run once.
    """
    spark = ml_table.sparkSession
    path = shared_folder(spark, "ml-cases")
    complete_cases(ml_table, target, spec).write.parquet(path)
    return spark.read.parquet(path)


def time_split(
    cases: DataFrame, share: float = TRAIN_SHARE, spec: MonitoringSpec = STATION
) -> DataFrame:
    """Add ``split``: the first ``floor(share * months)`` months train, the rest test.

    The cut-off is a one-row subquery over the distinct months, whose number is
    bounded by the calendar. It reads ``cases`` a second time: pass saved ones.
    """
    months = cases.agg(F.array_sort(F.collect_set(spec.period)).alias("months"))
    train_months = F.floor(F.size("months") * F.lit(share)).cast("int")
    # index 0 does not exist in SQL arrays: too few months leave nothing to train on
    cutoff = months.select(F.when(train_months > 0, F.get("months", train_months - 1)))
    return cases.withColumn(
        "split",
        F.when(F.col(spec.period) <= cutoff.scalar(), "train").otherwise("test"),
    )


def split_summary(split_cases: DataFrame, spec: MonitoringSpec = STATION) -> DataFrame:
    """Shape and month range of both parts."""
    columns = len(split_cases.columns) - 1
    return split_cases.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(columns).alias("column_count"),
        F.min(spec.period).alias("first_month"),
        F.max(spec.period).alias("last_month"),
    )


@dataclass(frozen=True)
class Model:
    """A logistic model as numbers; scoring is one SQL expression, so rows are not converted."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    target: str
    last_training_month: date
    passes: int

    def transformer(self) -> SQLTransformer:
        """Adds ``probability`` and ``prediction``; both are NULL where a feature is."""
        eta = newton.linear(self.features, self.coefficients, self.intercept)
        scores = f"SELECT *, 1 / (1 + exp(-({eta}))) AS probability FROM __THIS__"
        return SQLTransformer(statement=f"SELECT *, cast(probability > 0.5 AS int) AS prediction FROM ({scores})")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.transformer().transform(rows).select(*map(name, rows.columns), "prediction", "probability")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        """The scoring stage by Spark ML's writer, the numbers behind it as a one-row table."""
        writer = self.transformer().write()
        (writer.overwrite() if mode == "overwrite" else writer).save(f"{path.rstrip('/')}/scoring")
        row = (*(list(v) if isinstance(v, tuple) else v for v in vars(self).values()),)
        spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path.rstrip('/')}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        row = spark.read.schema(MODEL_SCHEMA).parquet(f"{path.rstrip('/')}/numbers").first()
        return cls(*(tuple(v) if isinstance(v, list) else v for v in row))


MODEL_SCHEMA = (
    "features array<string>, coefficients array<double>, intercept double, target string,"
    " last_training_month date, passes int"
)


@dataclass(frozen=True)
class Baseline:
    """A fitted model with the table it was fitted on."""

    model: Model
    split_cases: DataFrame

    @property
    def features(self) -> tuple[str, ...]:
        return self.model.features

    @property
    def target(self) -> str:
        return self.model.target

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.model.features, self.model.coefficients))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(rows)

    def test_predictions(self) -> DataFrame:
        return self.predict(self.split_cases.where("split = 'test'").drop("split"))


def fit_baseline(
    ml_table: DataFrame,
    target: str = TARGET,
    spec: MonitoringSpec = STATION,
    share: float = TRAIN_SHARE,
    cases: DataFrame | None = None,
) -> Baseline:
    """Split by time and fit an L2 logistic regression with balanced class weights.

    The objective is ``sum(weight * log-loss) + |coefficients|^2 / (2 C)`` with a free
    intercept, minimised by Newton steps (see ``newton``).

    Fitting reads the rows once per step, so they come from saved ``cases`` (see
    ``saved_cases``, the default). One job brings the class counts per month, as many rows
    as the calendar has months, to the driver: cut-off and weights follow from them.
    """
    if cases is None:
        cases = saved_cases(ml_table, target, spec)
    months = sorted(
        cases.groupBy(spec.period).agg(F.count(F.lit(1)), F.sum(F.col(target))).collect()
    )
    training_months = months[: math.floor(len(months) * share)]
    size = sum(n for _, n, _ in training_months)
    positives = sum(ones for _, _, ones in training_months)
    if positives in (0, size):
        raise ValueError(f"training data needs both classes of {target}; {positives} of {size} rows are 1")

    in_training = F.col(spec.period) <= F.lit(training_months[-1][0])
    split_cases = cases.withColumn("split", F.when(in_training, "train").otherwise("test"))
    train = cases.where(in_training).coalesce(-(-size // ROWS_PER_TASK))
    weight = (
        f"CASE WHEN {name(target)} = 1 THEN {size / (2.0 * positives)!r}D"
        f" ELSE {size / (2.0 * (size - positives))!r}D END"
    )
    found = newton.fit(train, spec.model_features, name(target), weight, 1 / INVERSE_PENALTY)
    fitted = Model(
        spec.model_features, found.coefficients, found.intercept, target, training_months[-1][0], found.passes
    )
    return Baseline(fitted, split_cases)


def stationarity(fitted: Baseline) -> DataFrame:
    """Per feature, how far the fit is from a stationary point of its penalised loss.

    ``gradient`` at the fitted coefficients and ``gradient_at_zero`` with all of them and
    the intercept at zero, both per training row; one pass over the training rows.
    """
    train = fitted.split_cases.where("split = 'train'")
    label = F.col(fitted.target)
    scored = fitted.predict(train).select(
        *fitted.features,
        label.alias("label"),
        (F.col("probability") - label).alias("residual"),
        (F.lit(0.5) - label).alias("residual_at_zero"),
    )

    def weighted(feature: str, residual: str):
        # balanced weights: half of the loss belongs to each class
        product = F.col(feature) * F.col(residual)
        return F.struct(
            F.sum(F.when(F.col("label") == 1, product)).alias("ones"),
            F.sum(F.when(F.col("label") == 0, product)).alias("zeros"),
        )

    totals = scored.agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("label").alias("positives"),
        F.array(
            *[
                F.struct(
                    F.lit(feature).alias("feature"),
                    F.lit(coefficient).alias("coefficient"),
                    weighted(feature, "residual").alias("fitted"),
                    weighted(feature, "residual_at_zero").alias("start"),
                )
                for feature, coefficient in fitted.coefficients().items()
            ]
        ).alias("sums"),
    )
    negatives = F.col("size") - F.col("positives")

    def per_row(part: str):
        return F.col(f"{part}.ones") / (2 * F.col("positives")) + F.col(f"{part}.zeros") / (2 * negatives)

    penalty = F.col("coefficient") / (INVERSE_PENALTY * F.col("size"))
    return totals.select("size", "positives", F.inline("sums")).select(
        "feature",
        "coefficient",
        (per_row("fitted") + penalty).alias("gradient"),
        per_row("start").alias("gradient_at_zero"),
    )


# (truth, prediction) -> short name
OUTCOMES = {(0, 0): "tn", (0, 1): "fp", (1, 0): "fn", (1, 1): "tp"}


def _outcome_counts(predictions: DataFrame, target: str) -> DataFrame:
    return predictions.agg(
        *[
            F.count_if((F.col(target) == truth) & (F.col("prediction") == guess)).alias(name)
            for (truth, guess), name in OUTCOMES.items()
        ]
    )


def classification_metrics(predictions: DataFrame, target: str = TARGET) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; an undefined ratio is 0."""

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _outcome_counts(predictions, target).select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def confusion_matrix(predictions: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows per (truth, prediction); all four cells, empty ones as 0."""
    cells = F.array(
        *[
            F.struct(
                F.lit(truth).alias("truth"),
                F.lit(guess).alias("prediction"),
                F.col(name).alias("row_count"),
            )
            for (truth, guess), name in OUTCOMES.items()
        ]
    )
    return _outcome_counts(predictions, target).select(F.inline(cells))
