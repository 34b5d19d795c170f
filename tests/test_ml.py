from datetime import date

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from driftmart import STATION
from driftmart.ml import baseline, newton
from driftmart.plans import pipeline


def months(n):
    return [date(2024 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    """Random features with a target that depends on two of them."""
    rng = np.random.default_rng(5)
    rows = []
    for month in months(15):
        for station in range(20):
            x = rng.normal(size=len(STATION.model_features)) * 3 + 1
            y = int(0.8 * x[0] - 0.6 * x[5] + rng.normal() > 1.5)
            rows.append((month, station, *map(float, x), y))
    schema = "month_start date, station_id long, " + ", ".join(
        f"{c} double" for c in STATION.model_features
    )
    return spark.createDataFrame(rows, schema + f", {baseline.TARGET} int")


@pytest.mark.parametrize("n, train", [(1, 0), (4, 3), (5, 4), (15, 12), (16, 12)])
def test_split_point(spark, n, train):
    df = spark.createDataFrame([(m, s) for m in months(n) for s in (1, 2)], "month_start date, s int")
    parts = baseline.time_split(df).groupBy("split").agg(F.countDistinct("month_start").alias("n"))
    expected = {"train": train, "test": n - train}
    assert {r["split"]: r["n"] for r in parts.collect()} == {k: v for k, v in expected.items() if v}


def test_complete_cases(spark, table):
    broken = table.withColumn(
        "avg_flow", F.when(F.col("station_id") == 3, None).otherwise(F.col("avg_flow"))
    ).withColumn(
        baseline.TARGET, F.when(F.col("station_id") == 4, None).otherwise(F.col(baseline.TARGET))
    )
    kept = baseline.complete_cases(broken)
    assert kept.count() == 15 * 18
    assert dict(kept.dtypes)[baseline.TARGET] == "int"


def newton_logistic(x, y, weight, penalty):
    """Minimum of sum(w * logloss) + penalty/2 * |coef|^2, free intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    beta = np.zeros(x1.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ beta))
        gradient = x1.T @ (weight * (p - y)) + ridge @ beta
        hessian = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta[:-1], beta[-1]


@pytest.fixture(scope="module")
def fitted(table):
    return baseline.fit_baseline(table)


def test_coefficients_minimise_the_balanced_penalised_loss(table, fitted):
    rows = table.toPandas()
    train = rows[rows.month_start <= months(15)[11]]
    x = train[list(STATION.model_features)].to_numpy()
    y = train[baseline.TARGET].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    coefficients, intercept = newton_logistic(x, y, weight, 1.0)
    mine = fitted.coefficients()
    assert list(mine) == list(STATION.model_features)
    assert np.allclose(list(mine.values()), coefficients, atol=1e-6, rtol=1e-6)
    assert fitted.model.intercept == pytest.approx(intercept, abs=1e-6)
    assert fitted.model.passes < 15


def test_metrics_follow_from_the_confusion_matrix(fitted):
    predictions = fitted.test_predictions()
    cells = {(r.truth, r.prediction): r.row_count for r in baseline.confusion_matrix(predictions).collect()}
    tn, fp, fn, tp = cells[0, 0], cells[0, 1], cells[1, 0], cells[1, 1]
    assert tn + fp + fn + tp == predictions.count() == 60
    m = baseline.classification_metrics(predictions).first()
    assert m.accuracy == (tp + tn) / 60
    assert m.precision == tp / (tp + fp)
    assert m.recall == tp / (tp + fn)
    assert m.f1 == pytest.approx(2 * m.precision * m.recall / (m.precision + m.recall))
    assert m.accuracy > 0.7
    agree = predictions.where("(probability > 0.5) = (prediction = 1)").count()
    assert agree == 60


def test_gradients_vanish_at_the_fit_only(table, fitted):
    rows = baseline.stationarity(fitted).collect()
    assert [r.feature for r in rows] == list(STATION.model_features)
    assert all(abs(r.gradient) <= 1e-6 * abs(r.gradient_at_zero) for r in rows)
    assert max(abs(r.gradient_at_zero) for r in rows) > 1e-4
    train = table.toPandas()
    train = train[train.month_start <= months(15)[11]]
    y = train[baseline.TARGET].to_numpy()
    weight = np.where(y == 1, 1 / (2 * y.sum()), 1 / (2 * (1 - y).sum()))
    expected = train[list(STATION.model_features)].to_numpy().T @ (weight * (0.5 - y))
    assert np.allclose([r.gradient_at_zero for r in rows], expected)


def test_a_step_that_overshoots_is_halved(spark):
    # From zero, the full Newton step on far outliers makes the loss larger.
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=60), [300.0, -250.0, 400.0]])
    y = np.concatenate([(x[:60] + rng.normal(size=60) > 0).astype(int), [0, 1, 0]])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    found = newton.fit(df, ["x"], "y", "1.0", 1e-3)
    coefficients, intercept = newton_logistic_by_bisection(x, y, 1e-3)
    assert found.coefficients[0] == pytest.approx(coefficients, rel=1e-6)
    assert found.intercept == pytest.approx(intercept, rel=1e-6, abs=1e-9)


def newton_logistic_by_bisection(x, y, penalty):
    """Minimum over two numbers, each found by bisection of the derivative."""

    def residual(b, a):
        return 1 / (1 + np.exp(-np.clip(b * x + a, -700, 700))) - y

    def root(f, low, high):
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) < 0 else (low, middle)
        return (low + high) / 2

    def best_intercept(b):
        return root(lambda a: residual(b, a).sum(), -1000, 1000)

    b = root(lambda b: x @ residual(b, best_intercept(b)) + penalty * b, -50, 50)
    return b, best_intercept(b)


def test_saved_model_scores_like_the_fitted_one(spark, table, fitted, tmp_path):
    target = str(tmp_path)
    results = pipeline.model(table, target=target)
    loaded = baseline.Model.load(spark, f"{target}/model")
    assert loaded.coefficients == pytest.approx(fitted.model.coefficients, rel=1e-8)
    by_stage = SQLTransformer.load(f"{target}/model/scoring").transform(table)
    mine, theirs, saved = (
        sorted(map(tuple, df.select("month_start", "station_id", "prediction", "probability").collect()))
        for df in (pipeline.score(spark, target, table), by_stage, results["predictions"])
    )
    assert mine == theirs
    assert saved == mine[-60:]
    saved_plan = results["metrics"]._jdf.queryExecution().executedPlan().toString()
    assert "exp(" not in saved_plan and "ReadSchema" in saved_plan  # scores read the saved rows, nothing is fitted or scored again
    holes = table.limit(1).withColumn("avg_flow", F.lit(None).cast("double"))
    assert pipeline.score(spark, target, holes).select("prediction", "probability").first() == (None, None)
    with pytest.raises(Exception, match="already exists"):
        pipeline.model(table, target=target)


def test_model_of_a_saved_table(table):
    results = pipeline.model(table)
    assert results["predictions"].count() == 60
    assert sum(r.row_count for r in results["confusion_matrix"].collect()) == 60
    assert {r.split: r.row_count for r in results["split_summary"].collect()} == {"train": 240, "test": 60}


def test_undefined_ratios_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], f"{baseline.TARGET} int, prediction int")
    assert tuple(baseline.classification_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in baseline.confusion_matrix(df).collect()] == [
        (0, 0, 2),
        (0, 1, 0),
        (1, 0, 0),
        (1, 1, 0),
    ]


def test_one_class_is_an_error(table):
    with pytest.raises(ValueError, match="both classes"):
        baseline.fit_baseline(table.withColumn(baseline.TARGET, F.lit(0)))


def test_split_summary(table):
    rows = {r["split"]: r for r in baseline.split_summary(baseline.time_split(table)).collect()}
    assert rows["train"].row_count == 240 and rows["test"].row_count == 60
    assert rows["train"].column_count == len(table.columns)
    assert rows["train"].last_month < rows["test"].first_month
