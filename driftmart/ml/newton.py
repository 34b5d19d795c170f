"""Weighted, L2-penalised logistic regression by Newton steps.

Every step is one pass: each row becomes a short vector, and the cross products of these
vectors, summed by Spark's Gramian (a tree aggregation inside the JVM), hold curvature,
gradient and loss at once. Only that matrix, of (features + 3) squared numbers, comes to the
driver, which solves for the next step. A step that makes the loss larger is halved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame

from driftmart.functions.expressions import name, named

# A fit ends when each feature's gradient is below this share of its value at zero
# coefficients, or with the step that promises to lower the loss by less than this share of it:
# steps converge quadratically, so what is left after that one is rounding.
GRADIENT_SHARE = 1e-9
LEAST_GAIN = 1e-15
MAX_PASSES = 40
# Curvature of a row is never taken as less, so that a division by it is possible.
LEAST_CURVATURE = 1e-30


@dataclass(frozen=True)
class Solution:
    coefficients: tuple[float, ...]
    intercept: float
    passes: int


def linear(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> str:
    """SQL text of the linear predictor."""
    return " + ".join([f"{float(intercept)!r}D", *[f"{float(b)!r}D * {name(f)}" for f, b in zip(features, coefficients)]])


def _evaluate(rows: DataFrame, features: Sequence[str], label: str, weight: str, beta: np.ndarray):
    """Loss, gradient and curvature of the unpenalised loss; the intercept comes last."""
    inputs = [f"cast({name(f)} AS double)" for f in features]
    with_eta = rows.selectExpr(
        *[named(x, f"x{i}") for i, x in enumerate(inputs)],
        named(f"cast({label} AS double)", "y"),
        named(f"cast({weight} AS double)", "w"),
        named(linear(features, beta[:-1], beta[-1]), "eta"),
    ).selectExpr("*", "1 / (1 + exp(-eta)) AS p")
    with_root = with_eta.selectExpr("*", f"sqrt(greatest(w * p * (1 - p), {LEAST_CURVATURE!r}D)) AS c")
    parts = with_root.selectExpr(
        *[f"c * x{i} AS v{i}" for i in range(len(inputs))],
        "c AS v",
        "w * (p - y) / c AS residual",
        "sqrt(w * (greatest(eta, 0) - y * eta + log1p(exp(-abs(eta))))) AS loss",
    )
    vectors = VectorAssembler(inputCols=parts.columns, outputCol="row").transform(parts).select("row")
    sums = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row")).computeGramianMatrix().toArray()
    n = len(features) + 1
    return sums[n + 1, n + 1], sums[:n, n], sums[:n, :n]


def fit(rows: DataFrame, features: Sequence[str], label: str, weight: str, penalty: float) -> Solution:
    """Minimise ``sum(weight * log-loss) + penalty / 2 * |coefficients|^2`` with a free intercept.

    ``label`` and ``weight`` are SQL expressions. ``rows`` are read once per pass, so they
    should be saved. Fails if the loss does not settle within ``MAX_PASSES``.
    """
    ridge = np.append(np.full(len(features), float(penalty)), 0.0)

    def at(beta: np.ndarray):
        loss, gradient, curvature = _evaluate(rows, features, label, weight, beta)
        return loss + float(ridge @ beta**2) / 2, gradient + ridge * beta, curvature + np.diag(ridge)

    beta = np.zeros(len(features) + 1)
    loss, gradient, curvature = at(beta)
    start, passes = np.abs(gradient[:-1]), 1
    while passes < MAX_PASSES:
        if (np.abs(gradient[:-1]) <= GRADIENT_SHARE * start).all() and passes > 1:
            break
        scale = 1 / np.sqrt(np.maximum(np.diag(curvature), LEAST_CURVATURE))
        step = scale * np.linalg.lstsq(curvature * np.outer(scale, scale), scale * gradient, rcond=1e-15)[0]
        if gradient @ step / 2 <= LEAST_GAIN * loss:
            beta = beta - step
            break
        share = 1.0
        while True:
            candidate = at(beta - share * step)
            passes += 1
            if candidate[0] <= loss * (1 + 1e-12) or passes >= MAX_PASSES:
                break
            share /= 2
        beta = beta - share * step
        loss, gradient, curvature = candidate
    else:
        raise RuntimeError(f"the fit did not settle in {MAX_PASSES} passes")
    return Solution(tuple(map(float, beta[:-1])), float(beta[-1]), passes)
