"""SQL expressions shared by the operators.

They are text for ``selectExpr``/``F.expr``: Spark parses a whole block of
columns in one call, where composing ``Column`` objects costs several
driver-to-JVM calls per operator of every formula. All of them are built-in
functions inside code generation.
"""

from __future__ import annotations

from pyspark.sql import types as T

from driftmart.spec import Metric

# Tolerances of the numeric comparison.
RELATIVE_TOLERANCE = 1e-5
ABSOLUTE_TOLERANCE = 1e-8


def name(column: str) -> str:
    return f"`{column}`"


def named(expression: str, column: str) -> str:
    return f"{expression} AS {name(column)}"


def number(value: float) -> str:
    return f"{value!r}D"


def month_start(date_column: str) -> str:
    """First day of the month, as a date."""
    return f"trunc({name(date_column)}, 'month')"


def nan_to_null(column: str) -> str:
    """Spark averages propagate NaN and ``NaN >= t`` is true, so a NaN reading has to become NULL."""
    return f"nanvl({name(column)}, NULL)"


def text(value: str) -> str:
    """A string literal; quotes and backslashes in the value are data."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def present(metric: Metric, data_type: T.DataType | None = None) -> str:
    """The metric's reading, NULL where it is missing or NaN."""
    floating = data_type is None or isinstance(data_type, (T.DoubleType, T.FloatType))
    return nan_to_null(metric.name) if floating else name(metric.name)


def sum_of(metric: Metric, data_type: T.DataType | None = None) -> str:
    """Sum of a metric, in units of its last decimal if it has declared decimals.

    With known decimals the sum runs over whole units (a long): exact, and cheaper
    than a decimal sum because neither the cast nor the buffer leaves primitives. A
    reading that is no whole number of units fails the aggregate; none is rounded.
    """
    value = present(metric, data_type)
    if metric.decimals is None:
        return f"sum({value})"
    unit = number(float(10**metric.decimals))
    scaled = f"{value} * {unit}"
    # Floating-point products of on-grid readings miss whole units by a few ulps only.
    on_grid = f"abs({scaled} - rint({scaled})) <= 1e-9D * greatest(1D, abs({scaled}))"
    complaint = text(f"{metric.name} has more than {metric.decimals} decimals")
    return (
        f"sum(CASE WHEN {value} IS NULL THEN NULL WHEN {on_grid} THEN cast(rint({scaled}) AS BIGINT)"
        f" ELSE cast(raise_error({complaint}) AS BIGINT) END)"
    )


def mean_from(metric: Metric, total: str, count: str) -> str:
    """Average from a sum by ``sum_of`` and the number of readings present."""
    unit = number(float(10 ** (metric.decimals or 0)))
    return f"try_divide(cast({total} AS DOUBLE) / {unit}, {count})"


def mean_of(metric: Metric, data_type: T.DataType | None = None) -> str:
    """Average of a metric; NULL and NaN readings are skipped."""
    value = present(metric, data_type)
    if metric.decimals is None:
        return f"avg({value})"
    return mean_from(metric, sum_of(metric, data_type), f"count({value})")


def mean_of_present(columns: list[str]) -> str:
    """Row-wise mean of the columns that are not NULL, added up in the given order."""
    total = " + ".join(f"coalesce({name(c)}, 0D)" for c in columns)
    present = " + ".join(f"if({name(c)} IS NULL, 0, 1)" for c in columns)
    return f"try_divide({total}, {present})"


def difference(value: str, base: str) -> str:
    return f"{name(value)} - {name(base)}"


def relative_difference(value: str, base: str) -> str:
    """``(value - base) / base``; NULL for a zero or missing base (ANSI division would raise)."""
    return f"try_divide({name(value)} - {name(base)}, {name(base)})"


def flag(condition: str) -> str:
    """1 or 0, and 0 where the condition is unknown."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def reaches(ratio: str, threshold: float) -> str:
    return f"abs({name(ratio)}) >= {number(threshold)}"


def share_of(flag_column: str) -> str:
    """Mean of a 0/1 column from two longs, hence exact whatever the task order."""
    return f"cast(sum({name(flag_column)}) AS DOUBLE) / count(1)"


def is_close(a: str, b: str) -> str:
    """Approximate equality of two numbers, scaled by ``b``; two missing values are equal."""
    x, y = f"double({name(a)})", f"double({name(b)})"
    tolerance = f"{number(ABSOLUTE_TOLERANCE)} + {number(RELATIVE_TOLERANCE)} * abs({y})"
    near = f"abs({y}) < double('Infinity') AND abs({x} - {y}) <= {tolerance}"
    return f"({name(a)} <=> {name(b)} OR coalesce({near}, false))"


def same_value(a: str, b: str, data_type: T.DataType) -> str:
    """Tolerant for numbers, exact for everything else, NULL equals NULL."""
    if isinstance(data_type, T.NumericType):
        return is_close(a, b)
    return f"({name(a)} <=> {name(b)})"
