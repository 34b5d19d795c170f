"""Every registered query against its SQL on DuckDB, compared without tolerance."""

from dataclasses import replace

import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as contract

from driftmart.plans import mart
from driftmart.plans.oracle import oracle_sql
from driftmart.plans.queries import REGISTRY
from driftmart.sources import star

# The optional corpus queries have their own tests.
ORACLE = oracle_sql()
WITHOUT_SQL = {"ml_predictions", "ml_metrics", "ml_confusion"}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_only_model_fitting_lacks_sql():
    assert set(REGISTRY) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(REGISTRY) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, con, name):
    assert compare(contract.queries()[name](spark, small), con, ORACLE[name]) is None


@pytest.mark.parametrize(
    "change", [{"prev_threshold": 0.2}, {"rolling_threshold": 0.2}, {"baseline_threshold": 0.3}, {"window": 2}]
)
def test_a_wrong_constant_shows(spark, small, con, change):
    wrong = replace(star.SPEC, **change)
    flags = mart.flagged(mart.monthly(star.measurements(spark, small), wrong), wrong)
    renamed = dict(zip(wrong.flag_columns, star.SPEC.flag_columns))
    columns = [F.col(c).alias(renamed.get(c, c)) for c in (*wrong.grain, *wrong.flag_columns)]
    assert compare(flags.select(*columns), con, ORACLE["signal_flags"]) is not None


def test_entry(spark, small):
    assert len(contract.entry(spark).columns) == 51
