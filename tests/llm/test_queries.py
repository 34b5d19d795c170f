"""Registered corpus queries against their SQL, and the pipeline."""

from __future__ import annotations

import duckdb
import pytest
from check_oracle import compare

import corpus_pipeline
from driftmart.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert compare(queries.REGISTRY[name](spark, small), con, queries.ORACLE_SQL[name]) is None


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in queries.REGISTRY] == [f"op{n}" for n in range(1, 14)]


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, small)
    single = corpus_pipeline.distinct_documents(spark, known, small)
    clean = corpus_pipeline.without_secrets(spark, single, small)
    mixed = corpus_pipeline.mixed_sources(spark, clean, small)
    assert known.columns == single.columns == clean.columns == mixed.columns == docs.columns
    assert docs.count() >= known.count() > single.count() == clean.count()
    kept = queries.near_dups.near_duplicates(known).where("kept").select("doc_id").collect()
    assert sorted(kept) == sorted(single.select("doc_id").collect())
    assert clean.where("text RLIKE '[0-9a-f]{32,}'").count() == 0
    tokens = corpus_pipeline.run(spark, small)
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(r.doc_id for r in mixed.collect())
    assert tokens.where("NOT round_trip").count() == 0
