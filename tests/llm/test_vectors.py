"""The vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmart.llm import inner_product, neighbours, queries, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, block long")


def odd_rows():
    rng = np.random.RandomState(4)
    rows = [(i, rng.standard_normal(8).tolist(), None, 1) for i in range(400)]
    rows += [(1000 + i, rows[7][1], None, 1) for i in range(60)]  # equal vectors
    rows += [(2000, None, 0, 0), (2020, [], 0, 0), (2040, [1.0, None], 0, 0), (2060, [float("nan")] * 8, 0, 0)]
    rows += [(2080, [float("inf")] * 8, 0, 0), (2100, [0.0] * 8, 0, 0), (None, [1.0] * 8, 0, 0), rows[0]]
    return rows


def plain(rows, step, wanted, scale, zeros):
    data = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = scale(np.float32(v).astype(float))
        if zeros or x.any():
            data[i] = x
    out = set()
    for q in data:
        if q % step == 0:
            scored = sorted((-float(data[q] @ data[c]), c) for c in data if c != q)[:wanted]
            out |= {(q, k + 1, c) for k, (_, c) in enumerate(scored)}
    return out


def test_exact_products_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rows = odd_rows()
    found = inner_product.top_products(table(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    expected = plain(rows, 20, 5, lambda x: np.floor(256 * x), True)
    assert {(r.query_id, r.rank, r.vec_id) for r in found} == expected


def test_components_beyond_64_bits_fail(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0**55])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        inner_product.top_products(rows, F.col("vec_id") == 0).collect()


def test_nearest_with_ties_and_odd_rows(spark):
    rows = odd_rows()
    found = neighbours.nearest(table(spark, rows[:200] + rows[400:]), F.col("vec_id") % 20 == 0, 20).collect()
    expected = plain(rows[:200] + rows[400:], 20, 20, lambda x: x, False)
    mine = {(r.query_id, r.vec_id) for r in found}
    assert len(found) == len(expected)
    assert len(mine & {(q, c) for q, _, c in expected}) >= 0.97 * len(expected)


def test_empty_and_fewer_than_wanted(spark):
    empty = table(spark, [])
    assert neighbours.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert inner_product.top_products(empty, F.col("vec_id") % 50 == 0).count() == 0
    three = table(spark, [(0, [1.0, 2.0], 0, 0), (1, [1.0, 0.0], 0, 0), (2, [0.0, 3.0], 0, 0)])
    assert [r.vec_id for r in neighbours.nearest(three, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]


def recall(found, ids, data, queries):
    """Share of the true nearest found per query; checks scores and order of what was found."""
    place = {int(v): k for k, v in enumerate(ids)}
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r)
    shares = []
    for q in queries:
        scores = neighbours.sequential_products(data, data[place[q]])
        rows = by_query[q]
        assert [r.rank for r in rows] == list(range(1, 21))
        assert [r.score for r in rows] == [scores[place[r.vec_id]] for r in rows]
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        order = np.lexsort((ids, -scores))
        best = [v for v in ids[order[:21]].tolist() if v != q][:20]
        shares.append(len({r.vec_id for r in rows} & set(best)) / 20)
    return np.array(shares)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_whole_tables(spark, small, scale):
    folder = small.replace("sf0.001", scale)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    data = np.array([r.embedding for r in rows], float)
    shares = recall(queries.op3_neighbours(spark, folder).collect(), ids, data, ids[ids % 20 == 0].tolist())
    assert shares.mean() >= 0.97
    assert (shares < 0.9).mean() <= 0.03


@pytest.mark.parametrize("size", [3_000, 50_000])
def test_recall_on_vectors_without_structure(spark, size):
    data = np.random.RandomState(6).standard_normal((size, 48))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(size), "embedding": pa.array(list(data))}))
    step = size // 100
    found = neighbours.nearest(rows, F.col("vec_id") % step == 0, 20).collect()
    shares = recall(found, np.arange(size), data, range(0, size, step))
    assert shares.mean() >= 0.97
    assert (shares < 0.9).mean() <= 0.03
