"""Exact top-k search by inner product over norm buckets.

Components are turned into ``floor(256 * x)``, scores are integer inner products. Vectors
are grouped by length into buckets a factor ``RATIO`` wide, and buckets are cut into blocks
of about ``vectors.BLOCK``. The blocks of the longest bucket go first and give each query a
lower bound on its k-th score. Then a query visits only those blocks whose longest vector
could reach its bound. In a block the bound becomes a local cosine threshold, and the block
is pruned by length (a vector shorter than bound / query length is out) or, where the
threshold leaves a narrow range, by coordinate: a cosine of t leaves a vector's direction
only an interval on each of the query's strongest coordinates. All that remain have their
products computed, so pruning never changes a result.

Defined cases: vectors that are NULL or empty or hold a NULL or non-finite component, and
rows with a NULL id take no part; zero vectors do, with score 0; missing components of
shorter vectors count as 0; rows repeating id and vector count once; equal vectors are one
class whose ids come in order; an empty table gives an empty result; a score beyond 64 bits
fails the query instead of being rounded; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm import vectors
from driftmart.llm.common import saved

RATIO = 1.05
FOCUS = 3
# Below this cosine the intervals are too wide to be worth a look.
COORDINATE_FROM = 0.6
SLACK = 1e-9


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; floating-point sums are exact below 2 to the 53."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows.tolist()]
    return np.array(exact, np.int64)


def search_block(wanted: int):
    def search(rows, ids, queries, own, bounds):
        norms = np.sqrt((rows**2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        rows, norms, ids = rows[order], norms[order], [ids[i] for i in order]
        directions = rows / np.maximum(norms, 1e-300)[:, None]
        found = []
        for k, query in enumerate(queries):
            bound, size = bounds[k], float(np.sqrt((query**2).sum()))
            keep = np.arange(len(rows))
            if bound > 0 and size > 0:
                # By length: the vectors are in order, so this is a prefix.
                reach = int(np.searchsorted(-norms, -(bound / size) * (1 - SLACK), side="right"))
                keep = keep[:reach]
                cosine = bound / (size * norms[0]) if norms[0] else 2.0
                if reach and COORDINATE_FROM <= cosine <= 1:
                    unit = query / size
                    least = cosine * (1 - SLACK)
                    for f in np.argsort(-np.abs(unit))[:FOCUS]:
                        spread = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - least**2))) + SLACK
                        on = directions[keep, f]
                        # Cosines of at least this mean an angle of at most acos(least).
                        low = -1.0 if -unit[f] > least else unit[f] * least - spread
                        high = 1.0 if unit[f] > least else unit[f] * least + spread
                        keep = keep[(on >= low) & (on <= high)]
            if not len(keep):
                continue
            scores = exact_products(rows[keep], query)
            near = vectors.take(scores, [ids[i] for i in keep], int(own[k]), wanted)
            found += [(q, v, int(s)) for q, v, s in near if s >= bound]
        return found

    return search


def top_products(table: DataFrame, is_query: Column, wanted: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``wanted`` highest integer inner products per query."""
    valid = vectors.valid(table, nonzero=False)
    # Beyond 64 bits floor() would saturate.
    scaled = F.transform(
        "vec",
        lambda x: F.when(F.abs(x) < F.lit(2.0**55), F.floor(x * 256).cast("double")).otherwise(
            F.raise_error(F.lit("a component is beyond 64 bits")).cast("double")
        ),
    )
    rows = saved(valid.select("vec_id", scaled.alias("vec")), "scaled")
    size = vectors.length()
    points = vectors.classes(rows, wanted).withColumn("norm", size)
    bucket = F.when(F.col("norm") > 0, F.floor(F.ln("norm") / F.lit(float(np.log(RATIO))))).otherwise(-1)
    points = saved(points.withColumn("bucket", bucket), "lengths")
    # One row per bucket: the number of its blocks and of those before it, longest first.
    per_bucket = points.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / vectors.BLOCK).cast("long").alias("blocks")
    )
    before = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("long"))
    dealt = saved(
        points.join(per_bucket, "bucket").select(
            "vec", "ids", "norm", (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("blocks"))).alias("block")
        ),
        "norm-blocks",
    )
    longest = dealt.groupBy("block").agg(F.max("norm").alias("longest"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    query_blocks = max(1, -(-queries.count() // vectors.QUERY_BLOCK))
    queries = queries.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    # Block 0 for all; as a literal it would leave the join without a key.
    head = queries.withColumn("block", F.pmod(F.col("qblock"), F.lit(1)).cast("long")).withColumn(
        "bound", F.lit(float("-inf"))
    )
    first = saved(vectors.meet(dealt, head, search_block(wanted), "long"), "longest")
    bounds = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= wanted, F.min("score").cast("double")).alias("bound")
    )
    bounded = queries.join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("-inf")))
    )
    last = dealt.agg(F.max("block")).first()[0] or 0
    rest = (
        bounded.withColumn("size", size)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
        .where("block > 0")
        .join(longest, "block")
        .where((F.col("bound") <= 0) | (F.col("size") * F.col("longest") * (1 + SLACK) >= F.col("bound")))
        .select("block", "qblock", "query_id", "vec", "bound")
    )
    more = vectors.meet(dealt.where("block > 0"), rest, search_block(wanted), "long")
    return vectors.best(first.unionByName(more), wanted)


ORACLE = """
WITH parts AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([a[1] * a[2] for a in list_zip(q.vec, c.vec)])::BIGINT AS score
  FROM parts q JOIN parts c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
