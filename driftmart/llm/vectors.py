"""Vectors for the search operators: valid ones, one per class of equal vectors, dealt to blocks.

A search compares a stated set of queries with all vectors, block by block: candidate
blocks and query blocks have bounded sizes, and each pair of blocks is one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_BLOCK = 256


def valid(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, vec of the rows that take part, each pair once."""
    bad = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.where(F.size("embedding") > 0)
    if nonzero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).distinct()


def classes(rows: DataFrame, wanted: int) -> DataFrame:
    """vec and the ``wanted + 1`` smallest ids of each class of equal vectors.

    A query asks for ``wanted`` neighbours besides itself, ties to smaller ids, so no other
    member of a class can be in a result. The limit acts before the shuffle, too.
    """
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= wanted + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def length(vec: str = "vec") -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def widest(column: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(column)).as_py() or 0


Search = Callable[[np.ndarray, list[list[int]], np.ndarray, np.ndarray, np.ndarray], list[tuple]]


def meet(candidates: DataFrame, queries: DataFrame, search: Search, score_type: str) -> DataFrame:
    """query_id, vec_id, score of ``search`` for every pair of a candidate and a query block.

    candidates: block, vec, ids. queries: block, qblock, query_id, vec, bound; a query goes to
    the blocks it names. Groups without queries are not formed.
    """
    wanted = queries.select("block", "qblock").distinct()
    sides = candidates.join(wanted, "block").select(
        "block", "qblock", F.lit(None).cast("long").alias("query_id"), "vec", "ids", F.lit(None).cast("double").alias("bound")
    )
    sides = sides.unionByName(
        queries.select("block", "qblock", "query_id", "vec", F.lit(None).cast("array<long>").alias("ids"), "bound")
    )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        asks = rows.column("query_id").is_valid().to_numpy()
        here, there = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
        found: list[tuple] = []
        if len(here) and len(there):
            width = widest(rows.column("vec"))
            found = search(
                matrix(here.column("vec"), width),
                here.column("ids").to_pylist(),
                matrix(there.column("vec"), width),
                there.column("query_id").to_numpy(),
                there.column("bound").to_numpy(),
            )
        kind = pa.int64() if score_type == "long" else pa.float64()
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)],
            names=["query_id", "vec_id", "score"],
        )

    return sides.groupBy("block", "qblock").applyInArrow(group, f"query_id long, vec_id long, score {score_type}")


def best(found: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` highest scores per query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= wanted)
        .select("query_id", "rank", "vec_id", "score")
    )


def take(scores: np.ndarray, ids: list[list[int]], own: int, wanted: int) -> list[tuple]:
    """(own, id, score) of the best ids other than ``own``, from classes and their scores."""
    if len(scores) > wanted + 1:
        floor = np.partition(scores, -(wanted + 1))[-(wanted + 1)]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    pairs = [(-scores[i], v) for i in near.tolist() for v in ids[i] if v != own]
    pairs.sort()
    return [(own, v, -s) for s, v in pairs[:wanted]]
