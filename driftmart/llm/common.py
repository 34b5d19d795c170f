"""What the corpus operators share: tables, saved intermediates, Arrow text as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmart.session import shared_folder

# Text bytes that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
# Rows up to which a table with one row per source or label is broadcast.
SMALL_TABLE_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the folder all nodes share and read back, so that no later failure recomputes it."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def normal_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; NULL is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, starts


def steps(starts: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, at least one row each."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd 64-bit integers."""
    base = np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + base) | np.uint64(1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for every (start, length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    out = np.ones(total, np.int64)
    firsts = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[firsts[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
