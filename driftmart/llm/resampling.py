"""Target-distribution importance resampling: documents that look like a target text are drawn more often.

Features are all runs of one and two words, hashed into buckets. Every bucket has a gain, the
log ratio of its share of the target's features to its share of the corpus'; a document's
weight is the mean gain of its features. Adding Gumbel noise to the weights and keeping the
highest scores draws without replacement in proportion to the importance weights.

1. Two counting jobs give the features per bucket, of corpus and target. Their sum has one
   number per bucket, the only table that comes to the driver; the gains go back as an array.
2. One pass scores all documents against that array, and the scores are saved.
3. The cut-off is bisected on numbers: each job counts, over the saved scores, how many rows
   reach each of a few thresholds, until one score is left, then one ``doc_id`` among the
   rows that tie there. No sort of all rows, no list of scores on the driver.
4. Only rows up to the cut-off are dealt out by ranges of (score, doc_id), sorted within their
   range and numbered from the ranges' sizes.

Style: Arrow batches for the features, DataFrame jobs for the rest.

Defined cases: NULL or wordless text has no features, weight 0 and is never drawn where
``least_words`` is positive; NULL ``doc_id`` draws its noise for the empty id and is last
among ties; repeated ids are rows of their own, ties among them go to fewer features; an
empty target or corpus counts as zero features; an empty table gives an empty result; other
columns are not touched. Texts are worked on in steps of bounded size, a single word of any
length included.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmart.llm.common import saved, string_bytes
from driftmart.llm.words import byte_class, crc_of_words_and_pairs, word_steps

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
# Words are digits, letters a to z (after lower-casing) and all that is not ASCII.
_BLANK = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
# Thresholds that one counting job tries: each job leaves a sixteenth of the interval.
PIVOTS = 15
# Drawn rows per range, and the most ranges.
RANGE_ROWS = 20_000
MOST_RANGES = 4_096
# Row number within a range in ``monotonically_increasing_id``.
_PLACE_BITS = 33


def _buckets(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per step: bucket and row of each word, bucket and row of each pair of words."""
    raw, starts = string_bytes(column)
    carry = None
    for text, first, length, row in word_steps(raw, starts, _BLANK):
        words, pairs, pair_row, carry = crc_of_words_and_pairs(text, first, length, row, carry)
        yield words % np.uint32(buckets), row, pairs % np.uint32(buckets), pair_row


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for words, _, pairs, _ in _buckets(batch.column(0), buckets):
            total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, column: str = "text") -> np.ndarray:
    """Features per bucket over all texts; each task sends at most one number per bucket."""
    rows = texts.select(F.col(column).cast("string").alias("text"))
    counted = rows.mapInArrow(partial(_count, buckets=buckets), "bucket int, n long")
    sums = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of the smoothed shares, rounded down."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    ratios = [(float(t + 1) * all_corpus) / (float(s + 1) * all_target) for s, t in zip(corpus, target)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """A thousand times standard Gumbel noise, a function of the id, rounded down."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, pairs, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for word, row, pair, pair_row in _buckets(batch.column("text"), len(gain)):
                for bucket, of, count in ((word, row, words), (pair, pair_row, pairs)):
                    if len(of):
                        low = of[0] if len(of) == 1 else int(of.min())
                        here = of - low
                        size = int(here.max()) + 1
                        count[low : low + size] += np.bincount(here, minlength=size)
                        # sums of whole numbers, exact in doubles within a step
                        part = np.bincount(here, weights=gain[bucket], minlength=size)
                        total[low : low + size] += part.astype(np.int64)
            features = words + pairs
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            drawn = np.array([noise(x, seed) for x in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (words, features, weight, weight + drawn))],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def highest_reached(rows: DataFrame, value: Column, wanted: int) -> int:
    """The largest number that at least ``wanted`` rows reach, by counting jobs alone."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = high - low
        tried = sorted({low + max(1, width * i // PIVOTS) for i in range(1, PIVOTS + 1)})
        reached = rows.agg(*[F.count_if(value >= F.lit(x)) for x in tried]).first()
        enough = [x for x, n in zip(tried, reached) if n >= wanted]
        short = [x for x, n in zip(tried, reached) if n < wanted]
        low, high = max([low, *enough]), min([high + 1, *short]) - 1
    return low


def _numbered(drawn: DataFrame, wanted: int, size: int) -> DataFrame:
    """``drawn`` with its rank by score and id; NULL beyond ``wanted``."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    parts = min(max(-(-size // RANGE_ROWS), 1), MOST_RANGES)
    placed = saved(
        drawn.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "resample-ranges",
    )
    part = F.shiftright("_place", _PLACE_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())
    before, offsets = 0, []
    for number, rows in sizes:  # one row per range
        offsets.append((number, before))
        before += rows
    offset = drawn.sparkSession.createDataFrame(offsets, "_part long, _before long")
    within = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    rank = F.col("_before") + within + 1
    return placed.join(F.broadcast(offset), part == F.col("_part")).withColumn(
        "rank", F.when(rank <= wanted, rank)
    )


def draw(
    scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS
) -> DataFrame:
    """``scores`` with ``rank``: 1 is the highest score of the share drawn, NULL is not drawn."""
    columns = [*scores.columns, "rank"]
    rows = saved(scores.withColumn("_row", F.monotonically_increasing_id()), "resample-scores")
    eligible = F.col("n_words") >= least_words
    wanted = rows.where(eligible).count() * percent // 100
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    cut = highest_reached(rows.where(eligible), F.col("score"), wanted)
    tied = eligible & (F.col("score") == cut)
    above = rows.where(eligible & (F.col("score") > cut)).count()
    # Smaller ids come first: their complements, larger.
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    last = ~highest_reached(rows.where(tied), F.bitwise_not(key), wanted - above)
    chosen = eligible & ((F.col("score") > cut) | (tied & (key <= F.lit(last))))
    size = rows.where(chosen).count()
    rest = rows.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return _numbered(rows.where(chosen), wanted, size).select(*columns).unionByName(rest.select(*columns))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document."""
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    return draw(scored(docs, gain, seed), percent, least_words)


# The same rows in DuckDB SQL; CRC-32 from its definition, byte by byte over distinct features.
ORACLE = r"""
WITH RECURSIVE crc_step(k, b, c) AS (
  SELECT 0, range, range::UBIGINT FROM range(256)
  UNION ALL
  SELECT k + 1, b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END
  FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT true AS corpus, doc_id, row_number() OVER () AS n,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT false, NULL, row_number() OVER (),
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
lists AS (
  SELECT corpus, doc_id, n, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
words AS (SELECT corpus, n, unnest(w) AS f, unnest(w[2:]) AS following FROM lists),
features AS (
  SELECT corpus, n, f FROM words
  UNION ALL SELECT corpus, n, f || ' ' || following FROM words WHERE following IS NOT NULL),
hashed AS (
  SELECT f, (xor(list_reduce(list_prepend(4294967295::UBIGINT,
               list_transform(range(1, octet_length(encode(f)) + 1),
                 lambda i: ('0x' || substr(hex(encode(f)), (2 * i - 1)::BIGINT, 2))::UBIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c & 255::UBIGINT, b) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000) AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table),
found AS (SELECT corpus, n, bucket FROM features JOIN hashed USING (f)),
buckets AS (
  SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM found GROUP BY bucket),
totals AS (SELECT count(*) FILTER (corpus) AS all_s, count(*) FILTER (NOT corpus) AS all_t FROM found),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g
  FROM buckets, totals),
sums AS (SELECT n, count(*) AS n_features, sum(g) AS total FROM found JOIN gain USING (bucket) WHERE corpus GROUP BY n),
weights AS (
  SELECT doc_id, n, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features > 0
              THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END::BIGINT AS weight
  FROM lists LEFT JOIN sums USING (n) WHERE corpus),
scores AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                                           + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM weights),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS wanted
  FROM scores)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= wanted THEN place END AS rank
FROM ranked
"""
