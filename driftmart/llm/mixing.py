"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its share by weight of the wanted total, at most
``cap`` times its own size, the excess reshared by weight. A document is expected
``target / size of its source`` times. The whole part of that is certain: so many
copies of every document are taken. The fraction is the inclusion probability p of one
more copy, decided by Pareto order sampling: documents are ranked by the odds of a
random number divided by the odds of p, and the smallest ranks are taken until their
words meet what the certain copies leave of the target.

Nothing is sorted by source as a whole. A histogram of the ranks finds the one narrow
bin per source in which the target is met; only that bin's documents are put in order.
The outcome is a cut per source, so that each document's decision needs no shuffle.

Only DataFrame functions are used. Random numbers come from the document's id, hence
reruns and retried tasks agree. Where several rows share an id (NULL always counts as
shared), a row's text and its place in the table come in, so each is decided by itself.

Defined cases: NULL or blank text has 0 words and follows its source; NULL ``source``
is a source of its own, last in order; rows that share ``doc_id`` are documents of their
own; an empty table gives an empty result; other columns are not touched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm.common import SMALL_TABLE_ROWS, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix"
# Bins of the rank histogram: a source's documents in order are at most about one of
# so many parts of it.
BINS = 4096
SALTS = 32


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def drawn(docs: DataFrame) -> DataFrame:
    """Adds ``_draw``, the text that a row's random number is a function of."""
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(shared.select(F.col("doc_id").alias("_shared")), "mix-shared-ids")
    count = shared.limit(SMALL_TABLE_ROWS + 1).count()
    if count:
        # A shared id's rows are split by adaptive execution where the ids are too many to broadcast.
        right = F.broadcast(shared) if count <= SMALL_TABLE_ROWS else shared
        docs = docs.join(right, F.col("doc_id") == F.col("_shared"), "left")
        is_shared = F.col("doc_id").isNull() | F.col("_shared").isNotNull()
    else:
        is_shared = F.col("doc_id").isNull()
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    row = F.concat_ws(":", own, text, F.monotonically_increasing_id().cast("string"))
    return docs.withColumn("_draw", F.when(is_shared, row).otherwise(own)).drop("_shared")


def random_number(draw: str = "_draw", seed: str = SEED) -> Column:
    """Uniform in (0, 1), from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(draw))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def pareto_rank(u: Column, p: Column) -> Column:
    """Odds of the random number over the odds of inclusion; NULL where nothing is left to sample."""
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def rank_bin(rank: Column) -> Column:
    return F.floor(rank / (1 + rank) * BINS)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """One row per source: source, source_size, target, copies (certain), p (of one more), rest (words)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on; both orders are over that small table.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))
    everything = Window.partitionBy()
    weighted = totals.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.col("source_size") * F.lit(float(cap))
    )
    # Sources reach their cap in the order of limit / weight.
    order = [
        (F.col("limit") / F.col("weight")).asc(),
        F.col("source").asc_nulls_last(),
    ]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = weighted.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("taken_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_onward"),
    ).withColumn(
        "full",
        (F.col("total") - F.col("taken_before")) * F.col("weight")
        >= F.col("limit") * F.col("weight_onward"),
    )
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    full_words = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0))
    shared = (F.col("total") - full_words) * F.col("weight") / open_weight
    target = F.when(F.col("full"), F.col("limit")).otherwise(shared)
    ratio = F.col("target") / F.col("source_size")
    certain = F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0)
    rest = F.col("target") - F.col("copies") * F.col("source_size")
    return (
        filled.select("source", "source_size", target.alias("target"))
        .withColumn("copies", certain.cast("long"))
        .withColumn("rest", rest)
        .withColumn(
            "p",
            F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0),
        )
    )


def _with_source(rows: DataFrame, per_source: DataFrame, key: str = "source") -> DataFrame:
    """Inner join on a source that may be NULL, without moving ``rows`` while sources are few.

    Beyond that the source's row is repeated per salt, so a hot source is many keys.
    """
    fields = [c for c in per_source.columns if c != "source"]
    right = per_source.select(F.col("source").alias("_source"), F.struct(*fields).alias("_mix"))
    same = F.col(key).eqNullSafe(F.col("_source"))
    if per_source.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS:
        return rows.join(F.broadcast(right), same).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(copies, same & (F.col("_salt") == F.col("_salt2")))
    return joined.drop("_source", "_salt", "_salt2")


def source_cuts(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """``source_targets`` plus the cut: all bins below ``cut_bin``, and up to (cut_rank, cut_id) in it."""
    targets = saved(source_targets(sizes, weights, share, cap), "mix-targets")
    rank = pareto_rank(random_number("_draw", seed), F.col("_mix.p"))
    ranked = _with_source(sizes, targets).select(
        "doc_id", "source", "size", F.col("_mix.rest").alias("rest"), rank.alias("rank")
    )
    ranked = ranked.where("rank IS NOT NULL").withColumn("bin", rank_bin(F.col("rank")))
    bins = ranked.groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest")
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("words").over(upto))
    crossing = (
        bins.where("upto > rest")
        .groupBy("source")
        .agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("words_before")), "bin").alias("c"))
        .select("source", F.col("c.bin").alias("cut_bin"), "c.words_before")
    )
    cuts = targets.join(
        crossing.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).drop("_s")
    cuts = saved(cuts, "mix-bins")
    inside = _with_source(
        ranked.select("doc_id", "source", "size", "rank", "bin"), cuts
    ).where(F.col("bin") == F.col("_mix.cut_bin"))
    running = (
        Window.partitionBy("source")
        .orderBy("rank", F.col("doc_id").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    middle = F.col("_mix.words_before") + F.sum("size").over(running) - F.col("size") / 2
    last = (
        inside.withColumn("middle", middle)
        .where(F.col("middle") <= F.col("_mix.rest"))
        .groupBy("source")
        .agg(F.max(F.struct("rank", "doc_id")).alias("last"))
        .select(F.col("source").alias("_s"), F.col("last.rank").alias("cut_rank"), F.col("last.doc_id").alias("cut_id"))
    )
    return cuts.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "words_before")


def with_copies(rows: DataFrame, cuts: DataFrame, seed: str = SEED, column: str = "_copies") -> DataFrame:
    """Adds the number of copies each row gets, and the source's row as ``_mix``."""
    rank = pareto_rank(random_number("_draw", seed), F.col("_mix.p"))
    place = F.struct(F.col("_rank").alias("rank"), F.col("doc_id"))
    cut = F.struct(F.col("_mix.cut_rank").alias("rank"), F.col("_mix.cut_id").alias("doc_id"))
    more = (
        F.when(F.col("_rank").isNull(), False)
        .when(F.col("_mix.cut_bin").isNull(), True)
        .when(rank_bin(F.col("_rank")) < F.col("_mix.cut_bin"), True)
        .when(rank_bin(F.col("_rank")) > F.col("_mix.cut_bin"), False)
        .when(F.col("_mix.cut_rank").isNull(), False)
        .otherwise(place <= cut)
    )
    joined = _with_source(rows, cuts).withColumn("_rank", rank)
    return joined.withColumn(column, F.col("_mix.copies") + more.cast("long")).drop("_rank")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, ``_draw``; saved, so that texts are read once."""
    rows = drawn(docs.select("doc_id", "source", "text"))
    return saved(rows.select("doc_id", "source", word_count("text").alias("size"), "_draw"), "mix-sizes")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sizes = document_sizes(docs)
    chosen = with_copies(sizes, source_cuts(sizes, weights, share, cap, seed), seed, "copies")
    return chosen.select(
        "doc_id",
        "source",
        "size",
        F.col("_mix.source_size").alias("source_size"),
        F.col("_mix.target").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, repeated by their copies."""
    cuts = source_cuts(document_sizes(docs), weights, share, cap, seed)
    counted = with_copies(drawn(docs), cuts, seed)
    repeated = counted.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return repeated.select(*docs.columns)


# The same result for doc_id, size, source_size, target, taken in DuckDB SQL.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS lim,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM totals),
filled AS (
  SELECT *,
         coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before,
         sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_onward
  FROM weighted),
marked AS (SELECT *, (total - taken_before) * weight >= lim * weight_onward AS is_full FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN lim
              ELSE (total - coalesce(sum(lim) FILTER (is_full) OVER (), 0)) * weight
                   / sum(weight) FILTER (NOT is_full) OVER () END AS target
  FROM marked),
certain AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM targets),
rests AS (SELECT *, target - copies * source_size AS rest,
                 CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS p
          FROM certain),
drawn AS (
  SELECT s.doc_id, s.size, r.*,
         (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
ranked AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rnk FROM drawn),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id NULLS FIRST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN rnk IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
