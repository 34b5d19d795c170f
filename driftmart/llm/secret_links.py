r"""Secrets in texts, with linking of multipart credentials.

Base kinds, leftmost and non-overlapping per kind, are reported wherever they occur:
``assign`` (a secret word, = or :, and a value of 8 or more characters), ``access``
(AKIA identifiers of 16 or more), ``hex`` (32 or more hexadecimal digits).

Weak candidates say little alone. They have roles: ``identifier`` (a named user,
account or key id), ``endpoint`` (an http address), and the secrets ``bare`` (40
characters of mixed case with digits) and ``short`` (a secret word with a value too
short for ``assign``). A candidate's scope is its span, widened by ``SCOPE`` characters
on both sides, inside its document. It is reported only if complementary parts lie in
that scope: a secret or endpoint needs an identifier, an identifier needs a secret, and
an endpoint needs both. Base spans count as parts (access: identifier, others: secret).

The interval join of candidates and parts is a sweep in order of position: the nearest
end of a role before, and the nearest start after, decide whether any part of that role
meets the scope, so no pairs are made. Matches, not texts, are shuffled.

Only DataFrame functions are used. Positions are code points, ends exclusive.

Defined cases: NULL text is empty; every input row gives one result row, also when rows
or ``doc_id`` repeat or are NULL; an empty table gives an empty result; other columns are
ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm.common import normal_text

ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
# Runs shorter than 32 are no match either way, so they need not be taken apart.
HEX = r"[0-9a-f]{32,}"
WEAK = (
    r"""(?i:client_?id|key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
    r"""|https?://[A-Za-z0-9.-]+(?::[0-9]+)?"""
    r"""|[A-Za-z0-9+/]{40,}"""
)
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "endpoint", "bare", "short")
SCOPE = 200


def _matches(text: Column, family: str) -> Column:
    """Array of (family, code points before the match since the last one, match)."""
    pattern = F.lit(PATTERNS[family])
    pairs = F.arrays_zip(
        F.split(text, PATTERNS[family], -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
    )
    # The text after the last match is a gap without a match.
    found = F.transform(
        F.filter(pairs, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(
            F.lit(family).alias("family"),
            F.length(x["gap"]).alias("gap"),
            x["hit"].alias("hit"),
        ),
    )
    nothing = F.array().cast("array<struct<family:string,gap:int,hit:string>>")
    return F.when(F.regexp_like(text, pattern), found).otherwise(nothing)


def _kind() -> Column:
    hit, family = F.col("hit"), F.col("family")
    value = F.regexp_extract(hit, ASSIGN, 1)
    mixed = (
        hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]") & (F.length(hit) == 40)
    )
    return (
        F.when(family == "assign", F.when(F.length(value) >= 8, "assign").otherwise("short"))
        .when(family == "access", F.when(F.length(hit) >= 16, "access"))
        .when(family == "hex", "hex")
        .when(hit.rlike("^https?://"), "endpoint")
        .when(hit.rlike("[:=]"), "identifier")
        .when(mixed, "bare")
    )


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def parts(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text_hash, kind, start, end of every match; one row without kind for a text without any."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_key"), "doc_id", normal_text().alias("text")
    )
    found = F.concat(*[_matches(F.col("text"), family) for family in PATTERNS])
    exploded = rows.select(
        "row_key", "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(found).alias("place", "m")
    ).select("row_key", "doc_id", "text_hash", "place", "m.*")
    # One shuffle serves both windows and the grouping that follows.
    moved = exploded.withColumn("length", F.length("hit")).repartition("row_key")
    upto = (
        Window.partitionBy("row_key", "family")
        .orderBy("place")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    end = F.sum(F.col("gap") + F.coalesce(F.col("length"), F.lit(0))).over(upto)
    return moved.select(
        "row_key",
        "doc_id",
        "text_hash",
        _kind().alias("kind"),
        (end - F.col("length")).alias("start"),
        end.alias("end"),
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Marks as ``reported`` the base spans and the weak candidates whose complements lie in their scope."""
    kind = F.col("kind")
    in_order = Window.partitionBy("row_key").orderBy("start", "end", "kind")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, as Spark adds up a growing frame but computes a shrinking one anew for every row.
    backwards = Window.partitionBy("row_key").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    after = backwards.rowsBetween(Window.unboundedPreceding, -1)

    def near(kinds: tuple[str, ...]) -> Column:
        of_role = kind.isin(*kinds)
        last_end = F.max(F.when(of_role, F.col("end"))).over(before)
        next_start = F.min(F.when(of_role, F.col("start"))).over(after)
        return F.coalesce(last_end >= F.col("start") - scope, F.lit(False)) | F.coalesce(
            next_start <= F.col("end") + scope, F.lit(False)
        )

    marked = found.withColumn("by_id", near(("access", "identifier"))).withColumn(
        "by_secret", near(("assign", "hex", "bare", "short"))
    )
    reported = (
        F.when(kind.isin(*BASE), True)
        .when(kind == "identifier", F.col("by_secret"))
        .when(kind == "endpoint", F.col("by_id") & F.col("by_secret"))
        .when(kind.isin("bare", "short"), F.col("by_id"))
        .otherwise(False)
    )
    return marked.withColumn("reported", reported).drop("by_id", "by_secret")


def _span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, all reported spans."""
    spans = linked(parts(docs), scope)
    span = F.struct("start", _order(F.col("kind")).alias("rank"), "kind", "end")
    is_base = F.col("kind").isin(*BASE)
    grouped = spans.groupBy("row_key", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("reported"), span))).alias("found"),
    )
    return grouped.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(_span_text(F.col("base")), 256).alias("base_sha256"),
        _span_text(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every reported span, overlaps merged, replaced by ``mark``.

    ``n_chars``, where there is one, follows the new text. Rows are matched to spans by id
    and text, so that repeated rows are each redacted and none is multiplied.
    """
    spans = linked(parts(docs), scope).where("reported")
    so_far = (
        Window.partitionBy("row_key")
        .orderBy("start", "end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opens = F.coalesce(F.col("start") > F.max("end").over(so_far), F.lit(True)).cast("int")
    island = F.sum(F.col("opens")).over(
        Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = (
        spans.withColumn("opens", opens)
        .withColumn("island", island)
        .groupBy("row_key", "doc_id", "text_hash", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row_key", "doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
        .agg(F.first("cuts").alias("_cuts"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(normal_text()) == F.col("_hash"))
    joined = docs.join(merged, same, "left")
    text = F.col("text")
    from_ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: c["end"]))
    to_starts = F.concat(
        F.transform("_cuts", lambda c: c["start"]), F.array(F.length(text).cast("long"))
    )
    kept = F.array_join(
        F.zip_with(
            from_ends,
            to_starts,
            lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")),
        ),
        mark,
    )
    redacted = joined.withColumn("text", F.when(F.col("_cuts").isNull(), text).otherwise(kept))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn(
            "n_chars",
            F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(
                F.length("text").cast(docs.schema["n_chars"].dataType)
            ),
        )
    return redacted.select(*docs.columns)


# The result of ``scan`` in DuckDB SQL.
_FAMILY = """SELECT row_key, doc_id, '{family}' AS family,
  unnest(regexp_extract_all(text, '{pattern}')) AS hit,
  unnest([length(x) for x in string_split_regex(text, '{pattern}')[:-2]]) AS gap,
  generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS place
FROM texts"""
ORACLE = (
    r"""
WITH texts AS (SELECT row_number() OVER () AS row_key, doc_id, coalesce(text, '') AS text FROM documents),
hits AS (
"""
    + "\nUNION ALL\n".join(
        _FAMILY.format(family=f, pattern=p.replace("'", "''")) for f, p in PATTERNS.items()
    )
    + r"""),
placed AS (
  SELECT *, sum(gap + length(hit)) OVER (PARTITION BY row_key, family ORDER BY place) AS e FROM hits),
kinds AS (
  SELECT row_key, doc_id, (e - length(hit))::BIGINT AS s, e::BIGINT AS e,
    CASE family
      WHEN 'assign' THEN CASE WHEN length(regexp_extract(hit, '"""
    + ASSIGN.replace("'", "''")
    + r"""', 1)) >= 8 THEN 'assign' ELSE 'short' END
      WHEN 'access' THEN CASE WHEN length(hit) >= 16 THEN 'access' END
      WHEN 'hex' THEN 'hex'
      ELSE CASE WHEN hit LIKE 'http://%' OR hit LIKE 'https://%' THEN 'endpoint'
                WHEN hit LIKE '%:%' OR hit LIKE '%=%' THEN 'identifier'
                WHEN length(hit) = 40 AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')
                     AND regexp_matches(hit, '[0-9]') THEN 'bare' END END AS kind
  FROM placed),
marked AS (
  SELECT k.*,
    EXISTS (SELECT 1 FROM kinds o WHERE o.row_key = k.row_key AND o.kind IN ('access', 'identifier')
            AND NOT (o.kind = k.kind AND o.s = k.s) AND o.e >= k.s - 200 AND o.s <= k.e + 200) AS by_id,
    EXISTS (SELECT 1 FROM kinds o WHERE o.row_key = k.row_key AND o.kind IN ('assign', 'hex', 'bare', 'short')
            AND NOT (o.kind = k.kind AND o.s = k.s) AND o.e >= k.s - 200 AND o.s <= k.e + 200) AS by_secret
  FROM kinds k WHERE k.kind IS NOT NULL),
reported AS (
  SELECT *, CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 WHEN 'hex' THEN 3 WHEN 'identifier' THEN 4
                      WHEN 'endpoint' THEN 5 WHEN 'bare' THEN 6 ELSE 7 END AS ord,
    CASE WHEN kind IN ('assign', 'access', 'hex') THEN true WHEN kind = 'identifier' THEN by_secret
         WHEN kind = 'endpoint' THEN by_id AND by_secret ELSE by_id END AS ok
  FROM marked)
SELECT t.doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)
                  FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ok), '') AS spans
FROM texts t LEFT JOIN reported r ON t.row_key = r.row_key
GROUP BY t.row_key, t.doc_id
"""
)
