"""Compare two versions of a result, row by row and column by column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmart.functions.expressions import name, named, same_value
from driftmart.operators.analysis import value_counts
from driftmart.session import shared_folder

# Names of the comparison frame.
LEFT_SUFFIX = "_pd"
RIGHT_SUFFIX = "_sql"
ORIGIN = "merge_flag"
BOTH, LEFT_ONLY, RIGHT_ONLY = "both", "left_only", "right_only"
# Saved keys take a byte or two each, so by file size Spark would broadcast millions of them.
BROADCAST_ROWS = 100_000


def shared_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in left.columns if c in right.columns and c not in keys]


def merged(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    how: str = "full",
    never_null: Sequence[str] = (),
) -> DataFrame:
    """Join two results on their grain; shared columns get a suffix per side.

    The grain must be unique on both sides (see ``grain_duplicates``). Missing
    key values match each other. ``merge_flag`` tells where a row came from.

    Keys declared ``never_null`` join by plain equality, which lets the join use a
    distribution that both sides already have; a missing value in one of them fails a
    full join instead of being matched or dropped.
    """
    columns = shared_columns(left, right, keys) if columns is None else list(columns)
    if not columns:
        raise ValueError("the two results share no column besides their keys")

    missing = " OR ".join(f"{name(k)} IS NULL" for k in never_null)
    present = f"CASE WHEN {missing} THEN cast(raise_error('missing key') AS BOOLEAN) ELSE true END" if missing else "true"

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.selectExpr(
            *[named(name(c), c + suffix) for c in (*keys, *columns)],
            named(present, f"present{suffix}"),
        )

    same_key = " AND ".join(
        f"{name(k + LEFT_SUFFIX)} {'=' if k in never_null else '<=>'} {name(k + RIGHT_SUFFIX)}" for k in keys
    )
    joined = side(left, LEFT_SUFFIX).join(side(right, RIGHT_SUFFIX), F.expr(same_key), how)
    origin = (
        f"CASE WHEN present{RIGHT_SUFFIX} IS NULL THEN '{LEFT_ONLY}'"
        f" WHEN present{LEFT_SUFFIX} IS NULL THEN '{RIGHT_ONLY}' ELSE '{BOTH}' END"
    )
    return joined.selectExpr(
        *[
            named(f"coalesce({name(k + LEFT_SUFFIX)}, {name(k + RIGHT_SUFFIX)})", k)
            for k in keys
        ],
        *[name(c + suffix) for c in columns for suffix in (LEFT_SUFFIX, RIGHT_SUFFIX)],
        named(origin, ORIGIN),
    )


def column_checks(frame: DataFrame) -> dict[str, str]:
    """Compared column -> expression that is true where both sides agree."""
    types = {f.name: f.dataType for f in frame.schema}
    compared = [
        c.removesuffix(LEFT_SUFFIX)
        for c in types
        if c.endswith(LEFT_SUFFIX) and c.removesuffix(LEFT_SUFFIX) + RIGHT_SUFFIX in types
    ]
    return {
        c: same_value(c + LEFT_SUFFIX, c + RIGHT_SUFFIX, types[c + LEFT_SUFFIX]) for c in compared
    }


def checked(frame: DataFrame) -> DataFrame:
    """Rows found on both sides with one ``*_check`` per column and ``is_match``."""
    checks = column_checks(frame)
    both = frame.where(F.col(ORIGIN) == BOTH)
    with_checks = both.selectExpr("*", *[named(e, f"{c}_check") for c, e in checks.items()])
    return with_checks.selectExpr(
        "*", named(" AND ".join(name(f"{c}_check") for c in checks), "is_match")
    )


def mismatches(check_frame: DataFrame) -> DataFrame:
    return check_frame.where(~F.col("is_match"))


def mismatches_by_column(check_frame: DataFrame) -> DataFrame:
    """Number of failed checks per column, worst first; one pass over the rows."""
    names = [c.removesuffix("_check") for c in check_frame.columns if c.endswith("_check")]
    totals = check_frame.selectExpr(
        *[named(f"count_if(NOT {name(c + '_check')})", c) for c in names]
    )
    return totals.unpivot([], names, "column_name", "mismatch_count").orderBy(
        F.desc("mismatch_count"), F.asc("column_name")
    )


def origin_counts(frame: DataFrame) -> DataFrame:
    return value_counts(frame, ORIGIN)


def summary(frame: DataFrame) -> DataFrame:
    """Matched, one-sided and mismatching rows of a full comparison, in one pass."""
    equal = " AND ".join(column_checks(frame).values())
    return frame.selectExpr(
        named(f"count_if({ORIGIN} = '{BOTH}')", "rows_matched"),
        named(f"count_if({ORIGIN} = '{LEFT_ONLY}')", "left_only_rows"),
        named(f"count_if({ORIGIN} = '{RIGHT_ONLY}')", "right_only_rows"),
        named(f"count_if({ORIGIN} = '{BOTH}' AND NOT ({equal}))", "mismatch_rows"),
    )


# ---- in two phases ---------------------------------------------------------------


def _digest(df: DataFrame, columns: Sequence[str], salt: int) -> str:
    """64-bit digest of a row's values; numbers as doubles, so that their types need not agree.

    What becomes equal by that is equal within the tolerance, too. Hashes skip NULL, so which
    columns are NULL is part of the digest.
    """
    types = {f.name: f.dataType for f in df.schema}
    values = [f"double({name(c)})" if isinstance(types[c], T.NumericType) else f"string({name(c)})" for c in columns]
    return f"xxhash64({', '.join([f'{salt}L', *values, *[f'{name(c)} IS NULL' for c in columns]])})"


def narrow_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    never_null: Sequence[str] = (),
) -> DataFrame:
    """keys, ``merge_flag`` and ``differs``: the join moves keys and a 128-bit digest per row only."""
    columns = shared_columns(left, right, keys) if columns is None else list(columns)

    def side(df: DataFrame) -> DataFrame:
        digests = [named(_digest(df, columns, salt), f"digest{salt}") for salt in (1, 2)]
        return df.selectExpr(*map(name, keys), *digests)

    frame = merged(side(left), side(right), keys, ("digest1", "digest2"), never_null=never_null)
    same = " AND ".join(f"digest{k}{LEFT_SUFFIX} = digest{k}{RIGHT_SUFFIX}" for k in (1, 2))
    return frame.selectExpr(*map(name, keys), ORIGIN, named(f"{ORIGIN} = '{BOTH}' AND NOT ({same})", "differs"))


@dataclass(frozen=True)
class Staged:
    """A full comparison of two results, see ``staged``."""

    pairs: DataFrame  # every key with its origin
    detail: DataFrame  # the wide rows of both sides whose digests differ

    def origins(self) -> DataFrame:
        return origin_counts(self.pairs)

    def mismatches(self) -> DataFrame:
        return mismatches(checked(self.detail))

    def mismatches_by_column(self) -> DataFrame:
        return mismatches_by_column(checked(self.detail))

    def summary(self) -> DataFrame:
        equal = " AND ".join(column_checks(self.detail).values())
        wrong = self.detail.selectExpr(named(f"count_if(NOT ({equal}))", "n"))
        counts = self.pairs.selectExpr(
            named(f"count_if({ORIGIN} = '{BOTH}')", "rows_matched"),
            named(f"count_if({ORIGIN} = '{LEFT_ONLY}')", "left_only_rows"),
            named(f"count_if({ORIGIN} = '{RIGHT_ONLY}')", "right_only_rows"),
        )
        return counts.select("*", wrong.scalar().alias("mismatch_rows"))


def staged(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    never_null: Sequence[str] = (),
) -> Staged:
    """Compare keys and digests first, whole rows only where digests differ.

    Meant for saved results that agree mostly: rows that agree to the last bit never move.
    Rows that differ are read again from both sides and compared with tolerance, so both
    sides should be saved or cheap. The narrow pairs are written to the shared folder.
    Where more than ``BROADCAST_ROWS`` rows differ, all wide rows move to find them, unless
    both sides are saved in as many buckets of a ``never_null`` key: then none does.
    """
    path = shared_folder(left.sparkSession, "reconcile-pairs")
    narrow_pairs(left, right, keys, columns, never_null).write.parquet(path)
    pairs = left.sparkSession.read.parquet(path)
    wanted = pairs.where("differs").select(*[F.col(f"`{k}`").alias(f"_wanted_{k}") for k in keys])
    differing = wanted.count()
    if differing > BROADCAST_ROWS:
        wanted = wanted.hint("merge")
    if differing == 0:
        # No job ever reads a wide column.
        parts = [df.where(F.lit(False)) for df in (left, right)]
    else:
        parts = []
        for df in (left, right):
            same = [
                F.col(f"`{k}`") == F.col(f"_wanted_{k}") if k in never_null else F.col(f"`{k}`").eqNullSafe(F.col(f"_wanted_{k}"))
                for k in keys
            ]
            parts.append(df.join(wanted, same, "left_semi"))
    return Staged(pairs, merged(*parts, keys, columns, how="inner", never_null=never_null))
