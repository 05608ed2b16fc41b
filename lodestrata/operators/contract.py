"""Checks of a table against what it must be: violations, parity, content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, violations): rows for which a condition holds, all counted in one aggregation. Null does not hold."""
    counted = df.agg(*(F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint").alias(f"c{i}") for i, c in enumerate(checks.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(checks)))
    return counted.select(F.inline(rows))


def table_checks(not_null: Sequence[str] = (), enums: dict[str, Sequence] | None = None, ranges: dict[str, tuple] | None = None, ordered: Sequence[tuple[str, str]] = (), flags: Sequence[str] = ()) -> dict[str, Column]:
    """Conditions that break a contract: nulls, values outside a list or range, flags not 0/1, pairs not in order."""
    out = {f"{c} is null": F.col(c).isNull() for c in not_null}
    out |= {f"{c} not in list": ~F.col(c).isin(*v) for c, v in (enums or {}).items()}
    out |= {f"{c} out of range": (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in (ranges or {}).items()}
    out |= {f"{c} not 0 or 1": ~F.col(c).isin(0, 1) for c in flags}
    return out | {f"{a} above {b}": F.col(a) > F.col(b) for a, b in ordered}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_columns(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names."""
    return [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], rounding: float = 1e-9) -> DataFrame:
    """(keys..., column, left_value, right_value, kind): cells that differ between two tables of equal shape.

    kind: ``left_only`` and ``right_only`` for rows (column null), ``rounding`` for doubles within ``rounding``
    of each other, else ``beyond rounding``. One full outer join, then the cells side by side.
    """
    columns = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*columns).alias("l"))
    b = right.select(*keys, F.struct(*columns).alias("r"))
    both = a.join(b, list(keys), "full_outer")
    cells = []
    for c in columns:
        l, r = F.col(f"l.{c}"), F.col(f"r.{c}")
        near = (F.abs(l - r) <= rounding) if dict(left.dtypes)[c] in ("double", "float") else F.lit(False)
        cells.append(F.struct(F.lit(c).alias("column"), l.cast("string").alias("left_value"), r.cast("string").alias("right_value"), F.when(l.eqNullSafe(r), None).when(near, "rounding").otherwise("beyond rounding").alias("kind")))
    lone = lambda kind: F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"), F.lit(kind).alias("kind")))
    listed = F.when(F.col("r").isNull(), lone("left_only")).when(F.col("l").isNull(), lone("right_only")).otherwise(F.array(*cells))
    return both.select(*keys, F.inline(listed)).where("kind is not null")


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, digest): the same for the same rows in any order and layout; doubles by their bits, one NaN, -0 as 0.

    Two 64-bit row hashes are summed as decimals, so repeated rows count.
    """
    parts = [F.coalesce((F.col(f"`{c}`") + 0.0 if t in ("double", "float") else F.col(f"`{c}`")).cast("string"), F.lit("\u0000")) for c, t in sorted(df.dtypes)]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))
