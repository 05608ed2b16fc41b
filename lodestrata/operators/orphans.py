"""References to records that do not exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Reference:
    """A table that refers to a parent: its name in the report, rows, key referred to, and day of the row."""

    table: str
    rows: DataFrame
    kind: str
    key: Column
    day: Column


@dataclass
class Parent:
    """A kind of parent. One row per key is made of many: the least ``begin`` and the least ``end``.

    The key exists from ``begin`` to the day before ``end``; a null begin means always, a null end for good.
    """

    kind: str
    rows: DataFrame
    key: Column
    begin: Column
    end: Column


def orphan_references(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """Orphans by table, month, key and reason: (table_name, period, ref_key, reason, n_rows).

    reason: ``missing`` (the key never existed), ``deleted`` (no longer on the row's day), ``late`` (not yet).

    References are counted per table, key and day before they move, parents reduced to one interval per key.
    Both are then hash-partitioned on (kind, key), sorted on it and merged in one linear pass, which is
    Spark's sort-merge join; the hint asks for it whatever the sizes. A key that a third of all rows refer to
    brings one row a day.

    Nulls: rows without reference or day are no cases; parents without key are left out. Repeated rows are
    counted in n_rows. Empty references give no rows; with empty parents every reference is ``missing``.
    Only the named columns are read.
    """
    refs = None
    for r in references:
        part = (
            r.rows.select(F.lit(r.table).alias("table_name"), F.lit(r.kind).alias("kind"), r.key.alias("ref_key"), r.day.cast("date").alias("day"))
            .where("ref_key is not null and day is not null")
        )
        refs = part if refs is None else refs.unionByName(part)
    refs = refs.groupBy("table_name", "kind", "ref_key", "day").agg(F.count(F.lit(1)).alias("n"))
    spans = None
    for p in parents:
        part = p.rows.select(F.lit(p.kind).alias("kind"), p.key.alias("ref_key"), p.begin.cast("date").alias("begin"), p.end.cast("date").alias("end")).where("ref_key is not null")
        spans = part if spans is None else spans.unionByName(part)
    spans = spans.groupBy("kind", "ref_key").agg(F.min("begin").alias("begin"), F.min("end").alias("end"))
    merged = refs.join(spans.withColumn("found", F.lit(True)).hint("merge"), ["kind", "ref_key"], "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("day") < F.col("begin"), "late").when(F.col("day") >= F.col("end"), "deleted")
    judged = merged.withColumn("reason", reason).where("reason is not null")
    return judged.groupBy("table_name", F.date_format("day", "yyyy-MM").alias("period"), "ref_key", "reason").agg(F.sum("n").alias("n_rows"))
