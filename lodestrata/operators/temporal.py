"""Latest rows, windowed reads bounded by a row's own cut-off, sequence numbers, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by ``order`` (first decides, null is least); the order must be total.

    An aggregate, not a sort: partial maxima are taken before rows move, so a hot key is one row per task.
    """
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.`{c}`") for c in (*order, *rest))).select(df.columns)


def within(day: str | Column, as_of: str | Column, days: int, skip: int = 0) -> Column:
    """Whether a day lies in the half-open window (as_of - skip - days, as_of - skip] of calendar days."""
    day, as_of = (F.col(c) if isinstance(c, str) else c for c in (day, as_of))
    return (day > F.date_sub(as_of, days + skip)) & (day <= F.date_sub(as_of, skip))


def windowed(measure: str | Column, day: str, as_of: str, days: int, skip: int = 0) -> Column:
    """Sum of a measure over a window, 0 where nothing falls into it. Several windows over one join share its scan."""
    value = F.col(measure) if isinstance(measure, str) else measure
    return F.coalesce(F.sum(F.when(within(day, as_of, days, skip), value)), F.lit(0))


def bounded_join(spine: DataFrame, events: DataFrame, key: str, day: str, until: Column) -> DataFrame:
    """Spine rows with their events up to ``until`` (left outer; spine rows without event stay).

    The bound is part of the join condition, so no event after a row's own cut-off is ever read into it.
    """
    right = events.withColumnRenamed(key, "__key")
    return spine.join(right, (spine[key] == right["__key"]) & (right[day] <= until), "left").drop("__key")


def salted_join(events: DataFrame, rows: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Events with the row of their key, for keys that hold a large part of all events.

    Events of one key are spread over ``salts`` groups by a hash of ``spread``, and each row, of which a key has few, is
    sent to every group; so no task gets more of a key than its share. ``how``: inner or left (events stay).
    """
    right = rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = events.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def inside_any(day: str | Column, spans: Sequence[tuple[str, str]]) -> Column:
    """Whether a day lies in any of a few fixed spans, both ends included; tested in an array, without a join."""
    if not spans:
        return F.lit(False)
    listed = F.array(*(F.struct(F.lit(a).cast("date").alias("a"), F.lit(z).cast("date").alias("z")) for a, z in spans))
    day = F.col(day) if isinstance(day, str) else day
    return F.exists(listed, lambda x: (day >= x["a"]) & (day <= x["z"]))


def inside_collected(points: DataFrame, day: str, spans: DataFrame, begin: str, end: str, name: str, most: int = 10_000) -> DataFrame:
    """Points with a flag ``name``: whether their day lies in any span of a table, both ends included; points are not
    multiplied where spans overlap. A null day is in none.

    Spans are counted first. Up to ``most`` they are collected into one array that goes to every task; beyond,
    the days of the points are reduced to distinct ones and looked up by ``overlapping``.
    """
    flag = lambda x: F.coalesce(x, F.lit(False)).alias(name)
    if spans.limit(most + 1).count() <= most:
        one = spans.agg(F.collect_list(F.struct(F.col(begin).alias("a"), F.col(end).alias("z"))).alias("__spans"))
        return points.crossJoin(F.broadcast(one)).select(*points.columns, flag(F.exists("__spans", lambda s: (F.col(day) >= s["a"]) & (F.col(day) <= s["z"]))))  # one row
    days = overlapping(points.select(day).where(F.col(day).isNotNull()).distinct(), day, spans.select(begin, end), begin, end, most).select(F.col(day).alias("__day")).distinct().withColumn("__in", F.lit(True))
    return points.join(days, F.col(day) == F.col("__day"), "left").select(*points.columns, flag(F.col("__in")))


def numbered_within(df: DataFrame, key: str, segment: Column, order: Sequence[Column], name: str = "seq") -> DataFrame:
    """A running number of each key's rows in ``order``, from 1.

    ``segment`` must rise with the order (the month of an ordering day, say). Rows are numbered within key and
    segment, and counts of the segments before are added, so a key with a third of all rows is numbered by
    many tasks. A null segment comes last.
    """
    rows = df.withColumn("__segment", segment)
    counts = rows.groupBy(key, "__segment").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(F.col("__segment").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("__k"), F.col("__segment").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(key, "__segment").orderBy(*order))
    joined = rows.join(offsets, F.col(key).eqNullSafe(F.col("__k")) & F.col("__segment").eqNullSafe(F.col("__s")))
    return joined.withColumn(name, F.col("__before") + local).drop("__k", "__s", "__segment", "__before")


def overlapping(points: DataFrame, day: str, spans: DataFrame, begin: str, end: str, most: int = 10_000) -> DataFrame:
    """Points with each span that contains their day, both ends included (no equality to join on).

    Spans are counted first. Up to ``most`` they are broadcast; beyond, points and spans meet by month, spans
    repeated for every month they touch, so the join is an equality and its size follows the true overlaps.
    """
    condition = (F.col(day) >= F.col(begin)) & (F.col(day) <= F.col(end))
    if spans.limit(most + 1).count() <= most:
        return points.join(F.broadcast(spans), condition)
    month = F.trunc(F.col(day), "month")
    months = F.sequence(F.trunc(F.col(begin), "month"), F.trunc(F.col(end), "month"), F.expr("interval 1 month"))
    spread = spans.where(F.col(begin) <= F.col(end)).withColumn("__month", F.explode(months))
    return points.withColumn("__month", month).join(spread, "__month").where(condition).drop("__month")


def classify(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; a null condition does not hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole as double, ``otherwise`` where whole is not positive; never divides by zero."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(otherwise))


def half_up(x: Column, digits: int = 4) -> Column:
    """Rounded half up on the binary value; the same in every engine, unlike rounding of decimal strings."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale
