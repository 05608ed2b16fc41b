"""Attributes as they were known at an event's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import written


def as_known(events: DataFrame, event_key: Column, event_day: Column, keep: dict[str, Column], facts: DataFrame, fact_key: Column, valid_day: Column, known_day: Column, order: dict[str, Column], wide: dict[str, Column] | None = None) -> DataFrame:
    """Each event with the fact valid and delivered by its day: (keep..., order..., wide...).

    A fact can be used from the later of ``valid_day`` and ``known_day`` on. Among the usable facts of the
    event's key the one with the greatest (valid_day, order...) holds. Events for which none is usable, or
    without key or day, do not come out. ``order`` must tell all facts of a key apart; it identifies the fact
    in the result.

    Narrow rows first: facts are reduced to the best of each key and first usable day, events to their
    distinct days. Over both, in day order, a fact counts as a change when it beats all facts before it, and
    the running number of changes is the version: of the fact that makes the change, and of the event days
    that follow. The numbered timeline is written once, as both sides of the join come from it. A key brings at most
    two narrow rows a day to the window, however many events it has. Wide attributes never enter the timeline: they
    are fetched for the facts that made a version. Days take their version's fact by an equi-join on key and version,
    and events, which move once, that of their day.

    Nulls: facts without key or valid day are left out, a null known day too (it was never delivered).
    Repeated events come out as often as they come in. Empty tables give no rows. Columns not named are never
    read, and the internal names are prefixed.
    """
    ranks = {f"__o{i}": c for i, c in enumerate(order.values())}
    more = {f"__w{i}": c for i, c in enumerate((wide or {}).values())}
    usable = (
        facts.select(fact_key.alias("__key"), F.struct(valid_day.cast("date").alias("__valid"), *(c.alias(n) for n, c in ranks.items())).alias("__fact"), known_day.cast("date").alias("__known"))
        .where("__key is not null and __fact.__valid is not null and __known is not null")
        .groupBy("__key", F.greatest("__fact.__valid", "__known").alias("__day"))
        .agg(F.max("__fact").alias("__fact"))
    )
    asked = events.select(event_key.alias("__key"), event_day.cast("date").alias("__day"), *(c.alias(f"__k{i}") for i, c in enumerate(keep.values()))).where("__key is not null and __day is not null")
    days = asked.select("__key", "__day").distinct()
    rank = F.struct(*(F.col(f"__fact.{n}") for n in ("__valid", *ranks)))
    timeline = usable.select("__key", "__day", F.lit(0).alias("__ask"), rank.alias("__rank")).unionByName(days.withColumn("__ask", F.lit(1)), allowMissingColumns=True)
    by_day = Window.partitionBy("__key").orderBy("__day", "__ask")
    before = F.max("__rank").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    changes = timeline.withColumn("__before", before).withColumn("__change", F.when((F.col("__ask") == 0) & (F.col("__before").isNull() | (F.col("__rank") > F.col("__before"))), 1).otherwise(0))
    numbered = changes.withColumn("__version", F.sum("__change").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    numbered = written(numbered.where("__version > 0 and (__ask = 1 or __change = 1)").select("__key", "__day", "__ask", "__version", "__rank"), "numbered")
    of_day = numbered.where("__ask = 1").select("__key", "__day", "__version")
    of_fact = numbered.where("__ask = 0")
    versions = of_fact.select("__key", "__version", F.col("__rank.__valid").alias("__valid"), *(F.col(f"__rank.{r}").alias(r) for r in ranks))
    if more:
        whole = facts.select(fact_key.alias("__key"), valid_day.cast("date").alias("__valid"), *(c.alias(n) for n, c in (ranks | more).items()))
        right = whole.where("__key is not null and __valid is not null")
        same = versions["__key"] == right["__key"]
        for c in reversed(["__valid", *ranks]):
            same = same & versions[c].eqNullSafe(right[c])
        versions = versions.join(right, same).select(versions["__key"], versions["__version"], *(versions[r] for r in ranks), *more)
    resolved = of_day.join(versions, ["__key", "__version"]).drop("__version")
    held = asked.join(resolved, ["__key", "__day"])
    return held.select(*(F.col(f"__k{i}").alias(n) for i, n in enumerate(keep)), *(F.col(r).alias(n) for r, n in zip(ranks, order, strict=True)), *(F.col(w).alias(n) for w, n in zip(more, wide or {}, strict=True)))
