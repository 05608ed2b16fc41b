"""One wide row per entity from many kinds of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_table(records: DataFrame, entity: str, kind: str, day: str, amount: str, kinds: Sequence[str], with_amount: Sequence[str] = (), other: str = "other") -> DataFrame:
    """One row per entity: for each kind in the fixed list the number of records, the latest day and, for
    those in ``with_amount``, the total: ``<kind>_n``, ``<kind>_last``, ``<kind>_total``.

    One pass over the records by partial aggregation: map tasks reduce them to one partial row per entity
    and kind, so what moves is bounded by entities x kinds, and a hot entity by the number of kinds. The
    partials of an entity then meet in its partition, where the conditional count, maximum-time and sum
    of each listed kind are taken in one grouped aggregation, without another exchange: wide rows never move. The
    conditions all ask for one value of the kind, so they are stated as a pivot over the fixed list: Spark then finds
    a partial's column by one lookup in place of a test of every column, and the time of a row does not grow with
    the list. Taken straight from the records, the same expressions would move a row of all columns per entity
    and map task.

    Nulls: records without entity are left out. A kind not in the list, or none, counts under ``other``. A
    null day does not count for the latest day, a null amount not for the total; the total of a kind without
    amounts is null, the number of a kind without records 0. Repeated rows count each time. An empty input
    gives no rows. Days come out as they come in (cast to date); columns not named are not read.
    """
    rank = F.when(F.col("__kind").isin(list(kinds)), F.col("__kind")).otherwise(F.lit(other))
    partial = (
        records.where(F.col(entity).isNotNull())
        .select(F.col(entity).alias("__e"), F.col(kind).alias("__kind"), F.col(day).cast("date").alias("__day"), F.col(amount).alias("__amount"))
        .withColumn("__kind", rank)
        .groupBy("__e", "__kind")
        .agg(F.count(F.lit(1)).alias("__n"), F.unix_date(F.max("__day")).alias("__last"), F.sum("__amount").alias("__total"))
        .repartition("__e")
    )
    names = [*kinds, other]
    wide = partial.groupBy("__e").pivot("__kind", names).agg(F.first("__n").alias("n"), F.first("__last").alias("last"), F.first("__total").alias("total"))
    columns = []
    for name in names:
        columns += [F.coalesce(F.col(f"`{name}_n`"), F.lit(0)).cast("bigint").alias(f"{name}_n"), F.date_from_unix_date(f"`{name}_last`").alias(f"{name}_last")]
        if name in with_amount:
            columns.append(F.col(f"`{name}_total`").alias(f"{name}_total"))
    return wide.select(F.col("__e").alias(entity), *columns)
