"""Placing rows for operators that read whole keys from their partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def together(df: DataFrame, *keys: str) -> DataFrame:
    """All rows with equal keys in one partition (nulls too).

    The planner drops a repartition on columns that the input seems to be partitioned by already, of a union of
    two aggregates for instance, whose sides adaptive execution may then coalesce differently: nothing above a
    Python operator tells it to keep them in step. Partitioning by a hash of the keys is never dropped.
    """
    return df.repartition(F.xxhash64(*keys))
