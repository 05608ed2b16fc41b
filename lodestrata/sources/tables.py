"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_of(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``: a Parquet file or folder. Its name stays in the plan, for lineage."""
    return spark.read.parquet(path_of(sf_dir, name)).alias(name)
