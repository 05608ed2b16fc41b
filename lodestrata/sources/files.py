"""Text files in and out, ingest lineage, inline relations."""

from __future__ import annotations

import csv
import datetime
import decimal
import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_with_schema(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV with header under a declared schema; nothing is inferred."""
    return spark.read.schema(ddl).option("header", True).csv(path)


def csv_as_text(spark: SparkSession, path: str, casts: dict[str, str] | None = None) -> DataFrame:
    """A CSV with header, all columns text, then cast by name; text that cannot be cast becomes null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()})


def csv_many(spark: SparkSession, folder: str, schemas: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Several CSV files under declared schemas: table -> (file, ddl)."""
    return {t: csv_with_schema(spark, f"{folder}/{f}", ddl) for t, (f, ddl) in schemas.items()}


def with_lineage(df: DataFrame, at: datetime.datetime) -> DataFrame:
    """Adds _source_file and _ingested_at, one time for the batch; call it right on a file scan."""
    return df.withColumn("_source_file", F.col("_metadata.file_path")).withColumn("_ingested_at", F.lit(at))


def without_lineage(df: DataFrame) -> DataFrame:
    return df.drop("_source_file", "_ingested_at")


def inline(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small fixed relation."""
    return spark.createDataFrame(list(rows), ddl)


def not_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): texts in date columns that are not plain calendar days, such as ones with a time or an offset."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.trim("value").rlike(r"^\d{4}-\d{2}-\d{2}$"))


def require_dates(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with header as text, or an error that names file, line, column and value of the first text in a date column that
    is not a plain calendar day. Lines are counted within each file, so quoted line breaks count as lines do."""
    df = csv_as_text(spark, path).withColumn("__file", F.col("_metadata.file_path"))
    bad = not_dates_in(df, columns).agg(F.min(F.struct("__file", "column", "value")).alias("b")).first().b
    if bad is None:
        return df.drop("__file")
    lines = spark.read.text(bad["__file"], wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    hit = lines.where((F.col("at") > 0) & F.contains("line", F.lit(bad["value"]))).agg(F.min("at")).first()[0]
    raise ValueError(f"{bad['__file']}, line {'?' if hit is None else hit + 1}, column {bad['column']}: {bad['value']!r} is not a day")


def not_dates_in(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``not_dates`` with the file of each text (__file)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select("__file", F.inline(pairs)).where(F.col("value").isNotNull() & ~F.trim("value").rlike(_DAY))


_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def export_file(df: DataFrame, path: str, order_by: Sequence[str], kind: str = "csv") -> int:
    """One CSV or JSON-lines file in order, for a local reader: staged beside ``path``, then renamed over it.

    Rows stream to the driver a partition at a time. For output of unbounded size use ``export_folder``.
    """
    staged = f"{path}.staged"
    n = 0
    with open(staged, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f) if kind == "csv" else None
        if writer:
            writer.writerow(df.columns)
        for row in df.orderBy(*order_by).toLocalIterator():
            values = [_plain(x) for x in row]
            writer.writerow(values) if writer else f.write(json.dumps(dict(zip(df.columns, values, strict=True))) + "\n")
            n += 1
    os.replace(staged, path)
    return n


def export_splits(df: DataFrame, path: str, splits: dict[str, tuple[Column, Sequence[str]]], kind: str = "csv") -> None:
    """Folders ``path``/<name> of one table: each with the rows of its condition and its columns (a model's rows without what
    tells the outcome, the audit's rows with it). The table is read once per split: write it first if it is costly."""
    for name, (condition, columns) in splits.items():
        export_folder(df.where(condition).select(*columns), f"{path}/{name}", kind)


def export_folder(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV or JSON part files, written by the executors."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
