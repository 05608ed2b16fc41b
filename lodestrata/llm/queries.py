"""The queries p8_ to p10_ over documents. SQL can express none of them; tests use brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.cleaning import clean_key
from lodestrata.llm.lookalikes import canonical_texts, look_classes, lookalike_pairs
from lodestrata.llm.mixing import Target, mixture, quality_weight, shares
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.tokens import sized
from lodestrata.session import written
from lodestrata.sources.tables import table


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """A fixed handful of rows; of a kind that is named twice the larger size holds."""
    rows = table(spark, sf_dir, "container_sizes").where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).collect()
    return {r.container_kind: r.c for r in rows}


def _targets(spark: SparkSession, sf_dir: str) -> list[Target]:
    """A fixed handful of rows, one per source."""
    rows = table(spark, sf_dir, "mix_targets").select(clean_key("source").alias("source"), "target_share", "max_repeats").where("source is not null").collect()
    return [Target(r.source, r.target_share or 0.0, r.max_repeats or 0) for r in rows]


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(sized(table(spark, sf_dir, "documents"), "doc_id", "text"), _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused space of each kind."""
    sizes = _capacities(spark, sf_dir)
    per = p8_packed(spark, sf_dir).groupBy("container_kind").agg((F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    capacity = F.create_map(*(x for k, c in sizes.items() for x in (F.lit(k), F.lit(c).cast("bigint"))))
    room = F.col("containers") * F.element_at(capacity, F.col("container_kind"))
    return per.withColumn("unused_share", 1 - F.col("tokens") / room)


def _mixed(spark: SparkSession, sf_dir: str, targets: list[Target]) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("__source", clean_key("source"))
    documents = documents.where(F.col("__source").isin([t.source for t in targets]))
    costly = sized(documents, "doc_id", "text", source=F.col("__source"), weight=quality_weight("text"))
    return mixture(written(costly, "mix-sizes"), targets)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, _targets(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return shares(spark, _mixed(spark, sf_dir, targets), targets)


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_texts(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(canonical_texts(table(spark, sf_dir, "documents"), keep_text=False))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of texts that look the same: what p10_found says, without all pairs."""
    return look_classes(canonical_texts(table(spark, sf_dir, "documents"), keep_text=False))


QUERIES = {f.__name__: f for f in (p8_packed, p8_fill, p9_mixture, p9_shares, p10_found, p10_forms, p10_classes)}
ORACLE: dict[str, str] = {}
