"""Entity search over a token index: exact, prefix and fuzzy matches by inverse document frequency."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scoring.
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY_CUTOFF, EXACT_ID_BONUS = 0.7, 0.6, 0.75, 100.0


# Words of a question that name nothing, and the part of an id that every id has.
STOP_WORDS = (
    "a an the of for in on at to and or by with about from is was find show me please what which who whose look up get id ids "
    "renewal renewals subscription subscriptions user users customer customers account sub"
).split()
ID_NOISE = ("sub",)


def tokens(text: Column, without: Sequence[str] = ID_NOISE) -> Column:
    """Distinct lower-case tokens of free text.

    A word or id stays whole and is also split: at ``:``, where a day stays whole and also counts as its month, then at
    ``_`` and ``-``; a number with leading zeros also counts without them.
    """
    whole = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}_:%-]*)"), 1), lambda t: F.regexp_replace(t, "[_:-]+$", ""))
    filled = lambda a: F.filter(a, lambda x: x != "")
    pieces = filled(F.flatten(F.transform(whole, lambda t: F.split(t, ":"))))
    is_day = lambda p: p.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    months = F.transform(F.filter(pieces, is_day), lambda p: F.substring(p, 1, 7))
    parts = filled(F.flatten(F.transform(F.filter(pieces, lambda p: ~is_day(p)), lambda p: F.split(p, "[_-]"))))
    bare = F.transform(F.filter(parts, lambda t: t.rlike("^0+[1-9][0-9]*$")), lambda t: F.regexp_replace(t, "^0+", ""))
    return F.filter(F.array_distinct(F.concat(whole, pieces, months, parts, bare)), lambda t: ~t.isin(list(without)) & (t != ""))


def day_words(first: Column, last: Column) -> Column:
    """Every day of a span as words: the day, its month by number and by name, short and long."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return F.lower(F.array_join(F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd yyyy-MM MMMM MMM")), " "))


def build_index(entities: DataFrame, kind: str, id_: str, text: Column) -> DataFrame:
    """(token, kind, id): one row per entity and distinct token."""
    return entities.select(F.col(kind).alias("kind"), F.col(id_).alias("id"), F.explode(tokens(F.concat_ws(" ", F.col(id_), text))).alias("token")).distinct()


def search(index: DataFrame, queries: DataFrame, query: str, n_entities: int | None = None, kinds: Sequence[str] = (), limit: int = 5) -> DataFrame:
    """(query, place, kind, id, score, how): the best entities for each query text; ``STOP_WORDS`` are not asked for.

    Each query token adds idf = ln(1 + N / df) per entity that has it; without an exact hit 0.7 x idf for each
    indexed token it begins (3 characters or more), else 0.6 x similarity x idf for its up to three closest
    words (difflib ratio of at least 0.75, alphabetic tokens). A query equal to an id adds 100. Ties go by the
    order of ``kinds``, then id.

    The vocabulary with its document frequencies is an aggregate of the index. Query tokens meet it by
    equality, by their first three characters for prefixes, and only tokens with neither are compared with
    words, on the distinct vocabulary in Arrow batches, never on entities.
    """
    asked = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    n = index.select("kind", "id").distinct().count() if n_entities is None else n_entities
    vocabulary = index.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + F.lit(float(max(1, n))) / F.col("df")))
    wanted = asked.select("query", F.explode(tokens(F.col("query"), (*ID_NOISE, *STOP_WORDS))).alias("asked"))
    distinct = wanted.select("asked").distinct()
    exact = distinct.join(vocabulary, F.col("asked") == F.col("token")).select("asked", "token", F.lit(1.0).alias("w"), F.lit("token").alias("how"), "idf")
    left = distinct.join(exact.select("asked"), "asked", "left_anti").where("length(asked) >= 3")
    begins = left.withColumn("head", F.substring("asked", 1, 3)).join(vocabulary.withColumn("head", F.substring("token", 1, 3)), "head").where(F.col("token").startswith(F.col("asked")))
    begins = begins.select("asked", "token", F.lit(PREFIX_WEIGHT).alias("w"), F.lit("prefix").alias("how"), "idf")
    rest = left.join(begins.select("asked"), "asked", "left_anti").where("asked rlike '^[a-z]+$'")
    words = [r.asked for r in rest.collect()]  # words of the stated queries, not of the data

    @F.pandas_udf("array<struct<asked:string,s:double>>")
    def near(token: pd.Series) -> pd.Series:
        out = []
        for t in token:
            found = []
            for w in words:
                m = difflib.SequenceMatcher(None, w, t)
                if m.real_quick_ratio() >= FUZZY_CUTOFF and m.quick_ratio() >= FUZZY_CUTOFF and (s := m.ratio()) >= FUZZY_CUTOFF:
                    found.append({"asked": w, "s": s})
            out.append(found)
        return pd.Series(out)

    fuzzy = vocabulary.where("length(token) >= 3 and token rlike '^[a-z]+$'").select("token", "idf", F.inline(near("token")))
    closest = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("s"), F.desc("token")))
    fuzzy = fuzzy.withColumn("r", closest).where("r <= 3").select("asked", "token", (FUZZY_WEIGHT * F.col("s")).alias("w"), F.lit("fuzzy").alias("how"), "idf")
    hits = wanted.join(exact.unionByName(begins).unionByName(fuzzy), "asked").join(index, "token").select("query", "kind", "id", (F.col("w") * F.col("idf")).alias("score"), "how")
    named = asked.join(index.select("kind", "id").distinct(), F.lower(F.col("id")) == F.lower(F.trim("query"))).select("query", "kind", "id", F.lit(EXACT_ID_BONUS).alias("score"), F.lit("id").alias("how"))
    order = F.array_position(F.array(*(F.lit(h) for h in ("id", "token", "prefix", "fuzzy"))), F.col("how"))
    scored = hits.unionByName(named).groupBy("query", "kind", "id").agg(F.sum("score").alias("score"), F.min_by("how", order).alias("how"))
    scored = scored.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    kind_order = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("kind")) if kinds else F.col("kind")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), kind_order, "id"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "kind", "id", "score", "how")
