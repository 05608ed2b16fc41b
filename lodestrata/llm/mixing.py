"""Mixing sources to target shares, by weighted sampling with exponential keys."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records of one source that may be sorted in one task; a range of keys with more of them is cut again.
SORT_ROWS = 100_000
#: Pieces into which a range of keys is cut at once.
PIECES = 256


@dataclass
class Target:
    """What a source is to give: its share of all tokens, and how often one record may be used."""

    source: str
    share: float
    max_repeats: int


def quality_weight(text: str) -> Column:
    """A weight in [0.05, 1] from the text alone: the geometric mean of five signals, each in [0, 1].

    * characters other than digits and ASCII signs, as running text has (full from 90 % on)
    * words of a plausible mean length (full from 3 to 9 characters, falling to 0 at 1 and 18)
    * few signs that markup, code and tables have: ``{}[]<>|\\^~=_#*@`` (none at all is full, 10 % is 0)
    * words that are not said again and again: distinct among all words, or the square root of the number of words where
      that is less, as long texts repeat words by nature (full from half of that on)
    * enough text to judge: characters up to 200

    Whole texts are read, by built-in expressions. A null or empty text, or one without words, gets the least weight.
    """
    # nothing here is a lambda or a branch, so the words are split once for all signals
    t = F.trim(text)
    n = F.nullif(F.length(t), F.lit(0))
    words = F.split(t, r"\s+")
    count = F.size(words)
    blanks = n - F.length(F.translate(t, " \t\r\n\u00a0", ""))
    plain = F.length(F.translate(t, "0123456789" + string.punctuation, ""))
    signs = n - F.length(F.translate(t, "{}[]<>|\\^~=_#*@", ""))
    mean = (n - blanks) / count
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    signals = [
        unit(plain / n / 0.9),
        unit(F.least((mean - 1) / 2, (18 - mean) / 9)),
        unit(1 - 10 * signs / n),
        unit(2 * F.size(F.array_distinct(words)) / F.least(count.cast("double"), 10 * F.sqrt(count.cast("double")))),
        unit(n / 200),
    ]
    product = signals[0]
    for x in signals[1:]:
        product = product * x
    return F.greatest(F.lit(0.05), F.coalesce(F.pow(product, 1 / len(signals)), F.lit(0.0)))


def mixture(documents: DataFrame, targets: list[Target], total: int | None = None, seed: int = 17) -> DataFrame:
    """How often each record enters the mixture: (doc_id, source, tokens, repeats), records with repeats >= 1.

    documents: (doc_id, source, tokens, weight), sources in the form the targets name. It is read a few
    times: write it first if it is costly.

    total: tokens of the mixture. By default the most that keeps every share within its cap: the least of
    tokens x max_repeats / share over the sources. A source whose budget exceeds its cap gives what the cap
    allows; one without tokens gives nothing and does not bind the total.

    A source's budget is share x total. Whole epochs come first: every record as often as the budget holds
    the source. The rest is a weighted sample without replacement (Efraimidis and Spirakis): record keys
    -ln(u) / weight in ascending order, as long as the running token sum is nearest to the rest; u comes from
    a hash of seed and doc_id, so the mixture is the same at every run.

    The running sums need no source in one task. A source's keys are cut into pieces and summed by piece; the piece in
    which the limit falls is cut again, between its own least and greatest key, until it holds ``SORT_ROWS`` records
    or one key. Records below it are in, those above are out, and only its own are sorted. However the weights are
    spread, the sorted piece is small; each cut is one pass that sends ``PIECES`` rows per source to the driver.

    Nulls: records without source or tokens, of sources without target, or of no size, do not enter; a null
    weight counts as the least. Ties in keys go by doc_id. An empty table, or no targets, gives no rows.
    Other columns are not read.
    """
    spark = documents.sparkSession
    wanted = {t.source: t for t in targets if t.share > 0 and t.max_repeats > 0}
    rows = documents.select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"), F.greatest(F.lit(1e-6), F.coalesce("weight", F.lit(1e-6))).alias("weight"))
    rows = rows.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    # at most one row per target
    have = {r.source: r for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")).collect()}
    if not have:
        return rows.select("doc_id", "source", "tokens", F.lit(0).cast("int").alias("repeats")).where("false")
    if total is None:
        total = min(int(have[s].tokens * wanted[s].max_repeats / wanted[s].share) for s in have)
    plan = {s: divmod(min(round(wanted[s].share * total), r.tokens * wanted[s].max_repeats), r.tokens) for s, r in have.items()}
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("mix"), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = rows.withColumn("key", -F.log(u) / F.col("weight"))
    cuts = limit_pieces(keyed, {s: rest for s, (_, rest) in plan.items()}, {s: r.n for s, r in have.items()})
    limits = spark.createDataFrame([(s, *plan[s], *cuts[s]) for s in have], "source string, epochs bigint, rest bigint, low double, high double, before bigint")  # a row per target
    placed = keyed.join(F.broadcast(limits), "source")
    inside = (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # a record enters if more than half of it lies within the limit: the sum ends as near to it as can be
    cut = placed.where(inside).withColumn("decided", (F.col("before") + running - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    clear = placed.where(~inside).withColumn("decided", (F.col("key") < F.col("low")).cast("int"))
    chosen = clear.unionByName(cut)
    return chosen.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("decided")).cast("int").alias("repeats")).where("repeats > 0")


def limit_pieces(keyed: DataFrame, rest: dict[str, int], n: dict[str, int]) -> dict[str, tuple[float, float, int]]:
    """source -> (low, high, before): the range of keys, both ends included, in which the running sum of its tokens
    passes ``rest``, and the tokens below it. keyed: (source, key, tokens)."""
    spark, most, found = keyed.sparkSession, SORT_ROWS, {s: (0.0, float("inf"), 0) for s in rest}
    open_ = {s for s in rest if n[s] > most}
    for s in rest:
        if not rest[s]:  # nothing beyond the whole epochs
            found[s] = (-1.0, -1.0, 0)
    open_ = {s for s in open_ if rest[s]}
    first = True
    while open_:
        spans = spark.createDataFrame([(s, found[s][0], found[s][1]) for s in open_], "source string, low double, high double")
        inside = keyed.join(F.broadcast(spans), "source").where("key >= low and key <= high")
        # keys of equal weight are exponential, so the first cut is by their quantiles
        share = 1 - F.exp(-F.col("key")) if first else (F.col("key") - F.col("low")) / (F.col("high") - F.col("low"))
        piece = F.least(F.lit(PIECES - 1), F.floor(share * PIECES)).cast("int")
        sums = inside.groupBy("source", piece.alias("piece")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        by: dict[str, list] = {}
        for r in sums.collect():  # PIECES rows per target
            by.setdefault(r.source, []).append(r)
        for s, pieces in by.items():
            before = found[s][2]
            for r in sorted(pieces, key=lambda r: r.piece):
                if before + r.tokens > rest[s]:
                    break
                before += r.tokens
            found[s] = (r.low, r.high, before if before + r.tokens > rest[s] else before - r.tokens)
            if r.n <= most or r.low == r.high:
                open_.discard(s)
        first = False
    return found


def shares(spark: SparkSession, mixed: DataFrame, targets: list[Target]) -> DataFrame:
    """The shares a mixture reached: (source, target_share, records, uses, tokens, actual_share, max_used)."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("repeats").alias("uses"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("max_used"))
    asked = spark.createDataFrame([(t.source, t.share, t.max_repeats) for t in targets], "source string, target_share double, max_repeats int")
    joined = asked.join(per, "source", "left").na.fill(0, ["records", "uses", "tokens", "max_used"])
    everything = F.sum("tokens").over(Window.partitionBy())  # a row per target
    return joined.select("source", "target_share", "max_repeats", "records", "uses", "tokens", F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0).alias("actual_share"), "max_used")
