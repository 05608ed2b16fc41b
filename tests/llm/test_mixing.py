from collections import Counter

import pytest

from lodestrata.llm.mixing import Target, mixture, quality_weight, shares


def docs(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint, weight double, key string")


def many(n=2000):
    return [(i, "abc"[i % 3] if i % 2 else "a", 1 + i * 7 % 50, 0.1 + (i % 10) / 10, "clash") for i in range(n)]


@pytest.mark.parametrize("bucket", [100_000, 17])
def test_shares_caps_and_epochs(spark, monkeypatch, bucket):
    monkeypatch.setattr("lodestrata.llm.mixing.SORT_ROWS", bucket)
    targets = [Target("a", 0.5, 1), Target("b", 0.2, 3), Target("c", 0.3, 2), Target("none", 0.0, 5)]
    data = many()
    have = Counter()
    for _, s, n, *_ in data:
        have[s] += n
    got = mixture(docs(spark, data), targets).collect()
    total = min(int(have[t.source] * t.max_repeats / t.share) for t in targets if t.share)
    used = Counter()
    for r in got:
        used[r.source] += r.tokens * r.repeats
    assert len({r.doc_id for r in got}) == len(got)
    for t in targets[:3]:
        assert abs(used[t.source] - t.share * total) <= 26  # half of the largest record
        repeats = {r.repeats for r in got if r.source == t.source}
        assert max(repeats) <= t.max_repeats and max(repeats) - min(repeats) <= 1
        if max(repeats) > 1:  # a complete epoch holds every record
            assert sum(r.source == t.source for r in got) == sum(d[1] == t.source for d in data)
    report = {r.source: r for r in shares(spark, mixture(docs(spark, data), targets), targets).collect()}
    assert report["a"].actual_share == pytest.approx(0.5, abs=0.01) and report["none"].tokens == 0


def test_same_selection_however_bucketed(spark, monkeypatch):
    t = [Target("a", 0.2, 1), Target("b", 0.8, 1)]
    one = {(r.doc_id, r.repeats) for r in mixture(docs(spark, many()), t).collect()}
    monkeypatch.setattr("lodestrata.llm.mixing.SORT_ROWS", 9)
    assert one == {(r.doc_id, r.repeats) for r in mixture(docs(spark, many()).repartition(7), t).collect()}


def test_heavier_records_come_first(spark):
    data = [(i, "a", 1, 1.0 if i % 2 else 0.1, "") for i in range(4000)]
    got = mixture(docs(spark, data), [Target("a", 1.0, 1)], total=1000).collect()
    assert len(got) == 1000
    assert 0.85 < sum(r.doc_id % 2 for r in got) / 1000 < 0.97  # by simulation of the sampling about 0.92


def test_small_source_stays_within_its_cap(spark):
    data = [(1, "tiny", 10, 1.0, "")] + [(i, "big", 10, 1.0, "") for i in range(2, 400)]
    got = {r.doc_id: r.repeats for r in mixture(docs(spark, data), [Target("tiny", 0.5, 4), Target("big", 0.5, 1)], total=1000).collect()}
    assert got[1] == 4 and sum(got.values()) == 4 + 50


def test_dirty_and_empty(spark):
    t = [Target("a", 0.5, 2), Target("gone", 0.5, 2)]
    data = [(1, "a", 5, None, ""), (2, None, 5, 1.0, ""), (3, "a", None, 1.0, ""), (4, "a", 0, 1.0, ""), (5, "untargeted", 5, 1.0, "")]
    assert [(r.doc_id, r.repeats) for r in mixture(docs(spark, data), t).collect()] == [(1, 2)]
    assert mixture(docs(spark, []), t).count() == 0
    assert mixture(docs(spark, data), []).count() == 0


def test_sorted_piece_stays_small_whatever_the_weights(spark, monkeypatch):
    """A third of the records with the least weight lie far from the others' keys."""
    from pyspark.sql import functions as F

    from lodestrata.llm import mixing

    monkeypatch.setattr(mixing, "SORT_ROWS", 50)
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("bigint").alias("tokens"), F.when(F.expr("id % 10 < 3"), 0.05).otherwise(1.0).alias("weight"))
    key = -F.log((F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit("mix"), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)) / F.col("weight")
    keyed = df.withColumn("key", key)
    keys = sorted(r.key for r in keyed.collect())
    for rest in (1, 20_000, 24_000, n - 1):
        low, high, before = mixing.limit_pieces(keyed, {"a": rest}, {"a": n})["a"]
        assert 0 < sum(low <= k <= high for k in keys) <= 50 and sum(k < low for k in keys) == before <= rest <= sum(k <= high for k in keys)
        got = {r.doc_id for r in mixture(df, [Target("a", 1.0, 1)], total=rest).collect()}
        assert got == {r.doc_id for r in keyed.orderBy("key").limit(rest).collect()}


def test_equal_keys_end_the_cutting(spark, monkeypatch):
    monkeypatch.setattr("lodestrata.llm.mixing.SORT_ROWS", 5)
    got = mixture(docs(spark, [(7, "a", 2, 1.0, "")] * 40), [Target("a", 1.0, 1)], total=41).collect()
    assert sum(r.tokens * r.repeats for r in got) in (40, 42)


def test_quality(spark):
    prose = "The service was slow this morning and several customers wrote to us about it. We found the cause after an hour. "
    texts = [(prose * 3,), ("word " * 300,), ("1234 5678 " * 30,), ("<td>a</td>|{x}={y}|" * 30,), ("x" * 500,), ("",), (None,), ("hi",), (prose * 400,)]
    got = [r.w for r in spark.createDataFrame(texts, "t string").select(quality_weight("t").alias("w")).collect()]
    assert got[0] > 0.9 and got[8] > 0.2
    assert all(w < 0.6 for w in got[1:8]) and got[5:7] == [0.05, 0.05]
