"""As-known joins, orphan references, the wide table and copy differences against brute force, with dirty rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators.asof import as_known
from lodestrata.operators.diff import Bitmap, differences
from lodestrata.operators.feature_table import feature_table
from lodestrata.operators.orphans import Parent, Reference, orphan_references
from tests.conftest import rows

D = dt.date(2024, 1, 1)
day = lambda n: None if n is None else D + dt.timedelta(n)
EVENTS, FACTS = "no bigint, k string, d date, plan string", "n bigint, k string, v date, known date, plan string, no string"


def known(spark, events, facts):
    e, f = spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS)
    return as_known(e, F.col("k"), F.col("d"), {"no": F.col("no")}, f, F.col("k"), F.col("v"), F.col("known"), {"n": F.col("n")}, {"held": F.col("plan")})


def test_as_known_equals_brute_force(spark):
    rng = random.Random(2)
    some = lambda p, x: None if rng.random() < p else x
    facts = []
    for i in range(1500):
        v = rng.randrange(100)
        facts.append((i, some(0.03, f"k{rng.randrange(30)}"), day(some(0.03, v)), day(some(0.03, v + rng.choice([0, 0, 1, 30]))), some(0.2, rng.choice("abc")), "clash"))
    events = [(i, some(0.03, "k0" if i % 3 == 0 else f"k{rng.randrange(35)}"), day(some(0.03, rng.randrange(-5, 140))), "clash") for i in range(2000)]
    want = []
    for no, k, d, _ in events:
        usable = [f for f in facts if None not in (k, d, f[2], f[3]) and f[1] == k and f[2] <= d and f[3] <= d]
        if usable:
            best = max(usable, key=lambda f: (f[2], f[0]))
            want.append((no, best[0], best[4]))
    assert rows(known(spark, events, facts)) == sorted(want, key=repr)


def test_as_known_empty(spark):
    assert known(spark, [], []).count() == 0
    assert known(spark, [(1, "a", D, "")], []).count() == 0


def test_orphans(spark):
    refs = [("a", day(0)), ("a", day(5)), ("a", day(10)), ("a", day(10)), ("ghost", day(3)), ("ghost", day(40)), (None, day(1)), ("a", None), ("ever", day(-900)), ("begun", day(3))]
    parents = [("a", day(2), day(9)), ("a", day(4), None), ("ever", None, None), ("begun", day(4), None), (None, day(0), None)]
    ref = lambda r: Reference("t", spark.createDataFrame(r, "k string, d date"), "p", F.col("k"), F.col("d"))
    par = lambda p: Parent("p", spark.createDataFrame(p, "k string, b date, e date"), F.col("k"), F.col("b"), F.col("e"))
    assert rows(orphan_references([ref(refs)], [par(parents)])) == sorted(
        [("t", "2024-01", "a", "late", 1), ("t", "2024-01", "a", "deleted", 2), ("t", "2024-01", "ghost", "missing", 1), ("t", "2024-02", "ghost", "missing", 1), ("t", "2024-01", "begun", "late", 1)], key=repr
    )
    assert orphan_references([ref([])], [par(parents)]).count() == 0
    assert orphan_references([ref(refs)], [par([])]).where("reason <> 'missing'").count() == 0
    assert "SortMergeJoin" in orphan_references([ref(refs)], [par(parents)])._jdf.queryExecution().executedPlan().toString()


def test_feature_table(spark):
    data = [("a", "x", day(1), 5, 1), ("a", "x", day(3), None, 1), ("a", "y", None, 7, 1), ("a", "new", day(2), 1, 1), ("a", None, day(9), 1, 1), ("b", "y", day(4), None, 1), (None, "x", day(1), 1, 1), ("a", "x", day(1), 5, 1)]
    df = spark.createDataFrame(data, "e string, kind string, d date, amount bigint, x_n int")
    got = {r.e: r.asDict() for r in feature_table(df, "e", "kind", "d", "amount", ["x", "y"], ["x", "y"]).collect()}
    assert got["a"] == {"e": "a", "x_n": 3, "x_last": day(3), "x_total": 10, "y_n": 1, "y_last": None, "y_total": 7, "other_n": 2, "other_last": day(9)}
    assert got["b"] == {"e": "b", "x_n": 0, "x_last": None, "x_total": None, "y_n": 1, "y_last": day(4), "y_total": None, "other_n": 0, "other_last": None}
    assert feature_table(df.where("false"), "e", "kind", "d", "amount", ["x"]).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 300_000, n)) for n in (150_000, 2_000))
    assert Bitmap(a).and_not(Bitmap(b)).tolist() == np.setdiff1d(a, b).tolist()
    assert Bitmap(b).and_not(Bitmap(a)).tolist() == np.setdiff1d(b, a).tolist()
    assert Bitmap(a).both(Bitmap(b)).tolist() == np.intersect1d(a, b).tolist()


def compare(spark, a, b):
    schema = "k string, d string, v double, s string, diff string"
    l, r = (spark.createDataFrame(x, schema) for x in (a, b))
    return rows(differences(l, r, {"k": F.lower("k"), "d": F.col("d")}, {"v": 0.005, "s": None}, ("l", "r")))


def test_differences(spark):
    nan = float("nan")
    a = [("A", "1", 1.0, "s", ""), ("a", "1", 1.0, "s", ""), ("b", "1", None, "s", ""), ("c", "1", 2.0, None, ""), (None, "1", 1.0, "s", ""), ("n", "1", nan, "s", ""), ("far", "1", 1.0, "s", ""), ("lone", "1", 0.0, "", "")]
    b = [("a", "1", 1.004, "s", ""), ("b", "1", 3.0, "t", ""), ("c", "1", 2.0, None, ""), (None, "1", 1.0, "s", ""), ("n", "1", nan, "s", ""), ("far", "1", 1.005001, "s", ""), ("other", "1", 0.0, "", "")]
    assert compare(spark, a, b) == sorted([("b", "1", "v"), ("b", "1", "s"), ("far", "1", "v"), ("lone", "1", "only_in_l"), ("other", "1", "only_in_r")], key=repr)
    assert compare(spark, [], []) == []
    assert {x[2] for x in compare(spark, a, [])} == {"only_in_l"}


def test_differences_over_many_containers(spark):
    left = spark.range(400_000).select(F.col("id").cast("string").alias("k"), F.lit("1").alias("d"), (F.col("id") * 1.0).alias("v"), F.lit("s").alias("s"))
    right = left.where("k % 1000 <> 7").withColumn("v", F.when(F.expr("k % 1000 = 8"), F.col("v") + 1).otherwise(F.col("v")))
    got = differences(left.repartition(5), right.repartition(3), {"k": F.col("k"), "d": F.col("d")}, {"v": 0.005, "s": None})
    assert {(r.diff, r["count"]) for r in got.groupBy("diff").count().collect()} == {("only_in_left", 400), ("v", 400)}


def test_rows_of_a_key_are_placed_together_whatever_the_planner_knows(spark):
    """The exchange before a Python operator must stay, even over sides that are partitioned alike but sized unlike."""
    a = spark.range(300_000).select((F.col("id") % 90_000).cast("string").alias("k"), F.lit("1").alias("d"), F.lit(1.0).alias("v"))
    b = spark.range(90_000).select(F.col("id").cast("string").alias("k"), F.lit("1").alias("d"), F.lit(1.0).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        left = a.withColumn("wide", F.lit("x"))
        got = differences(left, b, {"k": F.col("k"), "d": F.col("d")}, {"v": 0.005, "wide": None})
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.diff, r["count"]) for r in got.groupBy("diff").count().collect()] == [("wide", 90_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
