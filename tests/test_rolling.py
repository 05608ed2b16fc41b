import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodestrata.operators.rolling import Monoid, rolling_totals, two_stack
from tests.conftest import rows

D = dt.date(2024, 1, 1)
day = lambda n: D + dt.timedelta(n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=90), st.integers(1, 35))
def test_two_stack_equals_brute_force(xs, w):
    a = np.array(xs, dtype=np.int64)
    lo = np.iinfo(np.int64).min
    for op, identity, py in ((np.add, 0, sum), (np.maximum, lo, max)):
        got = two_stack(a, w, op, identity).tolist()
        assert got == [py(xs[max(0, i - w + 1) : i + 1]) for i in range(len(xs))]


def test_quiet_days_and_edges(spark):
    data = [("a", day(0), 5, 1.0, "x"), ("a", day(0), 2, None, "x"), ("a", day(9), None, 4.0, "x"), ("b", day(3), 1, 1.5, "x"), (None, day(1), 9, 9.0, "x"), ("b", None, 9, 9.0, "x")]
    df = spark.createDataFrame(data, "e string, d date, n bigint, v double, __e2 string")
    got = {(r.e, r.d): r for r in rolling_totals(df, "e", "d", {"n": "sum", "v": "max"}, (3, 7)).collect()}
    assert set(got) == {("a", day(i)) for i in range(10)} | {("b", day(3))}
    a = [got["a", day(i)] for i in range(10)]
    assert [r.n_3d for r in a] == [7, 7, 7, 0, 0, 0, 0, 0, 0, 0]
    assert [r.v_7d for r in a] == [1.0] * 7 + [None, None, 4.0]
    assert got["b", day(3)].v_3d == 1.5


def test_other_monoids_and_keys(spark):
    """A real value equal to the identity is a value; any ufunc and key type will do."""
    least = np.iinfo(np.int64).min
    data = [(dt.date(2024, 5, 1), day(0), 4, least), (dt.date(2024, 5, 1), day(2), 6, None), (dt.date(2024, 5, 1), day(3), 9, None)]
    df = spark.createDataFrame(data, "e date, d date, n bigint, m bigint")
    gcd = Monoid(np.gcd, 0, 0.0, F.max, 0)
    longest = Monoid(lambda a, b: max(a, b, key=abs), 0, 0.0, F.max)
    got = rolling_totals(df.withColumn("k", F.col("n")), "e", "d", {"n": gcd, "m": "max", "k": longest}, (3,)).orderBy("d").collect()
    assert [r.n_3d for r in got] == [4, 4, 2, 3]
    assert [r.m_3d for r in got] == [least, least, least, None]
    assert [r.k_3d for r in got] == [4, 4, 6, 9]
    decimals = spark.createDataFrame([(1, day(0), 2.5)], "e int, d date, v double").withColumn("e", F.col("e").cast("decimal(5,2)"))
    assert rolling_totals(decimals, "e", "d", {"v": "product"}, (3,)).first().v_3d == 2.5


def test_many_entities_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(f"e{rng.integers(40)}", day(int(rng.integers(200))), int(rng.integers(-5, 6))) for _ in range(3000)]
    df = spark.createDataFrame(data, "e string, d date, n bigint")
    per = {}
    for e, d, n in data:
        per.setdefault(e, {}).setdefault(d, 0)
        per[e][d] += n
    want = []
    for e, days in per.items():
        x, z = min(days), max(days)
        for i in range((z - x).days + 1):
            t = x + dt.timedelta(i)
            want.append((e, str(t), *(sum(v for d, v in days.items() if t - dt.timedelta(w) < d <= t) for w in (7, 30))))
    assert rows(rolling_totals(df, "e", "d", {"n": "sum"}, (7, 30), text_days=True)) == sorted(want, key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "e string, d date, n bigint")
    assert rolling_totals(df, "e", "d", {"n": "sum"}).count() == 0
