import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.operators.history import attribute_history
from tests.conftest import rows

D = dt.date(2024, 1, 1)
day = lambda n: D + dt.timedelta(n)
SCHEMA = "id string, d date, plan string, status string, n bigint, valid_from string"


def history(df):
    return attribute_history(df, F.col("id"), F.col("d"), {"plan": F.col("plan"), "status": F.col("status")}, [F.col("n").alias("n")], "id")


def brute(data):
    best = {}
    for i, d, p, s, n, _ in data:
        if None not in (i, d, p, s) and ((i, d) not in best or n > best[i, d][2]):
            best[i, d] = (p, s, n)
    out, last = [], {}
    for (i, d), (p, s, _) in sorted(best.items()):
        now = last.get(i)
        if now and now[1:3] == [p, s]:
            now[5] = d
        else:
            if now:
                now[4] = d - dt.timedelta(1)
            last[i] = [i, p, s, d, None, d]
            out.append(last[i])
    return sorted((tuple(r) for r in out), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(f"k{rng.randrange(60)}" if rng.random() > 0.02 else None, day(rng.randrange(120)) if rng.random() > 0.02 else None, rng.choice(["a", "a", "b", None, ""]), rng.choice(["x", "x", "y"]), i, "z") for i in range(4000)]
    assert rows(history(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_back_and_forth_and_corrections(spark):
    data = [("k", day(0), "a", "x", 1, ""), ("k", day(0), "b", "x", 2, ""), ("k", day(0), "b", "x", 2, ""), ("k", day(5), "a", "x", 3, ""), ("k", day(9), "b", "x", 4, "")]
    assert rows(history(spark.createDataFrame(data, SCHEMA))) == brute(data)
    assert len(brute(data)) == 3


def test_empty(spark):
    assert history(spark.createDataFrame([], SCHEMA)).count() == 0
