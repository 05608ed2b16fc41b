"""Temporal, statistical, similarity and graph operators against small brute force."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators.disclosure import Attacker, Relation, protect, ranges, suppress
from lodestrata.operators.graph import components, degree_histogram, merge_communities, modularity, paths, ranked_groups, reach, shortest_paths, split_wide, undirected, union_wide
from lodestrata.operators.leakage import cross_validated, fit_logistic, neighbour_rate, out_of_fold, stratified_folds
from lodestrata.operators.search import build_index, search
from lodestrata.operators.similarity import feature_shares, fit_scaler, mutual_flag, nearest, z_scores
from lodestrata.operators.stats import auc, banded, cube_counts, dense, rates
from lodestrata.operators.temporal import half_up, inside_any, inside_collected, latest, numbered_within, overlapping, ratio, salted_join, within
from tests.conftest import rows

D = dt.date(2024, 1, 1)
day = lambda n: D + dt.timedelta(n)


def test_latest_and_numbers(spark):
    t = spark.createDataFrame([("a", 1, None, "x"), ("a", 1, 5, "y"), ("a", 0, 9, "z"), (None, 1, 1, "n")], "k string, o int, p int, v string")
    assert rows(latest(t, ["k"], ["o", "p"])) == sorted([("a", 1, 5, "y"), (None, 1, 1, "n")], key=repr)
    data = [(random.Random(i).choice("ab"), day(i * 7 % 100) if i % 9 else None, i) for i in range(200)]
    n = numbered_within(spark.createDataFrame(data, "k string, d date, i int"), "k", F.trunc("d", "month"), [F.col("d").asc_nulls_last(), F.col("i")])
    want = {}
    for k in "ab":
        for j, r in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is None, r[1] or D, r[2])), 1):
            want[r[2]] = j
    assert {r.i: r.seq for r in n.collect()} == want


def test_windows_and_overlaps(spark):
    t = spark.createDataFrame([(day(i), day(10)) for i in range(14)], "d date, a date")
    assert [r.d for r in t.where(within("d", "a", 3)).collect()] == [day(8), day(9), day(10)]
    assert [r.d for r in t.where(within("d", "a", 3, 3)).collect()] == [day(5), day(6), day(7)]
    assert t.where(inside_any("d", [("2024-01-03", "2024-01-04"), ("2024-01-04", "2024-01-05")])).count() == 3
    assert t.where(inside_any("d", [])).count() == 0
    few = spark.createDataFrame([(day(2), day(4)), (day(4), day(5))], "b date, e date")
    for most in (10, 1):
        assert [r.d for r in inside_collected(t.select("d").unionByName(spark.createDataFrame([(None,)], "d date")), "d", few, "b", "e", "i", most).where("i").orderBy("d").collect()] == [day(i) for i in (2, 3, 4, 5)]
    spans = spark.createDataFrame([("s", day(2), day(40)), ("t", day(3), day(3)), ("bad", day(9), day(1))], "n string, b date, e date")
    one, two = (rows(overlapping(t.select("d"), "d", spans, "b", "e", most)) for most in (10, 1))
    assert one == two and len(one) == 13


def test_ratio_and_rounding(spark):
    t = spark.createDataFrame([(1, 0), (1, 3), (0, 0)], "a int, b int")
    assert [r.x for r in t.select(ratio(F.col("a"), F.col("b"), 1.0).alias("x")).collect()] == [1.0, 1 / 3, 1.0]
    assert [spark.range(1).select(half_up(F.lit(x), d).alias("x")).first().x for x, d in ((0.61335, 4), (2.5, 0), (-2.5, 0))] == [0.6133, 3.0, -2.0]  # by the binary value


def test_wilson_dense_cube_bands(spark):
    t = spark.createDataFrame([("p", 0, 1), ("p", 2, 0), ("q", 10, 1)], "plan string, hits int, y int").withColumn("band", banded(F.col("hits"), (0, 1, 3, 6, 10)))
    assert [r.band for r in t.orderBy("hits").collect()] == ["0", "1-2", "10+"]
    grid = dense(t, {"plan": ["p", "q", "r"], "band": ["0", "1-2"]}, {"n": F.count(F.lit(1))})
    assert grid.count() == 6 and grid.where("n = 0").count() == 4
    r = rates(spark.createDataFrame([(50, 100), (0, 10), (0, 0)], "k int, n int"), "n", "k").orderBy("n").collect()
    assert (r[2].lower, r[2].upper) == (0.404, 0.596)  # textbook values
    assert (r[1].lower, r[1].upper) == (0.0, 0.278)
    assert (r[0].rate, r[0].lower) == (None, None)
    assert rows(cube_counts(t.select("plan", "band"), ["plan"], {"n": F.count(F.lit(1))})) == [("*", 3), ("p", 2), ("q", 1)]


def test_auc_with_ties(spark):
    rng = random.Random(1)
    data = [(rng.randrange(6) / 5, rng.randrange(2)) for _ in range(80)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert auc(spark.createDataFrame(data, "s double, y int"), "s", "y").first().auc == pytest.approx(want)
    assert auc(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y").first().auc is None


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    block = [f"b{i % 3}" if i % 50 else None for i in range(300)]
    t = spark.createDataFrame([(block[i], i, v[i].tolist()) for i in range(300)], "block string, id bigint, v array<double>")
    got = defaultdict(list)
    for r in nearest(t.where("id % 10 = 0"), t, "block", "id", "v", 3, 4).orderBy("src", "rank").collect():
        got[r.src].append(r.dst)
    for i in range(0, 300, 10):
        if block[i]:
            cand = sorted((((v[i] - v[j]) ** 2).sum(), j) for j in range(300) if block[j] == block[i] and i != j)
            assert got[i] == [j for _, j in cand[:4]]
    assert nearest(t.where("false"), t, "block", "id", "v", 3).count() == 0
    few = nearest(t.where("id = 1"), t.where("id in (1, 4)"), "block", "id", "v", 3)
    assert [r.dst for r in few.collect()] == [4]  # fewer candidates than k, itself left out


def test_scaler_and_shares(spark):
    t = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0)], "id bigint, a double, c double")
    z = t.select("id", *z_scores(fit_scaler(t, ["a", "c"]), ["a", "c"]))
    assert rows(z) == [(0, -1.0, 0.0), (1, 1.0, 0.0)]
    e = spark.createDataFrame([(0, 1, 4.0)], "src bigint, dst bigint, d2 double")
    assert rows(feature_shares(e, z, "id", ["a", "c"], 1).select("feature", "share")) == [("a", 1.0)]
    both = mutual_flag(e.select("src", "dst"), spark.createDataFrame([(1, 0)], "src bigint, dst bigint"))
    assert both.first().mutual


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = dict(rows(components(spark.createDataFrame(edges, "src bigint, dst bigint"))))
    assert got == {x: find(x) for x in parent}


def test_paths_and_reach(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 1.0), (3, 4, 1.0), (4, 5, None)], "src bigint, dst bigint, w double")
    start = spark.createDataFrame([(1,)], "n bigint")
    assert rows(shortest_paths(e, start, "w")) == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (1, 4, 3.0)]
    assert rows(reach(e, start, 2)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]
    assert [2, 3, 4] in [r.path for r in paths(e, spark.createDataFrame([(2,)], "n bigint"), 3).collect()]
    assert rows(degree_histogram(spark.createDataFrame([(i,) for i in range(1, 7)], "n bigint"), "n", e, "src")) == [(0, 2), (1, 2), (2, 2)]


def test_communities(spark):
    two = [(i, j, 0.1) for base in (0, 10) for i in range(base, base + 6) for j in range(i + 1, base + 6)] + [(0, 10, 9.0)]
    links = undirected(spark.createDataFrame(two, "src bigint, dst bigint, d double"), "d")
    groups = ranked_groups(merge_communities(links))
    assert sorted((r.cohort, r.size) for r in groups.select("cohort", "size").distinct().collect()) == [(1, 6), (2, 6)]
    assert modularity(links, groups).first().modularity > 0.4
    again = ranked_groups(merge_communities(links.orderBy(F.rand(3)).repartition(5)))
    assert rows(groups) == rows(again)


def test_wide_and_split(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, p string"), spark.createDataFrame([(2, 3)], "id int, q int")
    wide = union_wide({"A": a, "B": b})
    assert rows(split_wide(wide, "label", {"A": ["id", "p"]})["A"]) == [(1, "x")]


def test_suppression_rules():
    counts = {(p, r): n for p, row in zip("ab", ([2, 9, 30], [8, 7, 40]), strict=True) for r, n in zip("xyz", row, strict=True)}
    hidden = suppress(counts, [lambda k: k[0], lambda k: ("col", k[1])])
    assert hidden == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")}


@pytest.mark.parametrize("seed", range(12))
def test_protection_against_exhaustive_attack(seed):
    rng = random.Random(seed)
    cells = [(p, r) for p in "ab" for r in "xyz"]
    counts = {c: rng.choice([0, 1, 2, 3, 6, 7, 8]) for c in cells}
    groups = [[c for c in cells if c[0] == p] for p in "ab"] + [[c for c in cells if c[1] == r] for r in "xyz"]
    hidden = protect(counts, groups)
    if hidden is None:
        return
    small = {c for c, n in counts.items() if n < 5}
    assert small <= hidden
    unknown = sorted(hidden)
    relations = [Relation(tuple(g), sum(counts[c] for c in g)) for g in groups]
    seen = defaultdict(set)

    def attack(i, value):  # every whole-number table that fits the published sums
        if i == len(unknown):
            if all(sum(value.get(c, counts[c]) for c in g) == t.total for g, t in zip(groups, relations, strict=True)):
                for c in unknown:
                    seen[c].add(value[c])
            return
        c = unknown[i]
        roof = min(t.total for g, t in zip(groups, relations, strict=True) if c in g)
        for v in range(roof + 1):
            now = value | {c: v}
            if all(sum(now.get(x, 0 if x in hidden else counts[x]) for x in g) <= t.total for g, t in zip(groups, relations, strict=True)):
                attack(i + 1, now)

    attack(0, {})
    view = ranges(counts, hidden, relations)
    for c in unknown:
        assert view[c] == (min(seen[c]), max(seen[c]))
        assert c not in small or len(seen[c]) > 1


def test_attacker_finds_contradiction():
    with pytest.raises(ValueError):
        Attacker({}, ["a"], [Relation(("a",), 3), Relation(("a",), 4)]).reach("a")


def test_search(spark):
    e = spark.createDataFrame([("k", "inc-002", "power outage"), ("k", "inc-010", "outages everywhere"), ("p", "sub_1", "maria gonzalez")], "kind string, id string, text string")
    q = spark.createDataFrame([(x,) for x in ("INC-002", "outage", "outag", "gonzales", "2", "zzz", None)], "q string")
    got = defaultdict(list)
    for r in search(build_index(e, "kind", "id", F.col("text")), q, "q").orderBy("query", "place").collect():
        got[r.query].append((r.id, r.how))
    assert got["INC-002"][0] == ("inc-002", "id")
    assert got["outage"] == [("inc-002", "token")]
    assert sorted(got["outag"]) == [("inc-002", "prefix"), ("inc-010", "prefix")]
    assert got["gonzales"] == [("sub_1", "fuzzy")]
    assert got["2"][0] == ("inc-002", "token") and "zzz" not in got


def test_logistic(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))).astype(int)
    t = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id bigint, a double, b double, y int")
    beta = fit_logistic(t, ["a", "b"], "y")
    assert beta[1] == pytest.approx(2, abs=0.5) and abs(beta[2]) < 0.4
    assert auc(out_of_fold(t, "id", ["a", "b"], "y", 3), "score", "y").first().auc > 0.8
    edges, labels = spark.createDataFrame([(1, 2), (1, 3)], "src bigint, dst bigint"), spark.createDataFrame([(2, 1), (3, 0)], "dst bigint, l int")
    assert neighbour_rate(edges, labels, "l").first().score == 0.5
    assert neighbour_rate(edges, labels, "l", F.col("dst") == 2).first().score == 1.0


def test_communities_settle_where_nothing_gains(spark):
    """No two communities are left that a merger would help; modularity as by the definition."""
    rng = random.Random(4)
    edges = {(min(a, b), max(a, b)): rng.random() for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(500)) if a != b}
    links = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a bigint, b bigint, weight double")
    groups = ranked_groups(merge_communities(links))
    of = {r.node: r.cohort for r in groups.collect()}
    whole = {e: int(np.floor(w * 1e6 + 0.5)) for e, w in edges.items()}
    m2, deg, between = 2 * sum(whole.values()), defaultdict(int), defaultdict(int)
    for (a, b), w in whole.items():
        deg[of[a]] += w
        deg[of[b]] += w
        if of[a] != of[b]:
            between[frozenset((of[a], of[b]))] += w
    assert all(m2 * w <= np.prod([deg[c] for c in pair], dtype=object) for pair, w in between.items())
    inside = sum(w for (a, b), w in whole.items() if of[a] == of[b])
    want = 2 * inside / m2 - sum(d * d for d in deg.values()) / m2**2
    assert modularity(links, groups).first().modularity == pytest.approx(want, abs=1e-8) and want > 0.2
    sizes = sorted(((r["size"], -r["least"], r.cohort) for r in groups.groupBy("cohort", "size").agg(F.min("node").alias("least")).collect()), reverse=True)
    assert [c for *_, c in sizes] == list(range(1, len(sizes) + 1))
    assert merge_communities(links.where("false")).count() == 0


def test_auc_over_many_ranges(spark):
    rng = random.Random(9)
    data = [(g, rng.random() if rng.random() < 0.9 else 0.5, int(rng.random() < 0.3)) for g in "ab" for _ in range(1500)]
    got = {r.g: r.auc for r in auc(spark.createDataFrame(data, "g string, s double, y int"), "s", "y", ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for h, s, y in data if h == g and y == v] for v in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_salted_join(spark):
    events = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(600)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    for how in ("inner", "left"):
        assert rows(salted_join(events, right, "k", "i", how)) == rows(events.join(right, "k", how))


def test_folds_are_even_and_hold_out_their_labels(spark):
    rng = np.random.default_rng(8)
    n = 500
    y = (rng.random(n) < 0.2).astype(int)
    t = spark.createDataFrame([(i, float(rng.normal()), int(v)) for i, v in enumerate(y)], "id bigint, a double, y int")
    folds = stratified_folds(t, "id", "y", 5, 3)
    for label in (0, 1):
        sizes = [r["count"] for r in folds.where(f"y = {label}").groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert rows(folds) == rows(stratified_folds(t.repartition(7), "id", "y", 5, 3))
    # each row's only neighbour is itself: a rate that saw the test fold's labels would tell all of them
    own = t.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    scored = cross_validated(t, "id", ["a"], "y", {"none": None, "itself": own}, 5, 1)
    got = {r.variant: r.auc for r in auc(scored, "score", "y", ["variant"]).collect()}
    assert got["itself"] < 0.65 and scored.groupBy("variant").count().where("count <> 500").isEmpty()


def test_regression_that_does_not_settle_is_an_error(spark):
    t = spark.createDataFrame([(0.0, 0), (1.0, 1)] * 5, "a double, y int")
    with pytest.raises(RuntimeError):
        fit_logistic(t, ["a"], "y", ridge=0.0, rounds=3)


def test_questions_that_are_refused(spark):
    from lodestrata.queries.metrics import lapse_rate_by

    for by, only in ((("city",), {}), (("plan_tier", "band", "first_renewal_after_change"), {}), (("plan_tier", "incident_exposed_28d"), {}), (("overage_toggled_off",), {"plan_tier": "pro"}), (("plan_tier",), {"hits": (2, 5)}), ((), {"plan_tier": "gold"}), (("band", "band"), {})):
        with pytest.raises(ValueError):
            lapse_rate_by(spark, "unread", by, **only)


def test_tokens_of_ids_days_and_stop_words(spark):
    from lodestrata.operators.search import STOP_WORDS, day_words, tokens

    one = lambda c: set(spark.range(1).select(c.alias("t")).first().t)
    assert one(tokens(F.lit("sub_0042:2025-08-20 Cap-Cut!"))) == {"sub_0042:2025-08-20", "sub_0042", "2025-08-20", "2025-08", "0042", "42", "cap-cut", "cap", "cut"}
    assert one(tokens(F.lit("show me the outage"), tuple(STOP_WORDS))) == {"outage"}
    assert spark.range(1).select(day_words(F.lit(day(30)), F.lit(day(31))).alias("w")).first().w == "2024-01-31 2024-01 january jan 2024-02-01 2024-02 february feb"
