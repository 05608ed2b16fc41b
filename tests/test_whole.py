"""What must cover every renewal, checked without the registered SQL."""

import pytest

import __spark_entry__ as entry
from lodestrata.queries import renewals as R
from tests.compare import connect
from tests.test_queries import SF, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["renewal_features", "lapse_rate", "graph_evidence", "graph_evidence_hidden", "graph_header", "similar_components", "similar_route_leak", "similar_max_in_degree", "similar_mutual"])
def test_sql_has_no_id_filter(name):
    assert "% 100" not in SQL[name]


def test_renewal_of_each_snapshot(spark, con):
    """One row per subscription and seven-days-before day, counted from the table without the repo's SQL."""
    want = con.execute("SELECT count(DISTINCT (lower(trim(subscription_id)), snapshot_date)), max(snapshot_date) FROM (SELECT * FROM subscription_snapshots WHERE trim(subscription_id) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(subscription_id)), snapshot_date ORDER BY _ingested_at DESC, snapshot_no DESC) = 1) WHERE snapshot_date = current_period_end - 7 AND trim(plan_tier) <> ''").fetchone()
    got = entry.queries()["renewal_features"](spark, SF)
    assert (got.count(), got.select("renewal_id").distinct().count()) == (want[0], want[0])
    assert got.agg({"as_of": "max"}).first()[0] > R.UNTIL


def test_every_renewal_has_a_cohort(spark):
    from lodestrata.queries import graph as G

    inside = G.gold(spark, SF).where("plan_tier is not null").count()
    members = entry.queries()["cohort_members"](spark, SF)
    assert (members.count(), members.select("node").distinct().count()) == (inside, inside)
    assert entry.queries()["leakage"](spark, SF).where("positives + negatives = 0").isEmpty()


def test_nearest_lapses_of_any_hops(spark):
    """Against Dijkstra's algorithm on the full graph."""
    import heapq
    from collections import defaultdict

    from lodestrata.queries import graph as G

    links, best = defaultdict(list), {}
    for r in G.similar_all(spark, SF).selectExpr("src", "dst", "floor(sqrt(d2_q / 1e9) * 1e6 + 0.5) / 1e6 AS w").collect():
        links[r.src].append((r.dst, r.w))
    rows = {r.no: r for r in G.scaled(spark, SF).select("no", "churned").collect()}
    for source in (n for n in rows if n % 100 == 0):
        heap, done = [(0.0, source)], {}
        while heap:
            cost, node = heapq.heappop(heap)
            if node not in done:
                done[node] = cost
                for to, w in links[node]:
                    heapq.heappush(heap, (cost + w, to))
        best |= {(source, n): c for n, c in done.items() if n != source and rows[n].churned == 1}
    got = {(r.source, r.node): r.path_dist for r in entry.queries()["similar_nearest_lapses"](spark, SF).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1.001e-4 for k in best)


def test_shortest_paths_without_bound(spark):
    from lodestrata.operators.graph import shortest_paths

    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)] + [(0, 9, 20.0)], "src int, dst int, w double")
    start = spark.createDataFrame([(0,)], "n int")
    cost = lambda hops: {r.node: r.cost for r in shortest_paths(line, start, "w", hops).collect()}
    assert cost(None) == {i: float(i) for i in range(10)}
    assert cost(4) == {**{i: float(i) for i in range(5)}, 9: 20.0}
