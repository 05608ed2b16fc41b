import pytest

from lodestrata.plans.guard import NotAllowed, guarded
from lodestrata.plans.lineage import Lineage, require_point_in_time
from lodestrata.plans.lineage_graph import TEMPLATES, LineageGraph
from lodestrata.queries import renewals as R
from lodestrata.sources.snapshots import SnapshotStore

SPINE, EVENTS = "k string, as_of date, cut date", "k string, d date, n int"


@pytest.fixture
def views(spark):
    spark.createDataFrame([], SPINE).createOrReplaceTempView("spine")
    spark.createDataFrame([], EVENTS).createOrReplaceTempView("ev")


def audit(df):
    return dict(Lineage(df).audit(["ev"]))


SAFE = "SELECT s.k, sum(CASE WHEN e.d > date_sub(s.as_of, 28) AND e.d <= s.as_of THEN e.n END) AS x FROM spine s LEFT JOIN ev e ON s.k = e.k GROUP BY s.k"


@pytest.mark.parametrize(
    ("text", "status"),
    [
        (SAFE, "compliant"),
        (SAFE.replace("AND e.d <= s.as_of", ""), "undeclared_exception"),
        (SAFE.replace("e.d <= s.as_of", "e.d <= date_add(s.as_of, 1)"), "undeclared_exception"),
        (SAFE.replace("e.d <= s.as_of", "s.as_of >= e.d"), "compliant"),
        (SAFE.replace("e.d <= s.as_of", "e.d < date_add(s.as_of, 1)"), "compliant"),
        (SAFE.replace("e.d <= s.as_of", "e.d <= s.cut"), "undeclared_exception"),
        (SAFE.replace("THEN e.n END", "THEN e.n ELSE e.n END"), "undeclared_exception"),
        ("SELECT s.k, count(e.n) AS x FROM spine s LEFT JOIN ev e ON s.k = e.k AND e.d <= s.as_of GROUP BY s.k", "compliant"),
        ("SELECT s.k, count(e.n) AS x FROM ev e LEFT JOIN spine s ON s.k = e.k AND e.d <= s.as_of GROUP BY s.k", "undeclared_exception"),
        ("WITH w AS (SELECT s.k, e.n FROM spine s JOIN ev e ON s.k = e.k WHERE e.d <= s.as_of) SELECT k, max(n) + 1 AS x FROM w GROUP BY k", "compliant"),
        ("SELECT k, as_of AS x FROM spine", "as_of_row"),
        (f"SELECT a.k, a.x + b.n AS x FROM ({SAFE}) a JOIN ev b ON a.k = b.k", "undeclared_exception"),
    ],
)
def test_edits_that_leak_are_found(spark, views, text, status):
    assert audit(spark.sql(text))["x"] == status


def test_windows_rules_and_refusals(spark, views):
    found = Lineage(spark.sql(SAFE))
    assert ("x", "as_of", 28, 0) in found.windows()
    assert ("x", "VALUE", "ev", "n") in found.reads() and ("x", "WINDOW_BOUND", "ev", "d") in found.reads()
    assert ("*", "JOIN_KEY", "ev", "k") in found.reads()
    assert ("d", "as_of", -7) in Lineage(spark.sql("SELECT * FROM ev e, spine s WHERE e.d = date_sub(s.as_of, 7)")).rules
    assert Lineage(spark.sql("SELECT * FROM ev LIMIT 3")).refused
    assert Lineage(spark.sql("SELECT row_number() OVER (ORDER BY d) AS r FROM ev")).unpartitioned_windows == 1
    with pytest.raises(ValueError, match="not bounded"):
        require_point_in_time(spark.sql(SAFE.replace("AND e.d <= s.as_of", "")), ["ev"])
    assert require_point_in_time(spark.sql(SAFE), ["ev"]).columns == ["k", "x"]
    clamp = spark.sql(SAFE.replace("sum(", "least(greatest(sum(").replace("END)", "END), 0), 3)"))
    assert dict(Lineage(clamp).guarantees())["x"] == "sql_clamp"


def test_guard(spark, views):
    assert guarded(spark, "WITH x AS (SELECT k FROM ev) SELECT count(*) AS n FROM x WHERE k IN (SELECT k FROM spine)", ["ev", "spine"]).first().n == 0
    for text in ("DROP VIEW ev", "SELECT * FROM spine", "INSERT INTO ev SELECT * FROM ev", "SELECT * FROM ev WHERE k IN (SELECT k FROM spine)", "CREATE TABLE z AS SELECT 1", "SELECT * FROM parquet.`/x`", "SET a = 1", "SHOW TABLES"):
        with pytest.raises(NotAllowed):
            guarded(spark, text, ["ev"])


def test_questions(spark, views, tmp_path):
    g = LineageGraph(spark)
    g.add_source(spark.table("ev"), "ev", True)
    g.add_query(spark.sql(SAFE), "f", ("as_of",), ["ev"])
    g.add_export("out", ["x"], "gold.f")
    g.add_assertion("x range", "export", "export.out.x", 0.0, 9.0)
    g.add_assertion("dangling", "export", None)
    g.add_consumer("model", ["gold.f.x"])
    g.add_parameter("days", "28", "sql", ["gold.f.x"])
    store = SnapshotStore(spark, f"file://{tmp_path}")
    first = store.commit("t", spark.range(1).toDF("v"))
    store.commit("t", spark.range(2).toDF("v"))
    store.tag("t", "one", first)
    g.add_run("child", "job", "root", [(first, "input")])
    g.add_run("root", "dag")
    g.add_snapshots(store, "t", "child")
    ask = lambda n, *ids: [tuple(r) for r in g.ask(n, ids).collect()]
    assert len(TEMPLATES) == 42 and all(g.ask(n, ["gold.f.x"]).columns for n in TEMPLATES)
    assert ask("guards_export_columns", "gold.f.x") == [("export.out.x", "gold.f.x")]
    assert g.guards("gold.f.x").first()["high"] == 9.0
    assert {r.id for r in g.unguarded().collect()} == {"gold.f.k"}
    assert {r.id for r in g.unused("bronze").collect()} == set()  # ev.k shapes the rows
    assert ask("contract_leaky") == [("assertion.export.dangling", "dangling")]
    assert {r.node for r in g.trace("bronze.ev.n", upstream=False).collect()} == {"bronze.ev.n", "gold.f.x", "export.out.x", "consumer.model"}
    assert ["bronze.ev.n", "gold.f.x", "export.out.x"] in [r.path for r in g.ask("contract_gold_descendants", ["bronze.ev.n"]).collect()]
    supersedes = dict(ask("contract_tier_supersedes"))
    assert list(supersedes.values()).count(None) == 1
    assert ask("contract_tier_parents") == [("run.child", "run.root", None)]
    assert ask("contract_tier_consumed") == [("run.child", f"snapshot.{first}", "input")]
    assert len(ask("contract_tier_refs")) == 2 and len(ask("contract_tier_produced")) == 1


def test_feature_query_is_point_in_time(spark):
    sf = "/root/testdata/sf0.001"
    from lodestrata.queries.lineage import EVENTS, EXCEPTIONS, LABELS

    assert require_point_in_time(R.features(spark, sf), EVENTS, ("as_of", "renewal_date"), LABELS, EXCEPTIONS, ("sid", "as_of"))
    with pytest.raises(ValueError, match="last_active_days_ago"):
        require_point_in_time(R.features(spark, sf, naive=True), EVENTS, ("as_of", "renewal_date"), LABELS, EXCEPTIONS)


def test_column_pruning_and_pushdown(spark):
    """Scans read only the columns a query needs, and filters reach them."""
    from lodestrata.queries.training import p5_found

    plan = p5_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "plan_tier" not in plan and "user_name" not in plan and "PushedFilters" in plan


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("SELECT s.k, s.as_of, count(a.n) AS x FROM spine s JOIN ev a ON s.k = a.k AND a.d <= s.as_of JOIN ev b ON b.k = s.k AND b.d <= s.as_of GROUP BY s.k, s.as_of", "joined with itself"),
        (SAFE, "without as_of"),
        ("SELECT s.k, s.as_of, e.n, sum(e.n) OVER (ORDER BY e.d) AS x FROM spine s JOIN ev e ON s.k = e.k AND e.d <= s.as_of", "window without partition"),
        ("SELECT s.k, s.as_of, e.n AS x FROM spine s JOIN ev e ON s.k = e.k AND e.d <= s.as_of LIMIT 3", "cannot follow"),
        ("SELECT s.k, s.as_of, e.n AS x FROM spine s JOIN ev TABLESAMPLE (10 PERCENT) e ON s.k = e.k AND e.d <= s.as_of", "cannot follow"),
    ],
)
def test_plans_that_cannot_be_vouched_for(spark, views, text, why):
    with pytest.raises(ValueError, match=why):
        require_point_in_time(spark.sql(text), ["ev"], grain=("k", "as_of"))


def test_a_plan_that_can(spark, views):
    good = SAFE.replace("GROUP BY s.k", "GROUP BY s.k, s.as_of").replace("SELECT s.k,", "SELECT s.k, s.as_of,")
    assert require_point_in_time(spark.sql(good), ["ev"], grain=("k", "as_of")).columns == ["k", "as_of", "x"]
