import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.contract import content_hash, parity, table_checks, violations
from lodestrata.sources.files import csv_as_text, csv_many, csv_with_schema, export_file, not_dates, with_lineage, without_lineage
from lodestrata.sources.snapshots import Conflict, SnapshotStore
from tests.conftest import rows


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def df(spark, data):
    return spark.createDataFrame(data, "k string, v int")


def test_time_travel_and_log(spark, store):
    first = store.commit("t", df(spark, [("a", 1)]), summary={"batch": "one"})
    second = store.commit("t", df(spark, [("b", 2)]))
    assert rows(store.read("t")) == [("a", 1), ("b", 2)]
    assert rows(store.read("t", first)) == rows(store.read("t", 1)) == [("a", 1)]
    assert [store.rows("t", v) for v in (1, 2, None)] == [1, 2, 2]
    log = store.snapshots("t").orderBy("sequence").collect()
    assert [r.parent_id for r in log] == [None, first]
    assert log[0].summary["batch"] == "one"
    third = store.commit("t", df(spark, []), "replace")
    assert store.read("t").count() == 0
    assert {r.snapshot_id for r in store.refs("t").collect()} == {third}
    assert rows(store.read("t", second)) == [("a", 1), ("b", 2)]
    with pytest.raises(LookupError):
        store.read("t", "no such")


def test_tags_never_move(spark, store):
    first = store.commit("t", df(spark, [("a", 1)]))
    store.tag("t", "x")
    store.commit("t", df(spark, [("b", 2)]))
    assert store.tag("t", "x", first) == first
    with pytest.raises(Conflict):
        store.tag("t", "x")
    assert rows(store.read("t", tag="x", expect_rows=1)) == [("a", 1)]
    with pytest.raises(ValueError):
        store.read("t", tag="x", expect_rows=2)
    with pytest.raises(LookupError):
        store.read("t", tag="y")


def test_two_writers_conflict(spark, store):
    store.commit("t", df(spark, [("a", 1)]))
    with pytest.raises(Conflict):
        store._create("t/log/0000000001.json", "{}")


def test_dml(spark, store):
    store.commit("t", df(spark, [("a", 1), ("b", 2), ("c", None)]))
    store.update("t", F.col("v").isNull(), {"v": F.lit(9)})
    store.delete("t", F.col("k") == "a")
    store.merge("t", spark.createDataFrame([("b", 5, False), ("d", 6, False), ("c", 0, True)], "k string, v int, gone boolean"), ["k"], "gone")
    assert rows(store.read("t")) == [("b", 5), ("d", 6)]
    store.delete("t")
    assert store.read("t").count() == 0


def test_publish_once(spark, store):
    store.commit("in", df(spark, [("a", 1)]))
    built = []

    def build():
        built.append(1)
        return {"out": store.read("in").withColumn("w", F.col("v") * 2)}

    a = store.publish("manifest", store.pin(["in"]), ["code"], build, {"out": ["k"]})
    b = store.publish("manifest", store.pin(["in"]), ["code"], build)
    assert a == (b[0], True) and not b[1] and built == [1]
    assert rows(store.newest("manifest", "out").select("k", "v", "w")) == [("a", 1, 2)]
    assert store.publish("manifest", store.pin(["in"]), ["other code"], build)[1]
    assert spark.table("in").count() == 1


def test_csv_and_lineage(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,d\nx,2024-01-02\ny,nonsense\n")
    assert rows(csv_as_text(spark, str(tmp_path / "a.csv"), {"d": "date"})) == [("x", dt.date(2024, 1, 2)), ("y", None)]
    t = csv_many(spark, str(tmp_path), {"a": ("a.csv", "k STRING, d STRING")})["a"]
    at = dt.datetime(2024, 1, 1)
    marked = with_lineage(t, at)
    assert {r._ingested_at for r in marked.collect()} == {at}
    assert all(r._source_file.endswith("a.csv") for r in marked.collect())
    assert without_lineage(marked).columns == ["k", "d"]
    assert rows(not_dates(t, ["d"])) == [("d", "nonsense")]
    n = export_file(csv_with_schema(spark, str(tmp_path / "a.csv"), "k STRING, d STRING"), str(tmp_path / "b.json"), ["k"], "json")
    assert n == 2 and [json.loads(x)["k"] for x in (tmp_path / "b.json").read_text().splitlines()] == ["x", "y"]
    assert export_file(t, str(tmp_path / "c.csv"), ["k"]) == 2
    assert (tmp_path / "c.csv").read_text().startswith("k,d\nx,") and not (tmp_path / "c.csv.staged").exists()


def test_contracts(spark):
    t = spark.createDataFrame([("a", 1, 0.5), (None, 3, 7.0), ("z", None, None)], "k string, f int, x double")
    got = dict(rows(violations(t, table_checks(["k"], {"k": ["a"]}, {"x": (0, 1)}, [("f", "x")], ["f"]))))
    assert got == {"k is null": 1, "k not in list": 1, "x out of range": 1, "f not 0 or 1": 1, "f above x": 1}
    other = spark.createDataFrame([("a", 1, 0.5 + 1e-12), ("q", 3, 7.0), ("z", None, 1.0)], "k string, f int, x double")
    kinds = [(r.k, r.kind) for r in parity(t.where("k is not null"), other, ["k"]).collect()]
    assert sorted(kinds) == [("a", "rounding"), ("q", "right_only"), ("z", "beyond rounding")]
    a, b = content_hash(t), content_hash(t.repartition(3))
    assert rows(a) == rows(b) != rows(content_hash(t.union(t.limit(1))))


def test_only_touched_folders_are_rewritten(spark, store):
    for i in range(4):
        store.commit("t", df(spark, [(f"k{i}", i), (f"m{i}", i)]))
    before = set(store.current("t")["counts"])
    store.delete("t", F.col("k") == "k1")
    store.update("t", F.col("k") == "m2", {"v": F.lit(20)})
    store.merge("t", df(spark, [("k3", 30), ("new", 1)]), ["k"])
    log = {r.sequence: r.summary for r in store.snapshots("t").collect()}
    assert [log[i]["rewritten-folders"] for i in (5, 6, 7)] == ["1", "1", "1"]
    now = store.current("t")
    assert len(before & set(now["counts"])) == 1 and now["rows"] == store.read("t").count() == 8
    assert rows(store.read("t")) == [("k0", 0), ("k2", 2), ("k3", 30), ("m0", 0), ("m1", 1), ("m2", 20), ("m3", 3), ("new", 1)]
    store.compact("t", ["k"])
    assert len(store.current("t")["counts"]) == 1 and rows(store.read("t")) == rows(store.read("t", 7))
    assert rows(store.read("t", 4)) == [(x + str(i), i) for x in "km" for i in range(4)]


def test_partitioned_commits_read_and_prune(spark, store):
    for i in range(2):
        store.commit("p", df(spark, [("a", i), ("b", i)]), partition_by=["k"])
    assert rows(store.read("p")) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    plan = store.read("p").where("k = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan and plan.count("FileScan") == 1
    store.delete("p", F.col("k") == "b")
    assert rows(store.read("p")) == [("a", 0), ("a", 1)] and store.current("p")["partition_by"] == ["k"]


def test_empty_table_takes_dml(spark, store):
    store.commit("t", df(spark, []))
    store.delete("t")
    store.merge("t", df(spark, [("a", 1)]), ["k"])
    assert rows(store.read("t")) == [("a", 1)]


def test_verify_finds_lost_and_torn_data(spark, store, tmp_path):
    import shutil

    store.commit("t", df(spark, [("a", 1)]))
    store.commit("t", df(spark, [("b", 2), ("c", 3)]))
    assert store.verify("t") == 3
    gone = store.current("t")["counts"]
    shutil.rmtree(tmp_path / "store" / next(f for f, n in gone.items() if n == 1))
    (tmp_path / "store" / next(f for f, n in gone.items() if n == 1)).mkdir()
    with pytest.raises(ValueError, match="differ"):
        store.verify("t")


def test_offender_is_named(spark, tmp_path):
    from lodestrata.sources.files import require_dates

    (tmp_path / "a.csv").write_text("k,day\n1,2024-01-01\n2,2024-01-02 10:00\n")
    with pytest.raises(ValueError, match=r"a.csv, line 3, column day: '2024-01-02 10:00'"):
        require_dates(spark, f"file://{tmp_path}/a.csv", ["day"])
    (tmp_path / "b.csv").write_text("k,day\n1,2024-01-01\n2,\n")
    assert require_dates(spark, f"file://{tmp_path}/b.csv", ["day"]).count() == 2


def test_intermediates_go_when_the_context_stops(tmp_path):
    """In a process of its own, as it ends a context."""
    import subprocess
    import sys

    code = f"""
from lodestrata.session import build_session, written
s = build_session("x", "local[1]", 1, spark__checkpoint__dir="file://{tmp_path}/shared")
written(s.range(3), "t").count()
import pathlib
assert list(pathlib.Path("{tmp_path}/shared").rglob("*.parquet"))
s.stop()
assert not list(pathlib.Path("{tmp_path}/shared").rglob("*.parquet"))
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parents[1]), capture_output=True).returncode == 0


def test_tables_from_sql_listed_and_dropped(spark, store):
    df(spark, [("a", 1), ("b", 2)]).createOrReplaceTempView("src_rows")
    store.create_as("ns/t", "SELECT k, v + 1 AS v FROM src_rows WHERE k = 'a'")
    store.create_as("ns/u", "SELECT 1 AS x")
    assert store.tables("ns") == ["t", "u"] and rows(store.read("ns/t")) == [("a", 2)]
    assert store.drop("ns/t") and not store.drop("ns/t") and store.tables("ns") == ["u"]


def test_splits(spark, tmp_path):
    from lodestrata.sources.files import export_splits

    export_splits(df(spark, [("a", 1), ("b", None)]), f"file://{tmp_path}/out", {"model": (F.col("v").isNotNull(), ["k"]), "audit": (F.lit(True), ["k", "v"])})
    assert rows(csv_with_schema(spark, f"file://{tmp_path}/out/model", "k STRING")) == [("a",)]
    assert rows(csv_with_schema(spark, f"file://{tmp_path}/out/audit", "k STRING, v INT")) == [("a", 1), ("b", None)]
