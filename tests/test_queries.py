"""Every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
CORE = [n for n in entry.queries() if entry.queries()[n].__module__.rpartition(".")[0] != "lodestrata.llm" or n in SQL]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(SQL) & set(CORE)))
def test_same_as_sql(spark, con, name):
    assert differs(spark, con, SF, entry.queries()[name], SQL[name]) == ""


def rows_of(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_only_these_have_no_sql():
    assert {n for n in CORE if n not in SQL} == {"protected_cells", "exposure_protected", "entity_search_misspelt", "lapse_model", "lineage_reads", "lineage_templates"}


@pytest.mark.parametrize("name", ["protected_cells", "exposure_protected"])
def test_protected_tables_hide_what_is_small(spark, name):
    """Shown counts are the true ones, and every hidden small count keeps several possible values for an attacker."""
    from lodestrata.operators.disclosure import Relation, ranges

    if name == "protected_cells":
        from lodestrata.queries.metrics import _cells

        tables = {"": _cells(spark, SF)}
        shown = {"": {(r.plan_tier, r.route): r.n for r in rows_of(spark, name)}}
    else:
        tables, shown = {}, {}
        for r in rows_of(spark, "exposure_cells"):
            tables.setdefault((r.kind, r.id), {})[r.plan_tier, r.route] = r.renewals
        for r in rows_of(spark, name):
            shown.setdefault((r.kind, r.id), {})[r.plan_tier, r.route] = r.renewals
            assert r.total == sum(tables[r.kind, r.id].values()) and (r.hidden or r.renewals is not None)
    for k, cells in tables.items():
        seen = shown[k]
        assert seen.keys() == cells.keys() and all(n is None or n == cells[c] for c, n in seen.items())
        hidden = [c for c in cells if seen[c] is None]
        assert all(cells[c] >= 5 for c in cells if c not in hidden)
        if hidden and len(hidden) < len(cells):
            groups = [[c for c in cells if c[i] == v] for i in (0, 1) for v in {c[i] for c in cells}] + ([list(cells)] if k else [])
            view = ranges(cells, hidden, [Relation(tuple(g), sum(cells[c] for c in g)) for g in groups])
            assert all(view[c][0] < view[c][1] for c in hidden if cells[c] < 5)


def test_misspelt_words_are_found(spark):
    found = {r.query: r for r in rows_of(spark, "entity_search_misspelt") if r.place == 1}
    assert found["weekli"].kind == "PricingChange" and found["incidnet"].kind == found["outtage"].kind == "Incident"
    assert {r.how for r in found.values()} == {"fuzzy"}


def test_model_learns_and_labels_of_the_test_fold_stay_out(spark):
    got = {r.variant: r for r in rows_of(spark, "lapse_model")}
    assert set(got) == {"features", "as_of_today", "known_by_as_of"} and all(0 < r.folds <= 15 and 0 <= r.auc <= 1 for r in got.values())


def test_lineage_reads_and_questions(spark):
    reads = {(r.src, r.role, r.dst) for r in rows_of(spark, "lineage_reads")}
    gold = "gold.renewal_features"
    assert (f"{gold}.limit_hits_14d", "WINDOW_BOUND", "bronze.limit_events.hit_at") in reads and (gold, "JOIN_KEY", "bronze.limit_events.subscription_id") in reads
    assert not any(dst.endswith(("_ingested_at", "hit_no")) and src == f"{gold}.limit_hits_14d" for src, _, dst in reads)
    counts = {r.template: r.n for r in rows_of(spark, "lineage_templates")}
    tiers = {t: counts[f"contract_tier_{t}"] for t in ("snapshots", "supersedes", "refs", "runs", "parents", "produced", "consumed")}
    assert tiers == {"snapshots": 2, "supersedes": 2, "refs": 2, "runs": 3, "parents": 2, "produced": 1, "consumed": 2}
    assert counts["pit_unbounded_reads"] == counts["pit_unbounded_rowcounts"] == 0 and counts["pit_features"] == 33


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_leak_is_found(spark):
    """Dropping the upper bound must change rows, else the fixture could not show a leak."""
    r = entry.queries()["renewal_features_naive"](spark, SF).first()
    assert r.last_active_days_ago > 0
