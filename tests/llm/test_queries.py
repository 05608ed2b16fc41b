"""The queries as a whole on the smallest tables."""

from collections import Counter

import pytest

from lodestrata.llm import queries as Q
from tests.llm.test_lookalikes import skeleton

SF = "/root/testdata/sf0.001"


def test_packed(spark):
    fill = Counter()
    for r in Q.p8_packed(spark, SF).collect():
        fill[r.container_kind, r.container_id] += r.tokens
    sizes = Q._capacities(spark, SF)
    assert fill and all(n <= sizes[k] for (k, _), n in fill.items())
    report = {r.container_kind: r for r in Q.p8_fill(spark, SF).collect()}
    for k, c in sizes.items():
        least = -(-sum(n for (x, _), n in fill.items() if x == k) // c)
        assert least <= report[k].containers <= least * 1.02 + 1


def test_shares(spark):
    report = Q.p9_shares(spark, SF).collect()
    assert sum(r.actual_share for r in report) == pytest.approx(1)
    assert all(r.max_used <= r.max_repeats for r in report)


def test_found(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    by = {}
    for i, t in docs:
        by.setdefault(skeleton(t), []).append((i, t))
    want = {tuple(sorted((a, b))) for g in by.values() for n, (a, s) in enumerate(g) for b, t in g[:n] if s != t}
    assert {(r.doc_id_a, r.doc_id_b) for r in Q.p10_found(spark, SF).collect()} == want
    assert Q.p10_forms(spark, SF).count() == len(docs)
