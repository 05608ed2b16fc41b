import bisect
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.packing import SumIndex, fill_containers, pack_documents, plan_containers


def check(plan, histogram, capacity):
    used = Counter()
    for lengths, times in plan.patterns:
        assert times > 0 and sum(x * n for x, n in lengths.items()) <= capacity
        for x, n in lengths.items():
            used[x] += n * times
    assert used == Counter({x: n for x, n in histogram.items() if n})


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 12), max_size=12))
def test_every_item_is_in_a_container_that_holds_it(histogram):
    check(plan_containers(histogram, 24), histogram, 24)


@pytest.mark.parametrize(
    ("histogram", "capacity", "containers"),
    [
        ({10: 3}, 10, 3),
        ({7: 5, 3: 5}, 10, 5),  # single complement
        ({5: 4}, 10, 2),
        ({6: 2, 3: 2, 1: 2}, 10, 2),  # pair complement
        ({4: 1, 3: 2}, 10, 1),
        ({6: 1, 2: 1, 1: 2}, 10, 1),  # triple complement
        ({5: 1, 2: 1, 1: 3}, 10, 1),  # 5 + 2 + 1 + 1 + 1: best fit
        ({9: 4, 1: 2}, 10, 4),
        ({3: 7}, 10, 3),
        ({}, 10, 0),
        ({1: 95}, 10, 10),
    ],
)
def test_known_cases(histogram, capacity, containers):
    plan = plan_containers(histogram, capacity)
    check(plan, histogram, capacity)
    assert sum(t for _, t in plan.patterns) == containers


def test_never_far_from_the_lower_bound():
    import random

    rng = random.Random(3)
    histogram = Counter(min(1024, 1 + int(rng.paretovariate(1.1) * 12)) for _ in range(40_000))
    plan = plan_containers(histogram, 1024)
    check(plan, histogram, 1024)
    least = -(-sum(x * n for x, n in histogram.items()) // 1024)
    assert sum(t for _, t in plan.patterns) <= least * 1.002 + 1


LENGTHS = {
    "uniform": lambda rng, c: rng.integers(1, c + 1, 20_000),
    "gaps": lambda rng, c: rng.choice(rng.choice(np.arange(1, c + 1), c // 20, replace=False), 20_000),
    "normal": lambda rng, c: np.clip(rng.normal(0.42 * c, 0.12 * c, 20_000), 1, c).astype(int),
    "lognormal": lambda rng, c: np.clip(rng.lognormal(np.log(c / 12), 1.0, 20_000), 1, c).astype(int),
}


@pytest.mark.parametrize("capacity", [256, 1024, 4096])
@pytest.mark.parametrize("kind", LENGTHS)
def test_never_worse_than_best_fit(kind, capacity):
    """Against best fit decreasing, item by item."""
    lengths = LENGTHS[kind](np.random.default_rng(capacity), capacity).tolist()
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    plan = plan_containers(Counter(lengths), capacity)
    check(plan, Counter(lengths), capacity)
    assert plan.containers <= len(gaps)


def test_sums_of_three():
    left = np.zeros(31, dtype=np.int64)
    left[[3, 7, 12]] = 1, 2, 1
    index = SumIndex(left)
    assert index.complement(17, 30) == (7, 7, 3) and index.complement(14, 30) == (7, 7) and index.complement(12, 30) == (12,)
    assert index.complement(6, 30) is None and index.complement(21, 30) is None and index.complement(22, 30) == (12, 7, 3)


def brute_force_least(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_close_to_the_optimum(lengths):
    plan = plan_containers(Counter(lengths), 12)
    assert sum(t for _, t in plan.patterns) <= brute_force_least(sorted(lengths, reverse=True), 12) + 1


@pytest.mark.parametrize("rank_rows", [200_000, 7])
def test_documents(spark, monkeypatch, rank_rows):
    """With few rows a task, too: a third of the items have one length."""
    monkeypatch.setattr("lodestrata.llm.packing.RANK_ROWS", rank_rows)
    sizes = [(i, 5 if i % 3 == 0 else i % 23, "clash") for i in range(300)] + [(1000, 57, ""), (1001, None, ""), (1002, 0, ""), (1003, 20, "")]
    got = pack_documents(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint, kind string"), {"s": 10, "l": 20}).collect()
    for kind, capacity in (("s", 10), ("l", 20)):
        mine = [r for r in got if r.container_kind == kind]
        fill, parts = Counter(), defaultdict(list)
        for r in mine:
            fill[r.container_id] += r.tokens
            parts[r.doc_id].append((r.piece, r.first_token, r.tokens))
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        want = {i: n for i, n, _ in sizes if n}
        assert set(parts) == set(want)
        for i, pieces in parts.items():
            assert sum(p[2] for p in pieces) == want[i] and len(pieces) == -(-want[i] // capacity)
            for j, (piece, first, n) in enumerate(sorted(pieces)):
                assert (piece, first) == (j, j * capacity) and (n == capacity or j == len(pieces) - 1)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert fill_containers(none, {"s": 10}).count() == 0
    assert fill_containers(spark.createDataFrame([(1, 1)], "doc_id bigint, tokens bigint"), {}).count() == 0
