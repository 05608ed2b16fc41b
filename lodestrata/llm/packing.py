"""Filling fixed-capacity containers with items, by exact complements and best fit for the rest."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import written

#: Rows of one length that one task ranks; more rows of a length are ranked by more tasks.
RANK_ROWS = 200_000


@dataclass
class Plan:
    """Patterns (length -> items of it in one container) and how many containers have each."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)

    def add(self, lengths: Counter | dict, times: int) -> None:
        self.patterns.append((dict(lengths), times))

    @property
    def containers(self) -> int:
        return sum(times for _, times in self.patterns)

    def lookup(self) -> tuple[np.ndarray, ...]:
        """Sorted by (length, first rank): length, first rank, items of the length a container, first container."""
        rows, used, base = [], Counter(), 0
        for lengths, times in self.patterns:
            for length, per in lengths.items():
                rows.append((length, used[length], per, base))
                used[length] += per * times
            base += times
        rows.sort()
        return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


def _sums(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which totals up to the capacity two and three available lengths add up to."""
    size, lengths = len(left), np.flatnonzero(left).tolist()
    full = (1 << size) - 1
    singles = sum(1 << a for a in lengths)
    pairs = triples = 0
    for a in lengths:
        pairs |= singles << a
    pairs &= full
    for a in lengths:
        triples |= pairs << a
    flags = []
    for bits in (pairs, triples):
        raw = np.frombuffer((bits & full).to_bytes(size // 8 + 1, "little"), dtype=np.uint8)
        flags.append(np.unpackbits(raw, bitorder="little")[:size].astype(bool))
    return flags[0], flags[1]


class SumIndex:
    """Which sums one, two or three available lengths have. Lengths only run out, so a sum that is not indexed never
    comes up again; one that is indexed is checked against what is left."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        self.pairs, self.triples = _sums(left)

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, none above ``most``; of several the pair with the longest."""
        low, high = -(-total // 2), min(most, total - 1)
        if total < 2 or high < low or not self.pairs[total]:
            return None
        a = np.arange(low, high + 1)
        there = (self.left[a] > 0) & (self.left[total - a] > 0)
        if total % 2 == 0:
            there[0] = self.left[low] > 1
        found = np.flatnonzero(there)
        if not len(found):
            return None
        return int(a[found[-1]]), int(total - a[found[-1]])

    def complement(self, gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly; fewer before more, longer before shorter,
        so that short lengths stay for gaps that nothing else fills."""
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap, most):
            return found
        if gap > 2 and self.triples[gap]:
            first = np.flatnonzero(self.left[1 : min(most, gap - 2) + 1])[::-1] + 1
            for x in first[self.pairs[gap - first]].tolist():
                self.left[x] -= 1
                rest = self.pair(gap - x, x)
                self.left[x] += 1
                if rest:
                    return (x, *rest)
        return None


#: How far down exact filling may go, as shares of the capacity; below, best fit takes over.
FLOORS = (0.0, 1 / 3, 1 / 2, 2 / 3, 5 / 6, 1.0)


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """How to fill containers of ``capacity`` with ``histogram[length]`` items of each length 1..capacity.

    From the longest length down, the gap it leaves is filled exactly: by one length, by two, by three, as
    long as such combinations are available, each taken as often as its rarest length allows. What has no
    exact complement is packed best fit decreasing, many equal items at a time.

    Exact filling spends short lengths early, which costs more than it saves where lengths are spread evenly. So
    plans are made with the exact part going down to several lengths (``FLOORS``), the last of them best fit alone,
    until one reaches the least number there can be; the one with the fewest containers is taken. It is never
    worse than best fit.

    Works on counts per length, so time and memory follow the capacity and not the number of items.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        counts[length] = n
    size = np.arange(capacity + 1)
    least = max(-(-int((size * counts).sum()) // capacity), int(counts[size * 2 > capacity].sum()))
    best = None
    for floor in FLOORS:
        plan = _plan(counts.copy(), capacity, floor)
        if best is None or plan.containers < best.containers:
            best = plan
        if best.containers <= least:
            break
    return best


def _plan(left: np.ndarray, capacity: int, floor: float) -> Plan:
    plan, index = Plan(capacity), SumIndex(left)
    for longest in range(capacity, int(capacity * floor), -1):
        gap = capacity - longest
        while left[longest] and gap:
            left[longest] -= 1
            found = index.complement(gap, longest)
            left[longest] += 1
            if found is None:
                break
            together = Counter((longest, *found))
            times = min(int(left[x]) // n for x, n in together.items())
            for x, n in together.items():
                left[x] -= n * times
            plan.add(together, times)
    _best_fit(left, plan)
    return plan


def _best_fit(left: np.ndarray, plan: Plan) -> None:
    capacity = plan.capacity
    open_at: list[list[tuple[Counter, int]]] = [[] for _ in range(capacity + 1)]
    is_open = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, lengths: Counter, times: int) -> None:
        if times:
            open_at[gap].append((lengths, times))
            is_open[gap] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(is_open[length:])
            if not len(fits):
                each = capacity // length
                put(capacity - each * length, Counter({length: each}), n // each)
                if n % each:
                    put(capacity - n % each * length, Counter({length: n % each}), 1)
                break
            gap = int(fits[0]) + length
            lengths, times = open_at[gap].pop()
            used = min(times, n)
            put(gap, lengths, times - used)
            is_open[gap] = bool(open_at[gap])
            put(gap - length, lengths + Counter({length: 1}), used)
            n -= used
    for groups in open_at:
        for lengths, times in groups:
            plan.add(lengths, times)


def fill_containers(sizes: DataFrame, capacities: dict[str, int], item: str = "doc_id", size: str = "tokens") -> DataFrame:
    """Assign items to containers of each kind: (container_kind, container_id, item, piece, first_token, tokens).

    An item longer than the capacity is cut into pieces of the full capacity and one of the rest; no other
    item is cut. Each kind packs all items. Container numbers start at 0 within a kind.

    1. Count items per kind and length: at most the sum of the capacities in rows, whatever the data; only
       these counts go to the driver, where ``plan_containers`` works out patterns.
    2. Rank the items of each length, by counts per (length, hash bucket) and a local row number, so a length
       that a third of all items have is ranked by many tasks.
    3. A pattern owns a range of ranks of each of its lengths; a binary search in the plan's table (bounded by
       the capacities as well) gives an item's container.

    Nulls: items of null or no size take no room and get no row. Repeated item ids are packed each (their
    order among equals is then open). Ties in length go by the item's hash and id. Empty input, or no
    capacity, gives no rows. Columns other than the two named are not read. ``sizes`` is read twice: write it
    first if it is costly.
    """
    kinds = sorted(capacities)
    caps = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(capacities[k]).cast("bigint").alias("capacity")) for k in kinds)) if kinds else F.expr("cast(array() as array<struct<kind:string,capacity:bigint>>)")
    whole = sizes.select(F.col(item).alias("__item"), F.col(size).cast("bigint").alias("__size")).where("__size > 0")
    each = whole.select("*", F.inline(caps))
    counted = each.select("kind", "capacity", F.expr("__size div capacity").alias("full"), F.expr("__size % capacity").alias("rest"))
    counts: dict[str, Counter] = {k: Counter() for k in kinds}
    for r in counted.groupBy("kind", "rest").agg(F.sum("full").alias("full"), F.count(F.lit(1)).alias("n")).collect():
        counts[r.kind][capacities[r.kind]] += r.full
        if r.rest:
            counts[r.kind][r.rest] += r.n
    plans = {k: plan_containers({x: n for x, n in counts[k].items() if n}, capacities[k]).lookup() for k in kinds}

    pieces = each.select(
        "kind", "__item", F.posexplode(F.expr("transform(sequence(0L, (__size - 1) div capacity), i -> named_struct('first', i * capacity, 'length', least(capacity, __size - i * capacity)))")).alias("piece", "p")
    ).select("kind", "__item", "piece", "p.first", "p.length")
    most = max((n for c in counts.values() for n in c.values()), default=0)
    buckets = max(1, -(-most // RANK_ROWS))
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__item", "piece"), F.lit(buckets)).cast("int"))
    if buckets > 1:
        per = pieces.groupBy("kind", "length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        earlier = F.sum("__n").over(Window.partitionBy("kind", "length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
        pieces = pieces.join(per.select("kind", "length", "__bucket", F.coalesce(earlier, F.lit(0)).alias("__before")), ["kind", "length", "__bucket"])
    else:
        pieces = pieces.withColumn("__before", F.lit(0))
    local = F.row_number().over(Window.partitionBy("kind", "length", "__bucket").orderBy("__item", "piece"))
    ranked = pieces.withColumn("__rank", F.col("__before") + local - 1)

    @F.pandas_udf("bigint")
    def container(kind: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(kind), dtype=np.int64)
        for k in kind.unique():
            lengths, first, per, base = plans[k]
            mine = np.flatnonzero((kind == k).to_numpy())
            x, r = length.to_numpy()[mine], rank.to_numpy()[mine]
            for one in np.unique(x):  # the entries of one length lie together, in order of first rank
                lo, hi = np.searchsorted(lengths, [one, one + 1])
                at = np.flatnonzero(x == one)
                entry = lo + np.searchsorted(first[lo:hi], r[at], side="right") - 1
                out[mine[at]] = base[entry] + (r[at] - first[entry]) // per[entry]
        return pd.Series(out)

    return ranked.select(
        F.col("kind").alias("container_kind"), container("kind", "length", "__rank").alias("container_id"), F.col("__item").alias(item), F.col("piece"), F.col("first").alias("first_token"), F.col("length").alias("tokens")
    )


def pack_documents(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``fill_containers`` over sizes that are costly to compute: they are written once and read back."""
    return fill_containers(written(sizes, "token-sizes"), capacities)
