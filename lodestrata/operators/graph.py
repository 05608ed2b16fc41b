"""Relational forms of graph operations over node and edge tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.temporal import numbered_within
from lodestrata.session import written


#: Community links that one task merges, and links that one task finds paths over: they bound its memory, not the result.
TASK_LINKS, TASK_EDGES = 1_000_000, 2_000_000
#: Sources whose paths a task finds at once, and pieces that the sources of a block are cut into at most.
SOURCES, PIECES = 32, 24


def union_wide(parts: dict[str, DataFrame], tag: str = "label") -> DataFrame:
    """One table of many typed ones: a tag column, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(n)) for n, df in parts.items()))


def split_wide(wide: DataFrame, tag: str, schemas: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The typed tables back out of a wide one."""
    return {n: wide.where(F.col(tag) == n).select(*columns) for n, columns in schemas.items()}


def degree_histogram(nodes: DataFrame, node: str, edges: DataFrame, end: str) -> DataFrame:
    """(degree, nodes), nodes without edge included."""
    degrees = edges.groupBy(F.col(end).alias("__n")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(degrees, nodes[node] == degrees["__n"], "left").groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("nodes"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """(node, component): weakly connected components, named by their least node.

    Alternating large-star and small-star steps: each round links a node's neighbours to the least of them,
    once for greater, once for smaller neighbours, until nothing changes, in a number of rounds that grows
    with the logarithm of the diameter. A star step is one aggregate (map-side combined) and one join; no
    neighbour list is collected. Each round is written to the shared folder. Ends when all edges point at roots; raises after ``rounds``.
    """
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(l: DataFrame, large: bool) -> DataFrame:
        both = l.union(l.select("b", "a")) if large else l
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        if large:  # strictly greater neighbours go to the least
            return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        moved = l.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    state = written(links, "components")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(state)
    for _ in range(rounds):
        state = written(star(star(state, True), False), "components")
        now = mark(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("component", "node").alias("component"))


def _costs(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """Least cost of node x source, inf where there is no path: the links are relaxed in turn until nothing changes. Links
    are sorted by their end."""
    cost = np.full((n, len(sources)), np.inf)
    cost[sources, np.arange(len(sources))] = 0.0
    starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.empty(0, dtype=int)
    ends = np.r_[starts[1:], len(dst)]
    parts = np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // 4096)) + 1) if len(starts) else []
    changed = True
    while changed:
        changed = False
        for part in parts:
            lo, hi = starts[part[0]], ends[part[-1]]
            new = np.minimum.reduceat(cost[src[lo:hi]] + w[lo:hi, None], starts[part] - lo, axis=0)
            at = dst[starts[part]]
            old = cost[at]
            if (new < old).any():
                changed = True
                cost[at] = np.minimum(new, old)
    return cost


def _walk(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of cells, sorted by cell: links (kind 0), sources (1), targets (2, or none for all nodes)."""
    cell, parts = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        kind, a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        link = kind == 0
        nodes = np.unique(np.concatenate((a, b[link])))
        src, dst, w = np.searchsorted(nodes, a[link]), np.searchsorted(nodes, b[link]), w[link]
        order = np.lexsort((src, dst))
        src, dst, w = src[order], dst[order], w[order]
        asked = np.unique(a[kind == 1])
        told = np.searchsorted(nodes, np.unique(a[kind == 2])) if (kind == 2).any() else np.arange(len(nodes))
        for i in range(0, len(asked), SOURCES):
            some = asked[i : i + SOURCES]
            cost = _costs(src, dst, w, len(nodes), np.searchsorted(nodes, some))[told]
            node, source = np.nonzero(np.isfinite(cost))
            for j in range(0, len(node), 100_000):
                x, y = node[j : j + 100_000], source[j : j + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some[y]), pa.array(nodes[told[x]]), pa.array(cost[x, y])], schema=out)

    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "b", "w")]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo < hi:
                if cells[lo] != cell:
                    yield from flush()
                    cell = cells[lo]
                parts.append(tuple(c[lo:hi].copy() for c in columns))
    yield from flush()


def block_paths(edges: DataFrame, sources: DataFrame, weight: str, block: str, targets: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(source, node, cost) as ``shortest_paths`` of any number of edges, to ``targets`` only where given, in a graph of blocks
    that no link leaves. edges: (src, dst, weight, block); sources and targets: (block, node). Nodes are whole numbers.

    The sources of a block are cut into pieces, and each piece gets the block's links in a task, which relaxes them for
    ``SOURCES`` sources at once. Blocks of more than ``task_edges`` links do not fit a task: then the whole graph is walked in
    rounds of joins.
    """
    links = edges.select(F.col(block).alias("block"), F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"), F.col(weight).cast("double").alias("w")).where("block is not null and a is not null and b is not null and w is not null")
    ask, tell = (None if df is None else df.toDF("block", "a").select("block", F.col("a").cast("bigint").alias("a")).where("block is not null and a is not null").distinct() for df in (sources, targets))
    largest = links.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    if largest > task_edges:
        found = shortest_paths(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), ask.select("a"), "w", None)
        return found if tell is None else found.join(tell.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("source", "node", "cost")
    pieces = ask.groupBy("block").agg(F.least(F.lit(PIECES), F.ceil(F.count(F.lit(1)) / SOURCES)).cast("int").alias("n"))  # a row per block
    every = lambda df: df.join(F.broadcast(pieces), "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    shape = lambda df, kind, b=F.lit(0), w=F.lit(0.0): df.select(F.concat_ws("/", "block", "piece").alias("cell"), F.lit(kind).alias("kind"), "a", b.cast("bigint").alias("b"), w.alias("w"))
    mine = ask.join(F.broadcast(pieces), "block").withColumn("piece", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    cells = shape(every(links), 0, F.col("b"), F.col("w")).unionByName(shape(mine, 1))
    if tell is not None:
        # a node that is in no block is told for none
        cells = cells.unionByName(shape(every(tell), 2)).unionByName(shape(every(ask.groupBy("block").agg(F.lit(-(2**63)).cast("bigint").alias("a"))), 2))
    out = pa.schema([("source", pa.int64()), ("node", pa.int64()), ("cost", pa.float64())])
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, F.xxhash64("cell")).sortWithinPartitions("cell").mapInArrow(lambda x: _walk(x, out), "source bigint, node bigint, cost double")


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str, max_hops: int | None = 6) -> DataFrame:
    """(source, node, cost): least total weight of a directed path of at most ``max_hops`` from each source, of any
    path if None.

    Rounds of relaxation over the frontier that improved, not over everything known; each is written once. Without
    a bound on hops they end when no cost improves, after as many rounds as the cheapest path with most edges has.
    sources: one column of nodes. Weights must not be negative; null weights are no edge.
    """
    links = edges.select("src", "dst", F.col(weight).cast("double").alias("w")).where("w is not null").groupBy("src", "dst").agg(F.min("w").alias("w"))
    known = written(sources.distinct().toDF("source").select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")), "paths")
    frontier = known
    for _ in count() if max_hops is None else range(max_hops):
        step = frontier.join(links, frontier["node"] == links["src"]).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        best = known.withColumn("old", F.lit(1)).unionByName(step.withColumn("old", F.lit(0))).groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min(F.when(F.col("old") == 1, F.col("cost"))).alias("was"))
        state = written(best.withColumn("better", F.col("was").isNull() | (F.col("cost") < F.col("was"))), "paths")
        known, frontier = state.select("source", "node", "cost"), state.where("better").select("source", "node", "cost")
        if frontier.isEmpty():
            break
    return known


def reach(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, depth): nodes reached within ``depth`` hops, with the least number of hops."""
    links = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).distinct()
    found = start.distinct().toDF("start").select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = found
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["__s"]).select("start", F.col("__d").alias("node")).distinct()
        frontier = written(step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(hop)), "reach")
        found = found.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def paths(edges: DataFrame, start: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(path, hops): every directed path of 1..``hops`` edges from the start nodes, as its list of nodes."""
    links = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"))
    walk = start.distinct().toDF("node").select(F.array("node").alias("path"))
    out = []
    for _ in range(hops):
        walk = walk.join(links, F.element_at("path", -1) == F.col("__s")).select(F.concat("path", F.array("__d")).alias("path"))
        out.append(walk)
    return reduce(DataFrame.unionByName, out).withColumn("hops", F.size("path") - 1)


def undirected(edges: DataFrame, distance: str) -> DataFrame:
    """(a, b, weight), a < b: weight 1 / (1 + distance), the larger of both directions."""
    w = 1.0 / (1.0 + F.col(distance))
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("weight"))


def _whole(weight: str = "weight") -> Column:
    """A weight in whole millionths: sums are exact and the same in any order."""
    return F.floor(F.col(weight) * 1_000_000 + 0.5).cast("decimal(20,0)")


def _mergers(a: np.ndarray, b: np.ndarray, w: np.ndarray, deg: np.ndarray, total: int) -> np.ndarray:
    """The rounds of ``merge_communities`` to their end, over arrays: the community that each ends in. Links are there in
    both directions, communities are numbered in the order of their labels.

    Gains are compared as doubles; where these cannot tell, as whole numbers.
    """
    n, into, deg = len(deg), np.arange(len(deg)), deg.copy()
    order = np.argsort(a * n + b, kind="stable")
    a, b, w = a[order], b[order], w[order]
    while len(a):
        down = deg[a].astype(float) * deg[b]
        whole = w * float(total)
        good = whole > down
        for e in np.flatnonzero(np.abs(whole - down) <= 1e-13 * down):
            good[e] = total * int(w[e]) > int(deg[a[e]]) * int(deg[b[e]])
        gain = np.where(good, w * 1e18 / down, -np.inf)
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        most = np.repeat(np.maximum.reduceat(gain, starts), np.diff(np.r_[starts, len(a)]))
        # less than one below the most, and what doubles round away: may be the same whole number
        first = np.flatnonzero(good & (gain >= most - 1.0 - 1e-13 * np.abs(most)))
        lead = first[np.searchsorted(a[first], a[first])]
        # those of equal link and weight as the first are equal to it, and it has the least label
        first = first[(first == lead) | (w[first] != w[lead]) | (deg[b[first]] != deg[b[lead]])]
        source = a[first]
        alone = np.ones(len(first), dtype=bool)
        alone[1:] &= source[1:] != source[:-1]
        alone[:-1] &= source[1:] != source[:-1]
        pick = np.full(n, -1)
        pick[source[alone]] = b[first[alone]]
        best: dict[int, tuple[int, int, int]] = {}
        for e in first[~alone]:
            x, y = int(a[e]), int(b[e])
            now = (-(int(w[e]) * 10**18 // (int(deg[x]) * int(deg[y]))), min(x, y), max(x, y))
            if x not in best or now < best[x]:
                best[x] = now
        for x, (_, low, high) in best.items():
            pick[x] = high if x == low else low
        low = np.flatnonzero(pick >= 0)
        low = low[(pick[low] > low) & (pick[pick[low]] == low)]
        if not len(low):
            break
        high = pick[low]
        move = np.arange(n)
        move[high] = low
        deg[low] += deg[high]
        into = move[into]
        touched = (move[a] != a) | (move[b] != b)
        x, y, z = move[a[touched]], move[b[touched]], w[touched]
        apart = x != y
        x, y, z = x[apart], y[apart], z[apart]
        again = np.argsort(x * n + y, kind="stable")
        a, b, w = (np.concatenate((old[~touched], new[again])) for old, new in ((a, x), (b, y), (w, z)))
        key = a * n + b
        order = np.argsort(key, kind="stable")  # two sorted runs
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=int)
        a, b = a[order][starts], b[order][starts]
        w = np.add.reduceat(w[order], starts) if len(key) else w
    return into


def _merged_in_task(nodes: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """(label, into): what the remaining rounds make of communities with links, in one task."""
    rows = nodes.join(edges.select(F.col("a").alias("label")).distinct(), "label", "left_semi").select("label", F.lit(None).cast("bigint").alias("b"), F.col("deg").cast("bigint").alias("w"))
    rows = rows.unionByName(edges.select(F.col("a").cast("bigint").alias("label"), F.col("b").cast("bigint").alias("b"), F.col("w").cast("bigint").alias("w")))
    out = pa.schema([("label", pa.int64()), ("into", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        own, links = t.filter(t.column("b").is_null()), t.filter(t.column("b").is_valid())
        labels, deg, a, b, w = (c.to_numpy() for c in (own.column("label"), own.column("w"), links.column("label"), links.column("b"), links.column("w")))
        order = np.argsort(labels)
        labels, deg = labels[order], deg[order]
        into = _mergers(np.searchsorted(labels, a), np.searchsorted(labels, b), w, deg, total)
        yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(labels[into])], schema=out)

    return rows.repartition(1).mapInArrow(run, "label bigint, into bigint")


def merge_communities(links: DataFrame, rounds: int = 2000, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, label): communities of an undirected graph (a, b, weight), by greedy merging for modularity.

    Every node starts on its own. In each round every community picks, of the neighbours with which a merger gains
    modularity, the one with the heaviest link for the weights of both (w / (deg_a * deg_b)); pairs that picked each
    other merge. That measure lets small communities merge first, so many pairs merge in a round and no hub draws all
    others one by one. The gains of disjoint pairs add up, so modularity rises with each round, and the first pair of
    all always picks each other, so the rounds end: when no merger gains. Ties go to the pair of least labels; all is
    compared as whole numbers, so the result is the same at every run. A community is named by its least node.

    Of those that pick one hub only one merges a round, so hubs need many rounds: 104 on a graph of 48,883 links.

    Works on the contracted graph: a round is one aggregate over community links and two joins, and is written to the
    shared folder. Picks are partial maxima, so a hub is reduced before it moves. Raises after ``rounds``. As soon as no more
    than ``task_links`` links are left between communities, one task makes the same rounds over arrays to their end. Nodes
    are whole numbers.
    """
    both = links.where("a <> b").select("a", "b", _whole().alias("w"))
    both = written(both.union(both.select("b", "a", "w")), "links")
    nodes = written(both.groupBy(F.col("a").alias("label")).agg(F.sum("w").cast("decimal(20,0)").alias("deg")), "communities")
    total = nodes.agg(F.sum("deg")).first()[0]
    members, edges = nodes.select(F.col("label").alias("node"), "label"), both
    if total is None:
        return members
    for _ in range(rounds):
        if total < 2**62 and edges.count() <= 2 * task_links:
            last = written(_merged_in_task(nodes, edges, int(total)), "mergers")
            return members.join(last, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
        ends = [nodes.select(F.col("label").alias(x), F.col("deg").alias(f"deg_{x}")) for x in ("a", "b")]
        gain = F.lit(total).cast("decimal(20,0)") * F.col("w") - F.col("deg_a") * F.col("deg_b")
        worth = edges.join(ends[0], "a").join(ends[1], "b").where(gain > 0).withColumns({"up": F.col("w") * F.lit(10**18).cast("decimal(19,0)"), "down": F.col("deg_a") * F.col("deg_b")})
        gains = worth.select("a", "b", F.expr("up div down").alias("gain"))
        best = gains.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("p"))
        # the community picked by both its ends
        pairs = best.groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("y").alias("label"), F.col("x").alias("into"))
        pairs = written(pairs, "mergers")
        if pairs.isEmpty():
            return members
        moved = lambda df, c: df.join(pairs.withColumnRenamed("label", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: B023, E731
        members = written(moved(members, "label"), "members")
        nodes = written(moved(nodes, "label").groupBy("label").agg(F.sum("deg").cast("decimal(20,0)").alias("deg")), "communities")
        edges = written(moved(moved(edges, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("w").cast("decimal(20,0)").alias("w")), "community-links")
    raise RuntimeError(f"communities did not settle in {rounds} rounds")


def ranked_groups(members: DataFrame, label: str = "label", node: str = "node") -> DataFrame:
    """Members with ``cohort`` 1, 2, ...: groups by size, larger first, then by least member (a whole number).

    Groups are numbered within their size, in ranges of members, and larger sizes are counted before: only the
    distinct sizes, few by nature, meet in one task.
    """
    groups = members.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.min(node).alias("least"))
    numbered = numbered_within(groups, "size", F.floor(F.col("least") / 1_000_000), [F.col("least")], "place")
    sizes = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))  # a row per distinct size
    offsets = sizes.select("size", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = numbered.join(offsets, "size").select(label, "size", (F.col("before") + F.col("place")).cast("int").alias("cohort"))
    return members.join(ranked, label).select(node, "cohort", "size")


def modularity(links: DataFrame, membership: DataFrame, group: str = "cohort") -> DataFrame:
    """(modularity): weighted, of an undirected graph (a, b, weight) and (node, group), to nine digits."""
    whole = links.select("a", "b", _whole().alias("w"))
    ends = whole.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").cast("decimal(20,0)").alias("degree"))
    totals = ends.join(membership, "node").groupBy(group).agg(F.sum("degree").cast("decimal(19,0)").alias("degree"))
    ma, mb = membership.select(F.col("node").alias("a"), F.col(group).alias("ga")), membership.select(F.col("node").alias("b"), F.col(group).alias("gb"))
    inner = whole.join(ma, "a").join(mb, "b").agg(F.sum(F.when(F.col("ga") == F.col("gb"), F.col("w"))).cast("double").alias("inside"), F.sum("w").cast("double").alias("m"))
    squares = totals.agg(F.sum(F.col("degree") * F.col("degree")).cast("double").alias("squares"))
    q = F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))
    return inner.crossJoin(squares).select((F.floor(q * 1e9 + 0.5) / 1e9).alias("modularity"))  # one row x one row


def hidden_unless(visible: Column, value: Column, otherwise: Column) -> Column:
    """A neighbour's value where it may be seen, else a stand-in; an unknown condition hides."""
    return F.when(F.coalesce(visible, F.lit(False)), value).otherwise(otherwise)
