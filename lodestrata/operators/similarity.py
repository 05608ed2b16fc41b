"""Scaling of features and nearest neighbours within blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidate values (rows x dims) of one task, and rows of a leaf: they bound its memory, not the result.
QUERY_BLOCK, CANDIDATE_VALUES = 5_000, 2_000_000
QUERY_LEAF, CANDIDATE_LEAF = 64, 256


def fit_scaler(reference: DataFrame, features: Sequence[str], digits: int = 9) -> DataFrame:
    """(feature, mean, std) over the reference rows: population moments, one pass, rounded half up so that the
    last bits of a sum's order do not reach the distances."""
    moments = reference.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std")) for c in features))
    scale = float(10**digits)
    tidy = lambda c: (F.floor(F.col(c) * scale + 0.5).cast("double") / scale).alias(c)
    return moments.select(F.inline(rows)).select("feature", tidy("mean"), tidy("std"))


def z_scores(scaler: DataFrame, features: Sequence[str]) -> list[Column]:
    """Standardised features as columns; a feature without spread is 0 everywhere. The scaler's few rows (one
    per feature) become constants of the plan."""
    fitted = {r.feature: (r.mean, r.std) for r in scaler.collect()}
    out = []
    for c in features:
        mean, std = fitted[c]
        z = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
        out.append(z.alias(f"z_{c}"))
    return out


def _leaves(v: np.ndarray, most: int) -> tuple[np.ndarray, list[int]]:
    """An order of the rows and where its leaves begin: halves by the dimension of widest spread, down to ``most`` rows."""
    order, edges, open_ = np.arange(len(v)), [0], [(0, len(v))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo <= most:
            edges.append(hi)
            continue
        mine = order[lo:hi]
        x, middle = int(v[mine].var(axis=0).argmax()), (hi - lo) // 2
        order[lo:hi] = mine[np.argpartition(v[mine, x], middle)]
        open_ += [(lo + middle, hi), (lo, lo + middle)]
    return order, edges


def _fewest_alike(v: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that have ``most`` rows of equal vector and lesser id before them."""
    order = np.lexsort((ids, *v.T))
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[order[1:]] != v[order[:-1]]).any(axis=1)
    first = np.flatnonzero(new)
    return order[np.arange(len(v)) - first[np.cumsum(new) - 1] < most]


def _nearest_in(qv: np.ndarray, qi: np.ndarray, cv: np.ndarray, ci: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(src, dst, d2): the k rows of ``cv`` least by (quantised distance, id) for each row of ``qv``.

    Both are cut into leaves with boxes. The leaves of candidates are visited from the nearest box on, until no box can
    hold anything better; in a leaf a matrix product, widened by more than its rounding error, tells which pairs are worth
    the exact distance. Of equal vectors only k + 1 of least id can be among the k.
    """
    some = np.isfinite(cv).all(axis=1)  # others are at no finite distance
    cv, ci = cv[some] + 0.0, ci[some]
    some = np.isfinite(qv).all(axis=1)
    qv, qi = qv[some], qi[some]
    if not len(cv) or not len(qv):
        return
    some = _fewest_alike(cv, ci, k + 1)
    cv, ci = cv[some], ci[some]
    order, edges = _leaves(cv, CANDIDATE_LEAF)
    cv, ci = cv[order], ci[order]
    low, high = np.minimum.reduceat(cv, edges[:-1]), np.maximum.reduceat(cv, edges[:-1])
    q_order, q_edges = _leaves(qv, QUERY_LEAF)
    for q_lo, q_hi in zip(q_edges, q_edges[1:], strict=False):
        mine = qv[q_order[q_lo:q_hi]]
        ids = qi[q_order[q_lo:q_hi]]
        n, middle = len(mine), mine.mean(axis=0)
        q = mine - middle
        q2 = (q * q).sum(axis=1)
        kth, row, dst, d2 = np.full(n, np.inf), *(np.empty(0, dtype=t) for t in (np.int64, np.int64, float))
        apart = lambda a, b, lo, hi: np.square(np.maximum(0.0, np.maximum(lo - b, a - hi))).sum(axis=1)
        boxes = apart(mine.min(axis=0), mine.max(axis=0), low, high)
        for leaf in np.argsort(boxes, kind="stable"):
            limit = (kth + 1.0) * 1e-9  # the k-th distance as it is quantised
            if boxes[leaf] * (1 - 1e-9) > limit.max():
                break
            at = np.flatnonzero(apart(mine, mine, low[leaf], high[leaf]) * (1 - 1e-9) <= limit)
            if not len(at):
                continue
            lo, hi = edges[leaf], edges[leaf + 1]
            c = cv[lo:hi] - middle
            c2 = (c * c).sum(axis=1)
            near = q2[at, None] + c2 - 2.0 * (q[at] @ c.T)
            i, j = np.nonzero(~(near > (limit[at] + 1e-12 * (1.0 + q2[at] + c2.max()))[:, None]))
            i, j = at[i], j + lo
            exact = np.zeros(len(i))
            for x in range(cv.shape[1]):  # left to right, so the sum has the same bits in every engine
                gap = mine[i, x] - cv[j, x]
                exact += gap * gap
            names = ci[j]
            keep = np.isfinite(exact) & (names != ids[i]) & (np.floor(exact * 1e9 + 0.5) <= kth[i])
            if not keep.any():
                continue
            row, dst, d2 = np.concatenate((row, i[keep])), np.concatenate((dst, names[keep])), np.concatenate((d2, exact[keep]))
            d2_q = np.floor(d2 * 1e9 + 0.5)
            best = np.lexsort((dst, d2_q, row))
            row = row[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best, row, place = best[place < k], row[place < k], place[place < k]
            dst, d2, d2_q = dst[best], d2[best], d2_q[best]
            kth[row[place == k - 1]] = d2_q[place == k - 1]
        yield ids[row], dst, d2


def _search(batches: Iterator[pa.RecordBatch], dims: int, k: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, k best candidates of each query and cell."""
    cell, parts = None, ([], [])

    def flush() -> Iterator[pa.RecordBatch]:
        if parts[0] and parts[1]:
            sides = [np.concatenate(x) for p in parts for x in zip(*p, strict=True)]
            parts[0].clear(), parts[1].clear()
            found = [[], [], []]
            for leaf in _nearest_in(*sides, k):
                for column, x in zip(found, leaf, strict=True):
                    column.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], schema=out)

    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if cells[lo] != cell:
                yield from flush()
                cell, parts = cells[lo], ([], [])
            part = batch.slice(lo, hi - lo)
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            split, i = int(np.searchsorted(part.column("side").to_numpy() == 1, True)), part.column("id").to_numpy()
            for to, x in ((parts[0], slice(0, split)), (parts[1], slice(split, None))):
                if len(i[x]):
                    to.append((v[x].copy(), i[x].copy()))
    yield from flush()


def nearest(queries: DataFrame, candidates: DataFrame, block: str, id_: str, vector: str, dims: int, k: int = 10) -> DataFrame:
    """(src, dst, d2, d2_q, rank): the ``k`` candidates of a query's block that are nearest to it.

    Exact. Ranked by (d2_q, dst), d2_q = floor(d2 * 1e9 + 0.5), the query itself excluded; fewer than k come
    out where the block has fewer. ids are bigint, vectors arrays of double of length ``dims``.

    Queries are searched against all candidates in blocks: both are cut by hash into pieces of bounded size, every query
    piece meets every candidate piece of its block in a cell, and a cell sends on k rows per query; no pair of rows is
    ever emitted. Cells of a block that holds a third of all rows are as small as others. In a cell only leaves near
    enough to matter are looked at, but what moves is candidates x query pieces of the block, and vectors without any
    structure are all looked at.

    Nulls: rows without block, id or vector are left out. Equal vectors are told apart by id. Empty inputs
    give no rows.
    """

    def side(df: DataFrame, s: int) -> DataFrame:
        return df.select(F.col(block).alias("block"), F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(s).alias("side")).where("block is not null and id is not null and size(v) > 0")

    q, c = side(queries, 0), side(candidates, 1)
    # pieces per block: a row per block
    pieces = lambda df, rows, name: df.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias(name))
    plan = pieces(q, QUERY_BLOCK, "qn").join(pieces(c, max(1, CANDIDATE_VALUES // dims), "cn"), "block")
    place = lambda mine, n: F.pmod(F.xxhash64(F.lit(mine), "id"), F.col(n)).cast("int")
    spread_q = q.join(plan, "block").withColumn("qp", place("q", "qn")).withColumn("cp", F.explode(F.sequence(F.lit(0), F.col("cn") - 1)))
    spread_c = c.join(plan, "block").withColumn("cp", place("c", "cn")).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
    cells = spread_q.unionByName(spread_c).withColumn("cell", F.concat_ws("/", "block", "qp", "cp")).select("cell", "side", "id", "v")
    out = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("d2", pa.float64())])
    # the number is given so that adaptive execution does not put small cells, which take long, into few tasks
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(tasks, F.xxhash64("cell")).sortWithinPartitions("cell", "side").mapInArrow(lambda b: _search(b, dims, k, out), "src bigint, dst bigint, d2 double")
    ranked = found.withColumn("d2_q", F.floor(F.col("d2") * 1e9 + 0.5)).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2_q", "dst")))
    return ranked.where(F.col("rank") <= k)


def mutual_flag(edges: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Edges with ``mutual``: whether the opposite edge exists in ``all_edges``."""
    back = all_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual")).distinct()
    return edges.join(back, ["src", "dst"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))


def feature_shares(edges: DataFrame, z: DataFrame, id_: str, features: Sequence[str], top: int = 3) -> DataFrame:
    """(src, dst, place, feature, share): the features with the largest part of a pair's squared distance."""
    a = z.select(F.col(id_).alias("src"), *(F.col(f"z_{c}").alias(f"a_{c}") for c in features))
    b = z.select(F.col(id_).alias("dst"), *(F.col(f"z_{c}").alias(f"b_{c}") for c in features))
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), ((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("part")) for c in features))
    long = edges.where("d2 > 0").join(a, "src").join(b, "dst").select("src", "dst", "d2", F.inline(parts))
    place = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.floor(F.col("part") * 1e9 + 0.5).desc(), "feature"))
    return long.withColumn("place", place).where(F.col("place") <= top).select("src", "dst", "place", "feature", (F.floor(F.col("part") / F.col("d2") * 1e6 + 0.5) / 1e6).alias("share"))
