"""History of changing attributes, by Merkle comparison of consecutive snapshots."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.placing import together

#: Leaf buckets of one partition's tree, and how many children a node has: leaves, branches, root.
LEAVES, FANOUT = 4096, 64


class MerkleState:
    """The last known attributes of a partition's keys under a hash tree.

    A leaf's digest is the XOR of the 64-bit row hashes of its keys, a branch's the XOR of its leaves, the
    root's that of the branches. A new snapshot gives a new tree; only where a node's digest differs from the
    one before does the comparison go down, and only in changed leaves are rows compared, value by value.
    """

    def __init__(self, width: int) -> None:
        self.ids: dict = {}
        self.digest = np.zeros((LEAVES // FANOUT, FANOUT), dtype=np.uint64)
        self.hash = np.zeros(0, dtype=np.uint64)
        self.since = np.zeros(0, dtype=np.int32)
        self.seen = np.zeros(0, dtype=np.int32)
        self.code = np.zeros((width, 0), dtype=np.int32)

    def slots(self, keys: list) -> np.ndarray:
        ids = self.ids
        at = np.fromiter((ids.setdefault(k, len(ids)) for k in keys), dtype=np.int64, count=len(keys))
        if (size := len(ids)) > len(self.hash):
            size = max(size, 2 * len(self.hash))
            for name in ("hash", "since", "seen"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(size - len(old), dtype=old.dtype))))
            self.code = np.concatenate((self.code, np.full((len(self.code), size - self.code.shape[1]), -1, dtype=np.int32)), axis=1)
        return at

    def changed(self, at: np.ndarray, leaf: np.ndarray, row_hash: np.ndarray) -> np.ndarray:
        """Which of the snapshot's rows lie in changed leaves; the tree becomes that of the snapshot.

        Keys that the snapshot leaves out keep their row, so they cancel out of every comparison and each
        digest is brought up to date by the rows of the keys that report.
        """
        branch, child = leaf // FANOUT, leaf % FANOUT
        tree = self.digest.copy()
        np.bitwise_xor.at(tree, (branch, child), self.hash[at] ^ row_hash)
        old, self.digest = self.digest, tree
        before, after = np.bitwise_xor.reduce(old, axis=1), np.bitwise_xor.reduce(tree, axis=1)
        if np.bitwise_xor.reduce(before) == np.bitwise_xor.reduce(after):
            return np.zeros(len(at), dtype=bool)
        branches = np.flatnonzero(before != after)
        differs = np.zeros_like(tree, dtype=bool)
        differs[branches] = old[branches] != tree[branches]
        return differs[branch, child]


def _histories(batches: Iterator[pa.RecordBatch], key: str, attributes: Sequence[str], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    state = MerkleState(len(attributes))
    values: list[list] = [[] for _ in attributes]
    codes: list[dict] = [{} for _ in attributes]
    names: list = []
    held: pa.Table | None = None

    def encode(i: int, column: pa.ChunkedArray) -> np.ndarray:
        d = column.combine_chunks().dictionary_encode()
        if isinstance(d, pa.ChunkedArray):
            d = d.combine_chunks()
        known = []
        for v in d.dictionary.to_pylist():
            if v not in codes[i]:
                codes[i][v] = len(values[i])
                values[i].append(v)
            known.append(codes[i][v])
        return np.asarray(known, dtype=np.int32)[d.indices.to_numpy()]

    def rows(at: np.ndarray, until: np.ndarray | None) -> pa.RecordBatch:
        day = lambda x: pa.array(x.astype(np.int32)).cast(pa.date32())
        data = [pa.array([names[i] for i in at], type=out.field(0).type)]
        data += [pa.array([values[k][c] for c in state.code[k, at]], type=out.field(1 + k).type) for k in range(len(attributes))]
        data += [day(state.since[at]), pa.nulls(len(at), pa.date32()) if until is None else day(until), day(state.seen[at])]
        return pa.RecordBatch.from_arrays(data, schema=out)

    def apply(t: pa.Table) -> Iterator[pa.RecordBatch]:
        days = t.column("__day").cast(pa.int32()).to_numpy()
        keys = t.column("__key").to_pylist()
        at = state.slots(keys)
        names.extend(itertools.islice(state.ids, len(names), None))
        leaf = t.column("__leaf").to_numpy().astype(np.int64)
        row_hash = t.column("__hash").to_numpy().view(np.uint64)
        code = np.stack([encode(i, t.column(a)) for i, a in enumerate(attributes)])
        edges = np.flatnonzero(np.diff(days)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(days)], strict=True):
            here, day = at[lo:hi], days[lo]
            look = np.flatnonzero(state.changed(here, leaf[lo:hi], row_hash[lo:hi]))
            state.hash[here] = row_hash[lo:hi]
            look = look[(state.code[:, here[look]] != code[:, lo:hi][:, look]).any(axis=0)]
            begun = here[look]
            known = begun[state.code[0, begun] >= 0]
            if len(known):
                yield rows(known, np.full(len(known), day - 1))
            state.code[:, begun] = code[:, lo:hi][:, look]
            state.since[begun] = day
            state.seen[here] = day

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if held is not None:
            t = pa.concat_tables([held, t])
        keep = pc.index(pc.equal(t.column("__day"), t.column("__day")[-1]), True).as_py()
        held = t.slice(keep)  # the last day may go on in the next batch
        if keep:
            yield from apply(t.slice(0, keep))
    if held is not None:
        yield from apply(held)
    for lo in range(0, len(state.ids), 50_000):
        yield rows(np.arange(lo, min(lo + 50_000, len(state.ids))), None)


def attribute_history(snapshots: DataFrame, key: Column, day: Column, attributes: dict[str, Column], order: Sequence[Column], key_name: str = "key") -> DataFrame:
    """Every version of each key's ``attributes`` (strings) with the days on which it held:
    (``key_name``, attributes..., valid_from, valid_to, last_seen).

    A version begins at a key's first day and at each day whose attributes differ from those of its day
    before; it ends on the day before the next begins. ``valid_to`` is null while it still holds;
    ``last_seen`` is the last day on which it was reported. Of several rows for one key and day the
    greatest by ``order`` counts.

    Rows are first reduced to one for each key and day (partial aggregation), then laid out by key hash and
    sorted by day. Each partition is a subtree: it plays its snapshots in order through ``MerkleState``,
    which holds one row per key and nothing of the past. The snapshots of a key that reports without end
    stream through.

    Nulls: rows without key, day or any attribute are left out. Empty texts count as the expressions given
    say. Repeated rows change nothing. An empty table gives no rows. Columns not named are never read.
    """
    names = list(attributes)
    latest = (
        snapshots.select(key.alias("__key"), day.cast("date").alias("__day"), F.struct(*order, *(c.alias(n) for n, c in attributes.items())).alias("__row"))
        .where(F.col("__key").isNotNull() & F.col("__day").isNotNull())
        .where(" and ".join(f"__row.`{n}` is not null" for n in names))
        .groupBy("__key", "__day")
        .agg(F.max("__row").alias("__row"))
        .select("__key", "__day", *(F.col(f"__row.`{n}`").alias(n) for n in names))
    )
    # digests are taken after the exchange: hashes do not compress
    marked = together(latest, "__key").withColumn("__leaf", F.pmod(F.xxhash64(F.lit("leaf"), "__key"), F.lit(LEAVES)).cast("int")).withColumn("__hash", F.xxhash64("__key", *names))
    placed = marked.sortWithinPartitions("__day")
    text = pa.string()
    out = pa.schema([(key_name, text), *((n, text) for n in names), ("valid_from", pa.date32()), ("valid_to", pa.date32()), ("last_seen", pa.date32())])
    ddl = ", ".join(f"`{n}` string" for n in (key_name, *names)) + ", valid_from date, valid_to date, last_seen date"
    return placed.mapInArrow(lambda b: _histories(b, key_name, names, out), ddl)
