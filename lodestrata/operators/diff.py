"""Differences between two copies of a table, by presence bitmaps over shared ordinals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.placing import together

#: Ordinals under one container of a bitmap; a sparse container keeps its members, a dense one its bits.
CONTAINER, SPARSE = 65_536, 4_096
#: Rows whose keys get ordinals together: several containers; only bounds a task's memory.
GATHER = 4 * CONTAINER


class Bitmap:
    """A compressed set of ordinals: per container of 65,536 either sorted 16-bit members or packed bits."""

    def __init__(self, ordinals: np.ndarray) -> None:
        self.parts: dict[int, np.ndarray] = {}
        high = ordinals // CONTAINER
        for h in np.unique(high):
            self._put(int(h), np.unique(ordinals[high == h] % CONTAINER))

    def _put(self, h: int, members: np.ndarray) -> None:
        if len(members) <= SPARSE:
            self.parts[h] = members.astype(np.uint16)
        else:
            bits = np.zeros(CONTAINER, dtype=bool)
            bits[members] = True
            self.parts[h] = np.packbits(bits)

    def bits(self, h: int) -> np.ndarray:
        part = self.parts.get(h)
        if part is None:
            return np.zeros(CONTAINER // 8, dtype=np.uint8)
        if part.dtype == np.uint8:
            return part
        bits = np.zeros(CONTAINER, dtype=bool)
        bits[part] = True
        return np.packbits(bits)

    def _with(self, other: Bitmap, invert: bool) -> np.ndarray:
        found = [np.zeros(0, dtype=np.int64)]
        for h in sorted(self.parts):
            theirs = other.bits(h)
            both = self.bits(h) & (~theirs if invert else theirs)
            found.append(np.flatnonzero(np.unpackbits(both)) + h * CONTAINER)
        return np.concatenate(found)

    def and_not(self, other: Bitmap) -> np.ndarray:
        """Ordinals here and not there, ascending."""
        return self._with(other, True)

    def both(self, other: Bitmap) -> np.ndarray:
        """Ordinals in both, ascending."""
        return self._with(other, False)


def _compare(batches: Iterator[pa.RecordBatch], keys: Sequence[str], fields: dict[str, float | None], names: tuple[str, str], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None

    def report(t: pa.Table, at: np.ndarray, diff: str) -> pa.RecordBatch:
        some = t.take(pa.array(at))
        return pa.Table.from_arrays([*(some.column(k) for k in keys), pa.array([diff] * len(at), pa.string())], schema=out).combine_chunks().to_batches()[0]

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        n = t.num_rows
        new = np.ones(n, dtype=bool)
        if n > 1:
            same = np.ones(n - 1, dtype=bool)
            for k in keys:
                a, b = t.column(k).slice(1), t.column(k).slice(0, n - 1)
                neither = pc.and_(pc.is_null(a), pc.is_null(b))
                same &= pc.or_(pc.fill_null(pc.equal(a, b), False), neither).to_numpy()
            new[1:] = ~same
        ordinal = np.cumsum(new) - 1
        side = t.column("__side").to_numpy()
        row = [np.full(ordinal[-1] + 1, -1, dtype=np.int64) for _ in names]
        maps = []
        for s in (0, 1):
            mine = np.flatnonzero(side == s)
            row[s][ordinal[mine]] = mine
            maps.append(Bitmap(ordinal[mine]))
        for s in (0, 1):
            if len(lone := maps[s].and_not(maps[1 - s])):
                yield report(t, row[s][lone], f"only_in_{names[s]}")
        if not len(common := maps[0].both(maps[1])):
            return
        left, right = row[0][common], row[1][common]
        for name, tolerance in fields.items():
            a, b = t.column(name).take(pa.array(left)), t.column(name).take(pa.array(right))
            gone_a, gone_b = a.is_null().to_numpy(), b.is_null().to_numpy()
            if tolerance is None:
                unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy()
            else:
                x, y = (v.cast(pa.float64()).fill_null(0.0).to_numpy() for v in (a, b))
                with np.errstate(invalid="ignore"):
                    near = np.abs(x - y) < tolerance
                unequal = ~(near | (x == y) | (np.isnan(x) & np.isnan(y)))
            differs = (gone_a != gone_b) | (~gone_a & ~gone_b & unequal)
            if len(at := np.flatnonzero(differs)):
                yield report(t, left[at], name)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if held is not None:
            t = pa.concat_tables([held, t])
        if t.num_rows < GATHER:
            held = t
            continue
        cut = t.num_rows - 1  # rows of one key (at most two) stay together
        while cut and all(t.column(k)[cut].as_py() == t.column(k)[cut - 1].as_py() for k in keys):
            cut -= 1
        held = t.slice(cut)
        if cut:
            yield from settle(t.slice(0, cut))
    if held is not None:
        yield from settle(held)


def differences(left: DataFrame, right: DataFrame, keys: dict[str, Column], fields: dict[str, float | None], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Where two copies of a table disagree: (keys..., diff).

    diff is ``only_in_<name>`` for a key that one side lacks, else the name of a field whose values differ:
    one is null and the other is not, or they are unequal; for a field with a number as tolerance, that far
    or more apart (NaN agrees with NaN). keys: name -> clean expression, the same on both sides.

    Repeated rows of a key within a side are reduced first to one (of unequal ones the greatest by its
    fields, nulls least), so a key brings two rows at most. Both sides meet in the key's partition, sorted;
    there the keys get ordinals shared by both sides, each side's presence becomes a compressed bitmap, and
    AND-NOT gives the missing rows, AND the ordinals whose columns are lined up and compared as arrays. Only
    a few containers' worth of rows is in memory.

    Nulls: a null key is a key like others. An empty side makes every key of the other ``only_in``. Columns
    not named are not read, so further or clashing ones do no harm.
    """

    def side(df: DataFrame, s: int) -> DataFrame:
        values = F.struct(*(F.col(f) for f in fields))
        return df.select(*(c.alias(k) for k, c in keys.items()), values.alias("__v")).groupBy(*keys).agg(F.max("__v").alias("__v")).select(*keys, F.lit(s).alias("__side"), "__v.*")

    both = side(left, 0).unionByName(side(right, 1))
    kinds = dict(both.dtypes)
    placed = together(both, *keys).sortWithinPartitions(*keys, "__side")
    arrow = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "int": pa.int32()}
    out = pa.schema([*((k, arrow[kinds[k]]) for k in keys), ("diff", pa.string())])
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", diff string"
    key_names = list(keys)
    return placed.mapInArrow(lambda b: _compare(b, key_names, fields, names, out), ddl)
