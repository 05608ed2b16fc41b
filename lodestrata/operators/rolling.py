"""Rolling totals over trailing day windows, quiet days included."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.operators.placing import together

@dataclass(frozen=True)
class Monoid:
    """An associative operation with its identity, and the Spark aggregate that reduces one day's records by it.

    op: a binary ufunc or any function of two numbers, never inverted. whole, real: the identity for
    int64 and for double. empty: what a window without any value gives, None for null.
    """

    op: np.ufunc | Callable
    whole: int
    real: float
    daily: Callable[[str], Column]
    empty: float | None = None


MONOIDS = {
    "sum": Monoid(np.add, 0, 0.0, F.sum, 0),
    "max": Monoid(np.maximum, np.iinfo(np.int64).min, -np.inf, F.max),
    "min": Monoid(np.minimum, np.iinfo(np.int64).max, np.inf, F.min),
    "or": Monoid(np.bitwise_or, 0, 0.0, F.bit_or),
    "product": Monoid(np.multiply, 1, 1.0, F.product),
}
#: Dense days laid out at once in a Python worker; only bounds memory, results do not depend on it.
DENSE_DAYS = 400_000


def two_stack(values: np.ndarray, width: int, op: np.ufunc | Callable, identity) -> np.ndarray:
    """The aggregate of the trailing ``width`` values at each position, by the two-stack queue.

    A two-stack queue moves its back stack over to the front one each time the front runs empty; with one
    push and one pop a day that happens every ``width`` days. So the front stack holds suffix aggregates of
    a block of ``width`` days and the back stack the prefix aggregate of the next block, and a window is
    front + back. The operation is never inverted, so maxima work as sums do. Positions before the first
    count as ``identity``.
    """
    boxed = not isinstance(op, np.ufunc)
    if boxed:
        op = np.frompyfunc(op, 2, 1)
    n = len(values)
    blocks = -(-(n + width) // width)
    # one block of identities in front, so that every window starts inside the array
    flat = np.full(blocks * width, identity, dtype=values.dtype)
    flat[width : width + n] = values
    grid = flat.reshape(blocks, width)
    run = lambda g: op.accumulate(g, axis=1, dtype=object if boxed else None).astype(values.dtype)
    back = run(grid).ravel()
    front = run(grid[:, ::-1])[:, ::-1].ravel()
    end = np.arange(width, width + n)
    start = end - width + 1
    return np.where(start % width == 0, back[end], op(front[start], back[end]).astype(values.dtype))


def _roll(batches: Iterator[pa.RecordBatch], measures: Sequence[tuple[str, Monoid]], windows: Sequence[int], text_days: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    pad = max(windows) - 1

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        entity, day = t.column(0), t.column(1).cast(pa.int32()).to_numpy()
        n = len(day)
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = pc.not_equal(entity.slice(1), entity.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        span = day[last].astype(np.int64) - day[first] + 1
        group = np.cumsum(new) - 1
        lo = 0
        while lo < len(first):  # some entities at a time, so that long silences do not fill the memory
            hi = lo + max(1, int(np.searchsorted(np.cumsum(span[lo:] + pad), DENSE_DAYS, side="right")))
            lens, rows = span[lo:hi], slice(first[lo], last[hi - 1] + 1)
            starts = np.concatenate(([0], np.cumsum(lens + pad)[:-1]))
            at = starts[group[rows] - lo] + (day[rows] - day[first[group[rows]]])
            size = int((lens + pad).sum())
            edge = np.bincount(np.concatenate((starts, starts + lens)), np.concatenate((np.ones(hi - lo), -np.ones(hi - lo))), size + 1)
            real = np.cumsum(edge[:size]) > 0
            owner = np.repeat(np.arange(lo, hi), lens)
            days = np.flatnonzero(real) - np.repeat(starts, lens) + np.repeat(day[first[lo:hi]].astype(np.int64), lens)
            columns = {out.names[0]: entity.take(pa.array(first[owner]))}
            if text_days:
                least = int(days.min())
                names = pa.array(np.arange(least, int(days.max()) + 1, dtype=np.int32)).cast(pa.date32()).cast(pa.string())
                columns[out.names[1]] = names.take(pa.array(days - least))
            else:
                columns[out.names[1]] = pa.array(days.astype(np.int32)).cast(pa.date32())
            for name, monoid in measures:
                source = t.column(name)
                real_valued = pa.types.is_floating(source.type)
                identity = monoid.real if real_valued else monoid.whole
                here = source.slice(rows.start, rows.stop - rows.start)
                dense = np.full(size, identity, dtype=np.float64 if real_valued else np.int64)
                dense[at] = here.fill_null(identity).to_numpy()
                if monoid.empty is None:  # how many values a window has tells an empty one, whatever the values are
                    there = np.zeros(size, dtype=np.int64)
                    there[at] = here.is_valid().to_numpy(zero_copy_only=False)
                for w in windows:
                    got = two_stack(dense, w, monoid.op, identity)[real]
                    none = two_stack(there, w, np.add, 0)[real] == 0 if monoid.empty is None else None
                    columns[f"{name}_{w}d"] = pa.array(got, mask=none)
            result = pa.table([columns[c] for c in out.names], names=out.names).cast(out)
            yield from result.to_batches(max_chunksize=65_536)
            lo = hi

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if held is not None:
            t = pa.concat_tables([held, t])
        ends = pc.equal(t.column(0), t.column(0)[-1])
        keep = pc.index(ends, True).as_py()  # sorted: the last entity's rows are the tail
        held = t.slice(keep)
        if keep:
            yield from emit(t.slice(0, keep))
    if held is not None:
        yield from emit(held)


def rolling_totals(activity: DataFrame, entity: str, day: str, measures: dict[str, str | Monoid], windows: Sequence[int] = (7, 30), text_days: bool = False) -> DataFrame:
    """One row per entity and calendar day between its first and last activity, with each measure
    aggregated over the trailing windows (the day itself included): columns ``<measure>_<w>d``.

    measures: column -> a name of ``MONOIDS`` or a ``Monoid``; integers stay int64, other numbers double. The entity may
    be of any type that sorts.

    The activity is summed per entity and day before it moves to the entity's partition, so an entity
    brings at most one row a day however many records it has. There the two-stack queue runs over the
    sorted rows.

    Nulls: rows without entity or day are no activity. A null measure is the identity (0 in a sum); a
    window without any value gives the monoid's ``empty``: 0 for a sum, null for max and min. Repeated rows count each time
    (drop repeats first); ties and order do not matter. An empty input gives no rows. Other columns of
    ``activity`` are left out, so clashing names do no harm.
    """
    kinds = dict(activity.dtypes)
    monoids = {m: MONOIDS[x] if isinstance(x, str) else x for m, x in measures.items()}
    whole = {m: kinds[m] in ("tinyint", "smallint", "int", "bigint") for m in measures}
    daily = (
        activity.select(F.col(entity).alias("__e"), F.col(day).cast("date").alias("__d"), *(F.col(m).cast("bigint" if whole[m] else "double").alias(m) for m in measures))
        .where(F.col("__e").isNotNull() & F.col("__d").isNotNull())
        .groupBy("__e", "__d")
        .agg(*(monoid.daily(m).cast("bigint" if whole[m] else "double").alias(m) for m, monoid in monoids.items()))
    )
    kind = {m: "bigint" if whole[m] else "double" for m in measures}
    ddl = f"`{entity}` {kinds[entity]}, `{day}` {'string' if text_days else 'date'}, " + ", ".join(f"`{m}_{w}d` {kind[m]}" for m in measures for w in windows)
    arrow = {"bigint": pa.int64(), "double": pa.float64()}
    entity_type = to_arrow_type(activity.schema[entity].dataType)
    out = pa.schema([(entity, entity_type), (day, pa.string() if text_days else pa.date32()), *((f"{m}_{w}d", arrow[kind[m]]) for m in measures for w in windows)])
    pairs, spans = list(monoids.items()), list(windows)
    placed = together(daily, "__e").sortWithinPartitions("__e", "__d")
    return placed.mapInArrow(lambda batches: _roll(batches, pairs, spans, text_days, out), ddl)
