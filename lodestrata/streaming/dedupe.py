"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.session import files_below, new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are reduced together before they move; only bounds a task's memory.
GATHER = 131_072
#: Bits and hashes of a bucket's filter of expired identifiers. Too small a filter costs lookups, never rows.
BITS, HASHES = 1 << 16, 4
_SURPLUS, _EXPIRED, _AGAIN = "surplus", "expired", "again"
_KINDS = pa.array([_SURPLUS, _EXPIRED, _AGAIN])


def _best(t: pa.Table, order: Sequence[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows sorted by (key, order), nulls least; the start of each key's run, and which rows are their key's last."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("key", *order)], null_placement="at_start")).combine_chunks()
    keys = t.column("key")
    new = np.ones(len(t), dtype=bool)
    if len(t) > 1:
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(t) - 1)).to_numpy()
    return t, np.flatnonzero(new), np.append(new[1:], True)


def _seen(t: pa.Table, starts: np.ndarray) -> np.ndarray:
    """The latest event time of each key's run; int64's least where none has one."""
    return np.maximum.reduceat(t.column("seen").fill_null(np.iinfo(np.int64).min).to_numpy(), starts)


def _replaced(t: pa.Table, name: str, values: pa.Array) -> pa.Table:
    return t.set_column(t.schema.get_field_index(name), t.schema.field(name), values)


def _payload(t: pa.Table) -> bytes:
    return t.combine_chunks().to_batches()[0].serialize().to_pybytes() if len(t) else b""


def _rows(blobs: Sequence[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), schema) for b in blobs if len(b)], schema=schema)


def _reduce(batches: Iterator[pa.RecordBatch], order: Sequence[str], buckets: int, gather: int, row: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows gathered, told from those beaten by a row of the same gathering, and laid into one payload per bucket."""
    out = pa.schema([("bucket", pa.int32()), ("event_time", pa.timestamp("us", tz="UTC")), ("payload", pa.binary())])
    least = np.iinfo(np.int64).min

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, starts, last = _best(pa.Table.from_batches(parts).cast(row), order)
        seen = np.where(last, np.repeat(_seen(t, starts), np.diff(np.append(starts, len(t)))), least)
        t = _replaced(t, "seen", pa.array(seen, mask=seen == least))
        t = _replaced(t, "state", pa.array(np.where(last, 0, 1).astype(np.int8)))
        # what is settled goes anywhere, so that an identifier with a third of all deliveries is one row here
        bucket = np.where(last, t.column("hash").to_numpy(), t.column("no").to_numpy()) % buckets
        at = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[at], prepend=-1, append=buckets))
        t, newest = t.take(pa.array(at)), [int(seen[at[lo:hi]].max()) for lo, hi in zip(edges, edges[1:], strict=False)]
        columns = [
            pa.array(bucket[at[edges[:-1]]].astype(np.int32)),
            pa.array(newest, mask=np.array([n == least for n in newest])).cast(pa.timestamp("us")).cast(pa.timestamp("us", tz="UTC")),
            pa.array([_payload(t.slice(lo, hi - lo)) for lo, hi in zip(edges, edges[1:], strict=False)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=out)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= gather:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    h = hashes.view(np.uint64)
    return ((h[:, None] >> np.uint64(11)) + np.arange(HASHES, dtype=np.uint64) * ((h[:, None] >> np.uint64(37)) | np.uint64(1))) % np.uint64(size)


def _step(state_rows: pa.Table, new: pa.Table, bits: np.ndarray, order: Sequence[str], watermark: int, expire: int) -> tuple[pa.Table, pa.Table]:
    """One bucket's store after a micro-batch, and the rows to report (``state`` 1 surplus, 2 expired, 3 again)."""
    settled = pc.equal(new.column("state"), 1)
    reports = [new.filter(settled).select(["no"])]
    t = pa.concat_tables([state_rows, new.filter(pc.invert(settled))])
    if not len(t):
        return t, _report(reports, [], [], t.schema)
    # a row of the store carries 2 (or 3, if its identifier may have expired before); a new row 0
    t, starts, last = _best(t, order)
    lens = np.diff(np.append(starts, len(t)))
    mark = t.column("state").to_numpy()
    held = np.maximum.reduceat(mark, starts)
    ends = np.flatnonzero(last)
    maybe = bits[_places(t.column("hash").to_numpy()[ends], len(bits))].all(axis=1)
    doubt = np.where(held > 0, held == 3, maybe)  # opened now: may have been here before
    lost = np.flatnonzero(~last)
    key = t.column("key")
    known = np.repeat(doubt, lens)[lost]
    losers = pa.table({"no": t.column("no").take(pa.array(lost)), "key": pc.if_else(pa.array(known), key.take(pa.array(lost)), pa.scalar(None, pa.string()))})
    best = t.take(pa.array(ends))
    seen = _seen(t, starts)
    now = max(watermark + expire, int(seen.max()))
    seen = np.where(seen == np.iinfo(np.int64).min, now, seen)  # without event time: as of now
    best = _replaced(best, "seen", pa.array(seen))
    again = best.filter(pa.array(doubt & (mark[ends] == 0)))
    best = _replaced(best, "state", pa.array(np.where(doubt, 3, 2).astype(np.int8)))
    old = seen < watermark
    gone = best.filter(pa.array(old))
    if len(gone):
        bits[_places(gone.column("hash").to_numpy(), len(bits)).ravel()] = True
    return best.filter(pa.array(~old)), _report([*reports, losers], [gone], [again], t.schema)


def _report(surplus: list[pa.Table], expired: list[pa.Table], again: list[pa.Table], row: pa.Schema) -> pa.Table:
    parts = []
    for mark, tables in enumerate((surplus, expired, again), 1):
        for t in tables:
            if len(t):
                columns = [pa.array(np.full(len(t), mark, dtype=np.int8)) if f.name == "state" else t.column(f.name) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in row]
                parts.append(pa.Table.from_arrays(columns, schema=row))
    return pa.concat_tables(parts) if parts else row.empty_table()


def _explode(batches: Iterator[pa.RecordBatch], row: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = _rows(batch.column(0).to_pylist(), row)
        if len(t):
            kind = _KINDS.take(pc.subtract(t.column("state").cast(pa.int32()), 1).combine_chunks())
            yield from t.drop_columns(["state", "seen", "hash"]).append_column("kind", kind).combine_chunks().to_batches()


def keyed_store(spark: SparkSession, path: str, key: Column, order: dict[str, Column], number: Column, event_time: Column, expire_after: datetime.timedelta = datetime.timedelta(30), batches: int = 4, buckets: int = 256, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the deliveries in ``path`` through a keyed state store and return what it decided: (kind, key, order..., no).

    The store (RocksDB, changelog checkpoints) holds per identifier the best delivery so far, until the event-time
    watermark has gone ``expire_after`` beyond the identifier's latest event. A delivery that meets a better one,
    or is beaten by a later one, comes out at once as ``surplus``. An identifier that expires comes out with its
    best delivery as ``expired`` and leaves one mark in its bucket's bit filter. A delivery whose identifier is not
    in the store opens it; where the filter says that it may have been there before, its best deliveries also come
    out as ``again``, for the lookup among the expired ones. Deliveries older than the watermark are not dropped:
    they open and expire at once. So the store follows the live window, and no delivery goes by unseen.

    Identifiers are held by hash bucket, an Arrow table each, so a micro-batch costs a call per bucket and not per
    identifier. Before the exchange a task reduces up to 131,072 rows to one per identifier; what is beaten there
    is settled and goes anywhere. An identifier with a third of all deliveries thus brings one row per gathering.

    Output files and state advance together: a micro-batch that is run again after a failure writes the same files
    once. ``out`` and ``checkpoint`` may name lasting folders; a later call then reads only the files that are new.
    Of a lasting store ``buckets`` must not change. A call costs about 10 ms however few identifiers it has, so take one
    bucket for some thousands of live identifiers. batches: over how many micro-batches the files that wait are spread.
    """
    out, checkpoint = out or new_path(spark, "decided"), checkpoint or new_path(spark, "dedupe-state")
    own = spark.newSession()  # settings of the stream's own, none changed for the caller
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", str(min(partitions, max(8, 2 * spark.sparkContext.defaultParallelism))))
    own.conf.set("spark.sql.adaptive.enabled", "false")
    files = files_below(spark, path)
    reader = own.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max(1, -(-(files or 1) // batches)))
    if files is None:  # a stream reads folders: of a single file's folder only that file
        folder, _, name = path.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(path)
    names = [f"r{i}" for i in range(len(order))]
    rows = stream.select(key.alias("key"), *(c.alias(n) for n, c in zip(names, order.values(), strict=True)), number.cast("bigint").alias("no"), F.unix_micros(event_time.cast("timestamp")).alias("seen"))
    rows = rows.where("key is not null and no is not null").withColumn("hash", F.xxhash64("key")).withColumn("state", F.lit(0).cast("tinyint"))
    row = to_arrow_schema(rows.schema)
    row = pa.schema([f.with_nullable(True) for f in row])
    ranks, gather, size = [*names, "no"], GATHER, BITS
    placed = rows.mapInArrow(lambda b: _reduce(b, ranks, buckets, gather, row), "bucket int, event_time timestamp, payload binary")
    delay = int(expire_after / datetime.timedelta(microseconds=1))

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, bits = state.get if state.exists else (b"", bytes(size // 8))
        bits = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        new = _rows([p for f in frames for p in f["payload"]], row)
        kept, report = _step(_rows([blob], row), new, bits, ranks, state.getCurrentWatermarkMs() * 1000, delay)
        state.update((_payload(kept), np.packbits(bits).tobytes()))
        yield pd.DataFrame({"payload": [_payload(report)]})

    decided = placed.withWatermark("event_time", f"{delay // 1000} milliseconds").groupBy("bucket").applyInPandasWithState(step, "payload binary", "live binary, filter binary", "append", GroupStateTimeout.NoTimeout)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("state", "seen", "hash")]
    found = decided.mapInArrow(lambda b: _explode(b, row), ", ".join([*fields, "kind string"]))
    query = found.writeStream.format("parquet").partitionBy("kind").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("kind", "key", *(F.col(n).alias(o) for n, o in zip(names, order, strict=True)), "no")


def surplus_deliveries(spark: SparkSession, path: str, delivery: str, key: Column, order: dict[str, Column], event_time: Column, **store) -> DataFrame:
    """The deliveries that are not the one to keep, one row each: (``delivery``).

    Deliveries of one ``key`` belong together; the greatest by ``order`` (name -> column, first decides;
    null is least) is kept.

    1. ``keyed_store`` decides each delivery against the best of its identifier while that is in the store.
    2. Late-arrival lookup: only identifiers that opened ``again`` are looked up among the expired ones. Of such an
       identifier the bests of its times in the store are compared, and all but the greatest come out too.

    The input is read once, by the stream; with lasting folders only its new files are. ``store``: parameters of
    ``keyed_store``.

    Nulls: rows without key are no cases; a null in ``order`` counts as least; a delivery without event time counts
    as seen when it arrives. Empty and blank-only keys count as the key expression says. Equal ``order`` values fall
    to the greatest delivery number. An empty table gives no rows. Columns not named are never read.
    """
    ranks = list(order)
    decided = keyed_store(spark, path, key, order, F.col(delivery), event_time, **store)
    surplus = decided.where(F.col("kind") == _SURPLUS)
    again = decided.where(F.col("kind") == _AGAIN).select("key", *ranks, "no")
    before = decided.where(F.col("kind") == _EXPIRED).select("key", *ranks, "no").join(again.select("key").distinct(), "key", "left_semi")
    rivals = again.unionByName(before).distinct().join(surplus.where("key is not null").select("no"), "no", "left_anti")
    best = rivals.groupBy("key").agg(F.max(F.struct(*ranks, "no")).alias("best"))
    beaten = rivals.join(best, "key").where(F.col("no") != F.col("best.no"))
    return surplus.select(F.col("no").alias(delivery)).unionByName(beaten.select(F.col("no").alias(delivery)))
