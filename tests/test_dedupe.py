import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import dedupe
from lodestrata.streaming.dedupe import keyed_store, surplus_deliveries

T = dt.datetime(2024, 1, 1)


def key():
    return F.nullif(F.trim("id"), F.lit(""))


def order():
    return {"ts": F.col("ts"), "arrived": F.col("arrived")}


def write(spark, path, batches):
    """One file per batch, in order of arrival."""
    for b in batches:
        spark.createDataFrame(b, "no bigint, id string, ts timestamp_ntz, arrived timestamp_ntz, extra string, key string").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def surplus(spark, path, **more):
    got = surplus_deliveries(spark, path, "no", key(), order(), F.col("ts"), **({"buckets": 8} | more))
    return sorted(r.no for r in got.collect())


def decided(spark, path, **more):
    return {k: sorted(r.no for r in g) for k, g in _by_kind(keyed_store(spark, path, key(), order(), F.col("no"), F.col("ts"), **({"buckets": 8} | more)).collect()).items()}


def _by_kind(rows):
    out = {}
    for r in rows:
        out.setdefault(r.kind, []).append(r)
    return out


def row(no, id_, day, late=0):
    return (no, id_, None if day is None else T + dt.timedelta(day), T + dt.timedelta((day or 0) + late), None, "clash")


def brute(data):
    rank = lambda r: tuple((x is not None, x) for x in (r[2], r[3])) + (r[0],)
    by = {}
    for r in data:
        if r[1] and r[1].strip():
            by.setdefault(r[1].strip(), []).append(r)
    return sorted(r[0] for g in by.values() for r in g if r is not max(g, key=rank))


@pytest.mark.parametrize("batches", [1, 3])
def test_keeps_the_latest(spark, tmp_path, batches):
    data = [[row(1, "a", 1), row(2, " a ", 2), row(3, "b", 1)], [row(4, "b", None), row(5, None, 3), row(6, None, 3), row(7, "  ", 3), row(8, "a", 2)], [row(9, "c", 5), row(10, "b", 1, late=9)]]
    # a: 2 and 8 tie on ts and arrival, the greater number stays; b: 10 arrived last, the one without time is least
    assert surplus(spark, write(spark, tmp_path / "t", data), batches=batches) == [1, 2, 3, 4]


def test_repeat_after_expiry_and_too_late(spark, tmp_path):
    """The state of x expires long before its repeats; y's repeat is older than the watermark."""
    data = [[row(1, "x", 1), row(2, "y", 1)], [row(3, "z", 500)], [row(9, "w", 510)], [row(4, "x", 900)], [row(5, "x", 901), row(6, "y", 0)], [row(7, "late and alone", 2)], [row(8, "y", 3)]]
    path = write(spark, tmp_path / "t", data)
    ten = dt.timedelta(10)
    kinds = decided(spark, path, expire_after=ten, batches=7, buckets=1)
    assert 4 in kinds["again"] and 6 in kinds["again"] and {1, 2} <= set(kinds["expired"]) and kinds["surplus"] == [4]
    assert surplus(spark, path, expire_after=ten, batches=7, buckets=1) == [1, 2, 4, 6]


def test_the_store_decides(spark, tmp_path, monkeypatch):
    """Nothing comes out that the store did not report."""
    path = write(spark, tmp_path / "t", [[row(1, "a", 1), row(2, "a", 2)], [row(3, "a", 3)]])
    assert surplus(spark, path) == [1, 2]
    whole = keyed_store
    monkeypatch.setattr(dedupe, "keyed_store", lambda *a, **k: whole(*a, **k).where("false"))
    assert surplus(spark, path) == []


def test_later_call_reads_only_new_files(spark, tmp_path):
    at = {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}
    path = write(spark, tmp_path / "t", [[row(1, "a", 1), row(2, "b", 1)]])
    assert surplus(spark, path, **at) == []
    for f in (tmp_path / "t").glob("*.parquet"):
        f.unlink()  # it cannot be read again; what is known of a is in the store
    write(spark, tmp_path / "t", [[row(3, "a", 2), row(4, "c", 2)]])
    assert surplus(spark, path, **at) == [1]
    write(spark, tmp_path / "t", [[row(5, "b", 0)]])
    assert surplus(spark, path, **at) == [1, 5]
    assert surplus(spark, path, **at) == [1, 5]


@pytest.mark.parametrize("bits", [dedupe.BITS, 8])
def test_random_deliveries_over_many_batches(spark, tmp_path, monkeypatch, bits):
    """Also with a filter so small that it is full at once."""
    monkeypatch.setattr(dedupe, "BITS", bits)
    rng = random.Random(11)
    data = [row(i, rng.choice([None, " "] + [f"k{rng.randrange(150)}"] * 30), rng.choice([None] + [i // 10 + rng.randrange(-20, 5)] * 20), late=rng.randrange(3)) for i in range(900)]
    path = write(spark, tmp_path / "t", [data[i : i + 150] for i in range(0, 900, 150)])
    assert surplus(spark, path, expire_after=dt.timedelta(5), batches=6) == brute(data)


def test_hot_identifier(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "GATHER", 400)
    data = [row(i, "hot" if i % 3 == 0 else f"k{i}", i % 20) for i in range(3000)]
    assert surplus(spark, write(spark, tmp_path / "t", [data[:1500], data[1500:]])) == brute(data)


def test_numbers_beyond_53_bits_and_settings(spark, tmp_path):
    big = 2**60
    before = spark.conf.getAll
    assert surplus(spark, write(spark, tmp_path / "t", [[row(big + 1, "a", 1), row(big, "a", 1)]])) == [big]
    assert spark.conf.getAll == before


def test_state_follows_the_live_window():
    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("seen", pa.int64()), ("hash", pa.int64()), ("state", pa.int8())])
    rows = lambda r: pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in r], schema=schema)
    bits = np.zeros(dedupe.BITS, dtype=bool)
    live, _ = dedupe._step(rows([]), rows([("a", 1, 5, 77, 0), ("b", 2, 50, 99, 0)]), bits, ["no"], 0, 10)
    live, said = dedupe._step(live, rows([("c", 3, 60, 11, 0)]), bits, ["no"], 20, 10)
    assert sorted(live.column("key").to_pylist()) == ["b", "c"]
    assert [(r["key"], r["state"]) for r in said.to_pylist()] == [("a", 2)]
    live, said = dedupe._step(live, rows([("a", 4, 61, 77, 0)]), bits, ["no"], 20, 10)
    assert [(r["no"], r["state"]) for r in said.to_pylist()] == [(4, 3)]


def test_empty(spark, tmp_path):
    assert surplus(spark, write(spark, tmp_path / "t", [[]])) == []
