"""Versioned Parquet tables: snapshots, time travel, tags that never move, merges, an idempotent publish log."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_SCHEMA = "sequence bigint, snapshot_id string, parent_id string, committed_at double, operation string, summary map<string,string>"
REF_SCHEMA = "name string, type string, snapshot_id string"


class Conflict(RuntimeError):
    """Another writer took the sequence number, or a tag exists with another snapshot."""


class SnapshotStore:
    """Tables below one root folder of any Hadoop file system.

    ``<table>/data/__commit=<id>/`` holds immutable Parquet of one commit, ``<table>/log/<sequence>.json`` a snapshot:
    the data folders that make it up with their row counts, its schema and summary; ``<table>/ids/<id>`` names a
    snapshot's sequence. A log entry is created exclusively, so of two writers one fails and nothing is half visible;
    the file system must refuse to create a file that exists (HDFS, local disks, object stores with conditional writes).
    The driver reads the one entry it needs; the log as a table is read by Spark. Every entry is whole, so a log of any
    length needs no replay. Deletes, updates and merges rewrite only the folders that hold a row they change.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}" if rest else self.root)

    def _create(self, rest: str, text: str) -> None:
        try:
            stream = self._fs.create(self._path(rest), False)
        except Exception as e:
            raise Conflict(f"{rest} exists") from e
        stream.write(bytearray(text.encode()))
        stream.close()

    def _read(self, rest: str) -> str:
        stream = self._fs.open(self._path(rest))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _names(self, rest: str) -> list[str]:
        path = self._path(rest)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def entries(self, table: str) -> list[dict]:
        """All snapshots of a table, oldest first."""
        return [json.loads(self._read(f"{table}/log/{n}")) for n in self._names(f"{table}/log") if n.endswith(".json")]

    def current(self, table: str) -> dict:
        names = [n for n in self._names(f"{table}/log") if n.endswith(".json")]
        if not names:
            raise LookupError(f"no snapshot of {table}")
        return json.loads(self._read(f"{table}/log/{names[-1]}"))

    def commit(self, table: str, df: DataFrame, mode: str = "append", summary: dict[str, str] | None = None, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), keep: Sequence[str] | None = None) -> str:
        """Write ``df`` as a new snapshot: appended to the current one, or replacing it. Returns its id. keep: the folders of
        the current snapshot that stay (all of them for ``append``, none for ``replace``)."""
        names = [n for n in self._names(f"{table}/log") if n.endswith(".json")]
        parent = json.loads(self._read(f"{table}/log/{names[-1]}")) if names else None
        snapshot = uuid.uuid4().hex
        folder = f"{table}/data/__commit={snapshot}"
        before = {f: n for f, n in (parent["counts"] if parent else {}).items() if (mode == "append" if keep is None else f in keep)}
        if before:  # folders that are read together are laid out alike
            if partition_by and list(partition_by) != parent["partition_by"]:
                raise ValueError(f"{table} is partitioned by {parent['partition_by']}")
            partition_by = parent["partition_by"]
        rows = df.sortWithinPartitions(*sort_by) if sort_by else df
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.root}/{folder}")
        added = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").count()  # from the footers
        counts = before | {folder: added}
        entry = {
            "sequence": parent["sequence"] + 1 if parent else 1, "snapshot_id": snapshot, "parent_id": parent["snapshot_id"] if parent else None, "committed_at": time.time(),
            "operation": mode, "counts": counts, "partition_by": list(partition_by), "schema": df.schema.jsonValue(), "rows": sum(counts.values()),
            "summary": {"added-records": str(added), "total-records": str(sum(counts.values())), "data-folders": str(len(counts)), **(summary or {})},
        }
        self._create(f"{table}/ids/{snapshot}", str(entry["sequence"]))
        self._create(f"{table}/log/{entry['sequence']:010d}.json", json.dumps(entry))
        return snapshot

    def create_as(self, table: str, text: str, **commit) -> str:
        """A table made of a query's rows (``CREATE OR REPLACE TABLE ... AS``)."""
        return self.commit(table, self.spark.sql(text), "replace", **commit)

    def tables(self, namespace: str = "") -> list[str]:
        """Tables below a namespace (a folder path), by name."""
        return [n for n in self._names(namespace) if self._names(f"{namespace}/{n}/log" if namespace else f"{n}/log")]

    def drop(self, table: str) -> bool:
        """The table with all its snapshots and data; whether there was one."""
        return bool(self._fs.delete(self._path(table), True))

    def _entry(self, table: str, version: str | int | None, tag: str | None) -> dict:
        if tag is not None:
            version = next((r["snapshot_id"] for r in self._refs(table) if r["name"] == tag), None)
            if version is None:
                raise LookupError(f"{table} has no tag {tag}")
        if version is None:
            return self.current(table)
        try:
            sequence = version if isinstance(version, int) else int(self._read(f"{table}/ids/{version}"))
            entry = json.loads(self._read(f"{table}/log/{sequence:010d}.json"))
        except Exception as e:
            raise LookupError(f"{table} has no snapshot {version}") from e
        if version not in (entry["snapshot_id"], entry["sequence"]):  # a writer that lost the sequence left its id behind
            raise LookupError(f"{table} has no snapshot {version}")
        return entry

    def read(self, table: str, version: str | int | None = None, tag: str | None = None, expect_rows: int | None = None) -> DataFrame:
        """The table now, at a snapshot id or sequence number, or at a tag. Never falls back to another version.

        expect_rows: refuse unless the snapshot's recorded row count is this.
        """
        e = self._entry(table, version, tag)
        if expect_rows is not None and e["rows"] != expect_rows:
            raise ValueError(f"{table} at {e['snapshot_id']} has {e['rows']} rows, not {expect_rows}")
        return self._scan(e, list(e["counts"]))

    def verify(self, table: str, version: str | int | None = None) -> int:
        """The rows of the data itself; an error unless every folder has what the log recorded of it."""
        e = self._entry(table, version, None)
        found = self._files(StructType.fromJson(e["schema"]), list(e["counts"])).groupBy(F.regexp_extract("_metadata.file_path", r"/(__commit=[0-9a-f]{32})/", 1).alias("f")).agg(F.count(F.lit(1)).alias("n")) if e["counts"] else None
        have = {r.f: r.n for r in found.collect()} if found is not None else {}  # a row per commit
        bad = {f: (n, have.get(f.rsplit("/", 1)[1], 0)) for f, n in e["counts"].items() if have.get(f.rsplit("/", 1)[1], 0) != n}
        if bad:
            raise ValueError(f"{table} at {e['snapshot_id']}: recorded and found rows differ: {bad}")
        return e["rows"]

    def _scan(self, entry: dict, folders: Sequence[str]) -> DataFrame:
        """One scan over all folders."""
        schema = StructType.fromJson(entry["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self._files(schema, folders).select(*(F.col(f"`{c}`") for c in schema.names))

    def _files(self, schema: StructType, folders: Sequence[str]) -> DataFrame:
        base = f"{self.root}/{folders[0].rsplit('/', 1)[0]}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{self.root}/{f}" for f in folders))

    def rows(self, table: str, version: str | int | None = None) -> int:
        """The row count, from the log alone."""
        return self._entry(table, version, None)["rows"]

    def snapshots(self, table: str) -> DataFrame:
        """The log as a table: sequence, snapshot_id, parent_id, committed_at, operation, summary."""
        if not self._names(f"{table}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.root}/{table}/log")

    def _refs(self, table: str) -> list[dict]:
        tags = [json.loads(self._read(f"{table}/refs/{n}")) for n in self._names(f"{table}/refs") if n.endswith(".json")]
        names = self._names(f"{table}/log")
        main = [{"name": "main", "type": "BRANCH", "snapshot_id": self.current(table)["snapshot_id"]}] if names else []
        return main + tags

    def refs(self, table: str) -> DataFrame:
        """Branch ``main`` and all tags: name, type, snapshot_id."""
        return self.spark.createDataFrame([(r["name"], r["type"], r["snapshot_id"]) for r in self._refs(table)], REF_SCHEMA)

    def tag(self, table: str, name: str, version: str | int | None = None) -> str:
        """Name a snapshot for good. Naming it again is a no-op; naming another one so is a conflict."""
        snapshot = self._entry(table, version, None)["snapshot_id"]
        try:
            self._create(f"{table}/refs/{name}.json", json.dumps({"name": name, "type": "TAG", "snapshot_id": snapshot}))
        except Conflict:
            have = next(r["snapshot_id"] for r in self._refs(table) if r["name"] == name)
            if have != snapshot:
                raise Conflict(f"tag {name} of {table} is {have}, not {snapshot}") from None
        return snapshot

    def pin(self, tables: Sequence[str], prefix: str = "") -> dict[str, str]:
        """Read each table at its current snapshot and register it as a temp view; returns the ids pinned."""
        pinned = {}
        for t in tables:
            pinned[t] = self.current(t)["snapshot_id"]
            self.read(t, pinned[t]).createOrReplaceTempView(f"{prefix}{t}")
        return pinned

    def _rewrite(self, table: str, touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], dml: str) -> str:
        """A new snapshot in which the folders that hold a row of ``touched`` are replaced by ``change`` of their rows."""
        entry = self.current(table)
        schema = StructType.fromJson(entry["schema"])
        every = list(entry["counts"])
        hit = set()
        if every:
            marked = self._files(schema, every).withColumn("__folder", F.regexp_extract("_metadata.file_path", r"/(__commit=[0-9a-f]{32})/", 1))
            names = {r[0] for r in touched(marked).select("__folder").distinct().collect()}  # a row per commit at most
            hit = {f for f in every if f.rsplit("/", 1)[1] in names}
        rows = change(self._scan(entry, [f for f in every if f in hit]))
        return self.commit(table, rows.select(*(F.col(f"`{c}`") for c in schema.names)), "replace", {"dml": dml, "rewritten-folders": str(len(hit))}, entry["partition_by"], keep=[f for f in every if f not in hit])

    def delete(self, table: str, where: Column | None = None) -> str:
        """Rows for which ``where`` holds go (all without one), as a new snapshot."""
        gone = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        return self._rewrite(table, lambda rows: rows.where(gone), lambda rows: rows.where(~gone), "delete")

    def update(self, table: str, where: Column, values: dict[str, Column]) -> str:
        def change(rows: DataFrame) -> DataFrame:
            return rows.withColumns({c: F.when(where, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})

        return self._rewrite(table, lambda rows: rows.where(where), change, "update")

    def merge(self, table: str, source: DataFrame, keys: Sequence[str], delete_when: str | None = None) -> str:
        """Upsert: source rows replace those of equal key, new keys are added; a source row for which
        ``delete_when`` (an expression over source columns) holds removes its key. Keys unique in the source."""
        fresh = source if delete_when is None else source.where(f"not coalesce({delete_when}, false)")
        known = source.select(*keys)
        return self._rewrite(table, lambda rows: rows.join(known, list(keys), "left_semi"), lambda rows: rows.join(known, list(keys), "left_anti").select(rows.columns).unionByName(fresh.select(rows.columns)), "merge")

    def compact(self, table: str, sort_by: Sequence[str] = ()) -> str:
        """The current rows in one folder, as a new snapshot; older snapshots keep theirs."""
        entry = self.current(table)
        return self.commit(table, self.read(table), "replace", {"dml": "compact"}, entry["partition_by"], sort_by)

    def publish(self, manifest: str, inputs: dict[str, str], code: Sequence[str], build: Callable[[], dict[str, DataFrame]], partition_by: dict[str, Sequence[str]] | None = None) -> tuple[str, bool]:
        """Build and publish tables once per (input snapshots, code): returns (build id, whether it was built).

        The id is a hash of both; a build already in the manifest writes nothing. Outputs are replaced, tagged
        with the id and only then recorded, with their row counts.
        """
        text = json.dumps({"inputs": inputs, "code": [hashlib.sha256(c.encode()).hexdigest() for c in code]}, sort_keys=True)
        build_id = hashlib.sha256(text.encode()).hexdigest()[:12]
        if self._names(f"{manifest}/log") and not self.read(manifest).where(F.col("build_id") == build_id).isEmpty():
            return build_id, False
        parts = {}
        for name, df in build().items():
            snapshot = self.commit(name, df, "replace", {"build": build_id}, (partition_by or {}).get(name, ()))
            self.tag(name, f"build-{build_id}", snapshot)
            parts[name] = {"snapshot_id": snapshot, "rows": self.rows(name, snapshot)}
        row = [(build_id, time.time(), json.dumps(inputs, sort_keys=True), json.dumps(parts, sort_keys=True))]
        self.commit(manifest, self.spark.createDataFrame(row, "build_id string, published_at double, inputs string, parts string"), "append")
        return build_id, True

    def newest(self, manifest: str, table: str) -> DataFrame:
        """A table as of the newest publish, at its tag, with its recorded row count verified."""
        row = self.read(manifest).orderBy(F.desc("published_at"), "build_id").limit(1).first()
        if row is None:
            raise LookupError(f"nothing published in {manifest}")
        return self.read(table, tag=f"build-{row.build_id}", expect_rows=json.loads(row.parts)[table]["rows"])
