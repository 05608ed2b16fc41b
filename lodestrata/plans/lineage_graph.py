"""Lineage as node and edge tables, and the questions asked of it, each as one SQL text over those tables.

Nodes: (id, label, layer, dataset, name, ordinal, status, low, high, guarantee, detail). Labels: Dataset, Column,
Window, Rule, Parameter, Assertion, Contract, Consumer, Snapshot, Ref, Run, Job.
Edges: (src, rel, dst, role, begin_days, end_days). A Column's id is layer.dataset.column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans.lineage import Lineage

NODE = "id string, label string, layer string, dataset string, name string, ordinal int, status string, low double, high double, guarantee string, detail string"
EDGE = "src string, rel string, dst string, role string, begin_days int, end_days int"

#: name -> SQL over {nodes} and {edges}; {ids} and {depth} are parameters.
TEMPLATES = {
    "count_nodes": "SELECT label, count(*) AS n FROM {nodes} GROUP BY label",
    "count_rels": "SELECT rel, count(*) AS n FROM {edges} GROUP BY rel",
    "column_by_ref": "SELECT * FROM {nodes} WHERE label = 'Column' AND id IN ({ids})",
    "column_refs": "SELECT id FROM {nodes} WHERE label = 'Column'",
    "trace_upstream_step": "SELECT e.src AS id, e.rel, e.role, e.dst AS source FROM {edges} e WHERE e.rel IN ('DERIVED_FROM', 'COUNTS_ROWS_OF') AND e.src IN ({ids})",
    "trace_downstream_step": "SELECT e.dst AS id, e.rel, e.role, e.src AS reader FROM {edges} e WHERE e.rel IN ('DERIVED_FROM', 'COUNTS_ROWS_OF') AND e.dst IN ({ids})",
    "trace_parameters": "SELECT e.src AS id, n.name, n.detail FROM {edges} e JOIN {nodes} n ON n.id = e.dst WHERE e.rel = 'USES' AND e.src IN ({ids})",
    "trace_consumers": "SELECT e.dst AS id, n.label, n.name FROM {edges} e JOIN {nodes} n ON n.id = e.src WHERE e.rel IN ('CHECKS', 'READS') AND e.dst IN ({ids})",
    "trace_contracts": "SELECT DISTINCT c.dst AS id, o.dst AS contract FROM {edges} c JOIN {edges} o ON o.src = c.src AND o.rel = 'BELONGS_TO' WHERE c.rel = 'CHECKS' AND c.dst IN ({ids})",
    "trace_export_consumers": "SELECT d.id AS export, n.name FROM {nodes} d JOIN {edges} e ON e.dst = concat('file.', d.dataset) AND e.rel = 'READS' JOIN {nodes} n ON n.id = e.src WHERE d.layer = 'export' AND d.id IN ({ids})",
    "pit_features": "SELECT id, name, status, guarantee FROM {nodes} WHERE label = 'Column' AND layer = 'gold' AND status IS NOT NULL",
    "pit_windows": "SELECT e.src AS id, w.detail AS anchor, e.begin_days, e.end_days FROM {edges} e JOIN {nodes} w ON w.id = e.dst WHERE e.rel = 'WINDOWED_BY'",
    "pit_rule": "SELECT name, detail FROM {nodes} WHERE label = 'Rule'",
    "pit_unbounded_reads": "SELECT e.src AS id, e.dst AS source FROM {edges} e JOIN {nodes} s ON s.id = e.dst AND s.status = 'event' WHERE e.rel = 'DERIVED_FROM' AND e.role = 'VALUE' AND NOT EXISTS (SELECT 1 FROM {edges} w WHERE w.src = e.src AND w.rel = 'WINDOWED_BY')",
    "pit_unbounded_rowcounts": "SELECT e.src AS id FROM {edges} e WHERE e.rel = 'COUNTS_ROWS_OF' AND NOT EXISTS (SELECT 1 FROM {edges} w WHERE w.src = e.src AND w.rel = 'WINDOWED_BY')",
    "guards_export_columns": "SELECT src AS export, dst AS id FROM {edges} WHERE rel = 'COPY_OF' AND dst IN ({ids})",
    "guards_assertions": "SELECT e.dst AS id, a.name, a.low, a.high FROM {edges} e JOIN {nodes} a ON a.id = e.src WHERE e.rel = 'CHECKS' AND e.dst IN ({ids})",
    "guards_same_rule": "SELECT a.id AS one, b.id AS other FROM {nodes} a JOIN {nodes} b ON a.label = 'Assertion' AND b.label = 'Assertion' AND a.name = b.name AND a.id <> b.id",
    "guards_checked_layers": "SELECT DISTINCT c.layer FROM {edges} e JOIN {nodes} c ON c.id = e.dst WHERE e.rel = 'CHECKS'",
    "guards_dataset_columns": "SELECT layer, dataset, ordinal, name FROM {nodes} WHERE label = 'Column'",
    "guards_value_checked_direct": "SELECT c.id FROM {nodes} c WHERE c.label = 'Column' AND EXISTS (SELECT 1 FROM {edges} e WHERE e.rel = 'CHECKS' AND e.dst = c.id)",
    "guards_value_checked_via_export": "SELECT DISTINCT k.dst AS id FROM {edges} k JOIN {edges} e ON e.rel = 'CHECKS' AND e.dst = k.src WHERE k.rel = 'COPY_OF'",
    "unused_columns": "SELECT c.id, count(e.src) AS readers FROM {nodes} c LEFT JOIN {edges} e ON e.dst = c.id AND e.rel IN ('DERIVED_FROM', 'READS', 'SHAPES') WHERE c.label = 'Column' AND c.layer <> 'export' GROUP BY c.id",
    "unused_graph_readers": "SELECT e.dst AS id, n.name FROM {edges} e JOIN {nodes} n ON n.id = e.src AND n.label = 'Consumer' WHERE e.rel = 'READS'",
    "contract_gold_columns": "SELECT c.id, count(DISTINCT v.dst) AS value_sources, count(DISTINCT o.dst) AS other_sources FROM {nodes} c LEFT JOIN {edges} v ON v.src = c.id AND v.rel = 'DERIVED_FROM' AND v.role = 'VALUE' LEFT JOIN {edges} o ON o.src = c.id AND o.rel = 'DERIVED_FROM' AND o.role <> 'VALUE' WHERE c.label = 'Column' AND c.layer = 'gold' GROUP BY c.id",
    "contract_counts_rows_of": "SELECT src, dst FROM {edges} WHERE rel = 'COUNTS_ROWS_OF'",
    "contract_ranges": "SELECT e.dst AS id, a.low, a.high, c.guarantee FROM {edges} e JOIN {nodes} a ON a.id = e.src JOIN {nodes} c ON c.id = e.dst WHERE e.rel = 'CHECKS' AND a.low IS NOT NULL",
    "contract_leaky": "SELECT a.id, a.name FROM {nodes} a LEFT JOIN {edges} e ON e.src = a.id AND e.rel = 'CHECKS' WHERE a.label = 'Assertion' AND e.dst IS NULL",
    "contract_parameters": "SELECT name, count(DISTINCT detail) AS forms, max(detail) AS detail FROM {nodes} WHERE label = 'Parameter' GROUP BY name",
    "contract_feature_reads": "SELECT src AS id, role, dst AS source FROM {edges} WHERE rel = 'DERIVED_FROM' UNION SELECT src, 'ROWCOUNT', dst FROM {edges} WHERE rel = 'COUNTS_ROWS_OF'",
    "contract_gold_descendants": "WITH RECURSIVE p(start, node, path, hops) AS (SELECT dst, src, array(dst, src), 1 FROM {edges} WHERE rel IN ('DERIVED_FROM', 'COPY_OF', 'READS') AND dst IN ({ids}) UNION ALL SELECT p.start, e.src, array_append(p.path, e.src), p.hops + 1 FROM p JOIN {edges} e ON e.dst = p.node AND e.rel IN ('DERIVED_FROM', 'COPY_OF', 'READS') WHERE p.hops < {depth}) SELECT start, path, hops FROM p",
    "contract_subgraph_edges": "SELECT count(*) AS edges, count(DISTINCT dst) AS sources FROM {edges} WHERE rel = 'DERIVED_FROM'",
    "contract_subgraph_rowcounts": "SELECT count(*) AS edges FROM {edges} WHERE rel = 'COUNTS_ROWS_OF'",
    "contract_window_usage": "SELECT e.dst AS window, count(*) AS uses FROM {edges} e WHERE e.rel = 'WINDOWED_BY' GROUP BY e.dst",
    "contract_bridge": "SELECT c.id AS consumer, count(DISTINCT r.dst) AS columns, count(DISTINCT d.dst) AS sources, count(DISTINCT s.dataset) AS tables FROM {nodes} c LEFT JOIN {edges} r ON r.src = c.id AND r.rel = 'READS' LEFT JOIN {edges} d ON d.src = r.dst AND d.rel = 'DERIVED_FROM' LEFT JOIN {nodes} s ON s.id = d.dst WHERE c.label = 'Consumer' GROUP BY c.id",
    "contract_tier_snapshots": "SELECT s.dataset, s.id, s.ordinal FROM {nodes} s WHERE s.label = 'Snapshot'",
    "contract_tier_supersedes": "SELECT id, lag(id) OVER (PARTITION BY dataset ORDER BY ordinal) AS supersedes FROM {nodes} WHERE label = 'Snapshot'",
    "contract_tier_refs": "SELECT r.name, r.status AS kind, e.dst AS snapshot FROM {nodes} r LEFT JOIN {edges} e ON e.src = r.id AND e.rel = 'NAMES' WHERE r.label = 'Ref'",
    "contract_tier_runs": "SELECT r.id, e.dst AS job FROM {nodes} r LEFT JOIN {edges} e ON e.src = r.id AND e.rel = 'RUN_OF' WHERE r.label = 'Run'",
    "contract_tier_parents": "SELECT a.src AS run, a.dst AS parent, b.dst AS root FROM {edges} a LEFT JOIN {edges} b ON b.src = a.dst AND b.rel = 'PARENT' WHERE a.rel = 'PARENT'",
    "contract_tier_produced": "SELECT src AS snapshot, dst AS run FROM {edges} WHERE rel = 'PRODUCED_BY'",
    "contract_tier_consumed": "SELECT src AS run, dst AS snapshot, role FROM {edges} WHERE rel = 'CONSUMED'",
}


class LineageGraph:
    """Collects facts on the driver (code-sized, not data-sized) and answers by SQL."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._nodes: dict[str, tuple] = {}
        self._edges: set[tuple] = set()

    def node(self, id_: str, label: str, layer=None, dataset=None, name=None, ordinal=None, status=None, low=None, high=None, guarantee=None, detail=None) -> str:
        self._nodes[id_] = (id_, label, layer, dataset, name, ordinal, status, low, high, guarantee, detail)
        return id_

    def edge(self, src: str, rel: str, dst: str, role: str | None = None, begin: int | None = None, end: int | None = None) -> None:
        self._edges.add((src, rel, dst, role, begin, end))

    def add_source(self, df: DataFrame, dataset: str, events: bool, layer: str = "bronze") -> None:
        self.node(f"{layer}.{dataset}", "Dataset", layer, dataset, dataset)
        for i, c in enumerate(df.columns):
            self.node(f"{layer}.{dataset}.{c}", "Column", layer, dataset, c, i, "event" if events else None)

    def add_query(self, df: DataFrame, dataset: str, anchors: Iterable[str], events: Iterable[str], labels: Iterable[str] = (), exceptions: Iterable[str] = (), layer: str = "gold") -> Lineage:
        """Columns, reads, windows and point-in-time status of a query, from its plan."""
        found = Lineage(df, tuple(anchors))
        status, safe = dict(found.audit(events, labels, exceptions)), dict(found.guarantees())
        self.node(f"{layer}.{dataset}", "Dataset", layer, dataset, dataset)
        for i, c in enumerate(df.columns):
            self.node(f"{layer}.{dataset}.{c}", "Column", layer, dataset, c, i, status[c], guarantee=safe[c])
        for c, role, t, s in found.reads():
            if role == "ROWCOUNT":
                self.edge(f"{layer}.{dataset}.{c}", "COUNTS_ROWS_OF", f"{layer}.{dataset}", role)
            elif c == "*":
                self.edge(f"{layer}.{dataset}", "SHAPES", f"bronze.{t}.{s}", role)
            else:
                self.edge(f"{layer}.{dataset}.{c}", "DERIVED_FROM", f"bronze.{t}.{s}", role)
        for c, anchor, begin, end in found.windows():
            w = self.node(f"window.{anchor}.{begin}.{end}", "Window", detail=anchor)
            self.edge(f"{layer}.{dataset}.{c}", "WINDOWED_BY", w, None, begin, end)
        for a, b, n in sorted(found.rules):
            self.node(f"rule.{a}.{b}", "Rule", name=a, detail=f"{b} {n:+d} days")
        return found

    def add_export(self, dataset: str, columns: Iterable[str], of: str) -> None:
        for i, c in enumerate(columns):
            self.node(f"export.{dataset}.{c}", "Column", "export", dataset, c, i)
            self.edge(f"export.{dataset}.{c}", "COPY_OF", f"{of}.{c}")

    def add_assertion(self, name: str, contract: str, column: str | None, low: float | None = None, high: float | None = None) -> None:
        self.node(f"contract.{contract}", "Contract", name=contract)
        a = self.node(f"assertion.{contract}.{name}", "Assertion", name=name, low=low, high=high)
        self.edge(a, "BELONGS_TO", f"contract.{contract}")
        if column:
            self.edge(a, "CHECKS", column)

    def add_consumer(self, name: str, columns: Iterable[str]) -> None:
        c = self.node(f"consumer.{name}", "Consumer", name=name)
        for x in columns:
            self.edge(c, "READS", x)

    def add_parameter(self, name: str, value: str, where: str, columns: Iterable[str] = ()) -> None:
        p = self.node(f"parameter.{where}.{name}", "Parameter", name=name, detail=value)
        for c in columns:
            self.edge(c, "USES", p)

    def add_snapshots(self, store, table: str, run: str | None = None) -> None:
        """A table's snapshot log and refs; ``run`` produced its newest snapshot."""
        entries = store.entries(table)
        for e in entries:
            self.node(f"snapshot.{e['snapshot_id']}", "Snapshot", dataset=table, ordinal=e["sequence"])
        for r in store.refs(table).collect():  # a row per tag
            self.node(f"ref.{table}.{r.name}", "Ref", dataset=table, name=r.name, status=r.type)
            self.edge(f"ref.{table}.{r.name}", "NAMES", f"snapshot.{r.snapshot_id}")
        if run and entries:
            self.edge(f"snapshot.{entries[-1]['snapshot_id']}", "PRODUCED_BY", f"run.{run}")

    def add_run(self, run: str, job: str, parent: str | None = None, consumed: Iterable[tuple[str, str]] = ()) -> None:
        self.node(f"job.{job}", "Job", name=job)
        self.node(f"run.{run}", "Run", name=run)
        self.edge(f"run.{run}", "RUN_OF", f"job.{job}")
        if parent:
            self.edge(f"run.{run}", "PARENT", f"run.{parent}")
        for snapshot, role in consumed:
            self.edge(f"run.{run}", "CONSUMED", f"snapshot.{snapshot}", role)

    @property
    def nodes(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._nodes.values()), NODE)

    @property
    def edges(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._edges, key=str), EDGE)

    def ask(self, template: str, ids: Iterable[str] = (), depth: int = 4) -> DataFrame:
        listed = ", ".join("'" + i.replace("'", "''") + "'" for i in ids) or "NULL"
        text = TEMPLATES[template].replace("{ids}", listed).replace("{depth}", str(int(depth)))
        return self.spark.sql(text, nodes=self.nodes, edges=self.edges)

    def trace(self, id_: str, upstream: bool = True, depth: int = 6) -> DataFrame:
        """(id, depth) reached from a column, up or down, with the least number of steps."""
        from lodestrata.operators.graph import reach

        links = self.edges.where("rel in ('DERIVED_FROM', 'COUNTS_ROWS_OF', 'COPY_OF', 'READS')")
        start = self.spark.createDataFrame([(id_,)], "node string")
        found = reach(links, start, depth, *(("src", "dst") if upstream else ("dst", "src")))
        return found.select("node", "depth")

    def guards(self, id_: str) -> DataFrame:
        """Assertions on a column or on its export copies."""
        copies = [r.export for r in self.ask("guards_export_columns", [id_]).collect()]
        return self.ask("guards_assertions", [id_, *copies])

    def unguarded(self, layer: str = "gold") -> DataFrame:
        checked = self.ask("guards_value_checked_direct").union(self.ask("guards_value_checked_via_export"))
        return self.nodes.where(f"label = 'Column' and layer = '{layer}'").select("id").join(checked.distinct(), "id", "left_anti")

    def unused(self, layer: str) -> DataFrame:
        return self.ask("unused_columns").where(f"readers = 0 and id like '{layer}.%'")
