"""Lineage and point-in-time audit of the feature query itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.lineage_graph import TEMPLATES, LineageGraph
from lodestrata.queries import renewals as R
from lodestrata.queries.medallion import orders_store
from lodestrata.sources.tables import table

EVENTS = ("limit_events", "overage_charges", "support_tickets", "invoices", "subscription_events")
LABELS = ("outcome", "outcome_observed_on", "scheduled_at", "route", "churned")
EXCEPTIONS = ("renewals_completed", "first_renewal_after_change")
GOLD = "gold.renewal_features"


def lineage_graph(spark: SparkSession, d: str) -> LineageGraph:
    g = LineageGraph(spark)
    for t in (*EVENTS, "subscription_snapshots"):
        g.add_source(table(spark, d, t), t, t in EVENTS)
    features = R.features(spark, d)
    g.add_query(features, "renewal_features", ("as_of", "renewal_date"), EVENTS, LABELS, EXCEPTIONS)
    g.add_export("model_rows", ("sid", "plan_tier", *R.FEATURES), GOLD)
    for f in ("engagement_trend", "share_change"):
        g.add_assertion(f"{f} range", "export", f"export.model_rows.{f}", 0.0, 4.0 if f == "engagement_trend" else 3.0)
    g.add_assertion("overage_toggled_off flag", "gold", f"{GOLD}.overage_toggled_off", 0.0, 1.0)
    g.add_assertion("no label in export", "export", None)
    g.add_consumer("similar", [f"{GOLD}.{f}" for f in R.FEATURES])
    g.add_consumer("lapse_rate", [f"{GOLD}.{c}" for c in ("plan_tier", "churned", "limit_hits_14d", "route")])
    g.add_parameter("cut", str(R.CUT), "renewals", [f"{GOLD}.allowance_used_pct"])
    # what was published, by which run, from which snapshot
    store = orders_store(spark, d)
    g.add_run("nightly", "pipeline")
    g.add_run("ingest", "bronze_orders", "nightly")
    g.add_snapshots(store, "bronze_orders", "ingest")
    g.add_run("report", "daily_metrics", "nightly", [(e["snapshot_id"], "bronze_orders") for e in store.entries("bronze_orders")])
    return g


def lineage_reads(spark, d):
    return lineage_graph(spark, d).edges.where("rel in ('DERIVED_FROM', 'SHAPES')").select("src", "role", "dst")


def lineage_pit(spark, d):
    return lineage_graph(spark, d).ask("pit_features")


def lineage_windows(spark, d):
    return lineage_graph(spark, d).ask("pit_windows")


def lineage_rules(spark, d):
    """Rules found in the plan: a day that must lie so many days from another."""
    return lineage_graph(spark, d).ask("pit_rule")


def lineage_trace(spark, d):
    return lineage_graph(spark, d).trace("bronze.limit_events.hit_at", upstream=False)


def lineage_guards(spark, d):
    return lineage_graph(spark, d).unguarded()


def lineage_unused(spark, d):
    return lineage_graph(spark, d).unused("bronze")


def lineage_paths(spark, d):
    return lineage_graph(spark, d).ask("contract_gold_descendants", ["bronze.support_tickets.created_date"], 4).distinct().withColumn("path", F.array_join("path", " > "))


def lineage_templates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each of the lineage questions."""
    g = lineage_graph(spark, d)
    ids = [f"{GOLD}.limit_hits_14d", f"{GOLD}.overage_toggled_off", "bronze.limit_events.hit_at"]
    out = None
    for name in TEMPLATES:
        one = g.ask(name, ids).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("template"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (lineage_reads, lineage_pit, lineage_windows, lineage_rules, lineage_trace, lineage_guards, lineage_unused, lineage_paths, lineage_templates)}

_STATUS = {f: "compliant" for f in R.FEATURES} | dict.fromkeys(("sid", "renewal_id", "as_of", "renewal_date", "plan_tier", "started_at", "user_name", "city"), "as_of_row") | dict.fromkeys(LABELS, "label_side") | {"renewals_completed": "declared_exception", "first_renewal_after_change": "as_of_row"}
_CLAMPED = ("engagement_trend", "last_active_days_ago", "allowance_used_pct", "share_change")
_LENGTH = ("active_days_7d", "active_days_28d", "limit_hits_14d", "weekly_share_28d", "overage_usd_28d", "five_hour_share_90d", "paid_rate_90d", "failed_rate_90d", "support_tickets_90d", "ide_events_90d", "cli_events_90d", "weekend_usage_ratio")
#: Days back where a feature's window begins (None: from the start) and ends, by the feature list; other columns have none.
_BEGINS = {"engagement_trend": 28, "allowance_used_pct": 28, "weekend_usage_ratio": 28, "share_change": 56, "last_active_days_ago": None, "overage_toggled_off": None} | {f: int(f.rsplit("_", 1)[1][:-1]) for f in R.FEATURES if f[-1] == "d" and f.rsplit("_", 1)[1][:-1].isdigit()}
#: Columns that read the ledger of all event tables, and so whatever any of them has.
_FED = sorted({*_BEGINS, "renewals_completed", *LABELS})
_READ = {
    "limit_events": ("subscription_id", "hit_at", "limit_type"), "overage_charges": ("subscription_id", "charged_at", "amount_usd"), "support_tickets": ("subscription_id", "created_date"),
    "invoices": ("subscription_id", "invoice_date", "status"), "subscription_events": ("subscription_id", "event_date", "event_type"),
}


def _rows_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join(f"({', '.join(map(lit, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns.items())} FROM (VALUES {values}) AS t({', '.join(columns)})"


def _window_rows() -> list[tuple]:
    out = [(f"{GOLD}.{f}", "as_of", n, 0) for f, n in _BEGINS.items()]
    out += [(f"{GOLD}.{f}", "renewal_date", None, -R.SHOWS) for f in (*_BEGINS, "renewals_completed", "scheduled_at")]
    # labels: from the renewal day on; the route also asks what was scheduled, and cancelled after as_of
    return [*out, *((f"{GOLD}.{c}", "renewal_date", 1, -R.SHOWS) for c in ("outcome", "outcome_observed_on", "route", "churned")), (f"{GOLD}.route", "as_of", 0, 0)]


def _path_rows() -> list[tuple]:
    start, out = "bronze.support_tickets.created_date", []
    for c in _FED:
        ends = [f"export.model_rows.{c}", "consumer.similar"] if c in R.FEATURES else []
        ends += ["consumer.lapse_rate"] if c in ("churned", "limit_hits_14d", "route") else []
        out += [(start, f"{start} > {GOLD}.{c}", 1), *((start, f"{start} > {GOLD}.{c} > {e}", 2) for e in ends)]
    return out


def _unread() -> str:
    one = lambda t, cs: f"(table_name = '{t}' AND column_name NOT IN ({', '.join(map(repr, cs))}))"
    return " OR ".join(one(t, cs) for t, cs in _READ.items())


_ALL_COLUMNS = sorted({*_STATUS})
_CHECKED = ("engagement_trend", "share_change", "overage_toggled_off")
#: What an independent reading of the feature list says must be found.
ORACLE = {
    "lineage_pit": " UNION ALL ".join(f"SELECT '{GOLD}.{c}' AS id, '{c}' AS name, '{s}' AS status, '{'sql_clamp' if c in _CLAMPED else 'window_length' if c in _LENGTH else 'data_dependent'}' AS guarantee" for c, s in _STATUS.items()),
    "lineage_windows": _rows_sql({"id": "VARCHAR", "anchor": "VARCHAR", "begin_days": "INT", "end_days": "INT"}, _window_rows()),
    "lineage_rules": "SELECT 'day' AS name, 'period_end -7 days' AS detail",
    "lineage_trace": _rows_sql({"node": "VARCHAR", "depth": "INT"}, [("bronze.limit_events.hit_at", 0), *((f"{GOLD}.{c}", 1) for c in _FED), *((f"export.model_rows.{c}", 2) for c in _FED if c in R.FEATURES), ("consumer.similar", 2), ("consumer.lapse_rate", 2)]),
    "lineage_guards": _rows_sql({"id": "VARCHAR"}, [(f"{GOLD}.{c}",) for c in _ALL_COLUMNS if c not in _CHECKED]),
    "lineage_unused": f"SELECT 'bronze.' || table_name || '.' || column_name AS id, CAST(0 AS BIGINT) AS readers FROM information_schema.columns WHERE {_unread()}",
    "lineage_paths": _rows_sql({"start": "VARCHAR", "path": "VARCHAR", "hops": "INT"}, _path_rows()),
}
