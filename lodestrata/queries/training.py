"""The queries p1_ to p7_ over the renewal and retail tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.cleaning import clean_key, clean_word, day_text
from lodestrata.operators.asof import as_known
from lodestrata.operators.diff import differences
from lodestrata.operators.feature_table import feature_table
from lodestrata.operators.history import attribute_history
from lodestrata.operators.orphans import Parent, Reference, orphan_references
from lodestrata.operators.rolling import rolling_totals
from lodestrata.sources.tables import path_of, table
from lodestrata.streaming.dedupe import surplus_deliveries

# An event type is one of these subjects and one of these verbs, or one of the single types.
SUBJECTS = ("agent_task", "api_token", "card", "cli", "coupon", "ide", "index", "invoice_copy", "model_pick", "overage", "profile", "review", "rule_file", "seat", "session", "snippet", "team", "trial", "webhook", "workspace")
VERBS = ("added", "closed", "denied", "expired", "exported", "opened", "paired", "removed", "renamed", "restored", "shared", "viewed")
SINGLE_TYPES = ("cancel_scheduled", "canceled")
LIMIT_TYPES = ("five_hour", "weekly")
INVOICE_STATUS = ("paid", "failed")
#: Money is summed in millionths of a dollar as whole numbers: exact, and the same in any order.
MICRO = 1_000_000

EVENT_KINDS = [f"event_{t}" for t in (*(f"{s}_{v}" for s in SUBJECTS for v in VERBS), *SINGLE_TYPES, "untyped")]
LIMIT_KINDS = [f"limit_{t}" for t in (*LIMIT_TYPES, "untyped")]
INVOICE_KINDS = [f"invoice_{t}" for t in (*INVOICE_STATUS, "untyped")]


def _micro(c: str):
    return F.round(F.col(c) * MICRO).cast("bigint")


def p1_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = clean_key("subscription_id").alias("subscription_id")
    charges = (
        table(spark, sf_dir, "overage_charges")
        .select("charge_no", sid, F.col("charged_at").alias("day"), _micro("amount_usd").alias("amount_usd"))
        .where("subscription_id is not null and day is not null")
        .groupBy("charge_no", "subscription_id", "day")
        .agg(F.max("amount_usd").alias("amount_usd"))
        .select("subscription_id", "day", "amount_usd", F.lit(0).cast("bigint").alias("hits"))
    )
    hits = (
        table(spark, sf_dir, "limit_events")
        .select("hit_no", sid, F.col("hit_at").cast("date").alias("day"))
        .where("subscription_id is not null and day is not null")
        .distinct()
        .select("subscription_id", "day", F.lit(None).cast("bigint").alias("amount_usd"), F.lit(1).cast("bigint").alias("hits"))
    )
    rolled = rolling_totals(charges.unionByName(hits), "subscription_id", "day", {"amount_usd": "sum", "hits": "sum"}, (7, 30), text_days=True)
    dollars = {w: (F.col(f"amount_usd_{w}d") / MICRO) for w in (7, 30)}
    return rolled.select("subscription_id", "day", *(c for w, x in dollars.items() for c in (x.alias(f"amount_usd_{w}d"), (x / w).alias(f"amount_usd_avg_{w}d"), F.col(f"hits_{w}d"))))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = {c: F.col(c) for c in ("order_ts", "_ingested_at", "_source_file")}
    return surplus_deliveries(spark, path_of(sf_dir, "orders_day2"), "delivery_no", clean_key("order_id"), order, F.col("order_ts"))


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = attribute_history(
        table(spark, sf_dir, "subscription_snapshots"),
        clean_key("subscription_id"),
        F.col("snapshot_date"),
        {"plan_tier": clean_word("plan_tier"), "status": clean_key("status")},
        [F.col("_ingested_at").alias("_ingested_at"), F.col("snapshot_no").alias("snapshot_no")],
        "subscription_id",
    )
    return history.select("subscription_id", "plan_tier", "status", *(day_text(c).alias(c) for c in ("valid_from", "valid_to", "last_seen")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_history(spark, sf_dir).select("subscription_id", "valid_from")


def _as_known(spark: SparkSession, sf_dir: str, keep: dict, wide: dict) -> DataFrame:
    events = table(spark, sf_dir, "subscription_events").where("event_date is not null")
    events = events.select("event_no", clean_key("subscription_id").alias("subscription_id"), "event_date", *(c.alias(n) for n, c in keep.items())).distinct()
    plan, status = clean_word("plan_tier"), clean_key("status")
    return as_known(
        events,
        F.col("subscription_id"),
        F.col("event_date"),
        {c: F.col(c) for c in ("event_no", *(["subscription_id", "event_date"] if wide else []), *keep)},
        table(spark, sf_dir, "subscription_snapshots").where(plan.isNotNull() & status.isNotNull()),
        clean_key("subscription_id"),
        F.col("snapshot_date"),
        F.col("_ingested_at").cast("date"),
        {"_ingested_at": F.col("_ingested_at"), "snapshot_no": F.col("snapshot_no")},
        wide,
    ).drop("_ingested_at")


def p4_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, with the plan and status known on its day."""
    wide = {"plan_tier": clean_word("plan_tier"), "status": clean_key("status")}
    return _as_known(spark, sf_dir, {"event_type": clean_word("event_type")}, wide).withColumn("event_date", day_text("event_date"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_known(spark, sf_dir, {}, {})


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = clean_key("subscription_id")
    gone = F.when(clean_key("status") == "deleted", F.col("snapshot_date"))
    return orphan_references(
        [
            Reference("orders_day2", table(spark, sf_dir, "orders_day2"), "customer", clean_key("customer_id"), F.col("order_ts")),
            Reference("support_tickets", table(spark, sf_dir, "support_tickets"), "subscription", sid, F.col("created_date")),
            Reference("invoices", table(spark, sf_dir, "invoices"), "subscription", sid, F.col("invoice_date")),
        ],
        [
            Parent("customer", table(spark, sf_dir, "customers"), clean_key("customer_id"), F.col("signup_date"), F.col("deleted_on")),
            Parent("subscription", table(spark, sf_dir, "subscription_snapshots"), sid, F.col("snapshot_date"), gone),
        ],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_report(spark, sf_dir).select("table_name", "period", "ref_key").distinct()


def p6_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = clean_key("subscription_id").alias("subscription_id")
    none = F.lit(None).cast("bigint")

    def records(name: str, number: str, prefix: str, kind, day: str, amount) -> DataFrame:
        tagged = F.concat(F.lit(f"{prefix}_"), F.coalesce(kind, F.lit("untyped")))
        rows = table(spark, sf_dir, name).select(F.col(number).alias("number"), sid, tagged.alias("kind"), F.col(day).cast("date").alias("day"), amount.alias("amount"))
        return rows.where("subscription_id is not null")

    # a record that arrives twice is the same once keys and words are clean, so equal rows are one record
    every = (
        records("subscription_events", "event_no", "event", clean_word("event_type"), "event_date", none)
        .unionByName(records("limit_events", "hit_no", "limit", clean_word("limit_type"), "hit_at", none))
        .unionByName(records("invoices", "invoice_no", "invoice", clean_key("status"), "invoice_date", _micro("amount_usd")))
        .distinct()
    )
    wide = feature_table(every, "subscription_id", "kind", "day", "amount", [*EVENT_KINDS, *LIMIT_KINDS, *INVOICE_KINDS], INVOICE_KINDS)
    money = {f"{k}_total": F.col(f"{k}_total") / MICRO for k in INVOICE_KINDS}
    dates = {c: day_text(c) for c in wide.columns if c.endswith("_last")}
    return wide.withColumns(money | dates)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"shop_id": clean_key("shop_id"), "order_date": day_text("order_date")}
    # the last bits of a sum must not decide: the limit is a hair below the named 0.005
    near = 0.005 - 1e-9
    fields = {"revenue": near, "avg_order_value": near, "orders": near, "cancelled_orders": near, "refunded_orders": near}
    return differences(table(spark, sf_dir, "gold_daily_metrics"), table(spark, sf_dir, "gold_daily_metrics_replica"), keys, fields, ("gold", "replica"))


QUERIES = {f.__name__: f for f in (p1_rolling_totals, p2_found, p3_found, p3_history, p4_found, p4_as_known, p5_found, p5_report, p6_feature_table, p7_found)}

_KEY = "nullif(lower(trim({0})), '')"
_WORD = "translate(nullif(lower(trim({0})), ''), ' -', '__')"


def _key(c: str) -> str:
    return _KEY.format(c)


def _word(c: str) -> str:
    return _WORD.format(c)


_P1 = f"""
WITH c AS (SELECT {_key('subscription_id')} AS s, charged_at AS d, max(CAST(round(amount_usd * {MICRO}) AS BIGINT)) AS a FROM overage_charges WHERE charged_at IS NOT NULL GROUP BY charge_no, 1, 2),
h AS (SELECT DISTINCT hit_no, {_key('subscription_id')} AS s, CAST(hit_at AS DATE) AS d FROM limit_events WHERE hit_at IS NOT NULL),
a AS (SELECT s, d, sum(a) AS a, sum(n) AS n FROM (SELECT s, d, a, 0 AS n FROM c UNION ALL SELECT s, d, NULL, 1 FROM h) WHERE s IS NOT NULL GROUP BY s, d),
g AS (SELECT s, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM a GROUP BY s),
f AS (SELECT g.s, g.d, coalesce(a.a, 0) AS a, coalesce(a.n, 0) AS n FROM g LEFT JOIN a ON g.s = a.s AND g.d = a.d),
w AS (SELECT s, d,
  CAST(sum(a) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / {MICRO} AS a7,
  CAST(sum(n) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS n7,
  CAST(sum(a) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS DOUBLE) / {MICRO} AS a30,
  CAST(sum(n) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS n30 FROM f)
SELECT s AS subscription_id, strftime(d, '%Y-%m-%d') AS "day", a7 AS amount_usd_7d, a7 / 7 AS amount_usd_avg_7d, n7 AS hits_7d, a30 AS amount_usd_30d, a30 / 30 AS amount_usd_avg_30d, n30 AS hits_30d FROM w"""

_P2 = f"""
SELECT delivery_no FROM (SELECT delivery_no, row_number() OVER (PARTITION BY {_key('order_id')} ORDER BY order_ts DESC NULLS LAST, _ingested_at DESC NULLS LAST, _source_file DESC NULLS LAST, delivery_no DESC) AS r
FROM orders_day2 WHERE {_key('order_id')} IS NOT NULL) WHERE r > 1"""

_P3 = f"""
WITH s AS (SELECT {_key('subscription_id')} AS s, snapshot_date AS d, {_word('plan_tier')} AS p, {_key('status')} AS t, _ingested_at AS i, snapshot_no AS n FROM subscription_snapshots),
k AS (SELECT s, d, p, t FROM s WHERE s IS NOT NULL AND d IS NOT NULL AND p IS NOT NULL AND t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s, d ORDER BY i DESC NULLS LAST, n DESC) = 1),
c AS (SELECT *, coalesce(p <> lag(p) OVER w OR t <> lag(t) OVER w, TRUE) AS fresh FROM k WINDOW w AS (PARTITION BY s ORDER BY d)),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY s ORDER BY d) AS v FROM c),
v AS (SELECT s, v, any_value(p) AS p, any_value(t) AS t, min(d) AS a, max(d) AS z FROM g GROUP BY s, v)
SELECT s AS subscription_id, p AS plan_tier, t AS status, strftime(a, '%Y-%m-%d') AS valid_from, strftime(CAST(lead(a) OVER (PARTITION BY s ORDER BY a) - INTERVAL 1 DAY AS DATE), '%Y-%m-%d') AS valid_to, strftime(z, '%Y-%m-%d') AS last_seen FROM v"""

_P4 = f"""
WITH e AS (SELECT event_no, any_value({_key('subscription_id')}) AS s, any_value({_word('event_type')}) AS y, any_value(event_date) AS d FROM subscription_events WHERE event_date IS NOT NULL GROUP BY event_no),
f AS (SELECT {_key('subscription_id')} AS s, snapshot_date AS d, CAST(_ingested_at AS DATE) AS k, _ingested_at AS i, snapshot_no, {_word('plan_tier')} AS p, {_key('status')} AS t FROM subscription_snapshots)
SELECT e.event_no, e.s AS subscription_id, e.y AS event_type, strftime(e.d, '%Y-%m-%d') AS event_date, f.snapshot_no, f.p AS plan_tier, f.t AS status
FROM e JOIN f ON e.s = f.s AND f.d <= e.d AND f.k <= e.d WHERE f.p IS NOT NULL AND f.t IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY e.event_no ORDER BY f.d DESC, f.i DESC, f.snapshot_no DESC) = 1"""

_P5 = f"""
WITH r AS (SELECT 'orders_day2' AS table_name, 'customer' AS kind, {_key('customer_id')} AS ref_key, CAST(order_ts AS DATE) AS d FROM orders_day2
  UNION ALL SELECT 'support_tickets', 'subscription', {_key('subscription_id')}, created_date FROM support_tickets
  UNION ALL SELECT 'invoices', 'subscription', {_key('subscription_id')}, invoice_date FROM invoices),
p AS (SELECT 'customer' AS kind, {_key('customer_id')} AS ref_key, min(signup_date) AS a, min(deleted_on) AS z FROM customers GROUP BY 2
  UNION ALL SELECT 'subscription', {_key('subscription_id')}, min(snapshot_date), min(CASE WHEN {_key('status')} = 'deleted' THEN snapshot_date END) FROM subscription_snapshots GROUP BY 2),
j AS (SELECT r.table_name, strftime(r.d, '%Y-%m') AS period, r.ref_key, CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN r.d < p.a THEN 'late' WHEN r.d >= p.z THEN 'deleted' END AS reason
  FROM r LEFT JOIN p ON r.kind = p.kind AND r.ref_key = p.ref_key WHERE r.ref_key IS NOT NULL AND r.d IS NOT NULL)
SELECT table_name, period, ref_key, reason, count(*) AS n_rows FROM j WHERE reason IS NOT NULL GROUP BY ALL"""


def _p6() -> str:
    parts = [
        f"SELECT any_value({_key('subscription_id')}) AS s, any_value('event_' || coalesce({_word('event_type')}, 'untyped')) AS k, any_value(event_date) AS d, CAST(NULL AS BIGINT) AS a FROM subscription_events GROUP BY event_no",
        f"SELECT any_value({_key('subscription_id')}), any_value('limit_' || coalesce({_word('limit_type')}, 'untyped')), any_value(CAST(hit_at AS DATE)), CAST(NULL AS BIGINT) FROM limit_events GROUP BY hit_no",
        f"SELECT any_value({_key('subscription_id')}), any_value('invoice_' || coalesce({_key('status')}, 'untyped')), any_value(invoice_date), any_value(CAST(round(amount_usd * {MICRO}) AS BIGINT)) FROM invoices GROUP BY invoice_no",
    ]
    known = [*EVENT_KINDS, *LIMIT_KINDS, *INVOICE_KINDS]
    listed = ", ".join(f"'{k}'" for k in known)
    columns = []
    for k in [*known, "other"]:
        mine = f"k = '{k}'" if k != "other" else f"k NOT IN ({listed})"
        columns.append(f"count(*) FILTER ({mine}) AS {k}_n, strftime(max(d) FILTER ({mine}), '%Y-%m-%d') AS {k}_last")
        if k in INVOICE_KINDS:
            columns.append(f"CAST(sum(a) FILTER ({mine}) AS DOUBLE) / {MICRO} AS {k}_total")
    return f"SELECT s AS subscription_id, {', '.join(columns)} FROM ({' UNION ALL '.join(parts)}) WHERE s IS NOT NULL GROUP BY s"


def _p7() -> str:
    fields = ("revenue", "avg_order_value", "orders", "cancelled_orders", "refunded_orders")
    side = lambda t: f"SELECT {_key('shop_id')} AS shop_id, strftime(order_date, '%Y-%m-%d') AS order_date, {', '.join(f'max({c}) AS {c}' for c in fields)} FROM {t} GROUP BY 1, 2"
    on = "g.shop_id = r.shop_id AND g.order_date = r.order_date"
    out = [f"SELECT g.shop_id, g.order_date, 'only_in_gold' AS diff FROM g ANTI JOIN r ON {on}", f"SELECT r.shop_id, r.order_date, 'only_in_replica' FROM r ANTI JOIN g ON {on}"]
    out += [f"SELECT g.shop_id, g.order_date, '{c}' FROM g JOIN r ON {on} WHERE (g.{c} IS NULL) <> (r.{c} IS NULL) OR abs(g.{c} - r.{c}) >= 0.005 - 1e-9" for c in fields]
    return f"WITH g AS ({side('gold_daily_metrics')}), r AS ({side('gold_daily_metrics_replica')}) {' UNION ALL '.join(out)}"


ORACLE = {
    "p1_rolling_totals": _P1,
    "p2_found": _P2,
    "p3_history": _P3,
    "p3_found": f"SELECT subscription_id, valid_from FROM ({_P3})",
    "p4_as_known": _P4,
    "p4_found": f"SELECT event_no, snapshot_no FROM ({_P4})",
    "p5_report": _P5,
    "p5_found": f"SELECT DISTINCT table_name, period, ref_key FROM ({_P5})",
    "p6_feature_table": _p6(),
    "p7_found": _p7(),
}
