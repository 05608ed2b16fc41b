"""Orders from raw deliveries to daily metrics, through versioned tables, with the SQL of each query."""

from __future__ import annotations

import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.cleaning import clean_key, clean_word
from lodestrata.operators.contract import content_hash, duplicate_keys, parity, table_checks, violations
from lodestrata.operators.temporal import half_up, inside_collected, latest, numbered_within
from lodestrata.plans.guard import guarded
from lodestrata.queries.renewals import INCIDENTS, hits, incidents, snapshots
from lodestrata.session import new_path
from lodestrata.sources.files import csv_as_text, csv_with_schema, export_folder, inline, not_dates, with_lineage, without_lineage
from lodestrata.sources.snapshots import SnapshotStore
from lodestrata.sources.tables import table

# The states a silver order may have, and those that count as paid.
STATES, PAID = ("paid", "shipped", "cancelled", "refunded"), ("paid", "shipped")
SPLIT = "2025-01-01"


def silver(orders: DataFrame) -> DataFrame:
    """The latest delivery of each order by (order_ts, _ingested_at, _source_file), then the allow-list: an order
    whose latest state is not listed goes, even if an earlier one was."""
    rows = orders.select(clean_key("order_id").alias("order_id"), clean_key("customer_id").alias("customer_id"), "order_ts", clean_key("status").alias("status"), "amount", "_source_file", "_ingested_at", "delivery_no").where("order_id is not null")
    return latest(rows, ["order_id"], ["order_ts", "_ingested_at", "_source_file", "delivery_no"]).where(F.col("status").isin(*STATES))


def daily(silver_orders: DataFrame) -> DataFrame:
    cents = F.round(F.when(F.col("status").isin(*PAID), F.col("amount")) * 100).cast("bigint")
    rows = silver_orders.where("order_ts is not null").select(F.col("order_ts").cast("date").alias("day"), "status", cents.alias("cents"))
    g = rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.count("cents").alias("priced"), F.sum((F.col("status") == "cancelled").cast("bigint")).alias("cancelled_orders"), F.sum((F.col("status") == "refunded").cast("bigint")).alias("refunded_orders")
    )
    average = F.when(F.col("priced") > 0, half_up(F.col("cents") / F.when(F.col("priced") > 0, F.col("priced")) / 100.0, 2))
    return g.select(F.col("day").cast("string").alias("order_date"), "orders", (F.col("cents") / 100.0).alias("revenue"), average.alias("avg_order_value"), "cancelled_orders", "refunded_orders")


def silver_orders(spark: SparkSession, d: str) -> DataFrame:
    return silver(table(spark, d, "orders_day2")).select("order_id", "customer_id", "status", "amount", "delivery_no")


def gold_daily(spark: SparkSession, d: str) -> DataFrame:
    return daily(silver(table(spark, d, "orders_day2")))


def customers_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customers").select(clean_key("customer_id").alias("customer_id"), F.trim("city").alias("city"), "signup_date")
    return rows.where("customer_id is not null").groupBy("customer_id").agg(F.max("city").alias("city"), F.max("signup_date").alias("signup_date"))


def orders_by_city(spark: SparkSession, d: str) -> DataFrame:
    joined = silver(table(spark, d, "orders_day2")).join(customers_latest(spark, d), "customer_id")
    return joined.groupBy(F.lower("city").alias("city"), "status").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_id").alias("customers"))


@cache
def orders_store(spark: SparkSession, d: str) -> SnapshotStore:
    """Bronze orders in two commits split by arrival, tagged after the first; written once a session and folder."""
    store = SnapshotStore(spark, new_path(spark, "store"))
    raw = table(spark, d, "orders_day2")
    early = F.col("_ingested_at") < F.lit(SPLIT).cast("timestamp_ntz")
    store.commit("bronze_orders", raw.where(early), "append", {"batch": "first"})
    store.tag("bronze_orders", "first")
    store.commit("bronze_orders", raw.where(~early), "append", {"batch": "second"})
    return store


def time_travel(spark: SparkSession, d: str) -> DataFrame:
    """Daily metrics of both versions of the orders table."""
    store = orders_store(spark, d)
    a = daily(silver(store.read("bronze_orders", tag="first"))).withColumn("version", F.lit("first"))
    b = daily(silver(store.read("bronze_orders", 2))).withColumn("version", F.lit("second"))
    return a.unionByName(b)


def snapshot_log(spark: SparkSession, d: str) -> DataFrame:
    log = orders_store(spark, d).snapshots("bronze_orders")
    total, added = F.element_at("summary", "total-records").cast("bigint"), F.element_at("summary", "added-records").cast("bigint")
    before = F.lag("snapshot_id").over(Window.orderBy("sequence"))  # one row per snapshot
    return log.select("sequence", "operation", F.element_at("summary", "batch").alias("batch"), added.alias("added"), total.alias("total"), F.coalesce(F.col("parent_id") == before, F.lit(False)).alias("follows"))


def snapshot_refs(spark: SparkSession, d: str) -> DataFrame:
    """Branches and tags of the orders table with the rows each one holds."""
    store = orders_store(spark, d)
    found = store.refs("bronze_orders").collect()  # a row per ref
    return inline(spark, [(r.name, r.type, store.verify("bronze_orders", r.snapshot_id)) for r in found], "name string, type string, rows bigint")


def published_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily metrics published from a pinned snapshot, asked for twice and built once, read back at the newest build."""
    store = orders_store(spark, d)
    pins = store.pin(["bronze_orders"], "pinned_")
    build = lambda: {"daily_metrics": daily(silver(store.read("bronze_orders", pins["bronze_orders"])))}
    store.publish("manifest", pins, ["daily"], build)
    if store.publish("manifest", pins, ["daily"], build)[1]:
        raise RuntimeError("the same inputs and code were built twice")
    return store.newest("manifest", "daily_metrics")


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV and taken in with their file and one time of arrival: rows, files and times per city."""
    path = new_path(spark, "landing")
    export_folder(customers_latest(spark, d), path)
    rows = with_lineage(csv_with_schema(spark, path, "customer_id STRING, city STRING, signup_date DATE"), datetime.datetime(2026, 7, 1))
    counted = rows.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count("_source_file").alias("with_file"), F.countDistinct("_ingested_at").alias("times"))
    return counted.withColumn("columns", F.lit(len(without_lineage(rows).columns)))


def guarded_sql(spark: SparkSession, d: str) -> DataFrame:
    """A question in SQL, let through as it only reads the view it may."""
    table(spark, d, "orders_day2").createOrReplaceTempView("asked_orders")
    return guarded(spark, "SELECT lower(trim(status)) AS status, count(*) AS n, count(DISTINCT delivery_no) AS deliveries FROM asked_orders GROUP BY 1", ["asked_orders"])


def not_days(spark: SparkSession, d: str) -> DataFrame:
    """Texts in columns of days that are more than a day, by column."""
    text = lambda n, *cs: not_dates(table(spark, d, n).select(*(F.col(c).cast("string").alias(c) for c in cs)), cs)
    every = text("orders_day2", "order_ts").unionByName(text("subscription_snapshots", "snapshot_date", "started_at"))
    return every.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def merged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Silver of the first version, merged with the latest deliveries of the second."""
    store = orders_store(spark, d)
    store.commit("silver_orders", silver(store.read("bronze_orders", tag="first")), "replace")
    now = latest(store.read("bronze_orders").select(clean_key("order_id").alias("order_id"), clean_key("customer_id").alias("customer_id"), "order_ts", clean_key("status").alias("status"), "amount", "_source_file", "_ingested_at", "delivery_no").where("order_id is not null"), ["order_id"], ["order_ts", "_ingested_at", "_source_file", "delivery_no"])
    allowed = ", ".join(f"'{s}'" for s in STATES)
    store.merge("silver_orders", now, ["order_id"], delete_when=f"status is null or status not in ({allowed})")
    return store.read("silver_orders").groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


def dml(spark: SparkSession, d: str) -> DataFrame:
    """Update and delete as new versions."""
    store = SnapshotStore(spark, new_path(spark, "store"))
    store.commit("t", customers_latest(spark, d).withColumn("signup_date", F.col("signup_date").cast("string")), "append")
    store.update("t", F.col("city").isNull(), {"city": F.lit("unknown")})
    store.delete("t", F.col("signup_date") < "2024-01-01")
    return store.read("t")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV by the executors and read twice: under a declared schema, and as text with casts."""
    path = new_path(spark, "csv")
    rows = customers_latest(spark, d)
    export_folder(rows, path)
    declared = csv_with_schema(spark, path, "customer_id STRING, city STRING, signup_date DATE")
    cast = csv_as_text(spark, path, {"signup_date": "date"})
    return parity_counts(declared, cast, ["customer_id"]).unionByName(declared.select(F.lit("rows").alias("kind"), F.col("customer_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def parity_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return parity(a, b, keys).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def gold_parity(spark: SparkSession, d: str) -> DataFrame:
    """Cells that differ between the two copies of the published metrics, by column and kind."""
    fields = ("orders", "revenue", "avg_order_value", "cancelled_orders", "refunded_orders")
    side = lambda n: table(spark, d, n).groupBy(clean_key("shop_id").alias("shop_id"), "order_date").agg(*(F.max(c).alias(c) for c in fields))
    return parity(side("gold_daily_metrics"), side("gold_daily_metrics_replica"), ["shop_id", "order_date"]).groupBy(F.coalesce("column", F.lit("-")).alias("column"), "kind").agg(F.count(F.lit(1)).alias("n"))


def snapshot_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subscription_snapshots").select("snapshot_no", clean_word("plan_tier").alias("plan_tier"), clean_key("status").alias("status"), "snapshot_date", "current_period_end", "started_at", F.trim("city").alias("city"))
    checks = table_checks(not_null=("plan_tier", "status", "city"), enums={"plan_tier": ("pro", "pro_plus", "ultra"), "status": ("active", "paused", "past_due", "trialing")}, ordered=(("started_at", "snapshot_date"), ("snapshot_date", "current_period_end")))
    return violations(rows, checks)


def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Group-size histogram of repeated line keys."""
    return duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    order = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return latest(rows, ["l_orderkey", "l_linenumber"], order).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("price"))


def same_content(spark: SparkSession, d: str) -> DataFrame:
    """A table and its reshuffled copy have one content hash."""
    rows = table(spark, d, "orders")
    return content_hash(rows).unionByName(content_hash(rows.repartition(7, "o_custkey"))).groupBy("rows").agg(F.countDistinct("digest").alias("digests"))


def numbered_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each hit's running number within its subscription."""
    rows = hits(spark, d).select("sid", "hit_no", "hit_at", "day")
    numbered = numbered_within(rows, "sid", F.trunc("day", "month"), [F.col("hit_at").asc_nulls_last(), F.col("hit_no")])
    return numbered.select("hit_no", F.format_string("lh:%s:%03d", "sid", "seq").alias("event_id"))


def hits_in_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Hits per month, and those on a day of any incident."""
    flagged = inside_collected(hits(spark, d), "day", incidents(spark), "starts_on", "ends_on", "inside")
    return flagged.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("inside").cast("bigint")).alias("inside"))


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Transitions between a subscription's consecutive snapshots (lag in order)."""
    w = Window.partitionBy("sid").orderBy("day")  # one row per key and day
    rows = snapshots(spark, d).withColumn("before", F.lag("status").over(w))
    return rows.where("before is not null and status is not null and before <> status").groupBy("before", "status").agg(F.count(F.lit(1)).alias("n"))


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Customers by what they have: orders and a record, only one of both."""
    ordered = silver(table(spark, d, "orders_day2")).select("customer_id").where("customer_id is not null").distinct()
    known = customers_latest(spark, d).select("customer_id")
    parts = {"both": ordered.intersect(known), "only_ordered": ordered.subtract(known), "only_known": known.subtract(ordered)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (key_sets, silver_orders, gold_daily, orders_by_city, time_travel, snapshot_log, merged_orders, dml, csv_round_trip, gold_parity, snapshot_contract, duplicate_lines, latest_lines, same_content, numbered_hits, hits_in_incidents, status_changes, snapshot_refs, published_daily, ingested, guarded_sql, not_days)}

_K = "nullif(lower(trim({0})), '')".format
_W = "translate(nullif(lower(trim({0})), ''), ' -', '__')".format
_IN = ", ".join(f"'{s}'" for s in STATES)


def _silver(where: str = "TRUE", allow: bool = True) -> str:
    inner = f"SELECT {_K('order_id')} AS order_id, {_K('customer_id')} AS customer_id, order_ts, {_K('status')} AS status, amount, delivery_no FROM orders_day2 WHERE {_K('order_id')} IS NOT NULL AND {where} QUALIFY row_number() OVER (PARTITION BY {_K('order_id')} ORDER BY order_ts DESC NULLS LAST, _ingested_at DESC NULLS LAST, _source_file DESC NULLS LAST, delivery_no DESC) = 1"
    return f"SELECT * FROM ({inner}) WHERE status IN ({_IN})" if allow else inner


def _daily(source: str) -> str:
    cents = "CAST(round(CASE WHEN status IN ('paid', 'shipped') THEN amount END * 100) AS BIGINT)"
    return f"""SELECT strftime(CAST(order_ts AS DATE), '%Y-%m-%d') AS order_date, count(*) AS orders, CAST(coalesce(sum({cents}), 0) AS DOUBLE) / 100.0::DOUBLE AS revenue,
    CASE WHEN count({cents}) > 0 THEN floor(CAST(sum({cents}) AS DOUBLE) / count({cents}) / 100.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS avg_order_value,
    count(*) FILTER (status = 'cancelled') AS cancelled_orders, count(*) FILTER (status = 'refunded') AS refunded_orders FROM ({source}) WHERE order_ts IS NOT NULL GROUP BY 1"""


_EARLY = f"_ingested_at < TIMESTAMP '{SPLIT}'"
_CUST = f"SELECT {_K('customer_id')} AS customer_id, max(trim(city)) AS city, max(signup_date) AS signup_date FROM customers WHERE {_K('customer_id')} IS NOT NULL GROUP BY 1"
_HIT = f"SELECT hit_no, any_value({_K('subscription_id')}) AS sid, any_value(hit_at) AS hit_at FROM limit_events WHERE hit_at IS NOT NULL AND {_K('subscription_id')} IS NOT NULL GROUP BY hit_no"


def _parity_sql() -> str:
    fields = ("orders", "revenue", "avg_order_value", "cancelled_orders", "refunded_orders")
    side = lambda t: f"SELECT {_K('shop_id')} AS shop_id, order_date, {', '.join(f'max({c}) AS {c}' for c in fields)} FROM {t} GROUP BY 1, 2"
    real = ("revenue", "avg_order_value")
    cells = [f"SELECT '{c}' AS \"column\", CASE WHEN {f'coalesce(abs(a.{c} - b.{c}) <= 1e-9, FALSE)' if c in real else 'FALSE'} THEN 'rounding' ELSE 'beyond rounding' END AS kind FROM a JOIN b USING (shop_id, order_date) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in fields]
    lone = ["SELECT '-', 'left_only' FROM a ANTI JOIN b USING (shop_id, order_date)", "SELECT '-', 'right_only' FROM b ANTI JOIN a USING (shop_id, order_date)"]
    return f"WITH a AS ({side('gold_daily_metrics')}), b AS ({side('gold_daily_metrics_replica')}) SELECT \"column\", kind, count(*) AS n FROM ({' UNION ALL '.join(cells + lone)}) GROUP BY ALL"


_SNAP = f"SELECT {_K('subscription_id')} AS sid, snapshot_date AS day, {_K('status')} AS status FROM subscription_snapshots QUALIFY row_number() OVER (PARTITION BY {_K('subscription_id')}, snapshot_date ORDER BY _ingested_at DESC, snapshot_no DESC) = 1"
_CHECKS = {
    "plan_tier is null": "plan_tier IS NULL", "status is null": "status IS NULL", "city is null": "city IS NULL", "plan_tier not in list": "plan_tier NOT IN ('pro', 'pro_plus', 'ultra')",
    "status not in list": "status NOT IN ('active', 'paused', 'past_due', 'trialing')", "started_at above snapshot_date": "started_at > snapshot_date", "snapshot_date above current_period_end": "snapshot_date > current_period_end",
}
_CLEAN = f"SELECT {_W('plan_tier')} AS plan_tier, {_K('status')} AS status, snapshot_date, current_period_end, started_at, trim(city) AS city FROM subscription_snapshots"
ORACLE = {
    "key_sets": f"WITH o AS (SELECT DISTINCT customer_id FROM ({_silver()}) WHERE customer_id IS NOT NULL), k AS (SELECT customer_id FROM ({_CUST})) SELECT 'both' AS part, count(*) AS n FROM (FROM o INTERSECT FROM k) UNION ALL SELECT 'only_ordered', count(*) FROM (FROM o EXCEPT FROM k) UNION ALL SELECT 'only_known', count(*) FROM (FROM k EXCEPT FROM o)",
    "silver_orders": f"SELECT order_id, customer_id, status, amount, delivery_no FROM ({_silver()})",
    "gold_daily": _daily(_silver()),
    "orders_by_city": f"SELECT lower(c.city) AS city, o.status, count(*) AS orders, count(DISTINCT o.customer_id) AS customers FROM ({_silver()}) o JOIN ({_CUST}) c ON o.customer_id = c.customer_id GROUP BY 1, 2",
    "time_travel": f"SELECT *, 'first' AS version FROM ({_daily(_silver(_EARLY))}) UNION ALL SELECT *, 'second' FROM ({_daily(_silver())})",
    "snapshot_log": f"SELECT CAST(1 AS BIGINT) AS sequence, 'append' AS operation, 'first' AS batch, count(*) AS added, count(*) AS total, FALSE AS follows FROM orders_day2 WHERE {_EARLY} UNION ALL SELECT 2, 'append', 'second', count(*) FILTER (NOT {_EARLY}), count(*), TRUE FROM orders_day2",
    "snapshot_refs": f"SELECT 'main' AS name, 'BRANCH' AS type, count(*) AS rows FROM orders_day2 UNION ALL SELECT 'first', 'TAG', count(*) FILTER ({_EARLY}) FROM orders_day2",
    "published_daily": _daily(_silver()),
    "ingested": f"SELECT city, count(*) AS n, count(*) AS with_file, CAST(1 AS BIGINT) AS times, 3 AS columns FROM ({_CUST}) GROUP BY city",
    "guarded_sql": "SELECT lower(trim(status)) AS status, count(*) AS n, count(DISTINCT delivery_no) AS deliveries FROM orders_day2 GROUP BY 1",
    "not_days": "SELECT 'order_ts' AS \"column\", count(order_ts) AS n FROM orders_day2",
    "merged_orders": f"SELECT status, count(*) AS orders FROM ({_silver()}) GROUP BY 1",
    "dml": f"SELECT customer_id, coalesce(city, 'unknown') AS city, strftime(signup_date, '%Y-%m-%d') AS signup_date FROM ({_CUST}) WHERE signup_date IS NULL OR signup_date >= DATE '2024-01-01'",
    "csv_round_trip": f"SELECT 'rows' AS kind, count(*) AS n FROM ({_CUST})",
    "gold_parity": _parity_sql(),
    "snapshot_contract": " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER ({c}) AS violations FROM ({_CLEAN})" for n, c in _CHECKS.items()),
    "duplicate_lines": "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1 GROUP BY n",
    "latest_lines": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS price FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1) GROUP BY 1, 2",
    "same_content": "SELECT count(*) AS rows, CAST(1 AS BIGINT) AS digests FROM orders",
    "numbered_hits": f"SELECT hit_no, printf('lh:%s:%03d', sid, row_number() OVER (PARTITION BY sid ORDER BY hit_at, hit_no)) AS event_id FROM ({_HIT})",
    "hits_in_incidents": f"SELECT strftime(hit_at, '%Y-%m') AS month, count(*) AS hits, count(*) FILTER ({' OR '.join(f"CAST(hit_at AS DATE) BETWEEN DATE '{a}' AND DATE '{z}'" for _, a, z in INCIDENTS)}) AS inside FROM ({_HIT}) GROUP BY 1",
    "status_changes": f"SELECT before, status, count(*) AS n FROM (SELECT status, lag(status) OVER (PARTITION BY sid ORDER BY day) AS before FROM ({_SNAP}) WHERE sid IS NOT NULL) WHERE before <> status GROUP BY 1, 2",
}
