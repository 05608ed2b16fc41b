"""Point-in-time features per renewal over the lakehouse tables, their labels, and the SQL of both.

Every feature reads a window that ends at the row's own as_of. The names and amounts below are parameters of
this data, not rules of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.cleaning import clean_key, clean_word
from lodestrata.operators.temporal import bounded_join, clamp, classify, half_up, inside_any, latest, ratio, windowed, within
from lodestrata.sources.files import inline
from lodestrata.sources.tables import table

#: The graph takes each subscription's last renewal with as_of up to this day; events go on after it.
UNTIL = "2026-01-31"
INCIDENTS = (("inc-001", "2025-03-10", "2025-03-16"), ("inc-002", "2025-09-01", "2025-09-12"), ("inc-003", "2026-01-05", "2026-01-14"))
CHANGES = (("cap-2025-08", "2025-08-20", "weekly caps cut"), ("cap-2026-01", "2026-01-25", "caps cut again"))
PLANS = (("pro", 20.0, 40.0), ("pro_plus", 60.0, 120.0), ("ultra", 200.0, 400.0))
CUT = 0.83
#: An outcome shows within so many days of the renewal.
SHOWS = 40
ON = ("overage_opened", "overage_added", "overage_restored", "overage_exported")
OFF = ("overage_closed", "overage_removed", "overage_expired", "overage_denied", "overage_shared", "overage_viewed", "overage_renamed", "overage_paired")

#: The numeric features that distances use.
FEATURES = (
    "renewals_completed", "active_days_7d", "active_days_28d", "engagement_trend", "last_active_days_ago", "allowance_used_pct", "limit_hits_14d", "weekly_share_28d", "overage_usd_28d", "overage_toggled_off",
    "five_hour_share_90d", "share_change", "paid_rate_90d", "failed_rate_90d", "incident_exposed_28d", "support_tickets_90d", "ide_events_90d", "cli_events_90d", "weekend_usage_ratio", "first_renewal_after_change",
)


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One clean row per subscription and snapshot day."""
    s = table(spark, d, "subscription_snapshots").select(
        clean_key("subscription_id").alias("sid"), F.col("snapshot_date").alias("day"), "_ingested_at", "snapshot_no", clean_word("plan_tier").alias("plan_tier"), clean_key("status").alias("status"), F.col("current_period_end").alias("period_end"), "started_at", F.trim("user_name").alias("user_name"), F.trim("city").alias("city")
    )
    return latest(s.where("sid is not null"), ["sid", "day"], ["_ingested_at", "snapshot_no"]).drop("_ingested_at", "snapshot_no")


def spine(spark: SparkSession, d: str) -> DataFrame:
    """Every renewal: each seven-days-before row of each subscription, keyed by (sid, as_of)."""
    rows = snapshots(spark, d).where((F.col("day") == F.date_sub("period_end", 7)) & F.col("plan_tier").isNotNull())
    return rows.select("sid", F.col("day").alias("as_of"), F.col("period_end").alias("renewal_date"), "plan_tier", "status", "started_at", "user_name", "city")


def last_renewals(spark: SparkSession, d: str) -> DataFrame:
    """Each subscription's last renewal with as_of up to UNTIL: the spine of the graph, whose edges are keyed by sid."""
    return latest(spine(spark, d).where(F.col("as_of") <= F.lit(UNTIL).cast("date")), ["sid"], ["as_of"])


def today(spark: SparkSession, d: str) -> DataFrame:
    """(today): the last snapshot day, one row."""
    return table(spark, d, "subscription_snapshots").where(clean_key("subscription_id").isNotNull()).agg(F.max("snapshot_date").alias("today"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "limit_events").select("hit_no", clean_key("subscription_id").alias("sid"), F.col("hit_at").cast("date").alias("day"), "hit_at", clean_word("limit_type").alias("limit_type")).where("sid is not null and day is not null").dropDuplicates(["hit_no"])


def charges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "overage_charges").select("charge_no", clean_key("subscription_id").alias("sid"), F.col("charged_at").alias("day"), F.round(F.col("amount_usd") * 1_000_000).cast("bigint").alias("micro")).where("sid is not null and day is not null").dropDuplicates(["charge_no"])


def tickets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "support_tickets").select(clean_key("ticket_id").alias("ticket_id"), clean_key("subscription_id").alias("sid"), F.col("created_date").alias("day")).where("sid is not null and day is not null").dropDuplicates(["ticket_id"])


def invoices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "invoices").select("invoice_no", clean_key("subscription_id").alias("sid"), F.col("invoice_date").alias("day"), clean_key("status").alias("status")).where("sid is not null and day is not null").dropDuplicates(["invoice_no"])


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subscription_events").select("event_no", clean_key("subscription_id").alias("sid"), F.col("event_date").alias("day"), clean_word("event_type").alias("event_type")).where("sid is not null and day is not null").dropDuplicates(["event_no"])


MEASURES = ("hits", "five", "weekly", "micro", "tickets", "paid", "failed", "ide", "cli", "on_", "off_", "canceled", "scheduled")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """One row per subscription and day with every measure: all windows of all features read this one table."""

    def part(rows: DataFrame, **found: Column) -> DataFrame:
        return rows.select("sid", "day", *(F.coalesce(found[m].cast("bigint"), F.lit(0)).alias(m) if m in found else F.lit(0).cast("bigint").alias(m) for m in MEASURES))

    one, is_ = F.lit(1), lambda c, v: (F.col(c) == v).cast("int")
    rows = part(hits(spark, d), hits=one, five=is_("limit_type", "five_hour"), weekly=is_("limit_type", "weekly"))
    rows = rows.unionByName(part(charges(spark, d), micro=F.col("micro"))).unionByName(part(tickets(spark, d), tickets=one))
    rows = rows.unionByName(part(invoices(spark, d), paid=is_("status", "paid"), failed=is_("status", "failed")))
    kind = F.col("event_type")
    marks = {"ide": kind.startswith("ide_").cast("int"), "cli": kind.startswith("cli_").cast("int"), "on_": kind.isin(*ON).cast("int"), "off_": kind.isin(*OFF).cast("int"), "canceled": (kind == "canceled").cast("int"), "scheduled": (kind == "cancel_scheduled").cast("int")}
    return rows.unionByName(part(events(spark, d), **marks)).groupBy("sid", "day").agg(*(F.sum(m).alias(m) for m in MEASURES))


def features(spark: SparkSession, d: str, naive: bool = False, last: bool = False) -> DataFrame:
    """Spine rows with features, outcome and route, one row per (sid, as_of). naive drops the upper bound (to show
    that a leak is found); last takes the graph's renewals, for which UNTIL is today."""
    until = F.date_add("renewal_date", SHOWS) if not naive else F.lit("9999-12-31").cast("date")
    renewals = last_renewals(spark, d) if last else spine(spark, d)
    rows = bounded_join(renewals, ledger(spark, d), "sid", "day", until)
    known = F.col("day") <= F.col("as_of") if not naive else F.lit(True)
    active = F.when(F.col("hits") > 0, 1)
    newest = lambda m: F.max(F.when(known & (F.col(m) > 0), F.col("day")))
    w = lambda m, n, skip=0: windowed(m, "day", "as_of", n, skip).cast("bigint")
    shows = (F.col("day") >= F.col("renewal_date")) & (F.col("day") <= F.date_add("renewal_date", SHOWS))
    at = lambda m: F.min(F.when(shows & (F.col(m) > 0), F.col("day")))
    key = ["sid", "as_of", "renewal_date", "plan_tier", "started_at", "user_name", "city"]
    weekend = F.when((F.col("hits") > 0) & F.dayofweek("day").isin(1, 7), 1)
    g = rows.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("day") < F.col("renewal_date"), F.col("paid"))), F.lit(0)).alias("renewals_completed"),
        w(active, 7).alias("active_days_7d"), w(active, 28).alias("active_days_28d"), newest("hits").alias("last_active"),
        w("hits", 28).alias("h28"), w("hits", 14).alias("limit_hits_14d"), w("weekly", 28).alias("w28"), w("five", 90).alias("f90"), w("hits", 90).alias("h90"),
        w("five", 28).alias("f28"), w("five", 28, 28).alias("fprev"), w("hits", 28, 28).alias("hprev"), w("micro", 28).alias("micro28"), newest("on_").alias("last_on"), newest("off_").alias("last_off"),
        w("paid", 90).alias("p90"), w("failed", 90).alias("x90"), F.coalesce(F.max(F.when(within("day", "as_of", 28) & (F.col("hits") > 0) & inside_any("day", [i[1:] for i in INCIDENTS]), 1)), F.lit(0)).alias("incident_exposed_28d"),
        w("tickets", 90).alias("support_tickets_90d"), w("ide", 90).alias("ide_events_90d"), w("cli", 90).alias("cli_events_90d"), w(weekend, 28).alias("weekend28"),
        at("paid").alias("paid_at"), at("failed").alias("failed_at"), F.min(F.when((F.col("day") > F.col("as_of")) & (F.col("day") <= F.date_add("renewal_date", SHOWS)) & (F.col("canceled") > 0), F.col("day"))).alias("canceled_at"), F.min(F.when((F.col("day") <= F.col("renewal_date")) & (F.col("scheduled") > 0), F.col("day"))).alias("scheduled_at"),
    )
    cuts = sum(((F.lit(c[1]).cast("date") <= F.col("as_of")).cast("int") for c in CHANGES), F.lit(0))
    cap = F.element_at(F.create_map(*(x for p in PLANS for x in (F.lit(p[0]), F.lit(p[2])))), F.col("plan_tier")) * F.pow(F.lit(CUT), cuts)
    after = [(F.lit(c[1]).cast("date") >= F.date_sub("renewal_date", 30)) & (F.lit(c[1]).cast("date") < F.col("renewal_date")) & (F.col("started_at") < F.lit(c[1]).cast("date")) for c in CHANGES]
    first_after = F.lit(False)
    for a in after:
        first_after = first_after | F.coalesce(a, F.lit(False))
    share, previous = half_up(ratio(F.col("f28"), F.col("h28"))), ratio(F.col("fprev"), F.col("hprev"), -1.0)
    wide = g.select(
        "sid", F.concat("sid", F.lit(":"), F.date_format("renewal_date", "yyyy-MM-dd")).alias("renewal_id"), "as_of", "renewal_date", "plan_tier", "started_at", "user_name", "city", "renewals_completed", "active_days_7d", "active_days_28d",
        half_up(clamp(F.col("active_days_7d") / F.greatest(F.lit(1.0), F.col("active_days_28d") / 4.0), 0.0, 4.0)).alias("engagement_trend"),
        clamp(F.coalesce(F.datediff("as_of", "last_active"), F.lit(90)), 0, 90).cast("bigint").alias("last_active_days_ago"),
        half_up(clamp(F.coalesce(F.col("h28") / cap, F.lit(0.0)), 0.0, 3.0)).alias("allowance_used_pct"), "limit_hits_14d", half_up(ratio(F.col("w28"), F.col("h28"))).alias("weekly_share_28d"),
        half_up(F.col("micro28") / 1_000_000, 2).alias("overage_usd_28d"), F.coalesce((F.col("last_off") > F.col("last_on")).cast("bigint"), F.lit(0)).alias("overage_toggled_off"),
        half_up(ratio(F.col("f90"), F.col("h90"))).alias("five_hour_share_90d"), half_up(clamp(F.when(previous > 0, share / previous).otherwise(1.0), 0.0, 3.0)).alias("share_change"),
        half_up(ratio(F.col("p90"), F.col("p90") + F.col("x90"))).alias("paid_rate_90d"), half_up(ratio(F.col("x90"), F.col("p90") + F.col("x90"))).alias("failed_rate_90d"), F.col("incident_exposed_28d").cast("bigint"),
        "support_tickets_90d", "ide_events_90d", "cli_events_90d", half_up(ratio(F.col("weekend28"), F.col("active_days_28d"))).alias("weekend_usage_ratio"), first_after.cast("bigint").alias("first_renewal_after_change"),
        classify([(F.col("canceled_at").isNotNull(), "voluntary_lapse"), (F.col("paid_at").isNotNull(), "renewed"), (F.col("failed_at").isNotNull(), "involuntary_lapse")], "pending").alias("outcome"),
        F.coalesce("canceled_at", "paid_at", "failed_at").alias("outcome_observed_on"), "scheduled_at",
    )
    wide = wide.withColumn("today", F.lit(UNTIL).cast("date")) if last else wide.crossJoin(F.broadcast(today(spark, d)))  # one row
    route = classify([(F.col("outcome") == "renewed", "model"), ((F.col("outcome") == "voluntary_lapse") & (F.col("scheduled_at") <= F.col("as_of")), "cancel_flow"), (F.col("outcome") == "voluntary_lapse", "model"), (F.col("outcome") == "involuntary_lapse", "dunning"), (F.col("as_of") == F.col("today"), "score_today")], "pending")
    return wide.withColumn("route", route).withColumn("churned", (F.col("outcome") == "voluntary_lapse").cast("bigint")).drop("today")


SHOWN = ("renewal_id", "as_of", "renewal_date", "plan_tier", *FEATURES, "outcome", "route", "churned")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if c in ("as_of", "renewal_date") else c for c in SHOWN))


def renewal_features(spark: SparkSession, d: str) -> DataFrame:
    return _shown(features(spark, d))


def renewal_features_naive(spark: SparkSession, d: str) -> DataFrame:
    """Rows per feature that change when the upper bound is dropped: the leak the windows keep out."""
    leak = ("last_active_days_ago", "overage_toggled_off")
    a = features(spark, d).select("renewal_id", *leak)
    b = features(spark, d, naive=True).select("renewal_id", *(F.col(c).alias(f"n_{c}") for c in leak))
    both = a.join(b, "renewal_id")
    return both.agg(*(F.sum(F.when(F.col(c) != F.col(f"n_{c}"), 1).otherwise(0)).cast("bigint").alias(c) for c in leak))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("route", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("lapses"))


def incidents(spark: SparkSession) -> DataFrame:
    df = inline(spark, INCIDENTS, "incident_id string, starts_on string, ends_on string")
    return df.select("incident_id", F.col("starts_on").cast("date"), F.col("ends_on").cast("date"), (F.datediff(F.col("ends_on").cast("date"), F.col("starts_on").cast("date")) + 1).alias("days"))


def changes(spark: SparkSession) -> DataFrame:
    return inline(spark, CHANGES, "change_id string, effective_date string, description string").withColumn("effective_date", F.col("effective_date").cast("date"))


QUERIES = {f.__name__: f for f in (renewal_features, renewal_features_naive, outcome_counts)}

_K = "nullif(lower(trim({0})), '')"
_W = "translate(nullif(lower(trim({0})), ''), ' -', '__')"
k, wd = _K.format, _W.format


def _r4(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE"


def _values(rows: tuple, columns: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS t({columns})"


def _ledger_sql() -> str:
    def part(found: dict[str, str], source: str) -> str:
        return f"SELECT sid, day, {', '.join(f'{found[m]} AS {m}' if m in found else f'0 AS {m}' for m in MEASURES)} FROM {source}"

    is_ = lambda c, v: f"CAST({c} = '{v}' AS INT)"
    parts = [
        part({"hits": "1", "five": is_("limit_type", "five_hour"), "weekly": is_("limit_type", "weekly")}, "hit"), part({"micro": "micro"}, "chg"), part({"tickets": "1"}, "tick"), part({"paid": is_("status", "paid"), "failed": is_("status", "failed")}, "inv"),
        part({"ide": "CAST(starts_with(event_type, 'ide_') AS INT)", "cli": "CAST(starts_with(event_type, 'cli_') AS INT)", "on_": f"CAST(event_type IN {ON} AS INT)", "off_": f"CAST(event_type IN {OFF} AS INT)", "canceled": is_("event_type", "canceled"), "scheduled": is_("event_type", "cancel_scheduled")}, "ev"),
    ]
    return f"SELECT sid, day, {', '.join(f'CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}' for m in MEASURES)} FROM ({' UNION ALL '.join(parts)}) WHERE sid IS NOT NULL AND day IS NOT NULL GROUP BY sid, day"


def _features_sql(naive: bool, today: str = "(SELECT max(day) FROM snap)") -> str:
    known = "TRUE" if naive else "l.day <= r.as_of"
    until = "TRUE" if naive else f"l.day <= r.renewal_date + {SHOWS}"

    def w(m: str, n: int, skip: int = 0) -> str:
        return f"CAST(coalesce(sum(CASE WHEN l.day > r.as_of - {n + skip} AND l.day <= r.as_of - {skip} THEN {m} END), 0) AS BIGINT)"

    last = lambda m: f"max(CASE WHEN {known} AND l.{m} > 0 THEN l.day END)"
    at = lambda m: f"min(CASE WHEN l.day >= r.renewal_date AND l.day <= r.renewal_date + {SHOWS} AND l.{m} > 0 THEN l.day END)"
    act = "CASE WHEN l.hits > 0 THEN 1 END"
    inside = " OR ".join(f"l.day BETWEEN DATE '{a}' AND DATE '{z}'" for _, a, z in INCIDENTS)
    agg = f"""SELECT r.sid, r.as_of, r.renewal_date, r.plan_tier, r.started_at, r.user_name, r.city,
 CAST(coalesce(sum(CASE WHEN l.day < r.renewal_date THEN l.paid END), 0) AS BIGINT) AS renewals_completed, {w(act, 7)} AS active_days_7d, {w(act, 28)} AS active_days_28d, {last('hits')} AS last_active,
 {w('l.hits', 28)} AS h28, {w('l.hits', 14)} AS limit_hits_14d, {w('l.weekly', 28)} AS w28, {w('l.five', 90)} AS f90, {w('l.hits', 90)} AS h90, {w('l.five', 28)} AS f28, {w('l.five', 28, 28)} AS fprev, {w('l.hits', 28, 28)} AS hprev,
 {w('l.micro', 28)} AS micro28, {last('on_')} AS last_on, {last('off_')} AS last_off, {w('l.paid', 90)} AS p90, {w('l.failed', 90)} AS x90,
 coalesce(max(CASE WHEN l.day > r.as_of - 28 AND l.day <= r.as_of AND l.hits > 0 AND ({inside}) THEN 1 END), 0) AS incident_exposed_28d,
 {w('l.tickets', 90)} AS support_tickets_90d, {w('l.ide', 90)} AS ide_events_90d, {w('l.cli', 90)} AS cli_events_90d, {w('CASE WHEN l.hits > 0 AND dayofweek(l.day) IN (0, 6) THEN 1 END', 28)} AS weekend28,
 {at('paid')} AS paid_at, {at('failed')} AS failed_at, min(CASE WHEN l.day > r.as_of AND l.day <= r.renewal_date + {SHOWS} AND l.canceled > 0 THEN l.day END) AS canceled_at, min(CASE WHEN l.day <= r.renewal_date AND l.scheduled > 0 THEN l.day END) AS scheduled_at
 FROM spine r LEFT JOIN ledger l ON r.sid = l.sid AND {until} GROUP BY ALL"""
    cuts = " + ".join(f"CAST(DATE '{c[1]}' <= as_of AS INT)" for c in CHANGES)
    cap = "CASE plan_tier " + " ".join(f"WHEN '{p[0]}' THEN {p[2]}::DOUBLE" for p in PLANS) + f" END * pow({CUT}::DOUBLE, {cuts})"
    after = " OR ".join(f"coalesce(DATE '{c[1]}' >= renewal_date - 30 AND DATE '{c[1]}' < renewal_date AND started_at < DATE '{c[1]}', FALSE)" for c in CHANGES)
    rat = lambda a, b, o="0.0::DOUBLE": f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE {o} END"
    share, prev = _r4(rat("f28", "h28")), f"({rat('fprev', 'hprev', '(-1.0)::DOUBLE')})"
    return f"""SELECT *, CASE WHEN outcome = 'renewed' THEN 'model' WHEN outcome = 'voluntary_lapse' AND scheduled_at <= as_of THEN 'cancel_flow' WHEN outcome = 'voluntary_lapse' THEN 'model' WHEN outcome = 'involuntary_lapse' THEN 'dunning' WHEN as_of = {today} THEN 'score_today' ELSE 'pending' END AS route,
 CAST(outcome = 'voluntary_lapse' AS BIGINT) AS churned FROM (SELECT sid, sid || ':' || strftime(renewal_date, '%Y-%m-%d') AS renewal_id, as_of, renewal_date, plan_tier, started_at, user_name, city, renewals_completed, active_days_7d, active_days_28d,
 {_r4("least(greatest(CAST(active_days_7d AS DOUBLE) / greatest(1.0::DOUBLE, CAST(active_days_28d AS DOUBLE) / 4.0::DOUBLE), 0.0), 4.0)")} AS engagement_trend,
 CAST(least(greatest(coalesce(date_diff('day', last_active, as_of), 90), 0), 90) AS BIGINT) AS last_active_days_ago,
 {_r4(f"least(greatest(coalesce(CAST(h28 AS DOUBLE) / ({cap}), 0.0), 0.0), 3.0)")} AS allowance_used_pct, limit_hits_14d, {_r4(rat("w28", "h28"))} AS weekly_share_28d,
 {_r4("CAST(micro28 AS DOUBLE) / 1000000.0::DOUBLE", 2)} AS overage_usd_28d, CAST(coalesce(last_off > last_on, FALSE) AS BIGINT) AS overage_toggled_off, {_r4(rat("f90", "h90"))} AS five_hour_share_90d,
 {_r4(f"least(greatest(CASE WHEN {prev} > 0 THEN ({share}) / {prev} ELSE 1.0::DOUBLE END, 0.0), 3.0)")} AS share_change, {_r4(rat("p90", "(p90 + x90)"))} AS paid_rate_90d, {_r4(rat("x90", "(p90 + x90)"))} AS failed_rate_90d,
 CAST(incident_exposed_28d AS BIGINT) AS incident_exposed_28d, support_tickets_90d, ide_events_90d, cli_events_90d, {_r4(rat("weekend28", "active_days_28d"))} AS weekend_usage_ratio, CAST({after} AS BIGINT) AS first_renewal_after_change,
 CASE WHEN canceled_at IS NOT NULL THEN 'voluntary_lapse' WHEN paid_at IS NOT NULL THEN 'renewed' WHEN failed_at IS NOT NULL THEN 'involuntary_lapse' ELSE 'pending' END AS outcome,
 coalesce(canceled_at, paid_at, failed_at) AS outcome_observed_on, scheduled_at FROM ({agg}))"""


def base_sql(last: bool = False) -> str:
    """CTEs that other SQL builds on: snap, spine, hit, chg, tick, inv, ev, ledger, feat, incident, change. ``last``
    takes each subscription's last renewal up to UNTIL (the graph), else every renewal."""
    one = f" AND day <= DATE '{UNTIL}'" if last else ""
    rank = " QUALIFY row_number() OVER (PARTITION BY sid ORDER BY day DESC) = 1" if last else ""
    feat = _features_sql(False, f"DATE '{UNTIL}'") if last else _features_sql(False)
    return f"""WITH snap AS (SELECT {k('subscription_id')} AS sid, snapshot_date AS day, {wd('plan_tier')} AS plan_tier, {k('status')} AS status, current_period_end AS period_end, started_at, trim(user_name) AS user_name, trim(city) AS city FROM subscription_snapshots
  WHERE {k('subscription_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k('subscription_id')}, snapshot_date ORDER BY _ingested_at DESC, snapshot_no DESC) = 1),
spine AS (SELECT sid, day AS as_of, period_end AS renewal_date, plan_tier, status, started_at, user_name, city FROM snap WHERE day = period_end - 7{one} AND plan_tier IS NOT NULL{rank}),
hit AS (SELECT hit_no, any_value({k('subscription_id')}) AS sid, any_value(CAST(hit_at AS DATE)) AS day, any_value(hit_at) AS hit_at, any_value({wd('limit_type')}) AS limit_type FROM limit_events WHERE hit_at IS NOT NULL GROUP BY hit_no),
chg AS (SELECT charge_no, any_value({k('subscription_id')}) AS sid, any_value(charged_at) AS day, any_value(CAST(round(amount_usd * 1000000) AS BIGINT)) AS micro FROM overage_charges WHERE charged_at IS NOT NULL GROUP BY charge_no),
tick AS (SELECT {k('ticket_id')} AS ticket_id, any_value({k('subscription_id')}) AS sid, any_value(created_date) AS day FROM support_tickets WHERE {k('subscription_id')} IS NOT NULL AND created_date IS NOT NULL GROUP BY 1),
inv AS (SELECT invoice_no, any_value({k('subscription_id')}) AS sid, any_value(invoice_date) AS day, any_value({k('status')}) AS status FROM invoices WHERE {k('subscription_id')} IS NOT NULL AND invoice_date IS NOT NULL GROUP BY invoice_no),
ev AS (SELECT event_no, any_value({k('subscription_id')}) AS sid, any_value(event_date) AS day, any_value({wd('event_type')}) AS event_type FROM subscription_events WHERE event_date IS NOT NULL GROUP BY event_no),
ledger AS MATERIALIZED ({_ledger_sql()}),
feat AS MATERIALIZED ({feat}),
incident AS (SELECT incident_id, CAST(a AS DATE) AS starts_on, CAST(z AS DATE) AS ends_on FROM {_values(INCIDENTS, 'incident_id, a, z')}),
change AS (SELECT change_id, CAST(a AS DATE) AS effective_date, description FROM {_values(CHANGES, 'change_id, a, description')})
"""


BASE = base_sql()
_LEAK = ("last_active_days_ago", "overage_toggled_off")
_SHOWN_SQL = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" if c in ("as_of", "renewal_date") else c for c in SHOWN)
ORACLE = {
    "renewal_features": f"{BASE} SELECT {_SHOWN_SQL} FROM feat",
    "renewal_features_naive": f"{BASE}, naive AS ({_features_sql(True)}) SELECT {', '.join(f'CAST(sum(CASE WHEN a.{c} <> b.{c} THEN 1 ELSE 0 END) AS BIGINT) AS {c}' for c in _LEAK)} FROM feat a JOIN naive b ON a.renewal_id = b.renewal_id",
    "outcome_counts": f"{BASE} SELECT route, outcome, count(*) AS n, CAST(sum(churned) AS BIGINT) AS lapses FROM feat GROUP BY ALL",
}
