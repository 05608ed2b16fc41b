"""The renewal graph as node and edge tables, and its pattern queries as joins, with the SQL of each.

Where a question asks about one renewal's neighbours, these queries answer it for every renewal of a stated set (id
divisible by 100), which is the batch form of the same plan.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.graph import block_paths, components, degree_histogram, hidden_unless, merge_communities, modularity, ranked_groups, reach, split_wide, undirected, union_wide
from lodestrata.operators.similarity import feature_shares, fit_scaler, mutual_flag, nearest, z_scores
from lodestrata.operators.temporal import half_up, numbered_within, overlapping, salted_join, within
from lodestrata.operators.stats import Z95, rates
from lodestrata.queries import renewals as R
from lodestrata.session import written
from lodestrata.sources.files import inline

K = 10
_NO = r"(\d+)$"


def _id(c: str = "sid") -> Column:
    return F.regexp_extract(c, _NO, 1).cast("bigint")


@cache
def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {}


def _once(spark: SparkSession, d: str, name: str, make, by: str | None = None) -> DataFrame:
    """Tables that many of these queries share are written once a session and folder."""
    kept = _tables(spark, d)
    if name not in kept:
        kept[name] = written(make(), name, by)
    return kept[name]


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The graph's renewals: one per subscription, as event edges start at the subscription."""
    return _once(spark, d, "gold", lambda: R.features(spark, d, last=True).withColumn("no", _id()))


def renewals(spark: SparkSession, d: str) -> DataFrame:
    """Every renewal with its features, for what counts renewals and follows no edge."""
    return _once(spark, d, "renewals", lambda: R.features(spark, d))


def _numbered(rows: DataFrame, prefix: str, number: str) -> DataFrame:
    out = numbered_within(rows, "sid", F.trunc("day", "month"), [F.col("day").asc_nulls_last(), F.col(number)])
    return out.withColumn("node_id", F.format_string(f"{prefix}:%s:%03d", "sid", "seq"))


def nodes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    g = gold(spark, d)
    subscribed = g.select("sid")
    mine = lambda df: df.join(subscribed, "sid", "left_semi")
    setting = R.events(spark, d).where(F.col("event_type").isin(*R.ON, *R.OFF)).withColumn("state", F.when(F.col("event_type").isin(*R.ON), "enabled").otherwise("disabled"))
    inv = R.invoices(spark, d).select("sid", "day", F.concat(F.lit("invoice_"), F.coalesce("status", F.lit("none"))).alias("type"), F.col("invoice_no").alias("no"))
    evs = R.events(spark, d).where(F.col("event_type").isin("canceled", "cancel_scheduled")).select("sid", "day", F.col("event_type").alias("type"), (F.col("event_no") + 1_000_000_000).alias("no"))
    bill = inv.unionByName(evs).join(g.select("sid", "renewal_date", "as_of"), "sid").where((F.col("day") >= F.col("renewal_date")) | F.col("type").isin("canceled", "cancel_scheduled"))
    bill = bill.withColumn("outcome_evidence", ~F.coalesce((F.col("type") == "cancel_scheduled") & (F.col("day") <= F.col("as_of")), F.lit(False)))
    return {
        "Subscription": g.select(F.col("sid").alias("node_id"), "sid", "user_name", "started_at", "plan_tier"),
        "Renewal": g.select(F.col("renewal_id").alias("node_id"), "sid", "as_of", "renewal_date", "plan_tier", "outcome", "route", "churned", *R.FEATURES),
        "Plan": inline(spark, R.PLANS, "node_id string, price double, cap double"),
        "Incident": R.incidents(spark).withColumnRenamed("incident_id", "node_id"),
        "PricingChange": R.changes(spark).withColumnRenamed("change_id", "node_id"),
        "LimitHit": mine(_numbered(R.hits(spark, d), "lh", "hit_no")).select("node_id", "sid", "day", "limit_type"),
        "OverageChange": mine(_numbered(setting, "ovs", "event_no")).select("node_id", "sid", "day", "state"),
        "OverageCharge": mine(_numbered(R.charges(spark, d), "ovc", "charge_no")).select("node_id", "sid", "day", (F.col("micro") / 1_000_000).alias("amount_usd")),
        "Ticket": mine(R.tickets(spark, d)).select(F.col("ticket_id").alias("node_id"), "sid", "day"),
        "BillingEvent": _numbered(bill, "bill", "no").select("node_id", "sid", "day", "type", "outcome_evidence"),
    }


def node_table(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "nodes", lambda: union_wide(nodes(spark, d)), "label")


EVENT_EDGES = {"HIT_LIMIT": "LimitHit", "CHANGED_OVERAGE": "OverageChange", "CHARGED_OVERAGE": "OverageCharge", "OPENED": "Ticket", "BILLED": "BillingEvent"}


def edges(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    wide, g = node_table(spark, d), gold(spark, d)
    out = {
        "HAS_RENEWAL": g.select(F.col("sid").alias("src"), F.col("renewal_id").alias("dst"), "as_of"),
        "ON_PLAN": g.select(F.col("renewal_id").alias("src"), F.col("plan_tier").alias("dst"), "as_of"),
    }
    extra = {"CHANGED_OVERAGE": ["state"], "CHARGED_OVERAGE": ["amount_usd"], "BILLED": ["type", "outcome_evidence"]}
    for rel, label in EVENT_EDGES.items():
        out[rel] = wide.where(F.col("label") == label).select(F.col("sid").alias("src"), F.col("node_id").alias("dst"), F.col("day").alias("event_date"), *extra.get(rel, []))
    active = R.hits(spark, d).join(g.select("sid"), "sid", "left_semi").select("sid", "day").distinct()
    out["EXPOSED_TO"] = overlapping(active, "day", R.incidents(spark), "starts_on", "ends_on").select(F.col("sid").alias("src"), F.col("incident_id").alias("dst"), F.col("day").alias("event_date"))
    near = (F.col("effective_date") >= F.date_sub("renewal_date", 30)) & (F.col("effective_date") < F.col("renewal_date")) & (F.col("started_at") < F.col("effective_date"))
    first = g.join(F.broadcast(R.changes(spark)), near)  # a fixed handful of changes
    out["FIRST_RENEWAL_AFTER"] = first.select(F.col("renewal_id").alias("src"), F.col("change_id").alias("dst"), F.col("effective_date").alias("event_date"), (F.col("effective_date") <= F.col("as_of")).alias("known_by_as_of"))
    plans = inline(spark, R.PLANS, "plan_tier string, price double, cap double")
    out["CUT_CAP"] = R.changes(spark).crossJoin(F.broadcast(plans)).select(F.col("change_id").alias("src"), F.col("plan_tier").alias("dst"), F.col("effective_date").alias("event_date"), F.lit(R.CUT).alias("multiplier"))  # fixed x fixed rows
    return out


def edge_table(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "edges", lambda: union_wide(edges(spark, d), "rel_type"), "rel_type")


def rel(spark: SparkSession, d: str, name: str) -> DataFrame:
    return edge_table(spark, d).where(F.col("rel_type") == name)


def scaled(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        g = gold(spark, d)
        zs = z_scores(fit_scaler(g.where("route = 'model'"), R.FEATURES), R.FEATURES)
        return g.select("no", "renewal_id", "plan_tier", "route", "outcome", "outcome_observed_on", "as_of", "churned", *zs).withColumn("v", F.array(*(f"z_{c}" for c in R.FEATURES)))

    return _once(spark, d, "scaled", make)


def similar(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, rank, d2, d2_q, dist, mutual): nearest reference renewals of the stated set and of its neighbours.

    The stated set is searched first; a second search from its neighbours finds the opposite edges.
    """

    def make() -> DataFrame:
        z = scaled(spark, d)
        candidates = z.where("route = 'model'")
        near = lambda q: nearest(q, candidates, "plan_tier", "no", "v", len(R.FEATURES), K)
        first = written(near(z.where("no % 100 = 0")), "first")
        reached = z.join(first.select(F.col("dst").alias("no")).distinct(), "no", "left_semi").where("no % 100 <> 0")
        every = written(first.unionByName(near(reached)), "both")
        return mutual_flag(every, every).withColumn("dist", F.sqrt("d2"))

    return _once(spark, d, "similar", make)


def similar_all(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, rank, d2, d2_q, dist, mutual): nearest reference renewals of every renewal of the graph, for what
    is asked of the graph as a whole."""

    def make() -> DataFrame:
        z = scaled(spark, d)
        every = written(nearest(z, z.where("route = 'model'"), "plan_tier", "no", "v", len(R.FEATURES), K), "every")
        return mutual_flag(every, every).withColumn("dist", F.sqrt("d2"))

    return _once(spark, d, "similar_all", make)


def _by_no(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    cols = ("no", "renewal_id", "plan_tier", "route", "outcome", "outcome_observed_on", "as_of", "churned")
    return scaled(spark, d).select(*(F.col(c).alias(f"{prefix}_{c}") for c in cols))


# ---- queries -------------------------------------------------------------------------------------------------


def graph_node_counts(spark, d):
    return node_table(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("ids"))


def graph_edge_counts(spark, d):
    return edge_table(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("targets"))


def graph_describe(spark, d):
    """What the graph holds: per node label and edge type the number, the first and last id and the days it covers."""
    days = lambda c: (F.min(c).cast("string").alias("first_day"), F.max(c).cast("string").alias("last_day"))
    n = node_table(spark, d).groupBy(F.col("label").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"), *days(F.coalesce("day", "as_of", "starts_on", "effective_date")))
    e = edge_table(spark, d).groupBy(F.col("rel_type").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first_id"), F.max("dst").alias("last_id"), *days(F.coalesce("event_date", "as_of")))
    return n.unionByName(e)


def graph_split(spark, d):
    """The typed tables back out of the wide one."""
    parts = split_wide(node_table(spark, d), "label", {"LimitHit": ["node_id", "sid", "limit_type"], "Ticket": ["node_id", "sid"]})
    return union_wide({k: v.groupBy("sid").agg(F.count(F.lit(1)).alias("n")) for k, v in parts.items()})


def graph_routes(spark, d):
    return node_table(spark, d).where("label = 'Renewal'").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("lapses"))


def graph_renewals_per_subscription(spark, d):
    return degree_histogram(node_table(spark, d).where("label = 'Subscription'").select("node_id"), "node_id", rel(spark, d, "HAS_RENEWAL").select("src"), "src")


def _events_of(spark, d, relation: str) -> DataFrame:
    """Renewals with their subscription's events, reduced to one row per day and kind (n of them) before they move."""
    r = gold(spark, d)
    micro = F.round(F.col("amount_usd") * 1_000_000).cast("bigint")
    e = rel(spark, d, relation).groupBy(F.col("src").alias("e_sid"), "event_date", "state", "type", "outcome_evidence").agg(F.count(F.lit(1)).alias("n"), F.sum(micro).alias("micro"))
    return r.join(e, r["sid"] == e["e_sid"], "left")


def _pit(relation: str, days: int, column: str):
    def query(spark, d):
        g = _events_of(spark, d, relation).groupBy("renewal_id", column).agg(
            F.coalesce(F.sum(F.when(within("event_date", "as_of", days), F.col("n"))), F.lit(0)).alias("pit"), F.coalesce(F.sum(F.when(F.col("event_date") > F.date_sub("as_of", days), F.col("n"))), F.lit(0)).alias("naive")
        )
        if relation == "EXPOSED_TO":
            g = g.withColumns({c: (F.col(c) > 0).cast("bigint") for c in ("pit", "naive")})
        return g.select("renewal_id", F.col(column).alias("gold"), "pit", "naive")

    return query


graph_pit_limit_hits = _pit("HIT_LIMIT", 14, "limit_hits_14d")
graph_pit_tickets = _pit("OPENED", 90, "support_tickets_90d")
graph_pit_incidents = _pit("EXPOSED_TO", 28, "incident_exposed_28d")


def graph_pit_overage(spark, d):
    g = _events_of(spark, d, "CHARGED_OVERAGE").groupBy("renewal_id", "overage_usd_28d").agg(F.coalesce(F.sum(F.when(within("event_date", "as_of", 28), F.col("micro"))), F.lit(0)).alias("m"))
    return g.select("renewal_id", F.col("overage_usd_28d").alias("gold"), (F.floor(F.col("m") / 1_000_000 * 100.0 + 0.5).cast("double") / 100.0).alias("pit"))


def graph_pit_toggled_off(spark, d):
    last = lambda s: F.max(F.when((F.col("event_date") <= F.col("as_of")) & (F.col("state") == s), F.col("event_date")))
    g = _events_of(spark, d, "CHANGED_OVERAGE").groupBy("renewal_id", "overage_toggled_off").agg(last("disabled").alias("off"), last("enabled").alias("on"))
    return g.select("renewal_id", F.col("overage_toggled_off").alias("gold"), F.coalesce((F.col("off") > F.col("on")).cast("bigint"), F.lit(0)).alias("pit"))


def graph_pit_first_after(spark, d):
    f = rel(spark, d, "FIRST_RENEWAL_AFTER").select(F.col("src").alias("renewal_id"), "event_date", "known_by_as_of")
    g = gold(spark, d).join(f, "renewal_id", "left").groupBy("renewal_id", "first_renewal_after_change").agg(F.count("event_date").alias("n"), F.sum(F.when(F.col("event_date") <= F.col("as_of"), 1)).alias("k"), F.coalesce(F.sum(F.when(F.col("known_by_as_of") != (F.col("event_date") <= F.col("as_of")), 1)), F.lit(0)).cast("bigint").alias("flag_inconsistent"))
    return g.select("renewal_id", F.col("first_renewal_after_change").alias("gold"), (F.col("n") > 0).cast("bigint").alias("pit"), (F.coalesce("k", F.lit(0)) > 0).cast("bigint").alias("as_of_filtered"), "flag_inconsistent")


def graph_billed(spark, d):
    c = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    early = F.col("event_date") <= F.col("as_of")
    return _events_of(spark, d, "BILLED").groupBy("renewal_id", "route").agg(c(early).alias("on_or_before"), c(early & (F.col("type") == "cancel_scheduled")).alias("scheduled"), c(~F.col("outcome_evidence")).alias("not_outcome_evidence"))


def graph_leak_surface(spark, d):
    r = gold(spark, d).select(F.col("sid").alias("src"), F.col("as_of").alias("cut"))
    daily = edge_table(spark, d).where(F.col("rel_type").isin(*EVENT_EDGES, "EXPOSED_TO")).groupBy("rel_type", "src", "event_date").agg(F.count(F.lit(1)).alias("n"))
    late = daily.join(r, "src").where("event_date > cut")
    return late.groupBy("rel_type", "src").agg(F.sum("n").alias("n")).groupBy("rel_type").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("renewals"))


def graph_first_after_unknown(spark, d):
    return rel(spark, d, "FIRST_RENEWAL_AFTER").where("known_by_as_of = false").groupBy(F.col("dst").alias("change_id")).agg(F.count(F.lit(1)).alias("edges"))


def _evidence(spark, d) -> DataFrame:
    r = gold(spark, d).select("sid", "renewal_id", F.col("as_of").alias("cut"), F.col("plan_tier").alias("plan"))
    e = edge_table(spark, d).where(F.col("rel_type").isin(*EVENT_EDGES, "EXPOSED_TO"))
    one = salted_join(e, r.withColumnRenamed("sid", "src"), "src", "dst").where((F.col("event_date") <= F.col("cut")) & ~F.coalesce("outcome_evidence", F.lit(False))).select("renewal_id", "event_date", F.col("rel_type").alias("relation"), F.col("dst").alias("target_id"), F.lit(False).alias("declared_exception"))
    two = rel(spark, d, "FIRST_RENEWAL_AFTER").join(r, F.col("src") == r["renewal_id"]).select("renewal_id", "event_date", F.lit("FIRST_RENEWAL_AFTER").alias("relation"), F.col("dst").alias("target_id"), (~F.col("known_by_as_of")).alias("declared_exception"))
    cut = rel(spark, d, "CUT_CAP")
    three = r.join(cut, r["plan"] == cut["dst"]).where("event_date <= cut").select("renewal_id", "event_date", F.lit("CUT_CAP").alias("relation"), F.col("src").alias("target_id"), F.lit(False).alias("declared_exception"))
    return one.unionByName(two).unionByName(three)


def graph_evidence(spark, d):
    """All evidence a renewal may be judged by, in one form."""
    return _evidence(spark, d).withColumn("event_date", F.col("event_date").cast("string"))


def graph_evidence_hidden(spark, d):
    r = gold(spark, d).select("sid", "renewal_id", F.col("as_of").alias("cut"))
    e = edge_table(spark, d).where(F.col("rel_type").isin(*EVENT_EDGES, "EXPOSED_TO")).groupBy("src", "event_date").agg(F.count(F.lit(1)).alias("n"))
    return r.join(e, (r["sid"] == e["src"]) & (e["event_date"] > r["cut"]), "left").groupBy("renewal_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hidden"))


def graph_header(spark, d):
    return gold(spark, d).select("renewal_id", "sid", "plan_tier", F.col("as_of").cast("string").alias("as_of"), F.col("renewal_date").cast("string").alias("renewal_date"), "route", "city")


def similar_edges(spark, d):
    """Nearest neighbours of the stated set: quantised distances, ranks, mutual flag."""
    return similar(spark, d).where("src % 100 = 0").select("src", "dst", "d2_q", F.col("rank").cast("bigint").alias("rank"), "mutual")


def similar_cut_row(spark, d):
    """The candidate just beyond the k-th: whether the cut fell between equal distances."""
    z = scaled(spark, d)
    more = nearest(z.where("no % 100 = 0"), z.where("route = 'model'"), "plan_tier", "no", "v", len(R.FEATURES), K + 1)
    last = more.groupBy("src").agg(F.max(F.when(F.col("rank") == K, F.col("d2_q"))).alias("kth"), F.max(F.when(F.col("rank") == K + 1, F.col("d2_q"))).alias("beyond"), F.least(F.lit(K), F.count(F.lit(1))).cast("bigint").alias("k_eff"))
    return last.withColumn("tied", F.coalesce(F.col("kth") == F.col("beyond"), F.lit(False)))


def similar_first_known(spark, d):
    """Each source's first three neighbours, by rank, whose outcome was known at its cut-off (a running count)."""
    from pyspark.sql import Window

    e = similar(spark, d).where("src % 100 = 0").join(_by_no(spark, d, "a"), F.col("src") == F.col("a_no")).join(_by_no(spark, d, "b"), F.col("dst") == F.col("b_no"))
    w = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most k rows
    seen = e.withColumn("known", F.coalesce(F.col("b_outcome_observed_on") <= F.col("a_as_of"), F.lit(False))).withColumn("nth", F.sum(F.col("known").cast("bigint")).over(w))
    return seen.where("known and nth <= 3").select("src", "nth", "dst", F.col("rank").cast("bigint").alias("rank"))


def similar_out_degree(spark, d):
    z = scaled(spark, d).where("no % 100 = 0").select("no")
    return degree_histogram(z, "no", similar(spark, d).where("src % 100 = 0").select("src"), "src")


def similar_checks(spark, d):
    e = similar(spark, d).where("src % 100 = 0").join(_by_no(spark, d, "a"), F.col("src") == F.col("a_no")).join(_by_no(spark, d, "b"), F.col("dst") == F.col("b_no"))
    c = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return e.agg(F.count(F.lit(1)).alias("edges"), c(F.col("a_plan_tier") != F.col("b_plan_tier")).alias("cross_plan"), c(F.col("b_route") != "model").alias("dst_not_model"), c(F.col("src") == F.col("dst")).alias("self_loops"), c(F.col("mutual")).alias("mutual_flagged"), F.countDistinct("dst").alias("distinct_dst"))


def similar_mutual(spark, d):
    e = similar_all(spark, d)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"]).agg(F.count(F.lit(1)).alias("mutual_edges"))


def similar_max_in_degree(spark, d):
    g = similar_all(spark, d).groupBy(F.col("dst").alias("no")).agg(F.count(F.lit(1)).alias("in_degree"))
    return g.orderBy(F.desc("in_degree"), "no").limit(1)


def _visible() -> Column:
    return (F.col("b_outcome_observed_on") <= F.col("a_as_of")) | F.col("a_route").isin("score_today", "pending")


def similar_visible(spark, d):
    """Neighbours with their outcome only where it was already observed at the source's cut-off."""
    e = similar(spark, d).where("src % 100 = 0").join(_by_no(spark, d, "a"), F.col("src") == F.col("a_no")).join(_by_no(spark, d, "b"), F.col("dst") == F.col("b_no"))
    return e.select("src", F.col("rank").cast("bigint").alias("rank"), "dst", hidden_unless(_visible(), F.col("b_outcome"), F.lit("not_yet_observed")).alias("outcome"), hidden_unless(_visible(), F.col("b_outcome_observed_on").cast("string"), F.lit(None)).alias("outcome_observed_on"))


def similar_top_k(spark, d):
    """Neighbours of the stated set with distance and today's outcome, in rank order."""
    e = similar(spark, d).where("src % 100 = 0").join(_by_no(spark, d, "b"), F.col("dst") == F.col("b_no"))
    return e.select("src", F.col("rank").cast("bigint").alias("rank"), "dst", half_up(F.col("dist"), 6).alias("dist"), F.col("b_outcome").alias("outcome"), F.col("b_outcome_observed_on").cast("string").alias("observed_on"))


def similar_invariants(spark, d):
    """What must hold of the whole graph: ranks rise with distance without a gap, no renewal has more than k neighbours or
    fewer than its plan offers, mutual edges have their opposite. Counts of violations."""
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy("rank")  # at most k rows
    e = similar_all(spark, d).withColumns({"before": F.lag("d2_q").over(w), "before_dst": F.lag("dst").over(w), "before_rank": F.lag("rank").over(w)})
    order = (F.col("before") > F.col("d2_q")) | ((F.col("before") == F.col("d2_q")) & (F.col("before_dst") >= F.col("dst")))
    c = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("bigint")), F.lit(0))
    ranks = e.agg(c(order).alias("order"), c(F.col("rank") != F.coalesce("before_rank", F.lit(0)) + 1).alias("gaps"))
    z = scaled(spark, d).where("plan_tier is not null")
    offers = z.where("route = 'model'").groupBy("plan_tier").agg(F.count(F.lit(1)).alias("offered"))
    degrees = similar_all(spark, d).groupBy(F.col("src").alias("no")).agg(F.count(F.lit(1)).alias("n"))
    want = F.least(F.lit(K), F.coalesce("offered", F.lit(0)) - (F.col("route") == "model").cast("int"))
    wrong = z.join(offers, "plan_tier", "left").join(degrees, "no", "left").agg(c(F.coalesce("n", F.lit(0)) != want).alias("degree"))
    back = similar_all(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("opposite"))
    flag = similar_all(spark, d).join(back, ["src", "dst"], "left").agg(c(F.col("mutual") != F.coalesce("opposite", F.lit(False))).alias("mutual"))
    return ranks.crossJoin(wrong).crossJoin(flag)  # one row each


def lapse_paths(spark, d, sources: DataFrame) -> DataFrame:
    """(source, node, path_dist, known): paths of any number of hops from ``sources`` (rows of ``scaled``) to lapses."""
    z = _by_no(spark, d, "b")
    plan = scaled(spark, d).select(F.col("no").alias("src"), F.col("plan_tier").alias("plan"))  # no edge leaves its plan
    e = similar_all(spark, d).join(plan, "src").select("src", "dst", "plan", (F.floor(F.sqrt(F.col("d2_q") / 1e9) * 1e6 + 0.5) / 1e6).alias("w"))
    lapses = z.where("b_churned = 1")
    found = block_paths(e, sources.select("plan_tier", "no"), "w", "plan", lapses.select("b_plan_tier", "b_no")).where("source <> node")
    lapsed = found.join(lapses, F.col("node") == F.col("b_no")).join(_by_no(spark, d, "a").select("a_no", "a_as_of"), F.col("source") == F.col("a_no"))
    return lapsed.select("source", "node", (F.floor(F.col("cost") * 1e4 + 0.5) / 1e4).alias("path_dist"), F.coalesce(F.col("b_outcome_observed_on") <= F.col("a_as_of"), F.lit(False)).alias("known"))


def similar_nearest_lapses(spark, d):
    """Least path distance, of any number of hops, from every renewal to renewals that lapsed, and whether that was known
    at the source's cut-off. As many rows as there are such pairs."""
    return lapse_paths(spark, d, scaled(spark, d))


def similar_sharing(spark, d):
    """Other sources that share a neighbour, by route."""
    e = similar(spark, d).where("src % 100 = 0").select("src", "dst")
    other = e.select(F.col("src").alias("other"), "dst")
    pairs = e.join(other, "dst").where("src <> other").select("src", "other").distinct()
    return pairs.join(_by_no(spark, d, "a"), F.col("other") == F.col("a_no")).groupBy("src", F.col("a_route").alias("route")).agg(F.count(F.lit(1)).alias("renewals"))


def similar_shares(spark, d):
    z = scaled(spark, d)
    return feature_shares(similar(spark, d).where("src % 100 = 0"), z, "no", R.FEATURES).select("src", "dst", F.col("place").cast("bigint").alias("place"), "feature", F.col("share"))


def graph_exposure_by_plan(spark, d):
    e = rel(spark, d, "EXPOSED_TO").select(F.col("src").alias("sid"), F.col("dst").alias("incident_id"), "event_date")
    hit = gold(spark, d).join(e, "sid").where(within("event_date", "as_of", 28)).select("incident_id", "renewal_id", "plan_tier", "route", "churned").distinct()
    c = lambda r, x=F.lit(1): F.coalesce(F.sum(F.when(F.col("route") == r, x)), F.lit(0)).cast("bigint")
    return hit.groupBy("incident_id", "plan_tier").agg(F.count(F.lit(1)).alias("exposed"), c("model").alias("model"), c("model", F.col("churned")).alias("voluntary_lapses"), c("cancel_flow").alias("cancel_flow"), c("dunning").alias("dunning"))


def graph_exposure_naive(spark, d):
    e = rel(spark, d, "EXPOSED_TO").groupBy(F.col("src").alias("sid"), F.col("dst").alias("incident_id")).agg(F.min("event_date").alias("first_seen"))
    return gold(spark, d).join(e, "sid").where("first_seen > as_of").groupBy("incident_id").agg(F.count(F.lit(1)).alias("naive_additional"))


def graph_exposure_change(spark, d):
    f = rel(spark, d, "FIRST_RENEWAL_AFTER").select(F.col("src").alias("renewal_id"), F.col("dst").alias("change_id"), "known_by_as_of")
    return gold(spark, d).join(f, "renewal_id").groupBy("change_id", "plan_tier", "route", "known_by_as_of").agg(F.count(F.lit(1)).alias("renewals"), F.sum("churned").alias("voluntary_lapses"))


def graph_motif(spark, d):
    """Reference renewals with a hit on or before a switch-off on or before the cut-off: first hits suffice."""
    off = rel(spark, d, "CHANGED_OVERAGE").where("state = 'disabled'").groupBy(F.col("src").alias("sid"), F.col("event_date").alias("off")).agg(F.count(F.lit(1)).alias("n"))
    hit = rel(spark, d, "HIT_LIMIT").groupBy(F.col("src").alias("sid")).agg(F.min("event_date").alias("hit"))
    found = gold(spark, d).where("route = 'model'").join(hit, "sid").join(off, "sid").where("hit <= off and off <= as_of").select("renewal_id", "churned").distinct()
    return found.agg(F.count(F.lit(1)).alias("renewals"), F.coalesce(F.sum("churned"), F.lit(0)).alias("lapses"))


def graph_first_after_by_plan(spark, d):
    f = rel(spark, d, "FIRST_RENEWAL_AFTER").select(F.col("src").alias("renewal_id")).distinct().withColumn("f", F.lit(True))
    g = gold(spark, d).where("route = 'model'").join(f, "renewal_id", "left").withColumn("first_after", F.coalesce("f", F.lit(False)))
    return g.groupBy("plan_tier", "first_after").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("lapses"))


def _pruned(spark, d) -> tuple[DataFrame, DataFrame]:
    r = gold(spark, d).select(F.col("sid").alias("src"), F.col("as_of").alias("cut"))
    e = edge_table(spark, d).where(F.col("rel_type").isin(*EVENT_EDGES, "EXPOSED_TO"))
    kept = salted_join(e, r, "src", "dst").where((F.col("event_date") <= F.col("cut")) & ~F.coalesce("outcome_evidence", F.lit(False))).drop("cut", "outcome_evidence", "type")
    n = node_table(spark, d).where(F.col("label").isin(*EVENT_EDGES.values(), "Incident"))
    return n.join(kept.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_semi"), kept


def graph_pruned(spark, d):
    """The evidence graph: every event cut at its renewal's as_of, unreachable event nodes gone, labels dropped."""
    n, e = _pruned(spark, d)
    return n.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy(F.col("rel_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def graph_pruned_proof(spark, d):
    """On the pruned graph even reads without an upper bound give the gold features: mismatches must be 0."""
    _, e = _pruned(spark, d)
    micro = F.round(F.col("amount_usd") * 1_000_000).cast("bigint")
    daily = e.groupBy("src", "rel_type", "event_date", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(micro).alias("micro"))
    of = daily.join(gold(spark, d).select(F.col("sid").alias("src"), "as_of"), "src")
    since = lambda r, days, x: F.coalesce(F.sum(F.when((F.col("rel_type") == r) & (F.col("event_date") > F.date_sub("as_of", days)), F.col(x))), F.lit(0))
    last = lambda state: F.max(F.when((F.col("rel_type") == "CHANGED_OVERAGE") & (F.col("state") == state), F.col("event_date")))
    naive = {
        "limit_hits_14d": since("HIT_LIMIT", 14, "n"), "support_tickets_90d": since("OPENED", 90, "n"), "incident_exposed_28d": (since("EXPOSED_TO", 28, "n") > 0).cast("bigint"),
        "overage_usd_28d": half_up(since("CHARGED_OVERAGE", 28, "micro") / 1_000_000, 2), "overage_toggled_off": F.coalesce((last("disabled") > last("enabled")).cast("bigint"), F.lit(0)),
    }
    found = of.groupBy(F.col("src").alias("sid")).agg(*(c.alias(f"naive_{n}") for n, c in naive.items()))
    both = gold(spark, d).join(found, "sid", "left")
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("gold"), F.coalesce(F.col(f"naive_{n}").cast("double"), F.lit(0.0)).alias("naive")) for n in naive))
    return both.select(F.inline(pairs)).groupBy("feature").agg(F.count(F.lit(1)).alias("renewals"), F.sum((F.col("gold") != F.col("naive")).cast("bigint")).alias("mismatches"))


def similar_route_leak(spark, d):
    """Lapse share of reference renewals with and without an incoming edge."""
    into = similar_all(spark, d).select(F.col("dst").alias("no")).distinct().withColumn("i", F.lit(True))
    g = scaled(spark, d).where("route = 'model'").join(into, "no", "left").withColumn("incoming", F.coalesce("i", F.lit(False)))
    return g.groupBy("incoming").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("lapses"))


def similar_components(spark, d):
    c = components(similar_all(spark, d).select("src", "dst"))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def similar_within_two(spark, d):
    """Renewals reached within two hops of each source, by number of hops."""
    found = reach(similar(spark, d).select("src", "dst"), scaled(spark, d).where("no % 100 = 0").select("no"), 2)
    return found.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"))


def _reference_links(spark, d) -> DataFrame:
    """The undirected graph of the reference renewals."""

    def make() -> DataFrame:
        reference = scaled(spark, d).where("route = 'model'").select(F.col("no").alias("src"))
        return undirected(similar_all(spark, d).join(reference, "src", "left_semi"), "dist")

    return _once(spark, d, "links", make)


def _members(spark, d) -> DataFrame:
    """(node, cohort, size, via): reference renewals in their community, others in that of their nearest neighbour."""

    def make() -> DataFrame:
        members = ranked_groups(merge_communities(_reference_links(spark, d)))
        nearest_one = similar_all(spark, d).where("rank = 1").select(F.col("src").alias("other"), F.col("dst").alias("node"))
        assigned = nearest_one.join(members, "node").join(members.select(F.col("node").alias("other")), "other", "left_anti")
        return members.withColumn("via", F.lit("member")).unionByName(assigned.select(F.col("other").alias("node"), "cohort", "size", F.lit("nearest").alias("via")))

    return _once(spark, d, "cohorts", make)


def cohort_members(spark, d):
    """Communities of the similarity graph: (node, cohort, size, via); size counts reference renewals."""
    return _members(spark, d)


def cohort_quality(spark, d):
    members = _members(spark, d).where("via = 'member'")
    plan = members.join(_by_no(spark, d, "a"), F.col("node") == F.col("a_no")).groupBy("cohort", "a_plan_tier").agg(F.count(F.lit(1)).alias("n")).groupBy("cohort").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return modularity(_reference_links(spark, d), members).crossJoin(plan.agg((F.sum("top") / F.sum("n")).alias("plan_purity"), F.count(F.lit(1)).alias("cohorts")))  # one row x one row


def cohort_profile(spark, d):
    """The five features whose mean lies furthest from the reference mean, per cohort of at least five."""
    from pyspark.sql import Window

    z = scaled(spark, d).join(_members(spark, d).where("via = 'member' and size >= 5"), F.col("no") == F.col("node"))
    means = z.groupBy("cohort").agg(*((F.floor(F.avg(f"z_{c}") * 1e6 + 0.5) / 1e6).alias(c) for c in R.FEATURES))
    long = means.select("cohort", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_z")) for c in R.FEATURES))))
    place = F.row_number().over(Window.partitionBy("cohort").orderBy(F.abs("mean_z").desc(), "feature"))
    return long.where("mean_z <> 0").withColumn("place", place.cast("bigint")).where("place <= 5")


def cohort_assigned(spark, d):
    """Renewals outside the reference, in the cohort of their nearest neighbour."""
    return _members(spark, d).where("via = 'nearest'").select("node", "cohort")


LEAST = 5


def _withheld(sizes: DataFrame) -> DataFrame:
    """(cohort, hidden) of (cohort, plan, size): cohorts below ``LEAST``, and where the hidden ones of a plan are one or
    hold fewer than ``LEAST`` together also the smallest other, so that the plan's total gives none back."""
    small = F.col("size") < LEAST
    per = sizes.groupBy("plan").agg(F.sum(small.cast("int")).alias("few"), F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)).alias("held"), F.min(F.when(~small, F.struct("size", "cohort"))).alias("next"))
    exposed = (F.col("few") > 0) & ((F.col("few") == 1) | (F.col("held") < LEAST))
    return sizes.join(per, "plan").select("cohort", (small | F.coalesce(exposed & (F.col("cohort") == F.col("next.cohort")), F.lit(False))).alias("hidden"))


def _cohort_facts(spark, d) -> DataFrame:
    """Reference members with plan, outcome and the day it was seen."""
    return _members(spark, d).where("via = 'member'").join(_by_no(spark, d, "a"), F.col("node") == F.col("a_no")).select("node", "cohort", "size", F.col("a_plan_tier").alias("plan"), F.col("a_churned").alias("churned"), F.col("a_outcome_observed_on").alias("seen_on"))


def cohort_list(spark, d):
    """Every cohort: name, size, lapses as of today with rate and interval; small cells and what gives them back hidden."""
    facts = _cohort_facts(spark, d)
    counts = facts.groupBy("cohort", "plan").agg(F.count(F.lit(1)).alias("size"), F.sum("churned").alias("lapses"))
    outside = _members(spark, d).where("via = 'nearest'").groupBy("cohort").agg(F.count(F.lit(1)).alias("assigned"))
    side = F.when(F.col("mean_z") > 0, "higher ").otherwise("lower ")
    names = cohort_profile(spark, d).where("place <= 2").groupBy("cohort").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(side, "feature").alias("t")))), lambda x: x["t"]), ", ").alias("told"))
    shown = rates(counts.join(_withheld(counts), "cohort").join(names, "cohort", "left").join(outside, "cohort", "left"), "size", "lapses")
    keep = lambda c: F.when(~F.col("hidden"), F.col(c)).alias(c)
    name = F.concat("plan", F.when(F.col("hidden"), ": withheld").otherwise(F.concat(F.lit(": "), F.coalesce("told", F.lit("no distinguishing feature")))))
    return shown.select("cohort", name.alias("name"), *map(keep, ("size", "lapses", "rate", "lower", "upper")), F.when(F.coalesce("assigned", F.lit(0)) >= LEAST, F.col("assigned")).alias("assigned"), "hidden")


def cohort_seen(spark, d):
    """For every renewal of the stated set: its cohort's outcomes as far as they were observed by its as_of, itself left
    out; hidden where few are counted or few separate this view from today's. Members are counted per cohort and day
    of observation first, so no source meets members one by one."""
    facts = _cohort_facts(spark, d)
    daily = facts.groupBy("cohort", "seen_on").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("lapses"))
    size = facts.groupBy("cohort", "plan").agg(F.count(F.lit(1)).alias("size"))
    asked = scaled(spark, d).where("no % 100 = 0").select("no", "as_of", "route", F.col("churned").alias("own"), F.col("outcome_observed_on").alias("own_on"))
    of = _members(spark, d).select(F.col("node").alias("no"), "cohort", F.col("via").alias("via"))
    now = F.col("route").isin("score_today", "pending")
    seen = F.coalesce(F.col("seen_on") <= F.col("as_of"), F.lit(False)) | now
    sums = asked.join(of, "no").join(daily, "cohort").groupBy("no", "cohort", "as_of", "route", "own", "own_on", "via").agg(F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(seen, F.col("lapses"))), F.lit(0)).alias("lapses"))
    itself = F.col("via") == "member"
    counted = (itself & (now | F.coalesce(F.col("own_on") <= F.col("as_of"), F.lit(False)))).cast("bigint")
    less = sums.withColumns({"lapses": F.col("lapses") - counted * F.col("own"), "n": F.col("n") - counted}).join(size, "cohort").join(_withheld(size), "cohort")
    behind = F.col("size") - F.col("n")
    less = less.withColumn("hidden", F.col("hidden") | (F.col("n") < LEAST) | ((behind > 0) & (behind < LEAST)))
    keep = lambda c: F.when(~F.col("hidden"), F.col(c)).alias(c)
    return rates(less, "n", "lapses").select("no", "cohort", F.when(now, "today").otherwise("source_as_of").alias("visibility"), *map(keep, ("n", "lapses", "rate", "lower", "upper")), "hidden")


QUERIES = {
    n: f for n, f in list(globals().items()) if n.startswith(("graph_", "similar_", "cohort_")) and callable(f) and f is not similar_all
}

# ---- the same in SQL ------------------------------------------------------------------------------------------

_EVENTS = "('HIT_LIMIT', 'CHANGED_OVERAGE', 'CHARGED_OVERAGE', 'OPENED', 'BILLED', 'EXPOSED_TO')"


def _seq(prefix: str, number: str, source: str, more: str) -> str:
    return f"SELECT printf('{prefix}:%s:%03d', sid, row_number() OVER (PARTITION BY sid ORDER BY day, {number})) AS node_id, sid, day{more} FROM ({source}) WHERE sid IS NOT NULL"


_MINE = "SELECT * FROM ({0}) WHERE sid IN (SELECT sid FROM feat)".format
_BILL = """SELECT b.*, as_of, NOT coalesce(type = 'cancel_scheduled' AND day <= as_of, FALSE) AS outcome_evidence FROM (SELECT sid, day, 'invoice_' || coalesce(status, 'none') AS type, invoice_no AS no FROM inv
 UNION ALL SELECT sid, day, event_type, event_no + 1000000000 FROM ev WHERE event_type IN ('canceled', 'cancel_scheduled')) b JOIN feat USING (sid) WHERE day >= renewal_date OR type IN ('canceled', 'cancel_scheduled')"""
GRAPH = f"""{R.base_sql(True)}, g AS (SELECT *, CAST(regexp_extract(sid, '(\\d+)$', 1) AS BIGINT) AS no FROM feat),
n_hit AS ({_MINE(_seq('lh', 'hit_no', 'SELECT * FROM hit', ', limit_type'))}),
n_set AS ({_MINE(_seq('ovs', 'event_no', f"SELECT * FROM ev WHERE event_type IN {R.ON + R.OFF}", f", CASE WHEN event_type IN {R.ON} THEN 'enabled' ELSE 'disabled' END AS state"))}),
n_chg AS ({_MINE(_seq('ovc', 'charge_no', 'SELECT * FROM chg', ', micro'))}),
n_tick AS ({_MINE('SELECT ticket_id AS node_id, sid, day FROM tick')}),
n_bill AS ({_seq('bill', 'no', _BILL, ', type, outcome_evidence')}),
e_exp AS (SELECT DISTINCT sid, incident_id AS node_id, day FROM hit JOIN incident ON day BETWEEN starts_on AND ends_on WHERE sid IN (SELECT sid FROM feat)),
e_first AS (SELECT renewal_id, sid, change_id, effective_date AS day, effective_date <= as_of AS known FROM g JOIN change ON effective_date >= renewal_date - 30 AND effective_date < renewal_date AND started_at < effective_date),
e AS MATERIALIZED (SELECT 'HIT_LIMIT' AS rel, sid, node_id, day, NULL AS state, NULL AS micro, NULL AS type, NULL AS oe FROM n_hit UNION ALL SELECT 'CHANGED_OVERAGE', sid, node_id, day, state, NULL, NULL, NULL FROM n_set
 UNION ALL SELECT 'CHARGED_OVERAGE', sid, node_id, day, NULL, micro, NULL, NULL FROM n_chg UNION ALL SELECT 'OPENED', sid, node_id, day, NULL, NULL, NULL, NULL FROM n_tick
 UNION ALL SELECT 'BILLED', sid, node_id, day, NULL, NULL, type, outcome_evidence FROM n_bill UNION ALL SELECT 'EXPOSED_TO', sid, node_id, day, NULL, NULL, NULL, NULL FROM e_exp)
"""


def _knn_sql(k: int, every: bool = False) -> str:
    """every: searched from each renewal of the graph, else from the stated set and what it reaches."""
    fs = R.FEATURES
    tidy = lambda x: f"floor(({x}) * 1e9 + 0.5) / 1e9"
    scaler = ", ".join(f"{tidy(f'avg({c}::DOUBLE)')} AS m{i}, {tidy(f'stddev_pop({c}::DOUBLE)')} AS s{i}" for i, c in enumerate(fs))
    z = ", ".join(f"CASE WHEN s{i} > 0 THEN ({c}::DOUBLE - m{i}) / s{i} ELSE 0.0::DOUBLE END AS z{i}" for i, c in enumerate(fs))
    d2 = "0.0::DOUBLE"
    for i in range(len(fs)):
        d2 = f"({d2} + (a.z{i} - b.z{i}) * (a.z{i} - b.z{i}))"
    knn = lambda q: f"SELECT a.no AS src, b.no AS dst, {d2} AS d2, CAST(floor({d2} * 1e9 + 0.5) AS BIGINT) AS d2_q FROM ({q}) a JOIN (SELECT * FROM z WHERE route = 'model') b ON a.plan_tier = b.plan_tier AND a.no <> b.no QUALIFY row_number() OVER (PARTITION BY a.no ORDER BY d2_q, b.no) <= {k}"
    first, more, shown = ("SELECT * FROM z", "SELECT * FROM z WHERE FALSE", "TRUE") if every else ("SELECT * FROM z WHERE no % 100 = 0", "SELECT * FROM z WHERE no % 100 <> 0 AND no IN (SELECT dst FROM k1)", "src % 100 = 0")
    return f"""{GRAPH}, sc AS (SELECT {scaler} FROM g WHERE route = 'model'), z AS MATERIALIZED (SELECT g.*, {z} FROM g, sc),
k1 AS MATERIALIZED ({knn(first)}), k2 AS MATERIALIZED ({knn(more)}),
ka AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2),
sim AS MATERIALIZED (SELECT k.*, row_number() OVER (PARTITION BY k.src ORDER BY d2_q, k.dst) AS rank, EXISTS (SELECT 1 FROM ka b WHERE b.src = k.dst AND b.dst = k.src) AS mutual FROM ka k), s1 AS (SELECT * FROM sim WHERE {shown})
"""


KNN, KNN_ALL = _knn_sql(K), _knn_sql(K, True)
_L = "LEFT JOIN e ON e.sid = g.sid AND rel ="
_I = "CAST(coalesce(sum(CASE WHEN {0} THEN 1 END), 0) AS BIGINT)".format
_SCHEDULED = "day <= as_of AND type = 'cancel_scheduled'"
_KEEP = f"e JOIN g USING (sid) WHERE rel IN {_EVENTS} AND day <= as_of AND NOT coalesce(oe, FALSE)"


def _pit_sql(relation: str, days: int, column: str) -> str:
    pit, naive = _I(f"day > as_of - {days} AND day <= as_of"), _I(f"day > as_of - {days}")
    if relation == "EXPOSED_TO":
        pit, naive = f"CAST({pit} > 0 AS BIGINT)", f"CAST({naive} > 0 AS BIGINT)"
    return f"{GRAPH} SELECT renewal_id, {column} AS gold, {pit} AS pit, {naive} AS naive FROM g {_L} '{relation}' GROUP BY renewal_id, {column}"


def _shares_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT s.src, s.dst, '{c}' AS feature, (a.z{i} - b.z{i}) * (a.z{i} - b.z{i}) AS part, s.d2 FROM s1 s JOIN z a ON a.no = s.src JOIN z b ON b.no = s.dst WHERE s.d2 > 0" for i, c in enumerate(R.FEATURES))
    return f"{KNN} SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY floor(part * 1e9 + 0.5) DESC, feature) AS place, feature, floor(part / d2 * 1e6 + 0.5) / 1e6 AS share FROM ({parts}) QUALIFY place <= 3"


def _describe_sql() -> str:
    text = lambda f, c: f"strftime({f}({c}), '%Y-%m-%d')"
    one = lambda part, source, id_, day: f"SELECT '{part}' AS part, count(*) AS n, min({id_}) AS first_id, max({id_}) AS last_id, {text('min', day)} AS first_day, {text('max', day)} AS last_day FROM {source}"
    plans = R._values(R.PLANS, "plan, price, cap")
    parts = [
        ("Subscription", "g", "sid", "CAST(NULL AS DATE)"), ("Renewal", "g", "renewal_id", "as_of"), ("Plan", plans, "plan", "CAST(NULL AS DATE)"), ("Incident", "incident", "incident_id", "starts_on"), ("PricingChange", "change", "change_id", "effective_date"),
        ("LimitHit", "n_hit", "node_id", "day"), ("OverageChange", "n_set", "node_id", "day"), ("OverageCharge", "n_chg", "node_id", "day"), ("Ticket", "n_tick", "node_id", "day"), ("BillingEvent", "n_bill", "node_id", "day"),
        ("HAS_RENEWAL", "g", "renewal_id", "as_of"), ("ON_PLAN", "g", "plan_tier", "as_of"), ("HIT_LIMIT", "n_hit", "node_id", "day"), ("CHANGED_OVERAGE", "n_set", "node_id", "day"), ("CHARGED_OVERAGE", "n_chg", "node_id", "day"), ("OPENED", "n_tick", "node_id", "day"), ("BILLED", "n_bill", "node_id", "day"),
        ("EXPOSED_TO", "e_exp", "node_id", "day"), ("FIRST_RENEWAL_AFTER", "e_first", "change_id", "day"), ("CUT_CAP", f"change, {plans}", "plan", "effective_date"),
    ]
    # a part of the graph without rows has no row
    return f"{GRAPH} SELECT * FROM ({' UNION ALL '.join(one(*p) for p in parts)}) WHERE n > 0"


def _proof_sql() -> str:
    since = lambda r, days, x: f"coalesce(sum(CASE WHEN rel = '{r}' AND day > as_of - {days} THEN {x} END), 0)"
    last = lambda state: f"max(CASE WHEN rel = 'CHANGED_OVERAGE' AND state = '{state}' THEN day END)"
    naive = {
        "limit_hits_14d": since("HIT_LIMIT", 14, "1"), "support_tickets_90d": since("OPENED", 90, "1"), "incident_exposed_28d": f"CAST({since('EXPOSED_TO', 28, '1')} > 0 AS INT)",
        "overage_usd_28d": f"floor(CAST({since('CHARGED_OVERAGE', 28, 'micro')} AS DOUBLE) / 1000000.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE", "overage_toggled_off": f"CAST(coalesce({last('disabled')} > {last('enabled')}, FALSE) AS INT)",
    }
    found = f"SELECT e.sid, {', '.join(f'{x} AS {n}' for n, x in naive.items())} FROM {_KEEP} GROUP BY e.sid"
    one = lambda n: f"SELECT '{n}' AS feature, count(*) AS renewals, CAST(sum(CAST(coalesce(CAST(x.{n} AS DOUBLE), 0) <> CAST(g.{n} AS DOUBLE) AS INT)) AS BIGINT) AS mismatches FROM g LEFT JOIN x ON x.sid = g.sid"
    return f"{GRAPH}, x AS ({found}) " + " UNION ALL ".join(map(one, naive))


def _cohort_sql() -> str:
    """CTEs up to coh (node, cohort, size, via)."""
    two = "SELECT a, b, w FROM lk UNION ALL SELECT b, a, w FROM lk"
    return KNN_ALL.replace("WITH snap", "WITH RECURSIVE snap", 1) + f""", lk AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(1.0::DOUBLE / (1.0::DOUBLE + sqrt(d2))) AS weight, CAST(floor(max(1.0::DOUBLE / (1.0::DOUBLE + sqrt(d2))) * 1000000 + 0.5) AS HUGEINT) AS w
  FROM sim JOIN z ON z.no = src WHERE route = 'model' AND src <> dst GROUP BY 1, 2),
duo AS MATERIALIZED ({two}), dg AS MATERIALIZED (SELECT a AS node, sum(w) AS deg FROM duo GROUP BY a), tot AS (SELECT sum(deg) AS m2 FROM dg),
st(round, node, c) AS (SELECT 0, node, node FROM dg UNION ALL (
  WITH cd AS (SELECT c, sum(deg) AS deg FROM st JOIN dg USING (node) GROUP BY c),
  ce AS (SELECT x.c AS a, y.c AS b, sum(w) AS w FROM duo JOIN st x ON x.node = duo.a JOIN st y ON y.node = duo.b WHERE x.c <> y.c GROUP BY 1, 2),
  gn AS (SELECT a, b, (w * 1000000000000000000::HUGEINT) // (p.deg * q.deg) AS gain FROM ce JOIN cd p ON p.c = a JOIN cd q ON q.c = b, tot WHERE m2 * w > p.deg * q.deg),
  best AS (SELECT a, b FROM gn QUALIFY row_number() OVER (PARTITION BY a ORDER BY gain DESC, least(a, b), greatest(a, b)) = 1),
  mp AS (SELECT x.a AS c, least(x.a, x.b) AS into_c FROM best x JOIN best y ON x.a = y.b AND x.b = y.a)
  SELECT round + 1, node, coalesce(into_c, st.c) FROM st LEFT JOIN mp ON mp.c = st.c WHERE EXISTS (SELECT 1 FROM mp))),
lb AS MATERIALIZED (SELECT node, c FROM st WHERE round = (SELECT max(round) FROM st)),
gr AS (SELECT c, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(node)) AS cohort FROM lb GROUP BY c),
mem AS MATERIALIZED (SELECT node, cohort, size FROM lb JOIN gr USING (c)),
coh AS MATERIALIZED (SELECT node, CAST(cohort AS INT) AS cohort, size, 'member' AS via FROM mem UNION ALL SELECT s.src, CAST(cohort AS INT), size, 'nearest' FROM sim s JOIN mem ON mem.node = s.dst WHERE s.rank = 1 AND s.src NOT IN (SELECT node FROM mem)),
fact AS (SELECT coh.node, cohort, size, z.plan_tier AS plan, z.churned, z.outcome_observed_on AS seen_on FROM coh JOIN z ON z.no = coh.node WHERE via = 'member'),
cnt AS (SELECT cohort, plan, count(*) AS size, CAST(sum(churned) AS BIGINT) AS lapses FROM fact GROUP BY 1, 2),
hid AS (SELECT cohort, size < {LEAST} OR (few > 0 AND (few = 1 OR held < {LEAST}) AND rn = few + 1) AS hidden FROM (SELECT cohort, size, count(*) FILTER (size < {LEAST}) OVER (PARTITION BY plan) AS few, sum(size) FILTER (size < {LEAST}) OVER (PARTITION BY plan) AS held, row_number() OVER (PARTITION BY plan ORDER BY size, cohort) AS rn FROM cnt)),
prof AS (SELECT cohort, feature, mean_z, row_number() OVER (PARTITION BY cohort ORDER BY abs(mean_z) DESC, feature) AS place FROM ({_means_sql()}) WHERE mean_z <> 0 QUALIFY place <= 5)
"""


def _means_sql() -> str:
    return " UNION ALL ".join(f"SELECT cohort, '{c}' AS feature, floor(avg(z{i}) * 1e6 + 0.5) / 1e6 AS mean_z FROM coh JOIN z ON z.no = coh.node WHERE via = 'member' AND size >= {LEAST} GROUP BY cohort" for i, c in enumerate(R.FEATURES))


def rates_sql(n: str, k: str) -> str:
    """rate, lower and upper as ``stats.rates`` has them."""
    p, z2 = f"(CAST({k} AS DOUBLE) / CAST({n} AS DOUBLE))", f"{Z95 * Z95!r}::DOUBLE"
    den = f"(1 + {z2} / {n})"
    half = f"({Z95!r}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * CAST({n} AS DOUBLE) * {n})) / {den})"
    bound = lambda sign: f"CASE WHEN {n} > 0 THEN floor(least(greatest(({p} + {z2} / (2 * CAST({n} AS DOUBLE))) / {den} {sign} {half}, 0.0), 1.0) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END"
    return f"CASE WHEN {n} > 0 THEN floor({p} * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE END AS rate, {bound('-')} AS lower, {bound('+')} AS upper"


COHORT = _cohort_sql()
_SHOWN = ", ".join(f"CASE WHEN NOT hidden THEN {c} END AS {c}" for c in ("rate", "lower", "upper"))
_NOW = "route IN ('score_today', 'pending')"
_SEEN = f"""SELECT a.no, c.cohort, a.as_of, a.route, a.churned AS own, a.outcome_observed_on AS own_on, c.via, count(*) FILTER (f.seen_on <= a.as_of OR a.{_NOW}) AS n, CAST(coalesce(sum(f.churned) FILTER (f.seen_on <= a.as_of OR a.{_NOW}), 0) AS BIGINT) AS lapses
 FROM z a JOIN coh c ON c.node = a.no JOIN fact f ON f.cohort = c.cohort WHERE a.no % 100 = 0 GROUP BY ALL"""
_LESS = f"SELECT s.no, s.cohort, s.route, cnt.size, n - k AS n, lapses_ - k * own AS lapses, hid.hidden FROM (SELECT * EXCLUDE (lapses), lapses AS lapses_, CAST(via = 'member' AND ({_NOW} OR coalesce(own_on <= as_of, FALSE)) AS BIGINT) AS k FROM ({_SEEN})) s JOIN cnt ON cnt.cohort = s.cohort JOIN hid ON hid.cohort = s.cohort"
_VIS = "coalesce(b.outcome_observed_on <= a.as_of OR a.route IN ('score_today', 'pending'), FALSE)"
_COUNTS = {"Subscription": "g", "Renewal": "g", "Plan": R._values(R.PLANS, "plan, price, cap"), "Incident": "incident", "PricingChange": "change", "LimitHit": "n_hit", "OverageChange": "n_set", "OverageCharge": "n_chg", "Ticket": "n_tick", "BillingEvent": "n_bill"}
_EDGES = {"HAS_RENEWAL": ("g", "renewal_id"), "ON_PLAN": ("g", "plan_tier"), "HIT_LIMIT": ("n_hit", "node_id"), "CHANGED_OVERAGE": ("n_set", "node_id"), "CHARGED_OVERAGE": ("n_chg", "node_id"), "OPENED": ("n_tick", "node_id"), "BILLED": ("n_bill", "node_id"), "EXPOSED_TO": ("e_exp", "node_id"), "FIRST_RENEWAL_AFTER": ("e_first", "change_id")}
#: Paths to lapses from the stated set, as similar_summary reads them.
LAPSES_OF_STATED = KNN_ALL.replace("WITH snap", "WITH RECURSIVE snap", 1) + """, w AS MATERIALIZED (SELECT src, dst, floor(sqrt(d2_q / 1e9) * 1e6 + 0.5) / 1e6 AS w FROM sim), p(source, node, cost) USING KEY (source, node) AS (SELECT no, no, 0.0::DOUBLE FROM z WHERE no % 100 = 0
 UNION SELECT p.source, w.dst, min(p.cost + w.w) FROM p JOIN w ON w.src = p.node LEFT JOIN recurring.p k ON k.source = p.source AND k.node = w.dst WHERE k.cost IS NULL OR p.cost + w.w < k.cost GROUP BY p.source, w.dst)
 SELECT source, node, floor(cost * 1e4 + 0.5) / 1e4 AS path_dist, coalesce(b.outcome_observed_on <= a.as_of, FALSE) AS known FROM p JOIN z b ON b.no = node AND b.churned = 1 JOIN z a ON a.no = source WHERE source <> node"""

ORACLE = {
    "graph_node_counts": f"{GRAPH} " + " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n, count(*) AS ids FROM {t}" for n, t in _COUNTS.items()),
    "graph_edge_counts": f"{GRAPH} " + " UNION ALL ".join(f"SELECT '{n}' AS rel_type, count(*) AS n, count(DISTINCT {c}) AS targets FROM {t}" for n, (t, c) in _EDGES.items()) + f" UNION ALL SELECT 'CUT_CAP', {len(R.CHANGES) * len(R.PLANS)}, {len(R.PLANS)}",
    "graph_describe": _describe_sql(),
    "graph_split": f"{GRAPH} SELECT 'LimitHit' AS label, sid, count(*) AS n FROM n_hit GROUP BY sid UNION ALL SELECT 'Ticket', sid, count(*) FROM n_tick GROUP BY sid",
    "graph_routes": f"{GRAPH} SELECT route, count(*) AS n, CAST(sum(churned) AS BIGINT) AS lapses FROM g GROUP BY route",
    "graph_renewals_per_subscription": f"{GRAPH} SELECT n AS degree, count(*) AS nodes FROM (SELECT sid, count(*) AS n FROM g GROUP BY sid) GROUP BY n",
    "graph_pit_limit_hits": _pit_sql("HIT_LIMIT", 14, "limit_hits_14d"),
    "graph_pit_tickets": _pit_sql("OPENED", 90, "support_tickets_90d"),
    "graph_pit_incidents": _pit_sql("EXPOSED_TO", 28, "incident_exposed_28d"),
    "graph_pit_overage": f"{GRAPH} SELECT renewal_id, overage_usd_28d AS gold, floor(CAST(coalesce(sum(CASE WHEN day > as_of - 28 AND day <= as_of THEN micro END), 0) AS DOUBLE) / 1000000.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS pit FROM g {_L} 'CHARGED_OVERAGE' GROUP BY renewal_id, overage_usd_28d",
    "graph_pit_toggled_off": f"{GRAPH} SELECT renewal_id, overage_toggled_off AS gold, CAST(coalesce(max(CASE WHEN day <= as_of AND state = 'disabled' THEN day END) > max(CASE WHEN day <= as_of AND state = 'enabled' THEN day END), FALSE) AS BIGINT) AS pit FROM g {_L} 'CHANGED_OVERAGE' GROUP BY renewal_id, overage_toggled_off",
    "graph_pit_first_after": f"{GRAPH} SELECT g.renewal_id, first_renewal_after_change AS gold, CAST(count(f.day) > 0 AS BIGINT) AS pit, CAST({_I('f.day <= as_of')} > 0 AS BIGINT) AS as_of_filtered, {_I('f.known <> (f.day <= as_of)')} AS flag_inconsistent FROM g LEFT JOIN e_first f ON f.renewal_id = g.renewal_id GROUP BY g.renewal_id, first_renewal_after_change",
    "graph_billed": f"{GRAPH} SELECT renewal_id, route, {_I('day <= as_of')} AS on_or_before, {_I(_SCHEDULED)} AS scheduled, {_I('NOT oe')} AS not_outcome_evidence FROM g {_L} 'BILLED' GROUP BY renewal_id, route",
    "graph_leak_surface": f"{GRAPH} SELECT rel AS rel_type, CAST(sum(n) AS BIGINT) AS edges, count(*) AS renewals FROM (SELECT rel, sid, count(*) AS n FROM e JOIN g USING (sid) WHERE day > as_of GROUP BY rel, sid) GROUP BY rel",
    "graph_first_after_unknown": f"{GRAPH} SELECT change_id, count(*) AS edges FROM e_first WHERE NOT known GROUP BY change_id",
    "graph_evidence": f"""{GRAPH} SELECT renewal_id, strftime(day, '%Y-%m-%d') AS event_date, rel AS relation, node_id AS target_id, FALSE AS declared_exception FROM {_KEEP}
 UNION ALL SELECT f.renewal_id, strftime(f.day, '%Y-%m-%d'), 'FIRST_RENEWAL_AFTER', change_id, NOT known FROM e_first f JOIN g ON g.renewal_id = f.renewal_id
 UNION ALL SELECT renewal_id, strftime(effective_date, '%Y-%m-%d'), 'CUT_CAP', change_id, FALSE FROM g, change WHERE effective_date <= as_of AND plan_tier IN ({', '.join(f"'{p[0]}'" for p in R.PLANS)})""",
    "graph_evidence_hidden": f"{GRAPH} SELECT renewal_id, count(day) AS hidden FROM g LEFT JOIN e ON e.sid = g.sid AND day > as_of GROUP BY renewal_id",
    "graph_header": f"{GRAPH} SELECT renewal_id, sid, plan_tier, strftime(as_of, '%Y-%m-%d') AS as_of, strftime(renewal_date, '%Y-%m-%d') AS renewal_date, route, city FROM g",
    "similar_edges": f"{KNN} SELECT src, dst, d2_q, rank, mutual FROM s1",
    "similar_cut_row": f"{_knn_sql(K + 1)} SELECT src, max(d2_q) FILTER (rank = {K}) AS kth, max(d2_q) FILTER (rank = {K + 1}) AS beyond, least({K}, count(*)) AS k_eff, coalesce(max(d2_q) FILTER (rank = {K}) = max(d2_q) FILTER (rank = {K + 1}), FALSE) AS tied FROM s1 GROUP BY src",
    "similar_first_known": f"{KNN} SELECT src, nth, dst, rank FROM (SELECT src, dst, rank, coalesce(b.outcome_observed_on <= a.as_of, FALSE) AS known, CAST(sum(CAST(coalesce(b.outcome_observed_on <= a.as_of, FALSE) AS INT)) OVER (PARTITION BY src ORDER BY rank) AS BIGINT) AS nth FROM s1 JOIN z a ON a.no = src JOIN z b ON b.no = dst) WHERE known AND nth <= 3",
    "similar_out_degree": f"{KNN} SELECT n AS degree, count(*) AS nodes FROM (SELECT no, count(dst) AS n FROM z LEFT JOIN s1 ON src = no WHERE no % 100 = 0 GROUP BY no) GROUP BY n",
    "similar_checks": f"{KNN} SELECT count(*) AS edges, CAST(sum(CAST(a.plan_tier <> b.plan_tier AS INT)) AS BIGINT) AS cross_plan, CAST(sum(CAST(b.route <> 'model' AS INT)) AS BIGINT) AS dst_not_model, CAST(sum(CAST(src = dst AS INT)) AS BIGINT) AS self_loops, CAST(sum(CAST(mutual AS INT)) AS BIGINT) AS mutual_flagged, count(DISTINCT dst) AS distinct_dst FROM s1 JOIN z a ON a.no = src JOIN z b ON b.no = dst",
    "similar_mutual": f"{KNN_ALL} SELECT count(*) AS mutual_edges FROM s1 a JOIN sim b ON a.src = b.dst AND a.dst = b.src",
    "similar_max_in_degree": f"{KNN_ALL} SELECT dst AS no, count(*) AS in_degree FROM s1 GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 1",
    "similar_visible": f"{KNN} SELECT src, rank, dst, CASE WHEN {_VIS} THEN b.outcome ELSE 'not_yet_observed' END AS outcome, CASE WHEN {_VIS} THEN strftime(b.outcome_observed_on, '%Y-%m-%d') END AS outcome_observed_on FROM s1 JOIN z a ON a.no = src JOIN z b ON b.no = dst",
    "similar_nearest_lapses": LAPSES_OF_STATED.replace("FROM z WHERE no % 100 = 0\n UNION", "FROM z\n UNION", 1),
    "similar_top_k": f"{KNN} SELECT src, rank, dst, floor(sqrt(d2) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS dist, b.outcome, strftime(b.outcome_observed_on, '%Y-%m-%d') AS observed_on FROM s1 JOIN z b ON b.no = dst",
    "similar_invariants": f"""{KNN_ALL}, o AS (SELECT *, lag(d2_q) OVER w AS pq, lag(dst) OVER w AS pd, lag(rank) OVER w AS pr FROM sim WINDOW w AS (PARTITION BY src ORDER BY rank)), dgr AS (SELECT z.no, z.route, count(s.dst) AS n, (SELECT count(*) FROM z c WHERE c.route = 'model' AND c.plan_tier = z.plan_tier) AS offered FROM z LEFT JOIN sim s ON s.src = z.no WHERE z.plan_tier IS NOT NULL GROUP BY z.no, z.route, z.plan_tier)
 SELECT count(*) FILTER (pq > d2_q OR pq = d2_q AND pd >= dst) AS "order", count(*) FILTER (rank <> coalesce(pr, 0) + 1) AS gaps, (SELECT count(*) FILTER (n <> least({K}, offered - CAST(route = 'model' AS INT))) FROM dgr) AS degree, (SELECT count(*) FILTER (mutual <> EXISTS (SELECT 1 FROM sim b WHERE b.src = a.dst AND b.dst = a.src)) FROM sim a) AS mutual FROM o""",
    "similar_sharing": f"{KNN} SELECT src, route, count(*) AS renewals FROM (SELECT DISTINCT a.src, b.src AS other FROM s1 a JOIN s1 b ON a.dst = b.dst AND a.src <> b.src) JOIN z ON no = other GROUP BY src, route",
    "similar_shares": _shares_sql(),
    "graph_exposure_by_plan": f"{GRAPH} SELECT incident_id, plan_tier, count(*) AS exposed, count(*) FILTER (route = 'model') AS model, CAST(coalesce(sum(CASE WHEN route = 'model' THEN churned END), 0) AS BIGINT) AS voluntary_lapses, count(*) FILTER (route = 'cancel_flow') AS cancel_flow, count(*) FILTER (route = 'dunning') AS dunning FROM (SELECT DISTINCT node_id AS incident_id, renewal_id, plan_tier, route, churned FROM g JOIN e_exp x ON x.sid = g.sid AND x.day > as_of - 28 AND x.day <= as_of) GROUP BY incident_id, plan_tier",
    "graph_exposure_naive": f"{GRAPH} SELECT incident_id, count(*) AS naive_additional FROM (SELECT sid, node_id AS incident_id, min(day) AS f FROM e_exp GROUP BY 1, 2) JOIN g USING (sid) WHERE f > as_of GROUP BY incident_id",
    "graph_exposure_change": f"{GRAPH} SELECT change_id, plan_tier, route, known AS known_by_as_of, count(*) AS renewals, CAST(sum(churned) AS BIGINT) AS voluntary_lapses FROM g JOIN e_first f ON f.renewal_id = g.renewal_id GROUP BY ALL",
    "graph_motif": f"{GRAPH} SELECT count(*) AS renewals, CAST(coalesce(sum(churned), 0) AS BIGINT) AS lapses FROM g WHERE route = 'model' AND EXISTS (SELECT 1 FROM n_hit h JOIN n_set o ON h.sid = o.sid WHERE h.sid = g.sid AND o.state = 'disabled' AND h.day <= o.day AND o.day <= g.as_of)",
    "graph_first_after_by_plan": f"{GRAPH} SELECT plan_tier, renewal_id IN (SELECT renewal_id FROM e_first) AS first_after, count(*) AS n, CAST(sum(churned) AS BIGINT) AS lapses FROM g WHERE route = 'model' GROUP BY 1, 2",
    "graph_pruned": f"{GRAPH}, kept AS (SELECT rel, node_id FROM {_KEEP}) SELECT rel AS kind, count(*) AS n FROM kept GROUP BY rel UNION ALL SELECT CASE rel WHEN 'HIT_LIMIT' THEN 'LimitHit' WHEN 'CHANGED_OVERAGE' THEN 'OverageChange' WHEN 'CHARGED_OVERAGE' THEN 'OverageCharge' WHEN 'OPENED' THEN 'Ticket' WHEN 'BILLED' THEN 'BillingEvent' ELSE 'Incident' END, count(DISTINCT node_id) FROM kept GROUP BY rel",
    "graph_pruned_proof": _proof_sql(),
    "similar_route_leak": f"{KNN_ALL} SELECT no IN (SELECT dst FROM s1) AS incoming, count(*) AS n, CAST(sum(churned) AS BIGINT) AS lapses FROM z WHERE route = 'model' GROUP BY 1",
    "similar_components": KNN_ALL.replace("WITH snap", "WITH RECURSIVE snap", 1) + ", l AS (SELECT src AS a, dst AS b FROM sim UNION SELECT dst, src FROM sim), r(x, y) AS (SELECT a, a FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y) SELECT c AS component, count(*) AS size FROM (SELECT x, min(y) AS c FROM r GROUP BY x) GROUP BY c",
    "cohort_members": f"{COHORT} SELECT node, cohort, size, via FROM coh",
    "cohort_assigned": f"{COHORT} SELECT node, cohort FROM coh WHERE via = 'nearest'",
    "cohort_profile": f"{COHORT} SELECT cohort, feature, mean_z, place FROM prof",
    "cohort_quality": f"""{COHORT}, ins AS (SELECT CAST(sum(CASE WHEN x.cohort = y.cohort THEN w END) AS DOUBLE) AS i, CAST(sum(w) AS DOUBLE) AS m FROM lk JOIN mem x ON x.node = a JOIN mem y ON y.node = b), sq AS (SELECT CAST(sum(deg * deg) AS DOUBLE) AS s FROM (SELECT sum(deg) AS deg FROM dg JOIN mem USING (node) GROUP BY cohort)),
 pur AS (SELECT CAST(sum(top) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS plan_purity, count(*) AS cohorts FROM (SELECT cohort, max(size) AS top, sum(size) AS n FROM cnt GROUP BY cohort)) SELECT floor((i / m - s / (4 * m * m)) * 1e9 + 0.5) / 1e9 AS modularity, plan_purity, cohorts FROM ins, sq, pur""",
    "cohort_list": f"""{COHORT}, told AS (SELECT cohort, string_agg(CASE WHEN mean_z > 0 THEN 'higher ' ELSE 'lower ' END || feature, ', ' ORDER BY place) AS t FROM prof WHERE place <= 2 GROUP BY cohort), ass AS (SELECT cohort, count(*) AS assigned FROM coh WHERE via = 'nearest' GROUP BY cohort)
 SELECT cohort, plan || CASE WHEN hidden THEN ': withheld' ELSE ': ' || coalesce(t, 'no distinguishing feature') END AS name, CASE WHEN NOT hidden THEN size END AS size, CASE WHEN NOT hidden THEN lapses END AS lapses, {_SHOWN}, CASE WHEN assigned >= {LEAST} THEN assigned END AS assigned, hidden
 FROM (SELECT *, {rates_sql('size', 'lapses')} FROM cnt JOIN hid USING (cohort) LEFT JOIN told USING (cohort) LEFT JOIN ass USING (cohort))""",
    "cohort_seen": f"{COHORT} SELECT no, cohort, CASE WHEN {_NOW} THEN 'today' ELSE 'source_as_of' END AS visibility, CASE WHEN NOT hidden THEN n END AS n, CASE WHEN NOT hidden THEN lapses END AS lapses, {_SHOWN}, hidden FROM (SELECT no, cohort, route, n, lapses, hidden OR n < {LEAST} OR (size - n > 0 AND size - n < {LEAST}) AS hidden, {rates_sql('n', 'lapses')} FROM ({_LESS}))",
    "similar_within_two": f"{KNN}, h AS (SELECT no AS start, no AS node, 0 AS d FROM z WHERE no % 100 = 0 UNION ALL SELECT src, dst, 1 FROM s1 UNION ALL SELECT a.src, b.dst, 2 FROM s1 a JOIN sim b ON b.src = a.dst) SELECT start, d AS depth, count(*) AS n FROM (SELECT start, node, min(d) AS d FROM h GROUP BY 1, 2) GROUP BY 1, 2",
}
