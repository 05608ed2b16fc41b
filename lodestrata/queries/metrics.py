"""Rates, dense answers, disclosure control, search and leakage over the renewal graph, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.disclosure import protect, suppress
from lodestrata.operators.leakage import cross_validated, neighbour_rate
from lodestrata.operators.search import ID_NOISE, STOP_WORDS, build_index, day_words, search
from lodestrata.operators.similarity import nearest
from lodestrata.operators.stats import auc, banded, cube_counts, dense, rates
from lodestrata.operators.temporal import within
from lodestrata.queries import graph as G
from lodestrata.queries import renewals as R
from lodestrata.sources.files import inline
from lodestrata.sources.tables import table

BANDS = (0, 1, 3, 6, 10)
BAND_NAMES = ("0", "1-2", "3-5", "6-9", "10+")
PLAN_NAMES = tuple(p[0] for p in R.PLANS)
ROUTES = (("model", "renewed"), ("model", "voluntary_lapse"), ("cancel_flow", "voluntary_lapse"), ("dunning", "involuntary_lapse"), ("score_today", "pending"), ("pending", "pending"))
SEARCHES = ("inc-002", "weekly caps", "incident 2025", "sub_00000100", "outag", "cap", "show me the outage in march", "2026-01-10", "sub_00000100:2025")
MISSPELT = ("weekli", "incidnet", "outtage")
#: What lapse rates may be asked by: these keys in any pair, with filters ...
KEYS = {"plan_tier": PLAN_NAMES, "first_renewal_after_change": ("0", "1"), "band": BAND_NAMES}
#: ... or these flags, alone or together, without filters.
FLAGS = {"incident_exposed_28d": ("0", "1"), "overage_toggled_off": ("0", "1")}
EXPOSED_ROUTES = ("model", "cancel_flow", "dunning", "current")


def _banded(spark: SparkSession, d: str) -> DataFrame:
    return G.renewals(spark, d).withColumn("band", banded(F.col("limit_hits_14d"), BANDS)).withColumn("exposed", F.col("incident_exposed_28d").cast("string"))


def lapse_rate(spark: SparkSession, d: str) -> DataFrame:
    """Lapse rate with interval by plan and band of hits: every cell of the grid, empty ones too."""
    counts = {"n": F.count(F.lit(1)), "lapses": F.sum("churned")}
    return rates(dense(_banded(spark, d).where("route = 'model'"), {"plan_tier": PLAN_NAMES, "band": BAND_NAMES}, counts), "n", "lapses")


def lapse_rate_by(spark: SparkSession, d: str, by: tuple[str, ...] = (), plan_tier: str | None = None, first_renewal_after_change: int | None = None, hits: tuple[int, int | None] | None = None) -> DataFrame:
    """Lapse rate of reference renewals by up to two keys, filtered: every cell of the keys' domains, empty ones too.

    hits: least and greatest number of hits, which must be one of the bands. Refused (ValueError): unknown keys, more than
    two, flags together with other keys or filters, a range that is no band. A flag answer that could be cut by other
    keys would give away cells that no answer shows.
    """
    only = {"plan_tier": plan_tier, "first_renewal_after_change": None if first_renewal_after_change is None else str(int(first_renewal_after_change)), "band": None}
    if hits is not None:
        ends = [*BANDS[1:], None]
        fits = [n for n, lo, end in zip(BAND_NAMES, BANDS, ends, strict=True) if hits == (lo, None if end is None else end - 1)]
        if not fits:
            raise ValueError(f"{hits} is not one of the bands {', '.join(BAND_NAMES)}")
        only["band"] = fits[0]
    only = {k: v for k, v in only.items() if v is not None}
    if stray := [k for k in by if k not in KEYS | FLAGS]:
        raise ValueError(f"unknown keys: {', '.join(stray)}")
    if len(set(by)) != len(by) or len(by) > 2:
        raise ValueError("at most two different keys")
    if any(k in FLAGS for k in by) and (only or any(k in KEYS for k in by)):
        raise ValueError("incident_exposed_28d and overage_toggled_off are asked for alone or together, without filters")
    if bad := [v for k, v in only.items() if v not in KEYS[k]]:
        raise ValueError(f"unknown value: {bad[0]}")
    rows = _banded(spark, d).where("route = 'model'").select("churned", *(F.col(k).cast("string").alias(k) for k in KEYS | FLAGS))
    for k, v in only.items():
        rows = rows.where(F.col(k) == v)
    domains = {k: ((only[k],) if k in only else (KEYS | FLAGS)[k]) for k in by}
    counts = {"n": F.count(F.lit(1)), "lapses": F.coalesce(F.sum("churned"), F.lit(0))}
    answer = dense(rows, domains, counts) if domains else rows.agg(*(c.alias(n) for n, c in counts.items()))
    return rates(answer, "n", "lapses")


#: The questions whose answers the query lists.
ASKED: tuple[tuple[tuple[str, ...], dict], ...] = (
    ((), {}), (("plan_tier",), {}), (("first_renewal_after_change",), {}), (("band",), {}), (("incident_exposed_28d",), {}), (("overage_toggled_off",), {}),
    (("plan_tier", "first_renewal_after_change"), {}), (("first_renewal_after_change", "band"), {}), (("incident_exposed_28d", "overage_toggled_off"), {}),
    (("band",), {"plan_tier": "pro"}), (("plan_tier", "band"), {"hits": (3, 5)}), ((), {"plan_tier": "ultra", "first_renewal_after_change": 1}), (("plan_tier",), {"first_renewal_after_change": 0, "hits": (10, None)}),
)


def lapse_rates_asked(spark: SparkSession, d: str) -> DataFrame:
    """The answers to several questions, each with its number."""
    out = None
    for i, (by, only) in enumerate(ASKED):
        cell = F.concat_ws("/", *(F.col(k) for k in by)) if by else F.lit("")
        one = lapse_rate_by(spark, d, by, **only).select(F.lit(i).alias("question"), cell.alias("cell"), "n", "lapses", "rate", "lower", "upper")
        out = one if out is None else out.unionByName(one)
    return out


def _graph_population(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("route").isin("score_today", "pending"), "current").otherwise(F.col("route"))
    return G.gold(spark, d).withColumn("shown_route", route)


def exposure_cells(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, plan_tier, route, renewals, lapses): every incident and change, plan and route, empty cells too. An incident
    counts renewals with a day of it in their window, a change those that come first after it."""
    g = _graph_population(spark, d)
    e = G.rel(spark, d, "EXPOSED_TO").select(F.col("src").alias("sid"), F.col("dst").alias("id"), "event_date")
    by_incident = g.join(e, "sid").where(within("event_date", "as_of", 28)).select(F.lit("incident").alias("kind"), "id", "renewal_id", "plan_tier", F.col("shown_route").alias("route"), "churned").distinct()
    f = G.rel(spark, d, "FIRST_RENEWAL_AFTER").select(F.col("src").alias("renewal_id"), F.col("dst").alias("id"))
    by_change = g.join(f, "renewal_id").select(F.lit("change").alias("kind"), "id", "renewal_id", "plan_tier", F.col("shown_route").alias("route"), "churned")
    rows = by_incident.unionByName(by_change).withColumn("entity", F.concat_ws("/", "kind", "id"))
    entities = [f"incident/{i[0]}" for i in R.INCIDENTS] + [f"change/{c[0]}" for c in R.CHANGES]
    lapses = F.coalesce(F.sum(F.when(F.col("route") == "model", F.col("churned"))), F.lit(0))
    grid = dense(rows, {"entity": entities, "plan_tier": PLAN_NAMES, "route": EXPOSED_ROUTES}, {"renewals": F.count(F.lit(1)), "lapses": lapses})
    return grid.select(F.split("entity", "/")[0].alias("kind"), F.split("entity", "/")[1].alias("id"), "plan_tier", "route", "renewals", "lapses")


def exposure_protected(spark: SparkSession, d: str) -> DataFrame:
    """The same for publication: each entity's total is always shown, and cells so that no hidden small count follows from
    row, column and overall sums, proved for each entity; lapses go with their cell and are hidden below five."""
    tables: dict[tuple, dict] = {}
    for r in exposure_cells(spark, d).orderBy("kind", "id", "plan_tier", "route").collect():  # entities x plans x routes, all fixed
        tables.setdefault((r.kind, r.id), {})[r.plan_tier, r.route] = (r.renewals, r.lapses)
    out = []
    for (kind, id_), cells in tables.items():
        counts = {k: n for k, (n, _) in cells.items()}
        groups = [[k for k in cells if k[0] == p] for p in PLAN_NAMES] + [[k for k in cells if k[1] == r] for r in EXPOSED_ROUTES] + [list(cells)]
        hidden = protect(counts, groups)
        for (plan, route), (n, l) in cells.items():
            hide = hidden is None or (plan, route) in hidden
            out.append((kind, id_, plan, route, None if hide else n, None if hide or 0 < l < 5 or 0 < n - l < 5 else l, hide, sum(counts.values())))
    return inline(spark, out, "kind string, id string, plan_tier string, route string, renewals bigint, lapses bigint, hidden boolean, total bigint")


def population_counts(spark: SparkSession, d: str) -> DataFrame:
    """(family, cell, n, lapses): the counts all answers about the graph's renewals come from: the cube of the keys, that of
    the flags, routes with outcomes, and exposures."""
    g = G.gold(spark, d).withColumn("band", banded(F.col("limit_hits_14d"), BANDS))
    model = g.where("route = 'model'")
    counts = {"n": F.count(F.lit(1)), "lapses": F.sum("churned")}

    def family(name: str, rows: DataFrame, keys) -> DataFrame:
        return rows.select(F.lit(name).alias("family"), F.concat_ws("/", *(F.coalesce(F.col(k), F.lit("none")) for k in keys)).alias("cell"), "n", "lapses")

    out = family("keys", cube_counts(model.select(*KEYS, "churned"), list(KEYS), counts), KEYS)
    out = out.unionByName(family("flags", cube_counts(model.select(*FLAGS, "churned"), list(FLAGS), counts), FLAGS))
    out = out.unionByName(family("routes", g.groupBy("plan_tier", "route", "outcome").agg(*(c.alias(n) for n, c in counts.items())), ("plan_tier", "route", "outcome")))
    exposed = exposure_cells(spark, d).where("renewals > 0").withColumnsRenamed({"renewals": "n"})
    return out.unionByName(family("exposure", exposed, ("kind", "id", "plan_tier", "route")))


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    """Six fixed (route, outcome) rows per plan, and for all plans."""
    g = G.renewals(spark, d).withColumn("pair", F.concat_ws("/", "route", "outcome")).select("pair", F.explode(F.array("plan_tier", F.lit("all"))).alias("plan_tier"))
    grid = dense(g, {"plan_tier": (*PLAN_NAMES, "all"), "pair": ["/".join(r) for r in ROUTES]}, {"n": F.count(F.lit(1))})
    return grid.select("plan_tier", F.split("pair", "/")[0].alias("route"), F.split("pair", "/")[1].alias("outcome"), "n")


def lapse_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every box of plan x exposure x band, * for all."""
    rows = _banded(spark, d).where("route = 'model'").select("plan_tier", "exposed", "band", "churned")
    return cube_counts(rows, ["plan_tier", "exposed", "band"], {"n": F.count(F.lit(1)), "lapses": F.sum("churned")})


def _cells(spark: SparkSession, d: str) -> dict:
    rows = dense(G.renewals(spark, d), {"plan_tier": PLAN_NAMES, "route": sorted({r for r, _ in ROUTES})}, {"n": F.count(F.lit(1))}).collect()  # plans x routes
    return dict(sorted(((r.plan_tier, r.route), r.n) for r in rows))


def suppressed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Plan x route counts with small cells and their complements hidden."""
    cells = _cells(spark, d)
    hidden = suppress(cells, [lambda k: ("plan", k[0]), lambda k: ("route", k[1])])
    return inline(spark, [(p, r, None if (p, r) in hidden else n, (p, r) in hidden) for (p, r), n in cells.items()], "plan_tier string, route string, n bigint, suppressed boolean")


def protected_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same, with a proof that no hidden small cell follows from the sums that are shown."""
    cells = _cells(spark, d)
    groups = [[k for k in cells if k[0] == p] for p in PLAN_NAMES] + [[k for k in cells if k[1] == r] for r in sorted({k[1] for k in cells})]
    hidden = protect(cells, groups)
    return inline(spark, [(p, r, None if hidden is None or (p, r) in hidden else n, hidden is None or (p, r) in hidden) for (p, r), n in cells.items()], "plan_tier string, route string, n bigint, suppressed boolean")


def feature_cards(spark: SparkSession, d: str) -> DataFrame:
    """Range and fill of each feature beside its declared window, and the renewals of the graph whose value rests on a
    declared exception: an event after their as_of."""
    windows = {f: int(f.rsplit("_", 1)[1][:-1]) if f.rsplit("_", 1)[-1][:-1].isdigit() else 0 for f in R.FEATURES}
    g = G.renewals(spark, d)
    stats = g.agg(*(x for f in R.FEATURES for x in (F.min(F.col(f).cast("double")).alias(f"lo_{f}"), F.max(F.col(f).cast("double")).alias(f"hi_{f}"), F.sum((F.col(f) != 0).cast("bigint")).alias(f"nz_{f}"))))
    long = stats.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(windows[f]).cast("bigint").alias("window_days"), F.col(f"lo_{f}").alias("low"), F.col(f"hi_{f}").alias("high"), F.col(f"nz_{f}").alias("nonzero")) for f in R.FEATURES))))
    late = G.rel(spark, d, "FIRST_RENEWAL_AFTER").where("known_by_as_of = false").agg(F.countDistinct("src").alias("late"))
    return long.crossJoin(F.broadcast(late)).select("*", F.when(F.col("feature") == "first_renewal_after_change", F.col("late")).otherwise(0).cast("bigint").alias("exceptions")).drop("late")  # one row


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, text) of what can be searched for."""
    g = G.gold(spark, d)
    row = lambda kind, id_, text: (F.lit(kind).alias("kind"), F.col(id_).alias("id"), text.alias("text"))
    out = g.select(*row("Renewal", "renewal_id", F.concat_ws(" ", "sid", "user_name"))).unionByName(g.select(*row("Subscription", "sid", F.concat_ws(" ", "user_name"))))
    out = out.unionByName(R.changes(spark).select(*row("PricingChange", "change_id", F.concat_ws(" ", F.lit("pricing price change cut cap"), day_words(F.col("effective_date"), F.col("effective_date")), "description"))))
    return out.unionByName(R.incidents(spark).select(*row("Incident", "incident_id", F.concat_ws(" ", F.lit("incident outage"), day_words(F.col("starts_on"), F.col("ends_on"))))))


KINDS = ("Renewal", "Subscription", "PricingChange", "Incident")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return G._once(spark, d, "search", lambda: build_index(entities(spark, d), "kind", "id", F.col("text")))


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact and prefix matches over an index that is kept for the session."""
    return search(_index(spark, d), inline(spark, [(s,) for s in SEARCHES], "query string"), "query", kinds=KINDS)


def entity_search_misspelt(spark: SparkSession, d: str) -> DataFrame:
    return search(_index(spark, d), inline(spark, [(s,) for s in MISSPELT], "query string"), "query", kinds=KINDS)


def similar_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per source: neighbours whose outcome may be seen, lapses among them with interval, the path distance to the nearest
    lapse known by its as_of, and the feature that tells it most from its nearest neighbour."""
    v = G.similar_visible(spark, d).where("outcome <> 'not_yet_observed'")
    g = v.groupBy("src").agg(F.count(F.lit(1)).alias("visible"), F.sum((F.col("outcome") == "voluntary_lapse").cast("bigint")).alias("lapsed"))
    paths = G.lapse_paths(spark, d, G.scaled(spark, d).where("no % 100 = 0")).where("known").groupBy(F.col("source").alias("src")).agg(F.min("path_dist").alias("nearest_known_lapse"))
    first = G.similar(spark, d).where("rank = 1 and src % 100 = 0").select("src", "dst").join(G.similar_shares(spark, d).where("place = 1"), ["src", "dst"]).select("src", F.col("feature").alias("leading_feature"), F.col("share").alias("leading_share"))
    return rates(g, "visible", "lapsed").join(paths, "src", "left").join(first, "src", "left")


def leakage(spark: SparkSession, d: str) -> DataFrame:
    """AUC of the neighbour lapse rate in four variants: with the row itself, as of today, only what was known, and
    of a random score."""
    e = G.similar_all(spark, d).select("src", "dst")
    z = G.scaled(spark, d).where("route = 'model'")
    labels = z.select(F.col("no").alias("dst"), F.col("churned").alias("label"), "outcome_observed_on")
    cut = z.select(F.col("no").alias("src"), F.col("as_of").alias("cut"), "churned")
    selves = cut.select("src", F.col("src").alias("dst"))
    variants = {
        "self_inclusive": neighbour_rate(e.unionByName(selves.join(e.select("src").distinct(), "src", "left_semi")), labels, "label"),
        "as_of_today": neighbour_rate(e, labels, "label"),
        "known_by_as_of": neighbour_rate(e.join(cut.select("src", "cut"), "src"), labels, "label", F.col("outcome_observed_on") <= F.col("cut"), 0.1, 5.0),
        "random": e.select("src").distinct().withColumn("score", F.pmod(F.col("src") * 7919, F.lit(1000)) / 1000.0),
    }
    scored = None
    for name, s in variants.items():
        part = s.join(cut.select("src", "churned"), "src").select(F.lit(name).alias("variant"), (F.floor(F.col("score") * 1e9 + 0.5) / 1e9).alias("score"), "churned")
        scored = part if scored is None else scored.unionByName(part)
    return auc(scored, "score", "churned", ["variant"])


def overage_auc(spark: SparkSession, d: str) -> DataFrame:
    """AUC of single features for the outcome, ties with average ranks."""
    g = G.renewals(spark, d).where("route in ('model', 'dunning')")
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("score")) for c in R.FEATURES))
    return auc(g.select(F.inline(pairs), (F.col("outcome") != "renewed").cast("bigint").alias("label")), "score", "label", ["feature"])


def lapse_model(spark: SparkSession, d: str) -> DataFrame:
    """Held-out AUC of a logistic regression for lapses, five stratified folds three times over: on the features alone, and
    with the lapse rate of neighbours of the training folds, as of today and as known by each row's as_of."""
    zs = [f"z_{c}" for c in R.FEATURES]
    z = G.scaled(spark, d).where("route = 'model'")
    rows = z.select("no", F.col("churned").alias("label"), *zs)
    e = G.similar_all(spark, d).select("src", "dst")
    known = e.join(z.select(F.col("no").alias("src"), "as_of"), "src").join(z.select(F.col("no").alias("dst"), "outcome_observed_on"), "dst").where("outcome_observed_on <= as_of").select("src", "dst")
    scored = cross_validated(rows, "no", zs, "label", {"features": None, "as_of_today": e, "known_by_as_of": known})
    per = auc(scored, "score", "label", ["variant", "repeat", "fold"])
    return per.groupBy("variant").agg(F.count("auc").alias("folds"), F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd"))


def embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the same label for the stated query set (vec_id divisible by 100)."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    found = nearest(e.where("vec_id % 100 = 0"), e, "label", "vec_id", "embedding", 64, 10)
    return found.select("src", "dst", F.floor(F.col("d2") * 1e6 + 0.5).alias("d2_e6"), F.col("rank").cast("bigint").alias("rank"))


def co_purchase(spark: SparkSession, d: str) -> DataFrame:
    """A pattern over the order graph: customers and suppliers of one nation in one order, by region."""
    t = lambda n: table(spark, d, n)
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    both = o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return both.join(where, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.countDistinct("o_orderkey").alias("orders"))


QUERIES = {f.__name__: f for f in (lapse_rate, lapse_rates_asked, population_counts, exposure_cells, exposure_protected, entity_search_misspelt, route_counts, lapse_cube, suppressed_cells, protected_cells, feature_cards, entity_search, similar_summary, leakage, overage_auc, lapse_model, embedding_neighbours, co_purchase)}

_BAND = "CASE WHEN limit_hits_14d < 1 THEN '0' WHEN limit_hits_14d < 3 THEN '1-2' WHEN limit_hits_14d < 6 THEN '3-5' WHEN limit_hits_14d < 10 THEN '6-9' ELSE '10+' END"


_rates = G.rates_sql


def _asked_sql() -> str:
    out = []
    lists = KEYS | FLAGS
    for i, (by, only) in enumerate(ASKED):
        where = ["route = 'model'"]
        if "plan_tier" in only:
            where.append(f"plan_tier = '{only['plan_tier']}'")
        if "first_renewal_after_change" in only:
            where.append(f"first_renewal_after_change = {only['first_renewal_after_change']}")
        if "hits" in only:
            lo, hi = only["hits"]
            where.append(f"limit_hits_14d >= {lo}" + ("" if hi is None else f" AND limit_hits_14d <= {hi}"))
        bands = [n for n, lo in zip(BAND_NAMES, BANDS, strict=True) if "hits" not in only or lo == only["hits"][0]]
        grids = [(k, bands if k == "band" else [only[k]] if k in only else lists[k]) for k in by]
        source = " CROSS JOIN ".join(f"{_grid(k, v)} t_{k}" for k, v in grids) or "(SELECT 1)"
        on = " AND ".join(f"CAST(m.{k} AS VARCHAR) = t_{k}.{k}" for k, _ in grids) or "TRUE"
        cell = " || '/' || ".join(f"t_{k}.{k}" for k, _ in grids) or "''"
        out.append(f"SELECT {i} AS question, {cell} AS cell, count(m.sid) AS n, CAST(coalesce(sum(m.churned), 0) AS BIGINT) AS lapses FROM {source} LEFT JOIN (SELECT *, {_BAND} AS band FROM g WHERE {' AND '.join(where)}) m ON {on} GROUP BY ALL")
    return f"SELECT *, {_rates('n', 'lapses')} FROM ({' UNION ALL '.join(out)})"


def _search_sql() -> str:
    word, day = "[\\p{L}\\p{N}][\\p{L}\\p{N}_:%-]*", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    whole = lambda t: f"list_transform(regexp_extract_all(lower({t}), '{word}'), lambda x: regexp_replace(x, '[_:-]+$', ''))"

    def toks(t: str, without) -> str:
        pieces = f"list_filter(flatten(list_transform({whole(t)}, lambda x: string_split(x, ':'))), lambda x: x <> '')"
        months = f"list_transform(list_filter({pieces}, lambda x: regexp_matches(x, '{day}')), lambda x: substr(x, 1, 7))"
        parts = f"list_filter(flatten(list_transform(list_filter({pieces}, lambda x: NOT regexp_matches(x, '{day}')), lambda x: regexp_split_to_array(x, '[_-]'))), lambda x: x <> '')"
        bare = f"list_transform(list_filter({parts}, lambda x: regexp_matches(x, '^0+[1-9][0-9]*$')), lambda x: regexp_replace(x, '^0+', ''))"
        stop = ", ".join(f"'{w}'" for w in without)
        return f"list_filter(list_distinct(list_concat({whole(t)}, {pieces}, {months}, {parts}, {bare})), lambda x: x <> '' AND x NOT IN ({stop}))"

    days = lambda a, z: f"(SELECT string_agg(lower(strftime(u, '%Y-%m-%d %Y-%m %B %b')), ' ') FROM (SELECT unnest(generate_series({a}, {z}, INTERVAL 1 DAY)) AS u))"
    ents = f"""SELECT 'Renewal' AS kind, renewal_id AS id, concat_ws(' ', renewal_id, sid, user_name) AS t FROM g UNION ALL SELECT 'Subscription', sid, concat_ws(' ', sid, user_name) FROM g
 UNION ALL SELECT 'PricingChange', change_id, change_id || ' pricing price change cut cap ' || {days('effective_date', 'effective_date')} || ' ' || description FROM change UNION ALL SELECT 'Incident', incident_id, incident_id || ' incident outage ' || {days('starts_on', 'ends_on')} FROM incident"""
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    return f"""{G.GRAPH}, ent AS MATERIALIZED ({ents}), idx AS MATERIALIZED (SELECT DISTINCT kind, id, unnest({toks('t', ID_NOISE)}) AS tok FROM ent), voc AS (SELECT tok, ln(1 + (SELECT count(*) FROM (SELECT DISTINCT kind, id FROM idx)) / CAST(count(*) AS DOUBLE)) AS idf FROM idx GROUP BY tok),
q AS (SELECT unnest([{', '.join(f"'{x}'" for x in SEARCHES)}]) AS query), ask AS (SELECT query, unnest({toks('query', (*ID_NOISE, *STOP_WORDS))}) AS asked FROM q),
exact AS (SELECT DISTINCT asked, tok, 1.0::DOUBLE AS w, 2 AS how, idf FROM ask JOIN voc ON tok = asked), pre AS (SELECT DISTINCT asked, tok, 0.7::DOUBLE AS w, 3 AS how, idf FROM ask JOIN voc ON starts_with(tok, asked) WHERE length(asked) >= 3 AND asked NOT IN (SELECT asked FROM exact)),
found AS (SELECT query, kind, id, w * idf AS s, how FROM ask JOIN (FROM exact UNION ALL FROM pre) USING (asked) JOIN idx USING (tok) UNION ALL SELECT query, kind, id, 100.0, 1 FROM q JOIN (SELECT DISTINCT kind, id FROM idx) ON lower(id) = lower(trim(query)))
SELECT query, place, kind, id, score, CASE how WHEN 1 THEN 'id' WHEN 2 THEN 'token' ELSE 'prefix' END AS how FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, CASE kind {order} END, id) AS place FROM (SELECT query, kind, id, floor(sum(s) * 1e6 + 0.5) / 1e6 AS score, min(how) AS how FROM found GROUP BY 1, 2, 3)) WHERE place <= 5"""


_grid = lambda name, values: f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name})"
_ALL_ROUTES = sorted({r for r, _ in ROUTES})
_SHOWN_ROUTE = "CASE WHEN route IN ('score_today', 'pending') THEN 'current' ELSE route END"
_EXPOSED = f"""SELECT kind, id, p.plan_tier, r.route, count(x.renewal_id) AS renewals, CAST(coalesce(sum(CASE WHEN x.route = 'model' THEN churned END), 0) AS BIGINT) AS lapses
 FROM (SELECT 'incident' AS kind, incident_id AS id FROM incident UNION ALL SELECT 'change', change_id FROM change) e CROSS JOIN {_grid('plan_tier', PLAN_NAMES)} p CROSS JOIN {_grid('route', EXPOSED_ROUTES)} r LEFT JOIN
 (SELECT DISTINCT 'incident' AS kind, node_id AS id, renewal_id, plan_tier, {_SHOWN_ROUTE} AS route, churned FROM g JOIN e_exp x ON x.sid = g.sid AND x.day > as_of - 28 AND x.day <= as_of UNION ALL SELECT 'change', change_id, g.renewal_id, plan_tier, {_SHOWN_ROUTE}, churned FROM g JOIN e_first f ON f.renewal_id = g.renewal_id) x USING (kind, id)
 WHERE x.renewal_id IS NULL OR TRUE GROUP BY ALL"""
_EXPOSED = _EXPOSED.replace("x USING (kind, id)\n WHERE x.renewal_id IS NULL OR TRUE GROUP BY ALL", "x ON x.kind = e.kind AND x.id = e.id AND x.plan_tier = p.plan_tier AND x.route = r.route GROUP BY ALL").replace("SELECT kind, id, p.plan_tier", "SELECT e.kind, e.id, p.plan_tier", 1)
_NO_NULL = "coalesce(CAST({0} AS VARCHAR), 'none')".format
_AUC = "SELECT {g}, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n) - sum(pos) AS BIGINT) AS negatives, CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(n) - sum(pos) AS DOUBLE)) END AS auc FROM (SELECT {g}, pos, n, coalesce(sum(n) OVER (PARTITION BY {g} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM (SELECT {g}, score, sum(label) AS pos, count(*) AS n FROM ({s}) GROUP BY {g}, score)) GROUP BY {g}"
_SINGLE = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS score, CAST(outcome <> 'renewed' AS BIGINT) AS label FROM g WHERE route IN ('model', 'dunning')" for c in R.FEATURES)
_WINDOW = {f: int(f.rsplit("_", 1)[1][:-1]) if f.rsplit("_", 1)[-1][:-1].isdigit() else 0 for f in R.FEATURES}
#: Every renewal, not the graph's.
_ALL = f"{R.BASE}, g AS (SELECT * FROM feat)"
#: Renewals of the graph that a change counts for which came after their as_of.
_LATE = f"(SELECT count(DISTINCT f.sid) FROM (SELECT * FROM feat WHERE as_of <= DATE '{R.UNTIL}' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY as_of DESC) = 1) f JOIN change ON effective_date >= renewal_date - 30 AND effective_date < renewal_date AND started_at < effective_date AND effective_date > as_of)"
ORACLE = {
    "lapse_rate": f"{_ALL} SELECT plan_tier, band, n, lapses, {_rates('n', 'lapses')} FROM (SELECT p.plan_tier, b.band, count(g.sid) AS n, CAST(coalesce(sum(g.churned), 0) AS BIGINT) AS lapses FROM {_grid('plan_tier', PLAN_NAMES)} p CROSS JOIN {_grid('band', BAND_NAMES)} b LEFT JOIN (SELECT *, {_BAND} AS band FROM g WHERE route = 'model') g ON g.plan_tier = p.plan_tier AND g.band = b.band GROUP BY 1, 2)",
    "route_counts": f"{_ALL} SELECT p.plan_tier, r.route, r.outcome, count(g.sid) AS n FROM {_grid('plan_tier', (*PLAN_NAMES, 'all'))} p CROSS JOIN (VALUES {', '.join(map(str, ROUTES))}) AS r(route, outcome) LEFT JOIN g ON (g.plan_tier = p.plan_tier OR p.plan_tier = 'all') AND g.route = r.route AND g.outcome = r.outcome GROUP BY ALL",
    "lapse_cube": f"{_ALL} SELECT coalesce(plan_tier, '*') AS plan_tier, coalesce(exposed, '*') AS exposed, coalesce(band, '*') AS band, count(*) AS n, CAST(sum(churned) AS BIGINT) AS lapses FROM (SELECT plan_tier, CAST(incident_exposed_28d AS VARCHAR) AS exposed, {_BAND} AS band, churned FROM g WHERE route = 'model') GROUP BY CUBE (plan_tier, exposed, band)",
    "feature_cards": f"{_ALL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({_WINDOW[c]} AS BIGINT) AS window_days, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, count(*) FILTER ({c} <> 0) AS nonzero, {_LATE if c == 'first_renewal_after_change' else 'CAST(0 AS BIGINT)'} AS exceptions FROM g" for c in R.FEATURES),
    "similar_summary": f"""{G.KNN}, near AS (SELECT source, min(path_dist) AS nearest_known_lapse FROM ({G.LAPSES_OF_STATED}) WHERE known GROUP BY source), lead AS (SELECT h.src, h.feature, h.share FROM ({G.ORACLE['similar_shares']}) h JOIN s1 ON s1.src = h.src AND s1.dst = h.dst WHERE s1.rank = 1 AND h.place = 1)
 SELECT t.src, visible, lapsed, {_rates('visible', 'lapsed')}, nearest_known_lapse, lead.feature AS leading_feature, lead.share AS leading_share FROM (SELECT src, count(*) AS visible, count(*) FILTER (b.outcome = 'voluntary_lapse') AS lapsed FROM s1 JOIN z a ON a.no = src JOIN z b ON b.no = dst WHERE {G._VIS} GROUP BY src) t LEFT JOIN near ON near.source = t.src LEFT JOIN lead ON lead.src = t.src""",
    "lapse_rates_asked": f"{_ALL} {_asked_sql()}",
    "exposure_cells": f"{G.GRAPH} {_EXPOSED}",
    "population_counts": f"""{G.GRAPH}, m AS (SELECT *, {_BAND} AS band FROM g WHERE route = 'model')
 SELECT 'keys' AS family, coalesce(plan_tier, '*') || '/' || coalesce(CAST(first_renewal_after_change AS VARCHAR), '*') || '/' || coalesce(band, '*') AS cell, count(*) AS n, CAST(sum(churned) AS BIGINT) AS lapses FROM m GROUP BY CUBE (plan_tier, first_renewal_after_change, band)
 UNION ALL SELECT 'flags', coalesce(CAST(incident_exposed_28d AS VARCHAR), '*') || '/' || coalesce(CAST(overage_toggled_off AS VARCHAR), '*'), count(*), CAST(sum(churned) AS BIGINT) FROM m GROUP BY CUBE (incident_exposed_28d, overage_toggled_off)
 UNION ALL SELECT 'routes', plan_tier || '/' || route || '/' || outcome, count(*), CAST(sum(churned) AS BIGINT) FROM g GROUP BY plan_tier, route, outcome UNION ALL SELECT 'exposure', kind || '/' || id || '/' || plan_tier || '/' || route, renewals, lapses FROM ({_EXPOSED}) WHERE renewals > 0""",
    "suppressed_cells": f"""{_ALL.replace("WITH snap", "WITH RECURSIVE snap", 1)}, c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p.plan_tier, r.route) AS i, p.plan_tier, r.route, count(g.sid) AS n FROM {_grid('plan_tier', PLAN_NAMES)} p CROSS JOIN {_grid('route', _ALL_ROUTES)} r LEFT JOIN g ON g.plan_tier = p.plan_tier AND g.route = r.route GROUP BY p.plan_tier, r.route),
gs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, k) AS ord, ids FROM (SELECT 1 AS o, plan_tier AS k, list(i) AS ids FROM c GROUP BY plan_tier UNION ALL SELECT 2, route, list(i) FROM c GROUP BY route)),
h(step, hidden) AS (SELECT 0, coalesce((SELECT list(i) FROM c WHERE n < 5), []) UNION ALL SELECT step + 1, list_append(hidden, (SELECT arg_min(c.i, (c.n, c.plan_tier, c.route)) FROM c WHERE list_contains(x.ids, c.i) AND NOT list_contains(h.hidden, c.i))) FROM h JOIN gs x ON x.ord = (SELECT min(ord) FROM gs y WHERE len(y.ids) > 1 AND len(list_intersect(y.ids, h.hidden)) = 1))
SELECT plan_tier, route, CASE WHEN NOT list_contains(hidden, i) THEN n END AS n, list_contains(hidden, i) AS suppressed FROM c, (SELECT hidden FROM h ORDER BY step DESC LIMIT 1)""",
    "entity_search": _search_sql(),
    "leakage": f"""{G.KNN_ALL}, m AS (SELECT * FROM z WHERE route = 'model'), ee AS (SELECT src, dst FROM sim), srcs AS (SELECT DISTINCT src FROM ee),
lr AS (SELECT 'self_inclusive' AS variant, src, avg(CAST(churned AS DOUBLE)) AS score FROM (SELECT src, dst FROM ee UNION ALL SELECT src, src FROM srcs JOIN m ON m.no = src) JOIN m ON m.no = dst GROUP BY src
 UNION ALL SELECT 'as_of_today', src, avg(CAST(churned AS DOUBLE)) FROM ee JOIN m ON m.no = dst GROUP BY src
 UNION ALL SELECT 'known_by_as_of', src, (sum(CAST(d.churned AS DOUBLE)) + 0.5::DOUBLE) / (count(*) + 5.0::DOUBLE) FROM ee JOIN m s ON s.no = src JOIN m d ON d.no = dst WHERE d.outcome_observed_on <= s.as_of GROUP BY src
 UNION ALL SELECT 'random', src, CAST((src * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE FROM srcs) {_AUC.format(g='variant', s="SELECT variant, floor(score * 1e9 + 0.5) / 1e9 AS score, churned AS label FROM lr JOIN m ON m.no = src")}""",
    "overage_auc": f"{_ALL} {_AUC.format(g='feature', s=_SINGLE)}",
    "embedding_neighbours": "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, floor(sum((a.x - b.x) * (a.x - b.x) ORDER BY a.i) * 1e6 + 0.5) AS d2_e6 FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2) SELECT src, dst, CAST(d2_e6 AS BIGINT) AS d2_e6, row_number() OVER (PARTITION BY src ORDER BY d2_e6, dst) AS rank FROM p QUALIFY rank <= 10",
    "co_purchase": "SELECT r_name, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
}
