"""Read-only SQL over registered views, bounded in rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans.lineage import Node, _tree

#: Plan nodes a query may consist of. Commands, writes, scripts and anything new are not among them.
ALLOWED = frozenset(
    "Project Filter Aggregate Join Union Sort Distinct SubqueryAlias View Window Generate Except Intersect GlobalLimit LocalLimit Offset WithCTE CTERelationDef CTERelationRef LogicalRelation LogicalRDD LocalRelation OneRowRelation Range Deduplicate Expand Pivot Unpivot RelationV2 DataSourceV2Relation UnionLoop UnionLoopRef RepartitionByExpression UnresolvedHint ResolvedHint EventTimeWatermark InMemoryRelation".split()
)


class NotAllowed(ValueError):
    """The statement is not a plain query over the views it may read."""


def guarded(spark: SparkSession, text: str, views: Iterable[str], limit: int = 200) -> DataFrame:
    """The first ``limit`` rows of a query that only reads ``views``. Judged on the parsed plan, not on the text."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    import json

    root: Node = _tree(json.loads(parsed.toJSON()))
    kinds = {n.kind for n in root.walk()}
    known = ALLOWED | {"UnresolvedRelation", "UnresolvedWith", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "UnresolvedHaving"}
    if kinds - known:
        raise NotAllowed(f"not allowed: {', '.join(sorted(kinds - known))}")
    names, local = set(), set()
    plain = parsed.toString()
    for n in root.walk():
        if n.kind == "UnresolvedRelation":
            names.add(".".join(n.fields["multipartIdentifier"]) if isinstance(n.fields["multipartIdentifier"], list) else str(n.fields["multipartIdentifier"]).strip("[]").replace(", ", "."))
        if n.kind == "SubqueryAlias" and isinstance(n.fields["identifier"], dict):
            local.add(n.fields["identifier"]["name"])
    import re

    names |= {x.replace(", ", ".") for x in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plain)}  # those inside subquery expressions and WITH too
    local |= set(re.findall(r"CTE \[([^\]]+)\]", plain)[0].replace(" ", "").split(",")) if "CTE [" in plain else set()
    if stray := sorted(names - set(views) - local):
        raise NotAllowed(f"not registered: {', '.join(stray)}")
    return spark.sql(text).limit(limit)
