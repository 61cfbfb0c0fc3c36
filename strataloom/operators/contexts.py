"""Source contexts: where a topic is referred to, grouped by scope, and the orders of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(refs: DataFrame) -> DataFrame:
    """(topic, scope, subscope, ref, sort_key, mentions): contexts of one scope are one, a reference stands once with the least place and all mentions."""
    keys = ["topic", "scope", "subscope", "ref"]
    return refs.groupBy(*keys).agg(F.min("sort_key").alias("sort_key"), F.array_sort(F.collect_set("mention")).alias("mentions"))


def in_source_order(refs: DataFrame) -> DataFrame:
    """(topic, scope, refs): references by place, then id."""
    return refs.groupBy("topic", "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "ref"))), lambda x: x["ref"]).alias("refs"))


def undominated(refs: DataFrame, listed: DataFrame, parts: int | None = None) -> DataFrame:
    """Expanded references (topic, ref, ancestors) without those inside a block that is already listed(topic, ref) for the topic; each reference node once.

    Dealt to so many parts if given, so that a task's rows do not grow with the input.
    """
    near = refs.withColumn("above", F.explode_outer("ancestors")).withColumn("_listed", F.lit(False))
    known = listed.filter("topic is not null and ref is not null").select("topic", F.col("ref").alias("above"), F.lit(True).alias("_listed"))
    # both sides are dealt by topic once; what is listed marks the references beside it
    rows = near.unionByName(known, allowMissingColumns=True)
    rows = (rows.repartition(parts, "topic") if parts else rows.repartition("topic")).withColumn("_own", ~F.col("_listed"))
    marked = rows.withColumn("_listed", F.max("_listed").over(Window.partitionBy("topic", "above"))).filter("_own")
    others = [c for c in refs.columns if c not in ("topic", "ref")]
    kept = marked.groupBy("topic", "ref").agg(F.max("_listed").alias("_listed"), *(F.first(c).alias(c) for c in others)).filter("not _listed")
    return kept.select(*refs.columns)


def order_by_subject(groups: DataFrame) -> DataFrame:
    """Groups (topic, contract, name, subject_contract): place of each, the subject's contract first, then names."""
    own = F.col("contract").eqNullSafe(F.col("subject_contract"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(own), "name", "contract")))


def ancestry_counts(inheritance: DataFrame) -> DataFrame:
    """(contract, ancestors, descendants) of inheritance(child, base) in its closure."""
    up = inheritance.groupBy(F.col("child").alias("contract")).agg(F.count_distinct("base").alias("ancestors"))
    down = inheritance.groupBy(F.col("base").alias("contract")).agg(F.count_distinct("child").alias("descendants"))
    return up.join(down, "contract", "full").select("contract", F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


def order_expanded(groups: DataFrame) -> DataFrame:
    """Groups (topic, contract, in_scope, ancestors, descendants): in scope first, those with ancestors first, fewer ancestors first; without ancestors, more descendants first."""
    has = F.col("ancestors") > 0
    keys = [F.desc("in_scope"), F.desc(has), F.when(has, F.col("ancestors")).otherwise(-F.col("descendants")), F.col("contract")]
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(*keys)))


def branch_groups(notes: DataFrame) -> DataFrame:
    """(owner, block, kind, has_sibling): annotated blocks of notes(owner, block, kind), one for each kind; branches of one `if` know of each other."""
    groups = notes.select("owner", "block", "kind").distinct()
    several = F.count("*").over(Window.partitionBy("owner", "block")) > 1
    return groups.select("owner", "block", "kind", (F.col("kind").startswith("If") & several).alias("has_sibling"))


def mutations_of(writes: DataFrame) -> DataFrame:
    """(target, sites): statements that write each variable, ascending."""
    return writes.groupBy("target").agg(F.array_sort(F.collect_set("site")).alias("sites"))


def in_scope_ancestry(inheritance: DataFrame, scope: DataFrame) -> DataFrame:
    """(contract, other, relation): ancestors and descendants with both ends in scope."""
    both = inheritance.join(scope.select(F.col("topic").alias("child")), "child", "left_semi").join(scope.select(F.col("topic").alias("base")), "base", "left_semi")
    up = both.select(F.col("child").alias("contract"), F.col("base").alias("other"), F.lit("ancestor").alias("relation"))
    return up.unionByName(both.select(F.col("base").alias("contract"), F.col("child").alias("other"), F.lit("descendant").alias("relation")))


def flows(arguments: DataFrame, returns: DataFrame, assignments: DataFrame, operands: DataFrame) -> DataFrame:
    """(target, source, relation) of variable flow.

    Arguments (parameter, source) and returned expressions (return_parameter,
    source) are ancestors; assignments and initialisers (target, source) one-way
    relatives; operands of one operator or branches of one choice (a, b)
    relatives both ways. Nothing flows into itself.
    """

    def rows(df: DataFrame, target: str, source: str, relation: str) -> DataFrame:
        return df.select(F.col(target).alias("target"), F.col(source).alias("source"), F.lit(relation).alias("relation"))

    out = rows(arguments, "parameter", "source", "ancestor").unionByName(rows(returns, "return_parameter", "source", "ancestor")).unionByName(rows(assignments, "target", "source", "relative"))
    out = out.unionByName(rows(operands, "a", "b", "relative")).unionByName(rows(operands, "b", "a", "relative"))
    return out.filter("target != source").distinct()


def tree_shake(members: DataFrame, inheritance: DataFrame, references: DataFrame, scope: DataFrame) -> DataFrame:
    """(node, referenced_by): what the contracts in scope reach through members(contract, member), bases and references(src, dst), each with who refers to it (among those reached)."""
    from strataloom.operators.graph import reach

    steps = members.select(F.col("contract").alias("src"), F.col("member").alias("dst")).unionByName(inheritance.select(F.col("child").alias("src"), F.col("base").alias("dst"))).unionByName(references.select("src", "dst")).distinct()
    far = reach(steps, scope.select(F.lit("scope").alias("root"), F.col("topic").alias("node"))).select("node").distinct()
    by = references.join(far.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("referenced_by"))
    return far.join(by, "node", "left").select("node", F.coalesce("referenced_by", F.lit(0)).alias("referenced_by"))


def recursive_ancestry(rows: DataFrame) -> DataFrame:
    """(topic, other, relation): closures of flows(target, source, relation), for ancestors, their reverse (descendants) and relatives apart; nothing is its own."""
    from strataloom.operators.graph import closure

    out = None
    for relation in ("ancestor", "relative"):
        pairs = rows.filter(F.col("relation") == relation).select(F.col("target").alias("src"), F.col("source").alias("dst"))
        far = closure(pairs).filter("src != dst")
        mine = far.select(F.col("src").alias("topic"), F.col("dst").alias("other"), F.lit(relation).alias("relation"))
        out = mine if out is None else out.unionByName(mine)
        if relation == "ancestor":
            out = out.unionByName(far.select(F.col("dst").alias("topic"), F.col("src").alias("other"), F.lit("descendant").alias("relation")))
    return out


def doc_panel(shown: DataFrame, above: DataFrame, contexts: DataFrame) -> DataFrame:
    """(panel, scope, subscope, ref, sort_key, mentions): the contexts of what a panel shows, one group for each scope.

    shown(panel, topic); above(topic, ancestor); contexts(topic, scope, subscope,
    ref, sort_key, mention). A topic with an ancestor in the same panel stands
    inside that one already and brings no contexts of its own; topics without
    ancestors stay, those without contexts bring none. Groups of one scope are one,
    and a reference that several topics share stands once with the least place.
    """
    told = shown.select("panel", "topic").join(above, "topic", "left").repartition("panel")
    # who is shown and who stands above, side by side: an ancestor that is also shown covers its topics
    sides = F.array(F.struct(F.col("topic").alias("name"), F.lit(1).alias("own"), "topic"), F.struct(F.col("ancestor").alias("name"), F.lit(0).alias("own"), "topic"))
    rows = told.select("panel", F.inline(sides)).filter("own = 1 or name is not null")
    met = F.max("own").over(Window.partitionBy("panel", "name"))
    tops = rows.withColumn("_inside", F.when(F.col("own") == 0, met).otherwise(0)).groupBy("panel", "topic").agg(F.max("_inside").alias("_inside")).filter("_inside = 0")
    # a topic's contexts travel as one list, and meet in their panel
    fields = ["scope", "subscope", "ref", "sort_key", "mention"]
    listed = contexts.groupBy("topic").agg(F.collect_list(F.struct(*fields)).alias("_c"))
    met_there = tops.join(listed, "topic").select("panel", "_c").repartition("panel").select(F.col("panel").alias("topic"), F.inline("_c"))
    return merged(met_there).withColumnRenamed("topic", "panel")


def nested_groups(refs: DataFrame, *, by: str = "topic") -> DataFrame:
    """(by, groups): references nested by scope and subscope, array<struct<scope, sort_key, refs, inner array<struct<subscope, sort_key, refs>>>>.

    refs(by, scope, subscope, ref, sort_key); a null subscope is the scope itself.
    References stand by place, then id; groups by the least place in them, then
    name. Each level is built from the one below, so no row holds more than one
    topic's groups.
    """
    items = lambda: F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "ref"))), lambda x: x["ref"])
    once = refs.groupBy(by, "scope", "subscope", "ref").agg(F.min("sort_key").alias("sort_key"))
    parts = once.groupBy(by, "scope", "subscope").agg(items().alias("refs"), F.min("sort_key").alias("sort_key"))
    own = F.when(F.col("subscope").isNull(), F.col("refs"))
    inner = F.when(F.col("subscope").isNotNull(), F.struct("sort_key", "subscope", "refs"))
    scopes = parts.groupBy(by, "scope").agg(F.min("sort_key").alias("sort_key"), F.coalesce(F.max(own), F.expr("slice(max(refs), 1, 0)")).alias("refs"), F.array_sort(F.collect_list(inner)).alias("inner"))
    swap = F.transform("inner", lambda x: F.struct(x["subscope"].alias("subscope"), x["sort_key"].alias("sort_key"), x["refs"].alias("refs")))
    whole = scopes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("sort_key", "scope", "refs", swap.alias("inner")))).alias("groups"))
    return whole.select(by, F.transform("groups", lambda x: F.struct(x["scope"].alias("scope"), x["sort_key"].alias("sort_key"), x["refs"].alias("refs"), x["inner"].alias("inner"))).alias("groups"))
