"""Joins, indexes, windows, set operators and review queries over the analogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import topics as tp
from strataloom.functions.tables import CHOICE_RATIO, MAX_SEED_DEPTH
from strataloom.operators import relations as r
from strataloom.plans.tables import COMMENTS_SQL, VOTES_SQL, comments, node, read, votes


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """(region, nation, customer): names of the scope tree."""
    c, n, g = (read(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(g), n["n_regionkey"] == g["r_regionkey"])


_TREE_SQL = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("c_custkey", tp.qualified_name(F.col("r_name"), F.col("n_name"), F.col("c_name")).alias("qualified_name"))


def scope_summary(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "Component").when(F.col("c_custkey") % 3 == 1, "Member").otherwise("ContainingBlock")
    return _tree(spark, d).select("c_custkey", tp.scope_summary(kind, F.col("r_name"), F.col("n_name"), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("summary"))


def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("c_custkey", F.array_join(tp.ancestors(F.col("r_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")), F.array("c_mktsegment")), ">").alias("chain"))


def topic_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "orders").select("o_orderkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("N", "D", "C", "A", "S", "P", "Y", "X")]), (F.col("o_orderkey") % 8 + 1).cast("int")), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise((F.col("o_orderkey") - 100).cast("string"))).alias("id"))
    t = tp.parse_topic(F.col("id"))
    return ids.select("o_orderkey", t["prefix"].alias("prefix"), t["num_id"].alias("num_id"), t["error"].alias("error"))


def max_id_per_prefix(spark: SparkSession, d: str) -> DataFrame:
    return topic_ids(spark, d).filter("error is null").groupBy("prefix").agg(F.max("num_id").alias("max_id"))


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def kind_filter(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in ("Function", "Modifier", "Event", "Local", "Struct")]), (F.col("p_size") % 5 + 1).cast("int"))).withColumn("visibility", F.when(F.col("p_partkey") % 2 == 0, "public").otherwise("internal"))
    return p.select("p_partkey", tp.is_indexable(F.col("kind")).alias("indexable"), tp.is_public_member(F.col("kind"), F.col("visibility")).alias("public_member"), tp.named_purity(F.when(F.col("p_size") % 2 == 0, "StateVariable:Mutable").otherwise(F.col("kind"))).alias("purity"))


def in_scope_semi(spark: SparkSession, d: str) -> DataFrame:
    scope = read(spark, d, "nation").filter(F.col("n_regionkey").isin(1, 3))
    return read(spark, d, "customer").join(F.broadcast(scope), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """(name, topic, transitive): part names repeat; every third part is a proxy of another."""
    return read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("topic"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") - 1).alias("transitive"))


_NAMES_SQL = "names as (select p_name as name, p_partkey as topic, case when p_partkey % 3 = 0 then p_partkey - 1 end as transitive from part)"


def name_index(spark: SparkSession, d: str) -> DataFrame:
    return r.name_index(_names(spark, d))


def candidates_by_name(spark: SparkSession, d: str) -> DataFrame:
    return r.candidates(_names(spark, d)).select("name", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"))


def qualified_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return r.last_wins(_names(spark, d), "name", "topic", "topic")


def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Fallback chain: id as text, then qualified name, then unique simple name."""
    asked = read(spark, d, "lineitem").select((F.col("l_partkey") % 97).cast("string").alias("name")).union(read(spark, d, "part").select("p_name")).distinct()
    part = read(spark, d, "part")
    ids = part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("topic"))
    qualified = r.last_wins(part.select(F.concat_ws(".", "p_brand", "p_name").alias("name"), F.col("p_partkey").alias("topic")), "name", "topic", "topic")
    simple = name_index(spark, d).filter("topic is not null").select("name", "topic")
    return r.first_match(asked, [ids, qualified, simple], "name", "topic")


def proxy_resolution(spark: SparkSession, d: str) -> DataFrame:
    calls = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("callee"))
    return r.resolve_proxy(calls, _names(spark, d), "callee").distinct()


def interface_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Proxies with their targets, as the mapping dump lists them."""
    n = _names(spark, d)
    t = n.select(F.col("topic").alias("target"), F.col("name").alias("target_name"))
    return n.filter("transitive is not null").join(t, F.col("transitive") == F.col("target")).select("topic", "name", "target", "target_name")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))


def interface_single_impl(spark: SparkSession, d: str) -> DataFrame:
    """A part's interface in a region with exactly one supplier there."""
    pairs = _suppliers(spark, d).select((F.col("l_partkey") * 10 + F.col("n_regionkey")).alias("base"), "l_suppkey")
    return r.single_implementation(pairs, base="base", impl="l_suppkey")


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    calls = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 100 + 1).alias("callee"), (F.col("l_returnflag") == "R").alias("in_try"))
    topics = read(spark, d, "supplier").select(F.col("s_suppkey").alias("topic"), F.when(F.col("s_suppkey") % 10 == 0, F.col("s_suppkey") - 1).alias("transitive"))
    scope = read(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("topic"))
    return r.call_edges(calls, topics, scope, with_try=False)


def reverse_index_counts(spark: SparkSession, d: str) -> DataFrame:
    index = r.reverse_index(read(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")
    return index.select("l_suppkey", F.size("values").cast("long").alias("n"), F.array_join(F.transform(F.slice("values", 1, 5), lambda x: x.cast("string")), ",").alias("first_five"))


def member_features_first_only(spark: SparkSession, d: str) -> DataFrame:
    """A requirement (part) shows only under the first feature (brand size) of a member (supplier)."""
    links = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    first = r.first_occurrence(links, ["l_suppkey", "l_partkey"], ["l_linenumber"])
    return first.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n_requirements"), F.min("l_partkey").alias("first_requirement"))


def _by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, all): the distinct values of each key."""
    return rows.groupBy(key).agg(F.collect_set(value).alias("all"))


def requirements_for_topic(spark: SparkSession, d: str) -> DataFrame:
    """Union of three paths from a customer to parts, each pair once.

    A customer and a part of its nation and remainder meet once, at the least
    nation they share, so these rows, by far the most, are not shuffled to be made
    distinct; the other paths leave out what that join gives.
    """
    o, li, p = (read(spark, d, x) for x in ("orders", "lineitem", "part"))
    there = _by_key(read(spark, d, "customer"), "c_custkey", "c_nationkey").withColumnRenamed("all", "nations")
    sizes = _by_key(p, "p_partkey", "p_size").withColumnRenamed("all", "sizes")
    several = lambda x: F.when(F.size(x) > 1, F.col(x))
    a = there.select(F.col("c_custkey").alias("topic"), F.explode("nations").alias("nation"), several("nations").alias("nations"))
    b = sizes.select(F.col("p_partkey").alias("requirement"), F.explode("sizes").alias("size"), several("sizes").alias("sizes"))
    once = F.col("nations").isNull() | F.col("sizes").isNull() | (F.array_min(F.array_intersect("nations", "sizes")) == F.col("nation"))
    section = a.join(b, (F.col("nation") == F.col("size")) & (F.col("topic") % 20 == F.col("requirement") % 20) & once).select("topic", "requirement")
    bought = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("topic"), F.col("l_partkey").alias("requirement"))
    rest = bought.unionByName(p.select(F.col("p_partkey").alias("topic"), F.col("p_partkey").alias("requirement")))
    near = F.coalesce(F.col("topic") % 20 == F.col("requirement") % 20, F.lit(False))
    asked = rest.filter(near).distinct().join(there, F.col("topic") == F.col("c_custkey"), "left").join(sizes, F.col("requirement") == F.col("p_partkey"), "left")
    left = asked.filter(~F.coalesce(F.arrays_overlap("nations", "sizes"), F.lit(False))).select("topic", "requirement")
    return section.unionByName(rest.filter(~near).distinct()).unionByName(left)


def invalidated_findings(spark: SparkSession, d: str) -> DataFrame:
    o, li, c = (read(spark, d, x) for x in ("orders", "lineitem", "customer"))
    invariants = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("invariant"), F.when(F.col("l_linenumber") != 3, F.col("l_orderkey")).alias("threat"), F.when(F.col("l_returnflag") == "R", "absent").when(F.col("l_returnflag") == "A", "partial").otherwise("present").alias("verdict"))
    invariants = invariants.groupBy("invariant").agg(F.min("threat").alias("threat"), F.min("verdict").alias("verdict"))
    validations = invariants.select("invariant", "verdict")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical", "odd")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    threats = o.filter("o_orderkey % 4 != 0").select(F.col("o_orderkey").alias("threat"), F.col("o_custkey").alias("condition"), severity.alias("severity"))
    conditions = c.select(F.col("c_custkey").alias("condition"), F.col("c_name").alias("subject"))
    return r.invalidated(invariants.select("invariant", "threat"), validations, threats, conditions).select("invariant", "verdict", "severity", "severity_rank", "subject")


def coverage_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    expected = read(spark, d, "customer").select(F.col("c_custkey").alias("topic"))
    received = read(spark, d, "orders").select((F.col("o_custkey") + 50).alias("topic"))
    return r.missing_and_extra(expected, received, "topic")


def subsumption_antijoin(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    leaf = tree.filter("c_custkey % 5 < 2").select("c_mktsegment", node("c", "c_custkey").alias("ref"), F.array(node("n", "n_nationkey"), node("r", "r_regionkey")).alias("above"))
    mid = tree.filter("n_nationkey % 3 = 0").select("c_mktsegment", node("n", "n_nationkey").alias("ref"), F.array(node("r", "r_regionkey")).alias("above")).distinct()
    return r.drop_subsumed(leaf.union(mid), by="c_mktsegment", ref="ref", ancestors="above").select("c_mktsegment", "ref")


def priority_union(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("section"), (F.col("o_orderkey") % 50).alias("member"))
    b = read(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("section"), (F.col("l_partkey") % 50).alias("member"))
    return r.priority_union(a, b, ["section", "member"])


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(read(spark, d, "orders").select("o_custkey").distinct())


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Shared parts of two suppliers of one nation."""
    sp = _suppliers(spark, d).select("n_nationkey", "l_suppkey", "l_partkey")
    b = sp.select("n_nationkey", F.col("l_suppkey").alias("other"), "l_partkey")
    return sp.join(b, ["n_nationkey", "l_partkey"]).filter("l_suppkey < other").groupBy("l_suppkey", "other").agg(F.count("*").alias("shared"))


def first_wins_validator(spark: SparkSession, d: str) -> DataFrame:
    """Answers as JSON: unreadable or unexpected subjects and empty texts go, the first answer of a subject stays."""
    e = read(spark, d, "events").filter("props is not null")
    rows = e.select("event_id", "user_id", F.from_json("props", "k int").alias("a")).select("event_id", "user_id", F.col("a.k").alias("subject"))
    return r.first_occurrence(rows.filter("subject is not null and subject % 9 != 0"), ["user_id", "subject"], ["event_id"])


def threats_xor_rationale(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("threat"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("none")).alias("rationale"))
    return o.groupBy(F.when(F.col("threat").isNotNull() & F.col("rationale").isNotNull(), "both").when(F.col("threat").isNull() & F.col("rationale").isNull(), "neither").otherwise("valid").alias("state")).agg(F.count("*").alias("n"))


def rank_with_runner_up(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.floor("o_totalprice")).cast("double").alias("score"))
    return r.choose(o, by="o_custkey", candidate="o_orderpriority", score="score", ratio=CHOICE_RATIO)


def seed_weights(spark: SparkSession, d: str) -> DataFrame:
    chain = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("topic"), F.col("l_linenumber").alias("distance"))
    return r.seed_weights(chain, by="l_orderkey", topic="topic", distance="distance", deepest=MAX_SEED_DEPTH)


def semantic_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = r.sessions(read(spark, d, "events"), by="user_id", at="ts", gap_seconds=21600)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def section_grouping(spark: SparkSession, d: str) -> DataFrame:
    heads = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])"), 1)).alias("pos", "level")).select("page_id", "pos", F.col("level").cast("int").alias("level"))
    return r.heading_parents(heads, by="page_id")


def colocation_pins(spark: SparkSession, d: str) -> DataFrame:
    li, s = read(spark, d, "lineitem"), read(spark, d, "supplier")
    pairs = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("candidate"), F.col("s_nationkey").alias("scope"))
    return r.pinned(pairs)


def vote_summary(spark: SparkSession, d: str) -> DataFrame:
    latest = r.latest(votes(spark, d), ["comment_id", "user_id"], ["vote"], "at")
    return r.vote_summary(latest, by="comment_id", user=7)


def unvoted_comments(spark: SparkSession, d: str) -> DataFrame:
    return r.unvoted(comments(spark, d), votes(spark, d), user=7).select("comment_id", "created_at")


def comments_by_type_status(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).filter("comment_type = 'question' and status = 'active'").orderBy(F.desc("created_at")).select("comment_id", "audit_id", "created_at")


def comments_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return r.by_ids(comments(spark, d), [0, 1, 7, 1001, 2002, 5003]).select("comment_id", "comment_type")


def parent_chain(spark: SparkSession, d: str) -> DataFrame:
    return r.parent_chain(comments(spark, d))


def thread_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each comment with its thread's root and its depth."""
    chain = r.parent_chain(comments(spark, d)).groupBy("comment_id").agg(F.max_by("ancestor", "depth").alias("root"), F.max("depth").alias("depth"))
    return comments(spark, d).select("comment_id").join(chain, "comment_id", "left").select("comment_id", F.coalesce("root", "comment_id").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def conversation_entries(spark: SparkSession, d: str) -> DataFrame:
    """Kinds in a fixed order, each by position, numbered through."""
    c = comments(spark, d)
    place = F.when(F.col("comment_type") == "info", 0).when(F.col("comment_type") == "question", 1).otherwise(2)
    w = Window.partitionBy("audit_id").orderBy("ord", "created_at")
    return c.filter("status <> 'hidden'").withColumn("ord", place).select("audit_id", "comment_id", F.row_number().over(w).alias("entry"))


def notes_joined(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a group in source order, as one block."""
    n = read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return n.select("p_brand", F.md5(F.concat_ws("\n", F.transform("x", lambda t: F.concat(F.lit("- "), t["p_name"]))).cast("binary")).alias("notes_md5"))


def batch_label(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("first"), F.count("*").alias("n"))
    return b.select("s_nationkey", F.concat("first", F.when(F.col("n") > 1, F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"))).otherwise("")).alias("label"))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of an id by its text and by its number: S10 before S2, and after it."""
    ids = read(spark, d, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("topic"))
    return ids.select("topic", F.row_number().over(Window.orderBy("topic")).alias("by_text"), F.row_number().over(Window.orderBy(tp.topic_key(F.col("topic")))).alias("by_number"))


QUERIES = {
    f.__name__: f
    for f in (qualified_names, scope_summary, ancestor_chain, topic_ids, max_id_per_prefix, kind_counts, kind_filter, in_scope_semi, name_index, candidates_by_name, qualified_last_wins, name_lookup, proxy_resolution, interface_mapping, interface_single_impl, call_edges, reverse_index_counts, member_features_first_only, requirements_for_topic, invalidated_findings, coverage_missing_extra, subsumption_antijoin, priority_union, set_difference, set_intersection, first_wins_validator, threats_xor_rationale, rank_with_runner_up, seed_weights, semantic_blocks, section_grouping, colocation_pins, vote_summary, unvoted_comments, comments_by_type_status, comments_by_ids, parent_chain, thread_tree, conversation_entries, notes_joined, batch_label, report_order)
}
_SUPPLIERS_SQL = "sup as (select distinct l_partkey, l_suppkey, n_nationkey, n_regionkey from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"
_IDS_SQL = "ids as (select o_orderkey, ['N','D','C','A','S','P','Y','X'][(o_orderkey % 8 + 1)::int] as p, case when o_orderkey % 5 = 0 then 'x' else (o_orderkey - 100)::varchar end as n from orders), parsed as (select o_orderkey, case when p = 'X' then 'prefix' when n = 'x' then 'number' end as error, p, n from ids)"
SQL = {
    "qualified_names": f"select c_custkey, r_name || '.' || n_name || '.' || c_name as qualified_name from {_TREE_SQL}",
    "scope_summary": f"select c_custkey, case c_custkey % 3 when 0 then 'in ' || n_name || ' (file: ' || r_name || ')' when 1 then 'in ' || n_name || '::' || c_name || case when c_custkey % 2 = 0 then ' [signature]' else '' end else 'inside ' || n_name || '::' || c_name end as summary from {_TREE_SQL}",
    "ancestor_chain": f"select c_custkey, concat_ws('>', r_name, case when c_custkey % 4 <> 0 then n_name end, c_mktsegment) as chain from {_TREE_SQL}",
    "topic_ids": f"with {_IDS_SQL} select o_orderkey, case when error is null then p end as prefix, case when error is null then n::int end as num_id, error from parsed",
    "max_id_per_prefix": f"with {_IDS_SQL} select p as prefix, max(n::int) as max_id from parsed where error is null group by p",
    "kind_counts": "select event_type, count(*) as n from events group by event_type",
    "kind_filter": "select p_partkey, p_size % 5 <> 3 as indexable, (p_size % 5 in (2, 4) or (p_size % 5 in (0, 1) and p_partkey % 2 = 0)) as public_member, case when p_size % 2 = 0 then 'NonPure' else 'Pure' end as purity from part",
    "in_scope_semi": "select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (1, 3))",
    "name_index": f"with {_NAMES_SQL}, g as (select name, count(*) as n, min(topic) as one, count(*) filter (transitive is null) as nd, min(topic) filter (transitive is null) as dir from names group by name) select name, case when n = 1 then one when nd = 1 then dir end as topic, n, (case when n = 1 then one when nd = 1 then dir end is null and n > 1) as ambiguous from g",
    "candidates_by_name": f"with {_NAMES_SQL} select name, string_agg(topic::varchar, ',' order by topic) as candidates from names group by name",
    "qualified_last_wins": f"with {_NAMES_SQL} select name, max(topic) as topic from names group by name",
    "name_lookup": f"with {_NAMES_SQL}, asked as (select distinct (l_partkey % 97)::varchar as name from lineitem union select p_name from part), g as (select name, case when count(*) = 1 then min(topic) when count(*) filter (transitive is null) = 1 then min(topic) filter (transitive is null) end as topic from names group by name), q as (select p_brand || '.' || p_name as name, max(p_partkey) as topic from part group by all) select a.name, coalesce(p.p_partkey, q.topic, g.topic) as topic from asked a left join part p on a.name = p.p_partkey::varchar left join q on a.name = q.name left join g on a.name = g.name",
    "proxy_resolution": "select distinct l_orderkey, case when l_partkey % 3 = 0 then l_partkey - 1 else l_partkey end as callee from lineitem",
    "interface_mapping": f"with {_NAMES_SQL} select a.topic, a.name, b.topic as target, b.name as target_name from names a join names b on a.transitive = b.topic",
    "interface_single_impl": f"with {_SUPPLIERS_SQL} select l_partkey * 10 + n_regionkey as base, min(l_suppkey) as l_suppkey from sup group by 1 having count(distinct l_suppkey) = 1",
    "call_edges": "with c as (select distinct l_suppkey as caller, case when (l_partkey % 100 + 1) % 10 = 0 and exists (select 1 from supplier where s_suppkey = l_partkey % 100 + 1) then l_partkey % 100 else l_partkey % 100 + 1 end as callee from lineitem where l_returnflag <> 'R'), s as (select s_suppkey from supplier where s_nationkey % 2 = 0) select distinct callee, caller from c where caller <> callee and caller in (select * from s) and callee in (select * from s)",
    "reverse_index_counts": "with x as (select distinct l_suppkey, l_partkey from lineitem) select l_suppkey, count(*) as n, array_to_string(list_sort(list(l_partkey))[1:5], ',') as first_five from x group by l_suppkey",
    "member_features_first_only": "with f as (select l_suppkey, l_partkey, min(l_linenumber) as l_linenumber from lineitem group by 1, 2) select l_suppkey, l_linenumber, count(*) as n_requirements, min(l_partkey) as first_requirement from f group by 1, 2",
    "requirements_for_topic": "select o_custkey as topic, l_partkey as requirement from orders join lineitem on o_orderkey = l_orderkey union select c_custkey, p_partkey from customer join part on c_nationkey = p_size and c_custkey % 20 = p_partkey % 20 union select p_partkey, p_partkey from part",
    "invalidated_findings": "with i as (select l_orderkey * 10 + l_linenumber as invariant, min(case when l_linenumber <> 3 then l_orderkey end) as threat, min(case l_returnflag when 'R' then 'absent' when 'A' then 'partial' else 'present' end) as verdict from lineitem group by 1), t as (select o_orderkey as threat, o_custkey as condition, ['low','medium','high','critical','odd'][o_orderpriority[1]::int] as severity from orders where o_orderkey % 4 <> 0) select invariant, verdict, coalesce(severity, 'pending') as severity, case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 when 'low' then 0 else -1 end as severity_rank, c_name as subject from i left join t using (threat) left join customer on condition = c_custkey where verdict in ('absent', 'partial')",
    "coverage_missing_extra": "(select c_custkey as topic, 'missing' as side from customer except select o_custkey + 50, 'missing' from orders) union all (select o_custkey + 50, 'extra' from orders except select c_custkey, 'extra' from customer)",
    "subsumption_antijoin": f"with t as (select * from {_TREE_SQL}), refs as (select c_mktsegment, 'c' || c_custkey as ref, ['n' || n_nationkey, 'r' || r_regionkey] as above from t where c_custkey % 5 < 2 union all select distinct c_mktsegment, 'n' || n_nationkey, ['r' || r_regionkey] from t where n_nationkey % 3 = 0) select c_mktsegment, ref from refs a where not exists (select 1 from refs b where a.c_mktsegment = b.c_mktsegment and list_contains(a.above, b.ref))",
    "priority_union": "with a as (select distinct o_custkey as section, o_orderkey % 50 as member from orders), b as (select distinct l_orderkey % 300 as section, l_partkey % 50 as member from lineitem) select *, 'mechanical' as source from a union all select *, 'bm25' from (select * from b except select * from a)",
    "set_difference": "select c_custkey as k from customer except select o_custkey from orders",
    "set_intersection": f"with {_SUPPLIERS_SQL} select a.l_suppkey, b.l_suppkey as other, count(*) as shared from sup a join sup b using (n_nationkey, l_partkey) where a.l_suppkey < b.l_suppkey group by 1, 2",
    "first_wins_validator": "with a as (select event_id, user_id, json_extract(props, '$.k')::int as subject from events where props is not null) select event_id, user_id, subject from a where subject is not null and subject % 9 <> 0 qualify row_number() over (partition by user_id, subject order by event_id) = 1",
    "threats_xor_rationale": "with o as (select o_orderstatus <> 'F' as t, starts_with(o_orderpriority, '1') as r from orders) select case when t and r then 'both' when not t and not r then 'neither' else 'valid' end as state, count(*) as n from o group by 1",
    "rank_with_runner_up": "with s as (select o_custkey, o_orderpriority, sum(floor(o_totalprice)::bigint)::double as score from orders group by 1, 2), w as (select *, row_number() over (partition by o_custkey order by score desc, o_orderpriority) as k, coalesce(lead(score) over (partition by o_custkey order by score desc, o_orderpriority), 0.0) as runner_up from s) select o_custkey, o_orderpriority, score, runner_up, score > 0 and score / (score + runner_up) >= 0.65 as chosen from w where k = 1",
    "seed_weights": "select l_orderkey, l_suppkey as topic, sum(pow(2.0, -l_linenumber))::double as weight from lineitem where l_linenumber <= 6 group by 1, 2",
    "semantic_blocks": "with g as (select *, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) >= 21600 then 1 else 0 end as new from events), s as (select *, (sum(new) over (partition by user_id order by ts rows unbounded preceding))::bigint as session from g) select user_id, session, count(*) as n, min(event_id) as first_event from s group by 1, 2",
    "section_grouping": "with h as (select page_id, unnest(regexp_extract_all(html, '<h([1-6])', 1))::int as level, unnest(range(len(regexp_extract_all(html, '<h([1-6])', 1))))::int as pos from pages) select page_id, pos, level, (select max(b.pos) from h b where b.page_id = a.page_id and b.pos < a.pos and b.level < a.level) as parent_pos from h a",
    "colocation_pins": "with p as (select distinct l_orderkey as section, l_linenumber as ref, l_suppkey as candidate, s_nationkey as scope from lineitem join supplier on l_suppkey = s_suppkey), g as (select section, ref, scope, count(*) as n, min(candidate) as c from p group by 1, 2, 3), m as (select a.section, a.ref as i, b.ref as j, count(*) as k, min(a.n) as ni, min(b.n) as nj, min(a.c) as ci, min(b.c) as cj from g a join g b using (section, scope) where a.ref < b.ref group by 1, 2, 3), v as (select * from m where k = 1 and ni = 1 and nj = 1), u as (select section, i as ref, ci as pin from v union all select section, j, cj from v) select section, ref, min(pin) as pin from u group by 1, 2 having count(distinct pin) = 1",
    "vote_summary": f"with {VOTES_SQL}, l as (select comment_id, user_id, arg_max(vote, \"at\") as vote from votes group by 1, 2) select comment_id, sum(vote)::bigint as score, count(*) filter (vote = 1) as up, count(*) filter (vote = -1) as down, max(vote) filter (user_id = 7) as mine from l group by comment_id",
    "unvoted_comments": f"with {COMMENTS_SQL}, {VOTES_SQL} select comment_id, created_at from comments where status <> 'hidden' and comment_id not in (select comment_id from votes where user_id = 7)",
    "comments_by_type_status": f"with {COMMENTS_SQL} select comment_id, audit_id, created_at from comments where comment_type = 'question' and status = 'active'",
    "comments_by_ids": f"with {COMMENTS_SQL} select comment_id, comment_type from comments where comment_id in (0, 1, 7, 1001, 2002, 5003) and status <> 'hidden'",
    "parent_chain": f"with recursive {COMMENTS_SQL}, c as (select comment_id, parent as ancestor, 1 as depth from comments where parent is not null union all select c.comment_id, p.parent, c.depth + 1 from c join comments p on c.ancestor = p.comment_id where p.parent is not null) select * from c",
    "thread_tree": f"with recursive {COMMENTS_SQL}, c as (select comment_id, comment_id as root, 0 as depth from comments where parent is null union all select x.comment_id, c.root, c.depth + 1 from comments x join c on x.parent = c.comment_id) select * from c",
    "conversation_entries": f"with {COMMENTS_SQL} select audit_id, comment_id, row_number() over (partition by audit_id order by case comment_type when 'info' then 0 when 'question' then 1 else 2 end, created_at)::int as entry from comments where status <> 'hidden'",
    "notes_joined": "select p_brand, md5(string_agg('- ' || p_name, chr(10) order by p_partkey)) as notes_md5 from part group by p_brand",
    "batch_label": "select s_nationkey, arg_min(s_name, s_suppkey) || case when count(*) > 1 then ' +' || (count(*) - 1) else '' end as label from supplier group by s_nationkey",
    "report_order": "select 'S' || p_partkey as topic, row_number() over (order by 'S' || p_partkey)::int as by_text, row_number() over (order by p_partkey)::int as by_number from part",
}
