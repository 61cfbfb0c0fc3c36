"""Joins, indexes and set operators over the knowledge base's tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.tables import COMMON_WORDS
from strataloom.functions.topics import severity_rank


def resolve_proxy(rows: DataFrame, topics: DataFrame, col: str) -> DataFrame:
    """rows with `col` replaced by its transitive topic, if it has one (one hop)."""
    hop = topics.filter("transitive is not null").select(F.col("topic").alias(col), F.col("transitive").alias("_to"))
    return rows.join(hop, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")


def call_edges(calls: DataFrame, topics: DataFrame, in_scope: DataFrame, *, with_try: bool = True) -> DataFrame:
    """(callee, caller): proxies resolved, both ends in scope, no self loop, each once."""
    rows = calls if with_try else calls.filter(~F.col("in_try"))
    ends = resolve_proxy(rows.select("caller", "callee"), topics, "callee").filter("caller <> callee")
    for end in ("caller", "callee"):
        ends = ends.join(in_scope.select(F.col("topic").alias(end)), end, "left_semi")
    return ends.select("callee", "caller").distinct()


def single_implementation(pairs: DataFrame, *, base: str, impl: str) -> DataFrame:
    """Bases with exactly one implementation, and that one."""
    return pairs.groupBy(base).agg(F.min(impl).alias(impl), F.count_distinct(impl).alias("_n")).filter("_n = 1").drop("_n")


def first_match(rows: DataFrame, tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """rows + value from the first table (key, value) that has the key."""
    out = rows
    for i, t in enumerate(tables):
        out = out.join(t.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(tables))])).drop(*[f"_v{i}" for i in range(len(tables))])


def reverse_index(links: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): distinct values of each key, ascending."""
    return links.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def name_index(names: DataFrame) -> DataFrame:
    """(name, topic, n, ambiguous) of names(name, topic, transitive): the unique topic, or the unique one that is no proxy; common words are left out."""
    direct = F.col("transitive").isNull()
    agg = names.filter(~F.col("name").isin(*COMMON_WORDS)).groupBy("name").agg(F.count("*").alias("n"), F.min("topic").alias("one"), F.count_if(direct).alias("n_direct"), F.min(F.when(direct, F.col("topic"))).alias("direct"))
    topic = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_direct") == 1, F.col("direct"))
    return agg.select("name", topic.alias("topic"), "n", (topic.isNull() & (F.col("n") > 1)).alias("ambiguous"))


def last_wins(rows: DataFrame, key: str, value: str, order: str | Column) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def candidates(names: DataFrame) -> DataFrame:
    """(name, candidates): all topics of a name, ascending."""
    return names.groupBy("name").agg(F.array_sort(F.collect_list("topic")).alias("candidates"))


def missing_and_extra(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """(key, side): expected but not received, and the reverse."""
    lost = expected.select(key).join(received, key, "left_anti").distinct().withColumn("side", F.lit("missing"))
    more = received.select(key).join(expected, key, "left_anti").distinct().withColumn("side", F.lit("extra"))
    return lost.unionByName(more)


def drop_subsumed(refs: DataFrame, *, by: str, ref: str, ancestors: str) -> DataFrame:
    """References none of whose ancestors is itself referenced in the same group."""
    above = refs.select(by, ref, F.explode(ancestors).alias("_above"))
    hit = above.join(refs.select(F.col(by).alias("_by"), F.col(ref).alias("_ref")), (F.col(by) == F.col("_by")) & (F.col("_above") == F.col("_ref"))).select(by, ref).distinct()
    return refs.join(hit, [by, ref], "left_anti")


def priority_union(first: DataFrame, second: DataFrame, keys: list[str], tags: tuple[str, str] = ("mechanical", "bm25")) -> DataFrame:
    """Rows of both, a pair of the second only if the first lacks it; `source` says which."""
    a, b = first.select(*keys).distinct().withColumn("source", F.lit(tags[0])), second.select(*keys).distinct().withColumn("source", F.lit(tags[1]))
    return a.unionByName(b.join(a, keys, "left_anti"))


def first_occurrence(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def choose(ranked: DataFrame, *, by: str, candidate: str, score: str, ratio: float) -> DataFrame:
    """(by, candidate, score, runner_up, chosen): the best, and whether best / (best + second) reaches the ratio; a best of 0 is not chosen."""
    w = Window.partitionBy(by).orderBy(F.desc(score), candidate)
    top = ranked.withColumn("_n", F.row_number().over(w)).withColumn("runner_up", F.coalesce(F.lead(score).over(w), F.lit(0.0))).filter("_n = 1")
    share = F.try_divide(F.col(score), F.col(score) + F.col("runner_up"))
    return top.select(by, candidate, score, "runner_up", ((F.col(score) > 0) & (share >= ratio)).alias("chosen"))


def seed_weights(chain: DataFrame, *, by: str, topic: str, distance: str, deepest: int) -> DataFrame:
    """(by, topic, weight): sum of 2 ** -distance over the ancestors up to a depth."""
    return chain.filter(F.col(distance) <= deepest).groupBy(by, topic).agg(F.sum(F.pow(F.lit(2.0), -F.col(distance))).alias("weight"))


def sessions(rows: DataFrame, *, by: str, at: str, gap_seconds: float) -> DataFrame:
    """rows + session: a new one after a gap of at least gap_seconds."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double") >= gap_seconds, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def statement_blocks(statements: DataFrame, *, by: str) -> DataFrame:
    """statements(by, pos, gap_text) + block: a new one where the text before a statement holds two line ends or more."""
    w = Window.partitionBy(by).orderBy("pos")
    new = F.when((F.col("pos") > F.min("pos").over(Window.partitionBy(by))) & (F.regexp_count("gap_text", F.lit("\n")) >= 2), 1).otherwise(0)
    return statements.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def heading_parents(headings: DataFrame, *, by: str) -> DataFrame:
    """headings(by, pos, level) + parent_pos: the nearest earlier heading of a smaller level."""
    w = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(w) for k in range(1, 7)]
    shallower = F.greatest(*[F.when(F.col("level") > k, last[k - 1]) for k in range(1, 7)], F.lit(None).cast("int"))
    return headings.withColumn("parent_pos", shallower)


def pinned(pairs: DataFrame) -> DataFrame:
    """(ref, pin) from candidate rows pairs(section, ref, candidate, scope).

    Two refs of a section pin each other if their scope sets share exactly one
    scope and each has exactly one candidate in it. A ref with different pins
    from different partners has none; its partners keep theirs.
    """
    in_scope = pairs.filter("scope is not null").groupBy("section", "ref", "scope").agg(F.count_distinct("candidate").alias("n"), F.min("candidate").alias("candidate"))
    a = in_scope.select("section", "scope", F.col("ref").alias("i"), F.col("n").alias("ni"), F.col("candidate").alias("ci"))
    b = in_scope.select("section", "scope", F.col("ref").alias("j"), F.col("n").alias("nj"), F.col("candidate").alias("cj"))
    shared = a.join(b, ["section", "scope"]).filter("i < j").groupBy("section", "i", "j").agg(F.count("*").alias("scopes"), F.min("ni").alias("ni"), F.min("nj").alias("nj"), F.min("ci").alias("ci"), F.min("cj").alias("cj"))
    good = shared.filter("scopes = 1 and ni = 1 and nj = 1")
    both = good.select("section", F.col("i").alias("ref"), F.col("ci").alias("pin")).unionByName(good.select("section", F.col("j").alias("ref"), F.col("cj").alias("pin")))
    return both.groupBy("section", "ref").agg(F.min("pin").alias("pin"), F.count_distinct("pin").alias("_n")).filter("_n = 1").drop("_n")


def transitive_effects(calls: DataFrame, direct: DataFrame, *, keep_try: bool, parts: DataFrame | None = None) -> DataFrame:
    """(fn, origin, effect, target): effects of all functions that fn reaches, itself included, each once.

    calls(caller, callee, in_try); direct(fn, effect, target). Reverts pass
    keep_try=False: a call inside try does not carry them. `parts` (node, part) of
    all calls serves both graphs (see call_parts).
    """
    from strataloom.operators.graph import fold_components

    used = calls if keep_try else calls.filter(~F.col("in_try"))
    own = direct.select(F.col("fn").alias("node"), "effect", "target")
    lift = {"origin": F.col("node"), "effect": F.col("effect"), "target": F.col("target")}
    return fold_components(used.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), own, lift=lift, dedup=[F.col("origin"), F.col("effect"), F.col("target")], parts=parts).withColumnRenamed("node", "fn")


def call_parts(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """(node, part): the weakly connected parts of the whole call graph, functions without calls included."""
    from strataloom.operators.graph import weak_parts

    return weak_parts(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), direct.select(F.col("fn").alias("node")))


def invalidated(invariants: DataFrame, validations: DataFrame, threats: DataFrame, conditions: DataFrame) -> DataFrame:
    """Invariants whose verdict is absent or partial, with threat, condition and subject; severest first, then the id as a string."""
    bad = validations.filter(F.col("verdict").isin("absent", "partial"))
    out = invariants.join(bad, "invariant").join(threats, "threat", "left").join(conditions, "condition", "left")
    return out.withColumn("severity", F.coalesce("severity", F.lit("pending"))).withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(F.desc("severity_rank"), F.col("invariant").cast("string"))


def vote_summary(votes: DataFrame, *, by: str, user: int) -> DataFrame:
    """(by, score, up, down, mine) of votes(by, user_id, vote)."""
    return votes.groupBy(by).agg(F.coalesce(F.sum("vote"), F.lit(0)).alias("score"), F.count_if(F.col("vote") == 1).alias("up"), F.count_if(F.col("vote") == -1).alias("down"), F.max(F.when(F.col("user_id") == user, F.col("vote"))).alias("mine"))


def latest(rows: DataFrame, keys: list[str], value: list[str], at: str | Column) -> DataFrame:
    """The last write of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), at).alias("_v")).select(*keys, "_v.*")


def unvoted(comments: DataFrame, votes: DataFrame, *, user: int) -> DataFrame:
    """Visible comments without a vote of the user, newest first."""
    mine = votes.filter(F.col("user_id") == user).select("comment_id").distinct()
    return comments.filter("status <> 'hidden'").join(mine, "comment_id", "left_anti").orderBy(F.desc("created_at"), F.desc("comment_id"))


def by_ids(comments: DataFrame, ids: list) -> DataFrame:
    """Visible comments of an id list, newest first; an empty list gives none."""
    return comments.filter(F.col("comment_id").isin(*ids) & (F.col("status") != "hidden")).orderBy(F.desc("created_at"), F.desc("comment_id")) if ids else comments.limit(0)


def parent_chain(comments: DataFrame) -> DataFrame:
    """(comment_id, ancestor, depth): all ancestors of each comment(comment_id, parent), nearest at depth 1.

    Paths double each round until none grows; a comment that is its own ancestor is an error.
    """
    from strataloom.sources.shared import write_out

    out = write_out(comments.select("comment_id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).filter("ancestor is not null"), "chain")
    step, reach = out, 1
    while step.limit(1).count() > 0:
        if step.filter("comment_id = ancestor").limit(1).count() > 0:
            raise ValueError("the parents form a cycle")
        ends = out.filter(F.col("depth") == reach).select("comment_id", F.col("ancestor").alias("_end"))
        more = out.select(F.col("comment_id").alias("_end"), "ancestor", (F.col("depth") + reach).alias("depth"))
        step = write_out(ends.join(more, "_end").select("comment_id", "ancestor", "depth"), "chain")
        out, reach = out.unionByName(step), 2 * reach
    return out
