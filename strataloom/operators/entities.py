"""User entities, listings, row shapes and comment bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.topics import topic_key

#: Variants that a listing shows, by the listing's name.
LISTINGS = {"contracts": "Contract", "documents": "Documentation", "features": "Feature", "requirements": "Requirement", "behaviors": "Behavior", "characteristics": "Characteristic", "semantics": "FunctionalSemantic"}


def listing(topics: DataFrame, variant: str, scope: DataFrame | None = None) -> DataFrame:
    """Topics whose kind is the variant or begins with `variant(`, in scope if a scope(container) is given, by topic id (prefix, number)."""
    kind = F.col("kind")
    rows = topics.filter((kind == variant) | kind.startswith(f"{variant}("))
    if scope is not None:
        rows = rows.join(scope.select("container").distinct(), "container", "left_semi")
    return rows.orderBy(topic_key(F.col("topic")), "topic")


def kind_label(kind: Column, titled: Column) -> Column:
    """Readable kind: named kinds as they are, titled ones in Titled(...), no kind as Documentation."""
    return F.when(titled, F.concat(F.lit("Titled("), kind, F.lit(")"))).otherwise(F.coalesce(kind, F.lit("Documentation")))


def scope_record(container: Column, component: Column, member: Column, blocks: Column) -> Column:
    """struct(scope_type, container, component, member, blocks): the narrowest scope that the parts name."""
    kind = F.when(F.size(F.coalesce(blocks, F.expr("array()"))) > 0, "ContainingBlock").when(member.isNotNull(), "Member").when(component.isNotNull(), "Component").when(container.isNotNull(), "Container").otherwise("Global")
    return F.struct(kind.alias("scope_type"), container.alias("container"), component.alias("component"), member.alias("member"), blocks.alias("blocks"))


def scope_of_record(record: Column) -> Column:
    """The record with only the parts that its scope_type has, which undoes scope_record."""
    depth = F.array_position(F.array(*[F.lit(x) for x in ("Global", "Container", "Component", "Member", "ContainingBlock")]), record["scope_type"]) - 1
    return F.struct(F.when(depth >= 1, record["container"]).alias("container"), F.when(depth >= 2, record["component"]).alias("component"), F.when(depth >= 3, record["member"]).alias("member"), F.when(depth >= 4, record["blocks"]).alias("blocks"))


def deeper(scope: Column, topic: Column) -> Column:
    """The scope one level further in: a container's component, a component's member, then blocks."""
    return (
        F.when(scope["component"].isNull(), scope.withField("component", topic))
        .when(scope["member"].isNull(), scope.withField("member", topic))
        .otherwise(scope.withField("blocks", F.concat(F.coalesce(scope["blocks"], F.expr("cast(array() as array<string>)")), F.array(topic))))
    )


def audit_snapshot(tables: dict[str, DataFrame], audit: Column | int) -> dict[str, DataFrame]:
    """The rows of one audit of each per-audit table; link tables follow their entity."""
    return {name: df.filter(F.col("audit_id") == audit) for name, df in tables.items()}


def snapshot_counts(table: DataFrame) -> DataFrame:
    """(audit_id, n): the rows that each audit's snapshot of a table has, for all audits by one grouping."""
    return table.groupBy("audit_id").agg(F.count("*").alias("n"))


def audit_links(links: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Link rows with the audit of their entity."""
    return links.join(entities.select(key, "audit_id"), key)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows whose key it does not hold yet; of rows with one key the first by all columns."""
    fresh = rows.select(table.columns).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*table.columns))).filter("_n = 1").drop("_n")
    return table.unionByName(fresh.join(table.select(*keys).distinct(), keys, "left_anti").select(table.columns))


def with_new_ids(rows: DataFrame, taken: DataFrame, *, by: str, order: list[str]) -> DataFrame:
    """Rows with ids after the greatest one taken(by, id) in their group, in order; 1, 2, ... where none is."""
    last = taken.groupBy(by).agg(F.max("id").alias("_last"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_place", place).join(last, by, "left").withColumn("id", F.coalesce("_last", F.lit(0)) + F.col("_place")).drop("_place", "_last")


def applied(topics: DataFrame, entities: DataFrame, key: str = "topic") -> DataFrame:
    """Topics with the user's entities; an entity replaces the topic of its id."""
    return topics.join(entities.select(key).distinct(), key, "left_anti").unionByName(entities)


def pruned(links: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Links whose entity is still there."""
    return links.join(kept.select(key).distinct(), key, "left_semi")


def with_mentions(index: DataFrame, found: DataFrame) -> DataFrame:
    """The mentions index (topic, comment_id) with what was resolved since, nothing twice."""
    return index.select("topic", "comment_id").union(found.select("topic", "comment_id")).distinct()


def occurrences(identifiers: DataFrame, *, by: str, order: str | list[str]) -> DataFrame:
    """Identifiers with their ordinal in the comment, from 0, in depth-first order."""
    keys = [order] if isinstance(order, str) else order
    return identifiers.withColumn("occurrence", F.row_number().over(Window.partitionBy(by).orderBy(*keys)) - 1)


def written_back(identifiers: DataFrame, resolved: DataFrame, *, by: str) -> DataFrame:
    """Identifiers (by, occurrence, topic) with the topic of resolved(by, occurrence, topic, candidates): the topic if one was chosen, else the candidates."""
    found = resolved.select(by, "occurrence", F.col("topic").alias("_topic"), F.col("candidates").alias("_candidates"))
    out = identifiers.join(found, [by, "occurrence"], "left")
    return out.withColumn("topic", F.coalesce("_topic", "topic")).withColumn("candidates", F.when(F.col("_topic").isNull(), F.col("_candidates"))).drop("_topic", "_candidates")


def comment_plan(comments: DataFrame, topics: DataFrame, ancestors: DataFrame, refs: DataFrame, developers: list[str]) -> DataFrame:
    """(comment_id, target, chain, known, ambiguous) of the developers' comments: the target's ancestors innermost first, resolved and ambiguous references in the text; refs(comment_id, pos, topic, n_candidates)."""
    chain = ancestors.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))), lambda x: x["ancestor"]).alias("chain"))
    known = F.array_sort(F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("pos", "topic"))))
    told = refs.groupBy("comment_id").agg(F.transform(known, lambda x: x["topic"]).alias("known"), F.array_sort(F.collect_list(F.when(F.col("topic").isNull() & (F.col("n_candidates") > 1), F.col("pos")))).alias("ambiguous"))
    mine = comments.filter(F.col("author").isin(*developers)).join(topics.select("topic"), F.col("target") == F.col("topic"), "left_semi")
    out = mine.join(chain.withColumnRenamed("topic", "target"), "target", "left").join(told, "comment_id", "left")
    empty = F.expr("cast(array() as array<string>)")
    return out.select("comment_id", "target", F.coalesce("chain", empty).alias("chain"), F.coalesce("known", empty).alias("known"), F.coalesce("ambiguous", F.expr("cast(array() as array<int>)")).alias("ambiguous"))


def first_semantic(semantics: DataFrame) -> DataFrame:
    """(declaration, description, several): of semantics(topic, declaration, description) the one with the least topic id."""
    return semantics.groupBy("declaration").agg(F.min_by("description", topic_key(F.col("topic"))).alias("description"), (F.count("*") > 1).alias("several"))


def semantics_of(semantics: DataFrame) -> DataFrame:
    """(declaration, texts) in topic order."""
    return semantics.groupBy("declaration").agg(F.transform(F.array_sort(F.collect_list(F.struct(topic_key(F.col("topic")).alias("key"), F.col("description").alias("text")))), lambda x: x["text"]).alias("texts"))


def natspec(tags: DataFrame, parameters: DataFrame, returns: DataFrame) -> DataFrame:
    """(fn, target, text) of tags(fn, pos, tag, name, text), parts of a target joined by newlines in source order.

    `notice` is the function's own; `dev` and other tags go to target `dev`;
    `param` to the parameter of its name; `return` to the return parameter whose
    name is the first word, or to the only one there is; what names nothing goes
    to `dev`. parameters and returns: (fn, name).
    """
    known = parameters.select("fn", "name", F.lit("param").alias("tag")).unionByName(returns.select("fn", "name", F.lit("return").alias("tag"))).withColumn("_known", F.lit(True)).distinct()
    only = returns.groupBy("fn").agg(F.count_distinct("name").alias("_n"), F.min("name").alias("_only"))
    word = F.when(F.col("tag") == "return", F.substring_index("text", " ", 1)).otherwise(F.col("name"))
    rows = tags.withColumn("name", word).join(known, ["fn", "name", "tag"], "left").join(only, "fn", "left")
    target = (
        F.when(F.col("tag") == "notice", "notice")
        .when(F.col("tag").isin("param", "return") & F.col("_known"), F.concat("tag", F.lit(":"), "name"))
        .when((F.col("tag") == "return") & (F.col("_n") == 1), F.concat(F.lit("return:"), "_only"))
        .otherwise("dev")
    )
    return rows.groupBy("fn", target.alias("target")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def specific_mentions(refs: DataFrame) -> DataFrame:
    """(topic, mentions): of refs(topic, ref, doc_topic, depth) the most specific document topic of each reference, each once."""
    deepest = refs.groupBy("topic", "ref").agg(F.max_by("doc_topic", F.struct("depth", "doc_topic")).alias("doc"))
    return deepest.groupBy("topic").agg(F.array_sort(F.collect_set("doc")).alias("mentions"))
