"""The relational parts of the ten analysis steps: what goes into a model's prompt and how its answers become rows.

The model itself is passed in as an annotator (validators.annotate).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources.shared import shared_folder


def condensed(texts: DataFrame, topics: DataFrame, condense: Callable[[list[str]], str]) -> DataFrame:
    """(declaration, text): texts(declaration, ord, text) after one proxy hop; a single text passes through, several go to the condenser in order."""
    from strataloom.operators.relations import resolve_proxy

    rows = resolve_proxy(texts, topics.select("topic", "transitive"), "declaration")
    grouped = rows.groupBy("declaration").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    one = grouped.filter(F.size("texts") == 1).select("declaration", F.col("texts")[0].alias("text"))

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"declaration": f["declaration"], "text": [condense(list(t)) for t in f["texts"]]})

    schema = grouped.select("declaration", F.lit("").alias("text")).schema
    return one.unionByName(grouped.filter(F.size("texts") > 1).mapInPandas(run, schema))


def parsed_requirements(answers: DataFrame, sections: DataFrame, documents: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(answer, requirement, section): requirements of answers(answer, json); unknown sections and documents are skipped, an unknown kind is an error."""
    schema = "array<struct<id:string,kind:string,document:string,sections:array<string>>>"
    rows = answers.select("answer", F.explode(F.from_json("json", schema)).alias("r")).select("answer", "r.*")
    rows = rows.withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null"))))))
    rows = rows.join(documents.select("document"), "document", "left_semi").select("answer", F.col("id").alias("requirement"), "kind", F.explode("sections").alias("section"))
    return rows.join(sections.select("section"), "section", "left_semi").distinct()


def parsed_behaviors(answers: DataFrame) -> DataFrame:
    """(answer, member, text): behaviors of answers(answer, json); ids that are no N topics are skipped."""
    rows = answers.select("answer", F.explode(F.from_json("json", "array<struct<member:string,behaviors:array<string>>>")).alias("r"))
    return rows.filter(F.col("r.member").rlike("^N-?[0-9]+$")).select("answer", "r.member", F.posexplode("r.behaviors").alias("pos", "text"))


def allowed_ids(batches: DataFrame, field: str) -> DataFrame:
    """(batch, subject, id): the ids that each subject of a batch (batch, json) may be answered with."""
    schema = f"array<struct<subject:string,{field}:array<string>>>"
    rows = batches.select("batch", F.explode(F.from_json("json", schema)).alias("s"))
    return rows.select("batch", "s.subject", F.explode(f"s.{field}").alias("id")).distinct()


def validated(answers: DataFrame, allowed: DataFrame, *, order: str, evidence: str | None = None) -> DataFrame:
    """Answers (batch, subject, id, order, ...) of allowed ids; of several for one subject and id the first in order; with malformed evidence (no `file:line`) dropped."""
    rows = answers.join(allowed, ["batch", "subject", "id"], "left_semi")
    if evidence:
        rows = rows.filter(F.col(evidence).isNull() | F.col(evidence).rlike("^[^:]+:[0-9]+$"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("batch", "subject", "id").orderBy(order))).filter("_n = 1").drop("_n")


def subjects_with(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects that have rows; those without are dropped before the next step."""
    return subjects.join(rows.select("subject").distinct(), "subject", "left_semi")


def eligible_members(members: DataFrame, with_feature: DataFrame, non_pure: DataFrame) -> DataFrame:
    """(member, n_subjects): members that have a feature and non-pure subjects(member, subject)."""
    counted = non_pure.groupBy("member").agg(F.count_distinct("subject").alias("n_subjects"))
    return members.select("member").distinct().join(with_feature, "member", "left_semi").join(counted, "member")


def cleared(topics: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Topics without those that a step makes anew."""
    return topics.filter(~F.col("kind").isin(*kinds))


def direct_io(effects: DataFrame, topics: DataFrame) -> DataFrame:
    """(fn, effect, targets): reads and writes of state variables, in place order, repeats kept."""
    kept = effects.filter(F.col("effect").isin("read", "write")).join(topics.filter(F.col("kind").startswith("StateVariable")).select(F.col("topic").alias("target")), "target", "left_semi")
    return kept.groupBy("fn", "effect").agg(F.transform(F.array_sort(F.collect_list(F.struct("site", "target"))), lambda x: x["target"]).alias("targets"))


def _least_effects(effects: DataFrame, by: list[str]) -> DataFrame:
    key = F.when(F.col("effect") == "revert", F.coalesce("target", F.concat(F.lit("stmt "), F.col("stmt").cast("string")))).otherwise(F.col("target"))
    rows = effects.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "effect", "_key").orderBy("site")))
    return rows.filter("_n = 1").drop("_key", "_n")


def distinct_effects(effects: DataFrame) -> DataFrame:
    """Effects (fn, origin, effect, target, stmt, site): reverts once for each origin, effect and error (or statement without one), others for each origin and target; the least place stands."""
    return _least_effects(effects, ["fn", "origin"])


def called_effects(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """distinct_effects() of calls(fn, origin) joined with effects(origin, effect, target, stmt, site).

    All callers see the same effects of an origin, so these are made distinct
    before callers and effects meet; the joined rows are not shuffled again.
    """
    return calls.select("fn", "origin").distinct().join(_least_effects(effects, ["origin"]), "origin")


def effect_clauses(effects: DataFrame, names: DataFrame) -> DataFrame:
    """(fn, clauses): `reads (a, b) writes (c) emits (d) reverts (e)` with each name once, in place order; a kind without any is left out."""
    verb = F.create_map(*[F.lit(x) for pair in (("read", "reads"), ("write", "writes"), ("event", "emits"), ("revert", "reverts")) for x in pair])
    rank = F.create_map(*[x for i, k in enumerate(("read", "write", "event", "revert")) for x in (F.lit(k), F.lit(i))])
    first = effects.groupBy("fn", "effect", "target").agg(F.min("site").alias("site")).join(names.select(F.col("topic").alias("target"), "name"), "target")
    lists = first.groupBy("fn", "effect").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "name"))), lambda x: x["name"]), ", ").alias("names"))
    clause = F.concat(verb[F.col("effect")], F.lit(" ("), "names", F.lit(")"))
    return lists.groupBy("fn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank[F.col("effect")].alias("rank"), clause.alias("clause")))), lambda x: x["clause"]), " ").alias("clauses"))


def revert_messages(calls: DataFrame, arguments: DataFrame, errors: DataFrame) -> DataFrame:
    """(site, kind, message): of require and revert calls(site, kind, error) the error's name, else the literal argument (place 1 for require, 0 for revert); arguments(site, pos, literal), errors(error, name)."""
    place = F.when(F.col("kind") == "require", 1).otherwise(0)
    literal = arguments.select("site", F.col("pos").alias("_pos"), "literal")
    out = calls.withColumn("_pos", place).join(literal, ["site", "_pos"], "left").join(errors, "error", "left")
    return out.select("site", "kind", F.coalesce("name", "literal").alias("message"))


def rendered(members: DataFrame, effects: DataFrame, calls: DataFrame) -> DataFrame:
    """(member, json): a member with its visibility, written variables, emitted events and callees, lists ascending, as JSON."""

    def lists(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("topic")).agg(F.array_sort(F.collect_set(value)).alias(name))

    empty = F.expr("cast(array() as array<string>)")
    out = members.join(lists(effects.filter("effect = 'write'"), "fn", "target", "writes"), "topic", "left").join(lists(effects.filter("effect = 'event'"), "fn", "target", "emits"), "topic", "left").join(lists(calls, "fn", "callee", "calls"), "topic", "left")
    body = F.struct("topic", "name", "visibility", *(F.coalesce(x, empty).alias(x) for x in ("writes", "emits", "calls")))
    return out.select(F.col("topic").alias("member"), F.to_json(body).alias("json"))


def chunks(rows: DataFrame, *, by: str, order: list[str], size: int) -> DataFrame:
    """Rows with a chunk number: `size` rows each within `by`, in order."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))


def merge_tree(items: DataFrame, merge: Callable[[DataFrame], DataFrame], *, by: str, folder: str | None = None) -> DataFrame:
    """(by, body): the answers of each `by` merged two and two, round by round, until one is left.

    items(by, place, body) with places 0, 1, 2, ... in each `by`. merge takes
    (by, place, left, right) rows and returns (by, place, body), a model's answers
    for instance; an answer without partner goes on as it is. The tree depends on
    places alone, never on partitions. Every round is written to the shared
    folder; with `folder` named, a run that was broken off goes on behind its last
    whole round and asks nothing again.
    """
    spark = items.sparkSession
    folder = folder or f"{shared_folder(spark)}/strataloom-merge-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first = items.select(by, F.col("place").cast("long").alias("place"), "body")
    schema, k = first.schema, 0

    def merged(rows: DataFrame) -> DataFrame:
        pair = F.expr("place div 2").alias("place")
        left = rows.filter("place % 2 = 0").select(by, pair, F.col("body").alias("left"))
        right = rows.filter("place % 2 = 1").select(by, pair, F.col("body").alias("right"))
        answers = merge(left.join(right, [by, "place"])).select(by, "place", "body")
        return answers.unionByName(left.join(right, [by, "place"], "left_anti").withColumnRenamed("left", "body"))

    make = lambda: first
    while True:
        at = f"{folder}/round={k}"
        if not fs.exists(path(f"{at}/_SUCCESS")):
            make().write.mode("overwrite").parquet(at)
        rows = spark.read.schema(schema).parquet(at)
        if not rows.filter("place > 0").head(1):
            return rows.select(by, "body")
        make, k = lambda rows=rows: merged(rows), k + 1


def section_text(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """(section, text): `Section: title`, then its parts by place, one to a line."""
    body = parts.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return sections.join(body, "section", "left").select("section", F.concat_ws("\n", F.concat(F.lit("Section: "), "title"), "body").alias("text"))
