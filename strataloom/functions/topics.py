"""Topic ids, names, scopes, purity and label codecs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.tables import SEVERITIES, TOPIC_PREFIXES


def parse_topic(c: Column) -> Column:
    """struct<prefix, num_id, error>: error is empty, prefix or number; null if fine."""
    prefix = F.left(c, F.lit(1))
    number = F.substring(c, 2, 20).try_cast("int")
    error = F.when(c.isNull() | (c == ""), "empty").when(~prefix.isin(*TOPIC_PREFIXES), "prefix").when(number.isNull() | ~F.substring(c, 2, 20).rlike(r"^-?\d+$"), "number")
    return F.struct(F.when(error.isNull(), prefix).alias("prefix"), F.when(error.isNull(), number).alias("num_id"), error.alias("error"))


def topic_key(c: Column) -> Column:
    """Sort key of a topic id: prefix order, then the signed number (never the string)."""
    t = parse_topic(c)
    return F.struct(reduce(lambda acc, p: acc.when(t["prefix"] == p[1], p[0]), enumerate(TOPIC_PREFIXES), F.when(F.lit(False), 0)).alias("ord"), t["num_id"].alias("num"))


def is_kind(c: Column, prefix: str) -> Column:
    return parse_topic(c)["prefix"] == prefix


def qualified_name(component: Column, member: Column, name: Column) -> Column:
    """component.member.name with absent parts left out; null for an unnamed topic."""
    return F.when(name.isNotNull(), F.concat_ws(".", component, member, name))


def ancestors(component: Column, member: Column, blocks: Column) -> Column:
    """Outermost first, without nulls."""
    return F.filter(F.concat(F.array(component, member), F.coalesce(blocks, F.array().cast("array<string>"))), lambda x: x.isNotNull())


def scope_summary(kind: Column, container: Column, component: Column, member: Column, signature: Column) -> Column:
    return (
        F.when(kind == "Global", "global")
        .when(kind == "Container", F.concat(F.lit("file: "), container))
        .when(kind == "Component", F.concat(F.lit("in "), component, F.lit(" (file: "), container, F.lit(")")))
        .when(kind == "Member", F.concat(F.lit("in "), component, F.lit("::"), member, F.when(signature.isNotNull(), F.lit(" [signature]")).otherwise(F.lit(""))))
        .otherwise(F.concat(F.lit("inside "), component, F.lit("::"), member))
    )


def named_purity(kind: Column) -> Column:
    return F.when(kind == "StateVariable:Mutable", "NonPure").otherwise("Pure")


def node_purity(kind: Column, call_purity: Column) -> Column:
    return F.when(kind.isin("Mutation", "InlineAssembly", "NewExpression"), "NonPure").when((kind == "FunctionCall") & (call_purity == "NonPure"), "NonPure").otherwise("Pure")


def call_purity(calls: DataFrame, functions: DataFrame, interface_map: DataFrame) -> DataFrame:
    """calls(call, callee) + purity: the callee is mapped through the interface map; pure and view are Pure, the unknown is NonPure."""
    mapped = calls.join(interface_map.select(F.col("interface").alias("callee"), "implementation"), "callee", "left").withColumn("real", F.coalesce("implementation", "callee"))
    known = mapped.join(functions.select(F.col("topic").alias("real"), "mutability"), "real", "left")
    return known.select("call", "callee", F.when(F.col("mutability").isin("pure", "view"), "Pure").otherwise("NonPure").alias("purity"))


def is_public_member(kind: Column, visibility: Column) -> Column:
    return kind.isin("Event", "Error", "Struct", "Enum") | kind.isin("Function", "Modifier") & visibility.isin("public", "external") | (kind == "StateVariable") & (visibility == "public")


def is_indexable(kind: Column) -> Column:
    return kind.isin("Function", "Modifier", "Event", "Error", "Struct", "Enum", "EnumMember", "StateVariable", "LocalVariable")


def severity_rank(c: Column) -> Column:
    """critical 3 to low 0; pending or unknown -1."""
    return reduce(lambda acc, s: acc.when(c == s[0], s[1]), SEVERITIES[1:], F.when(c == SEVERITIES[0][0], SEVERITIES[0][1])).otherwise(-1)


def status_of(c: Column) -> Column:
    """Comment status: unknown ones are active."""
    from strataloom.functions.code import comment_status_of

    return comment_status_of(c)


def author_of(id_: Column, system: dict[int, str]) -> Column:
    """Fixed ids 1 to 7 have names; any other id is a user."""
    return reduce(lambda acc, kv: acc.when(id_ == kv[0], kv[1]), system.items(), F.when(id_.isNull(), F.lit(None))).otherwise(F.concat(F.lit("user:"), id_.cast("string")))


def next_ids(rows: DataFrame, taken: DataFrame, *, prefix: str, order: list[str]) -> DataFrame:
    """rows + topic: the highest taken number of the prefix plus a rank in a total order."""
    from pyspark.sql import Window

    top = taken.filter(F.col("prefix") == prefix).agg(F.coalesce(F.max("num_id"), F.lit(0)).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("topic", F.concat(F.lit(prefix), (F.col("_top") + F.row_number().over(Window.orderBy(*order))).cast("string"))).drop("_top")


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
