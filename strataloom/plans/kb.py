"""Knowledge-base tables over the driver's tables, with the same tables as SQL.

Contracts are nations (in the file of their region; every fifth is an
interface), functions and modifiers are customers, state variables are parts,
events and errors are suppliers, locals are orders. A customer's line items are
the calls, writes, reads, events and reverts of its function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.plans.tables import line_parts, node, read


def _topic(topic: Column, kind: Column, name: Column, container: Column | None, component: Column | None, member: Column | None, visibility: Column, transitive: Column | None) -> list[Column]:
    none = F.lit(None).cast("string")
    given = {"topic": topic, "kind": kind, "name": name, "container": container, "component": component, "member": member, "visibility": visibility, "transitive": transitive}
    return [(none if c is None else c).alias(k) for k, c in given.items()]


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])


def contracts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 5 == 0, "Contract(Interface)").otherwise("Contract(Contract)")
    return _nations(spark, d).select(*_topic(node("k", "n_nationkey"), kind, F.col("n_name"), F.col("r_name"), None, None, F.lit("public"), None))


def functions(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), F.broadcast(_nations(spark, d).select("n_nationkey", "r_name"))
    kind = F.when(F.col("c_custkey") % 4 == 0, "Modifier").otherwise("Function(Function)")
    seen = F.when(F.col("c_custkey") % 3 == 0, "public").when(F.col("c_custkey") % 3 == 1, "external").otherwise("internal")
    proxy = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("f"), (F.col("c_custkey") - 1).cast("string")))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(*_topic(node("f", "c_custkey"), kind, F.col("c_name"), F.col("r_name"), node("k", "c_nationkey"), None, seen, proxy))


def variables(spark: SparkSession, d: str) -> DataFrame:
    p, n = read(spark, d, "part").withColumn("_n", F.col("p_size") % 25), F.broadcast(_nations(spark, d).select("n_nationkey", "r_name"))
    seen = F.when(F.col("p_partkey") % 2 == 0, "public").otherwise("internal")
    return p.join(n, F.col("_n") == n["n_nationkey"]).select(*_topic(node("v", "p_partkey"), F.lit("StateVariable(Mutable)"), F.col("p_name"), F.col("r_name"), node("k", "n_nationkey"), None, seen, None))


def signals(spark: SparkSession, d: str) -> DataFrame:
    s, n = read(spark, d, "supplier"), F.broadcast(_nations(spark, d).select("n_nationkey", "r_name"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "Event").otherwise("Error")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(*_topic(node("e", "s_suppkey"), kind, F.col("s_name"), F.col("r_name"), node("k", "s_nationkey"), None, F.lit("public"), None))


def local_variables(spark: SparkSession, d: str) -> DataFrame:
    o, f = read(spark, d, "orders"), functions(spark, d).select(F.col("topic").alias("fn"), "container", "component")
    return o.join(f, node("f", "o_custkey") == f["fn"]).select(*_topic(node("l", "o_orderkey"), F.lit("LocalVariable"), F.concat(F.lit("local"), F.col("o_orderkey").cast("string")), F.col("container"), F.col("component"), F.col("fn"), F.lit("internal"), None))


def topics(spark: SparkSession, d: str) -> DataFrame:
    out = contracts(spark, d)
    for part in (functions, variables, signals, local_variables):
        out = out.unionByName(part(spark, d))
    return out


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(fn, site, pos, line columns): line items with the function that they belong to."""
    o = read(spark, d, "orders").select("o_orderkey", node("f", "o_custkey").alias("fn"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    if parts := line_parts(spark, d):
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).withColumn("site", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("fn", "site", node("f", "l_suppkey").alias("callee"), ((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F")).alias("in_try"))


def effects(spark: SparkSession, d: str) -> DataFrame:
    """(fn, effect, target, site): direct writes, reads, events and reverts."""
    signal = F.when(F.col("l_suppkey") % 2 == 0, "event").otherwise("revert")
    effect = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "N", "read").otherwise(signal)
    target = F.when(F.col("l_returnflag") == "A", node("e", "l_suppkey")).otherwise(node("v", "l_partkey"))
    return lines(spark, d).select("fn", effect.alias("effect"), target.alias("target"), "site")


def inheritance(spark: SparkSession, d: str) -> DataFrame:
    """(child, base): a nation derives from the one at half and the one at a third of its number."""
    n = read(spark, d, "nation").filter("n_nationkey > 0")
    half = n.select(node("k", "n_nationkey").alias("child"), F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("base"))
    third = n.select(node("k", "n_nationkey").alias("child"), F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("base"))
    return half.unionByName(third).distinct()


def scope_contracts(spark: SparkSession, d: str) -> DataFrame:
    """(topic): contracts in scope, those of the files AMERICA and ASIA."""
    return contracts(spark, d).filter(F.col("container").isin("AMERICA", "ASIA")).select("topic")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(section, ref, pos, candidate): a section is an order, its references are its line items, and a reference may mean the part or the supplier."""
    li = lines(spark, d).select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", "l_returnflag")
    part = li.select("section", "pos", node("v", "l_partkey").alias("candidate"))
    return part.unionByName(li.filter("l_returnflag = 'N'").select("section", "pos", node("e", "l_suppkey").alias("candidate")))


KB_SQL = """
kn as (select *, 'k' || n_nationkey as k from nation join region on n_regionkey = r_regionkey),
contracts as (select k as topic, case when n_nationkey % 5 = 0 then 'Contract(Interface)' else 'Contract(Contract)' end as kind, n_name as name, r_name as container, null::varchar as component, null::varchar as member, 'public' as visibility, null::varchar as transitive from kn),
functions as (select 'f' || c_custkey as topic, case when c_custkey % 4 = 0 then 'Modifier' else 'Function(Function)' end as kind, c_name as name, r_name as container, k as component, null::varchar as member,
  case c_custkey % 3 when 0 then 'public' when 1 then 'external' else 'internal' end as visibility, case when c_custkey % 10 = 0 then 'f' || (c_custkey - 1) end as transitive from customer join kn on c_nationkey = n_nationkey),
variables as (select 'v' || p_partkey as topic, 'StateVariable(Mutable)' as kind, p_name as name, r_name as container, k as component, null::varchar as member, case when p_partkey % 2 = 0 then 'public' else 'internal' end as visibility, null::varchar as transitive from part join kn on p_size % 25 = n_nationkey),
signals as (select 'e' || s_suppkey as topic, case when s_suppkey % 2 = 0 then 'Event' else 'Error' end as kind, s_name as name, r_name as container, k as component, null::varchar as member, 'public' as visibility, null::varchar as transitive from supplier join kn on s_nationkey = n_nationkey),
locals as (select 'l' || o_orderkey as topic, 'LocalVariable' as kind, 'local' || o_orderkey as name, container, component, topic as member, 'internal' as visibility, null::varchar as transitive from orders join functions on 'f' || o_custkey = topic),
topics as (select * from contracts union all select * from functions union all select * from variables union all select * from signals union all select * from locals),
lines as (select 'f' || o_custkey as fn, l_orderkey * 10 + l_linenumber as site, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus from lineitem join orders on l_orderkey = o_orderkey),
calls as (select fn, site, 'f' || l_suppkey as callee, l_linenumber = 1 and l_linestatus = 'F' as in_try from lines),
effects as (select fn, case l_returnflag when 'R' then 'write' when 'N' then 'read' else case when l_suppkey % 2 = 0 then 'event' else 'revert' end end as effect, case when l_returnflag = 'A' then 'e' || l_suppkey else 'v' || l_partkey end as target, site from lines),
inheritance as (select 'k' || n_nationkey as child, 'k' || (n_nationkey // 2) as base from nation where n_nationkey > 0 union select 'k' || n_nationkey, 'k' || (n_nationkey // 3) from nation where n_nationkey > 0),
scope_contracts as (select topic from contracts where container in ('AMERICA', 'ASIA')),
mentions as (select l_orderkey as section, l_linenumber as pos, 'v' || l_partkey as candidate from lines union all select l_orderkey, l_linenumber, 'e' || l_suppkey from lines where l_returnflag = 'N')
"""
