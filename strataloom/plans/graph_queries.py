"""Graph queries: PageRank, reachability, effects, components, layers, batches and resolution rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.tables import TOP_EDGES
from strataloom.operators import graph as g
from strataloom.operators import relations as r
from strataloom.operators import resolve
from strataloom.plans import kb
from strataloom.plans.tables import GRAPH_SQL, call_pairs, contains_pairs, graph, graph_pairs, node, read
from strataloom.sources.shared import write_out


def edge_dedup_undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d)


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("total_w"))


def out_weight(spark: SparkSession, d: str) -> DataFrame:
    return g.out_weights(graph(spark, d)).select("src", F.round("out_w", 6).alias("out_w"))


def residual_references(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "lineitem").select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst")).unionByName(contains_pairs(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(read(spark, d, "lineitem").select(node("c", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst")))
    return g.residual_references(refs, graph_pairs(spark, d))


def graph_dump(spark: SparkSession, d: str) -> DataFrame:
    return g.in_order(graph(spark, d)).select("src", "dst", "kind", "ord")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("seed_set"), node("n", "n_nationkey").alias("node"), F.lit(1.0).alias("weight"))


def ppr_nation_seed(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of nations, customers and suppliers for one nation as seed; 0 where it does not reach."""
    ranks = g.pagerank(graph(spark, d), _seeds(spark, d).filter("seed_set = 3"), every=True)
    return ranks.filter("node like 'n%' or node like 'c%' or node like 's%'").select("node", F.round("rank", 6).alias("rank"))


def ppr_multi_seed(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the suppliers for every nation's seed set."""
    return g.pagerank(graph(spark, d), _seeds(spark, d)).filter("node like 's%'").select("seed_set", "node", F.round("rank", 6).alias("rank"))


def ppr_top_edges(spark: SparkSession, d: str) -> DataFrame:
    e = write_out(graph(spark, d), "edges")
    ranks = g.pagerank(e, _seeds(spark, d).filter("seed_set = 3"), written=True)
    targets = read(spark, d, "customer").filter("c_nationkey = 3").select(node("c", "c_custkey").alias("node"))
    return g.top_contributions(e, ranks, targets, TOP_EDGES).select("dst", "src", "kind", F.round("contribution", 6).alias("contribution"), "place")


def reachability(spark: SparkSession, d: str) -> DataFrame:
    """What each region of the tree reaches: nations, customers, orders."""
    top = read(spark, d, "nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    pairs = top.unionByName(contains_pairs(spark, d)).unionByName(call_pairs(spark, d))
    far = g.reach(pairs, read(spark, d, "region").select(node("r", "r_regionkey").alias("root"), node("r", "r_regionkey").alias("node")))
    return far.groupBy("root", F.left("node", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def ancestry(spark: SparkSession, d: str) -> DataFrame:
    up = read(spark, d, "customer").select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst")).unionByName(read(spark, d, "nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")))
    return g.closure(up)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Part to part calls with some cycles."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    n = p.agg(F.count("*").alias("n"))
    forward = p.crossJoin(F.broadcast(n)).select(F.col("k").alias("src"), ((F.col("k") * 2 + F.col("p_size")) % F.col("n") + 1).alias("dst"))
    return forward.filter("src % 3 != 0 and src != dst and dst % 5 != 0")


_CALLS_SQL = "pc as (select src, dst from (select p_partkey as src, (p_partkey * 2 + p_size) % (select count(*) from part) + 1 as dst from part) where src % 3 <> 0 and src <> dst and dst % 5 <> 0)"


def scc_components(spark: SparkSession, d: str) -> DataFrame:
    return g.strong_components(_calls(spark, d))


def dag_layers(spark: SparkSession, d: str) -> DataFrame:
    return g.layers(_calls(spark, d))


def affinity_batches(spark: SparkSession, d: str) -> DataFrame:
    """Functions of every contract (an audit of its own) in batches by call layer and shared callees."""
    members = kb.functions(spark, d).select(F.col("component").alias("audit"), F.col("topic").alias("member"))
    of = lambda name: members.select(F.col("audit").alias(f"{name}_audit"), F.col("member").alias(name))
    calls = kb.calls(spark, d).select(F.col("fn").alias("caller"), "callee").distinct().join(of("caller"), "caller").join(of("callee"), "callee").filter("caller_audit = callee_audit").withColumnRenamed("caller_audit", "audit")
    return g.call_batches(calls.select("audit", "callee", "caller"), members, by="audit")


def transitive_effects(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), (F.col("src") % 4 == 0).alias("in_try"))
    direct = read(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("fn"), F.when(F.col("p_size") % 2 == 0, "revert").otherwise("write").alias("effect"), F.col("p_size").alias("target"))
    parts = r.call_parts(calls, direct)
    reverts = r.transitive_effects(calls, direct.filter("effect = 'revert'"), keep_try=False, parts=parts)
    return reverts.unionByName(r.transitive_effects(calls, direct.filter("effect = 'write'"), keep_try=True, parts=parts))


def chain_following(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select(F.col("p_partkey").alias("topic"), F.when((F.col("p_partkey") % 8 != 1) & (F.col("p_partkey") > 0), F.col("p_partkey") - 1).alias("next"))
    return g.follow_chain(t)


def top3_contributions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)).alias("c"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("c"), "l_partkey"))
    return li.withColumn("place", place).filter("place <= 3")


def resolve_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous part names inside orders, resolved by the graph around each order and by co-location."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("section"), node("o", "o_orderkey").alias("seed"))
    s = read(spark, d, "supplier")
    li = read(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    refs = li.select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("ref"), node("p", "l_partkey").alias("candidate"), F.col("s_nationkey").alias("scope")).distinct()
    refs = refs.join(o.select("section"), "section", "left_semi")
    seeds = o.select("section", F.col("seed").alias("node"), F.lit(1.0).alias("weight"))
    return resolve.resolve_rounds(graph(spark, d), refs, seeds)


QUERIES = {f.__name__: f for f in (edge_dedup_undirected, edge_counts, out_weight, residual_references, graph_dump, ppr_nation_seed, ppr_multi_seed, ppr_top_edges, reachability, ancestry, scc_components, dag_layers, affinity_batches, transitive_effects, chain_following, top3_contributions, resolve_rounds)}
_PPR_SQL = f"""{GRAPH_SQL},
flow as (select src, dst, sum(w) / (sum(sum(w)) over (partition by src)) as q from graph group by src, dst),
nodes as (select src as node from graph union select dst from graph),
loose as (select node from nodes where node not in (select src from graph)),
rounds as (select node, case when node = 'n3' then 1.0::double else 0.0::double end as rank, 0 as k from nodes
  union all
  select n.node, (0.15 * (n.node = 'n3')::int + 0.85 * (coalesce(m.got, 0.0) + (n.node = 'n3')::int * x.lost))::double, x.k + 1
  from nodes n cross join (select max(k) as k, coalesce(sum(rank) filter (node in (select node from loose)), 0.0) as lost from rounds) x
  left join (select f.dst as node, sum(r.rank * f.q) as got from rounds r join flow f on r.node = f.src group by f.dst) m on n.node = m.node
  where x.k < 30)
"""
SQL = {
    "edge_dedup_undirected": f"with {GRAPH_SQL} select * from graph",
    "edge_counts": f"with {GRAPH_SQL} select kind, count(*) as n, round(sum(w), 6) as total_w from graph group by kind",
    "out_weight": f"with {GRAPH_SQL} select src, round(sum(w), 6) as out_w from graph group by src",
    "residual_references": f"with {GRAPH_SQL}, r as (select 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select dst, src from contains union select 'c' || l_suppkey, 'p' || l_partkey from lineitem) select src, dst from r where not exists (select 1 from graph where graph.src = r.src and graph.dst = r.dst)",
    "graph_dump": f"with {GRAPH_SQL} select src, dst, kind, case kind when 'ContainsMember' then 0 when 'Calls' then 3 when 'References' then 4 else 5 end as ord from graph",
    "ppr_nation_seed": f"with recursive {_PPR_SQL} select node, round(rank, 6) as rank from rounds where k = 30 and (node like 'n%' or node like 'c%' or node like 's%')",
    # mass is kept, so every unit of rank gives 0.15 of itself back to the seed, and all of it at a node without a way out
    "ppr_multi_seed": f"""with recursive {GRAPH_SQL},
flow as (select src, dst, sum(w) / (sum(sum(w)) over (partition by src)) as q from graph group by src, dst),
rounds as (select n_nationkey as s, 'n' || n_nationkey as node, 1.0::double as rank, 0 as k from nation
  union all
  select s, node, v, k + 1 from (select s, node, sum(v)::double as v, k from (
    select r.s, f.dst as node, 0.85 * r.rank * f.q as v, r.k from rounds r join flow f on f.src = r.node
    union all select r.s, 'n' || r.s, r.rank * case when r.node in (select src from flow) then 0.15 else 1.0 end, r.k from rounds r) where k < 30 group by s, node, k))
select s as seed_set, node, round(rank, 6) as rank from rounds where k = 30 and node like 's%'""",
    "ppr_top_edges": f"""with recursive {_PPR_SQL},
parts as (select dst, src, kind, round(rank * w / (select sum(w) from graph o where o.src = graph.src), 9) as c from graph join rounds on node = src and k = 30 where dst in (select 'c' || c_custkey from customer where c_nationkey = 3)),
placed as (select *, (row_number() over (partition by dst order by c desc, src, kind))::int as place from parts)
select dst, src, kind, round(c, 6) as contribution, place from placed where place <= 3 and (c > 0 or place = 1)""",
    "reachability": "select 'r' || n_regionkey as root, kind, count(*) as n from (select n_regionkey, 'r' as kind from (select r_regionkey as n_regionkey from region) union all select n_regionkey, 'n' from nation union all select n_regionkey, 'c' from customer join nation on c_nationkey = n_nationkey union all select n_regionkey, 'o' from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) group by 1, 2",
    "ancestry": "select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 'c' || c_custkey, 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey",
    "scc_components": f"with recursive {_CALLS_SQL}, far as (select src, dst from pc union select far.src, pc.dst from far join pc on far.dst = pc.src) select node, least(node, coalesce((select min(a.dst) from far a where a.src = node and exists (select 1 from far b where b.src = a.dst and b.dst = node)), node)) as component from (select src as node from pc union select dst from pc)",
    "dag_layers": f"with recursive {_CALLS_SQL}, far as (select src, dst from pc union select far.src, pc.dst from far join pc on far.dst = pc.src), comp as (select node, least(node, coalesce((select min(a.dst) from far a where a.src = node and exists (select 1 from far b where b.src = a.dst and b.dst = node)), node)) as c from (select src as node from pc union select dst from pc)), e as (select distinct a.c as a, b.c as b from pc join comp a on pc.src = a.node join comp b on pc.dst = b.node where a.c <> b.c), walk as (select distinct c, 0 as layer from comp union select e.b, walk.layer + 1 from walk join e on walk.c = e.a) select c as component, max(layer)::int as layer from walk group by c",
    "transitive_effects": f"with recursive {_CALLS_SQL}, f as (select p_partkey as fn, case when p_size % 2 = 0 then 'revert' else 'write' end as effect, p_size as target from part where p_partkey % 2 = 0), n as (select src as node from pc union select dst from pc union select fn from f), fw as (select node as fn, node as origin from n union select fw.fn, pc.dst from fw join pc on fw.origin = pc.src), fr as (select node as fn, node as origin from n union select fr.fn, pc.dst from fr join pc on fr.origin = pc.src where pc.src % 4 <> 0) select fw.fn, origin, effect, target from fw join f on origin = f.fn where effect = 'write' union select fr.fn, origin, effect, target from fr join f on origin = f.fn where effect = 'revert'",
    "chain_following": "select p_partkey as topic, greatest(p_partkey - (p_partkey + 7) % 8, 0) as target from part",
    "top3_contributions": "select * from (select *, row_number() over (partition by l_suppkey order by c desc, l_partkey)::int as place from (select l_suppkey, l_partkey, sum(floor(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint as c from lineitem group by 1, 2)) where place <= 3",
}
