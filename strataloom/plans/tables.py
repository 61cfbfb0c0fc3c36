"""The driver's tables and the analogues that stand for the knowledge base's own.

Scope tree: region (container), nation (component), customer (member), order
(block), line item (leaf). Graph: nation and customer contain each other's
members, a customer calls its orders, an order references its parts, suppliers
and parts implement each other. Comments are conversation turns (each replies
to the turn before), votes are purchase and error events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.graph import edges_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a small input has fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def node(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def contains_pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))


def call_pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))


def reference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"))


def supply_pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst"))


def graph(spark: SparkSession, d: str) -> DataFrame:
    return (
        edges_of(contains_pairs(spark, d), "ContainsMember")
        .unionByName(edges_of(call_pairs(spark, d), "Calls"))
        .unionByName(edges_of(reference_pairs(spark, d), "References"))
        .unionByName(edges_of(supply_pairs(spark, d), "Implements"))
    )


def graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst) of graph(), where pairs may repeat."""
    both = contains_pairs(spark, d).unionByName(supply_pairs(spark, d))
    there, back = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("src", "dst"), ("dst", "src")))
    return both.select(F.inline(F.array(there, back))).unionByName(call_pairs(spark, d)).unionByName(reference_pairs(spark, d))


#: Line items of a task, about, where rows are dealt by number.
TASK_LINES = 500_000


def line_parts(spark: SparkSession, d: str) -> int | None:
    """Parts of about TASK_LINES line items (counted in the files' footers); none where the session's own number is enough."""
    n = read(spark, d, "lineitem").count() // TASK_LINES + 1
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


GRAPH_SQL = """
contains as (select distinct 'n' || c_nationkey as src, 'c' || c_custkey as dst from customer),
calls as (select distinct 'c' || o_custkey as src, 'o' || o_orderkey as dst from orders),
refs as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem),
supplies as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem),
graph as (
  select src, dst, 'ContainsMember' as kind, 1.0::double as w from contains union all select dst, src, 'ContainsMember', 1.0 from contains
  union all select src, dst, 'Calls', 0.7 from calls union all select src, dst, 'References', 0.5 from refs
  union all select src, dst, 'Implements', 0.8 from supplies union all select dst, src, 'Implements', 0.8 from supplies)
"""


def comments(spark: SparkSession, d: str) -> DataFrame:
    """(comment_id, parent, audit_id, author, comment_type, status, created_at, content): a turn replies to the one before; every seventh is hidden."""
    t = read(spark, d, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return t.select(
        key.alias("comment_id"),
        F.when(F.col("turn") > 0, key - 1).alias("parent"),
        F.col("conv_id").alias("audit_id"),
        F.col("role").alias("author"),
        F.when(F.col("role") == "system", "info").when(F.col("role") == "user", "question").otherwise("note").alias("comment_type"),
        F.when(key % 7 == 0, "hidden").otherwise("active").alias("status"),
        key.alias("created_at"),
        F.col("text").alias("content"),
    )


COMMENTS_SQL = """
comments as (select conv_id * 1000 + turn as comment_id, case when turn > 0 then conv_id * 1000 + turn - 1 end as parent, conv_id as audit_id, role as author,
  case role when 'system' then 'info' when 'user' then 'question' else 'note' end as comment_type,
  case when (conv_id * 1000 + turn) % 7 = 0 then 'hidden' else 'active' end as status, conv_id * 1000 + turn as created_at, text as content from conversations)
"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(comment_id, user_id, vote, at): purchases vote up and errors down; an event's comment follows from its id."""
    e = read(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    c = read(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("n"))
    return e.crossJoin(F.broadcast(c)).select((F.pmod("event_id", "n") * 1000 + F.pmod("event_id", F.lit(3))).alias("comment_id"), "user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("vote"), F.col("event_id").alias("at"))


VOTES_SQL = """
votes as (select event_id % (select count(distinct conv_id) from conversations) * 1000 + event_id % 3 as comment_id, user_id,
  case event_type when 'purchase' then 1 else -1 end as vote, event_id as "at" from events where event_type in ('purchase', 'error'))
"""
