"""Sources, validators and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import validators as v
from strataloom.plans.tables import comments, read, spread
from strataloom.sources import syntax
from strataloom.sources.shared import shared_folder
from strataloom.streaming import events as st
from strataloom.streaming import state


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.concat(F.lit("# Title\n- item\n> said\n```\n---\n\n## Sub\n"), F.col("text")).alias("text"))
    return syntax.markdown_blocks(c, key="k", text="text").groupBy("kind", "level").agg(F.count("*").alias("n"))


def doc_comments(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", F.concat(F.lit(" * "), F.col("p_name"), F.lit("\n * @notice about "), F.col("p_brand"), F.lit("\n *   more\n * @custom x\n * y\n * @param a "), F.col("p_type")).alias("c"))
    return t.select("p_partkey", F.explode(syntax.doc_comment(F.col("c"))).alias("s")).select("p_partkey", "s.tag", "s.text")


def syntax_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each order: a unit with one call for each line item."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    li = li.repartition(max(spark.sparkContext.defaultParallelism, li.count() // 100_000 + 1), "l_orderkey")
    item = F.struct((F.col("l_orderkey") * 100 + F.col("l_partkey") + 1000000).alias("id"), F.lit("FunctionCall").alias("nodeType"), F.struct(F.lit("Identifier").alias("nodeType"), F.col("l_partkey").alias("referencedDeclaration")).alias("expression"))
    tree = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("nodes")).select(F.col("l_orderkey").cast("string").alias("file"), F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.lit("SourceUnit").alias("nodeType"), "nodes")).alias("json"))
    return syntax.flatten(tree, ("file", "kind", "depth", "refers_to")).groupBy("file", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("refers_to").alias("refs"))


def verdict_validator(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts answered in JSON for the invariants of a batch (an order's lines); states of kept and rejected answers."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.concat(F.lit("Y"), F.col("l_linenumber").cast("string")).alias("invariant"), "l_returnflag", "l_partkey")
    answer = F.struct(F.col("invariant").alias("invariant_topic"), F.when(F.col("l_returnflag") == "R", "absent").when(F.col("l_returnflag") == "A", "partial").otherwise("odd").alias("verdict"), F.when(F.col("l_partkey") % 5 != 0, "because").otherwise(" ").alias("rationale"))
    answers = li.groupBy("batch").agg(F.to_json(F.collect_list(answer)).alias("body"))
    expected = li.filter("invariant != 'Y7'").select("batch", "invariant").distinct()
    good, lost = v.verdicts(answers, expected)
    return good.groupBy(F.lit("kept").alias("state")).agg(F.count_distinct("batch").alias("n_batches")).unionByName(lost.filter("reject = 'unexpected'").groupBy(F.col("reject").alias("state")).agg(F.count_distinct("batch").alias("n_batches")))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    out = st.drain_updates(st.windowed_counts(st.open_stream(spark, d, "events.parquet", schema), late="60 days"), "windows", ["window", "event_type"])
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    out = st.drain(st.session_counts(st.open_stream(spark, d, "events.parquet", schema), late="60 days"), "sessions")
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def status_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Comment statuses after a batch of changes, applied twice."""
    stored = comments(spark, d).select("comment_id", "status", F.lit(0).cast("long").alias("at"))
    batch = read(spark, d, "events").filter("event_type = 'view'").select((F.col("event_id") % 100 * 1000).alias("comment_id"), F.when(F.col("event_id") % 2 == 0, "hidden").otherwise("resolved").alias("status"), (F.col("event_id") + 1).alias("at"))
    once = st.upsert_latest(stored, batch, ["comment_id"], "at")
    return st.upsert_latest(once, batch, ["comment_id"], "at").select("comment_id", "status")


def comment_stream(spark: SparkSession, d: str) -> DataFrame:
    """Comments, statuses and votes made of all events, run as a stream with state: what is shown after the last batch."""
    e = st.open_stream(spark, d, "events.parquet", read(spark, d, "events").schema)
    kind = F.when(F.col("event_type") == "purchase", "vote").when(F.col("event_type") == "error", "vote").when(F.col("event_type") == "view", "status").when(F.col("event_id") % 3 == 0, "unvote").otherwise("comment")
    comment, none = F.col("event_id") % 300, F.lit(None)
    said = kind == "comment"
    rows = e.select(
        (comment % 7).cast("long").alias("audit_id"), comment.cast("long").alias("comment_id"), kind.alias("kind"), F.col("event_id").cast("long").alias("seq"),
        F.when(said, F.concat(F.lit("N"), (F.col("event_id") % 50).cast("string"))).alias("target"), F.when(said, F.array(F.concat(F.lit("M"), (F.col("event_id") % 11).cast("string")), F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string")))).alias("mentions"),
        F.when(kind == "status", F.when(F.col("event_id") % 4 == 0, "hidden").otherwise("active")).alias("status"), F.when(kind.isin("vote", "unvote"), F.col("user_id")).cast("long").alias("user_id"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(none).cast("int").alias("vote"),
    )
    before = spark.conf.get(state.STORE, None)
    state.use_rocksdb(spark)
    try:
        base = f"{shared_folder(spark)}/strataloom-comments-{uuid.uuid4().hex}"
        state.write_by_audit(state.comment_updates(rows), base)
    finally:
        spark.conf.unset(state.STORE) if before is None else spark.conf.set(state.STORE, before)
    return state.latest(spark, base).withColumn("mentions", F.array_join("mentions", ","))


QUERIES = {f.__name__: f for f in (markdown_blocks, doc_comments, syntax_nodes, verdict_validator, stream_windows, stream_sessions, status_upsert, comment_stream)}
SQL = {
    "comment_stream": """with e as (select event_id % 300 as comment_id, event_id as seq, user_id, case when event_type in ('purchase', 'error') then 'vote' when event_type = 'view' then 'status' when event_id % 3 = 0 then 'unvote' else 'comment' end as kind, case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as vote from events),
      v as (select comment_id, user_id, arg_max(vote, seq) as vote from e where kind in ('vote', 'unvote') group by 1, 2), t as (select comment_id, count(*) filter (vote > 0) as up, count(*) filter (vote < 0) as down from v group by 1),
      m as (select comment_id, string_agg(distinct x, ',' order by x) as mentions from (select comment_id, unnest(['M' || (seq % 11), 'M' || (user_id % 5)]) as x from e where kind = 'comment') group by 1),
      c as (select comment_id, 'N' || (arg_max(seq, seq) filter (kind = 'comment') % 50) as target, coalesce(case when (max(seq) filter (kind = 'status')) % 4 = 0 then 'hidden' when max(seq) filter (kind = 'status') is not null then 'active' end, 'active') as status, max(seq) as seq from e group by 1)
      select comment_id % 7 as audit_id, comment_id, target, status, target is not null and status <> 'hidden' as visible, coalesce(mentions, '') as mentions, coalesce(up, 0) - coalesce(down, 0) as score, coalesce(up, 0) as up, coalesce(down, 0) as down, seq from c left join t using (comment_id) left join m using (comment_id)""",
    "markdown_blocks": r"""with l as (select unnest(string_split('# Title' || chr(10) || '- item' || chr(10) || '> said' || chr(10) || '```' || chr(10) || '---' || chr(10) || chr(10) || '## Sub' || chr(10) || text, chr(10))) as line from conversations), k as (select line, length(regexp_extract(line, '^(#{1,6})\s', 1)) as level from l)
      select case when regexp_matches(line, '^\s*```') then 'fence' when level > 0 then 'heading' when regexp_matches(line, '^\s*([-*+]|\d+\.)\s') then 'item' when regexp_matches(line, '^\s*>') then 'quote' when regexp_matches(line, '^\s*(-{3,}|\*{3,}|_{3,})\s*$') then 'rule' when trim(line) = '' then 'blank' else 'paragraph' end as kind, case when level > 0 then level::int end as level, count(*) as n from k group by 1, 2""",
    "doc_comments": "select p_partkey, unnest(['untagged', 'notice', 'param']) as tag, unnest([p_name, 'about ' || p_brand || ' more', 'a ' || p_type]) as text from part",
    "syntax_nodes": "with li as (select * from lineitem), n as (select l_orderkey, count(*) as n, sum(l_partkey)::bigint as refs from li group by 1) select l_orderkey::varchar as file, 'SourceUnit' as kind, 1::bigint as n, 0 as depth, null::bigint as refs from n union all select l_orderkey::varchar, 'FunctionCall', n, 1, null from n union all select l_orderkey::varchar, 'Identifier', n, 2, refs from n",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_sessions": "with g as (select *, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) >= 21600 then 1 else 0 end as new from events), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g), c as (select user_id, s, count(*) as n from s group by 1, 2) select user_id, count(*) as n_sessions, max(n) as longest from c group by 1",
    "status_upsert": "with c as (select conv_id * 1000 + turn as comment_id, case when (conv_id * 1000 + turn) % 7 = 0 then 'hidden' else 'active' end as status, 0::bigint as a from conversations union all select event_id % 100 * 1000, case when event_id % 2 = 0 then 'hidden' else 'resolved' end, event_id + 1 from events where event_type = 'view') select comment_id, arg_max(status, a) as status from c group by comment_id",
}
