r"""Mixing sources to target weights by systematic sampling.

Method. Sources in code point order (null last) take the weights in turn and
share `share` times all words; a source's target stops at `most` times its own
words and the excess goes to the others by weight, until none is above. Each
document of a source then expects target / source words copies. Within a
source the documents are laid out by size, the expected copies are prefix
summed, one random offset of the source is added, and a document is taken once
for every integer boundary that its stretch crosses. Since the order is by
size, the words taken differ from the target by at most about the size of the
largest document.

All documents of a source expect the same number of copies, so the prefix sum
at a document is that number times its rank. Ranks are found from counts by
(source, size, bucket of the id), so a source that holds most rows, or one
size that does, is never sorted in one task.

Cases: a null text has size 0; sources of size 0 have target 0 and nothing is
taken; repeated rows are documents of their own; null ids take part; an empty
table gives an empty result; other columns are ignored. The offset depends on
the seed and the source only: reruns agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20240601
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds weight, target and expected to by_source(source, source_size); one row for each source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    out = by_source.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", level).withColumn("k", F.row_number().over(ratio))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    out = out.withColumn("first_free", F.min(F.when(free, F.col("k"))).over(everything))
    out = out.withColumn("final", F.max(F.when(F.col("k") == F.col("first_free"), F.col("level"))).over(everything))
    target = F.when(F.col("k") < F.col("first_free"), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("final"), F.col("cap")))
    out = out.withColumn("target", F.coalesce(target, F.lit(0.0)))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", expected.alias("expected"))


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def sample(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id_col, source, size, source_size, target, copies) for each row."""
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    bucket = F.pmod(F.col("id") if whole else F.xxhash64("id"), F.lit(BUCKETS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("bucket", F.coalesce(bucket, F.lit(-1).cast("long")).cast("int")).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    rows = materialize(rows, "sizes")
    counts = materialize(rows.groupBy("key", "source", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    by_source = materialize(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "targets")
    # rank of the first document of a (source, size), and of a bucket inside it
    sizes = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "size", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.select("key", "source", "size", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("skip"))
    first = buckets.join(sizes, ["key", "size"]).select("key", "size", "bucket", (F.col("base") + F.col("skip")).alias("first"))
    own = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy(F.col("id").asc_nulls_first())) - 1
    ranked = rows.withColumn("own", own).join(first, ["key", "size", "bucket"]).withColumn("rank", (F.col("first") + F.col("own")).cast("double"))
    out = ranked.join(by_source.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source"), "key")
    u = _offset(F.col("source"), seed)
    copies = F.floor((F.col("rank") + 1.0) * F.col("expected") + u) - F.floor(F.col("rank") * F.col("expected") + u)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def taken(docs: DataFrame, **names) -> DataFrame:
    """The report of a mix: words taken of each document, repeats counted."""
    drawn = sample(docs, **names)
    return drawn.select(names.get("id_col", "doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", limit: int = 1_000_000, **names) -> DataFrame:
    """docs with each row as often as the mix takes it; the same columns."""
    drawn = materialize(sample(docs, id_col=id_col, **names).select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("copies").alias("_copies")), "drawn")
    total, ids = drawn.agg(F.count("*"), F.count_distinct("_id")).first()
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    if total == ids:
        side = drawn.filter("_copies > 0")
        out = docs.join(F.broadcast(side) if total <= limit else side, docs[id_col] == side["_id"])
    else:  # repeated or missing ids: of the rows with one id and size the k-th takes the k-th count
        size, place = (f"_mix_{x}_{uuid.uuid4().hex}" for x in ("size", "place"))
        side = drawn.withColumn(place, F.row_number().over(Window.partitionBy("_id", "_size").orderBy("_copies"))).filter("_copies > 0")
        sized = docs.withColumn(size, word_count(F.col(names.get("text_col", "text"))))
        numbered = sized.withColumn(place, F.row_number().over(Window.partitionBy(id_col, size).orderBy(F.xxhash64(*docs.columns))))
        out = numbered.join(side, numbered[id_col].eqNullSafe(side["_id"]) & (numbered[size] == side["_size"]) & (numbered[place] == side[place]))
    kept = [(docs if total == ids else numbered)[c] for c in docs.columns]
    extra = f"_mix_{uuid.uuid4().hex}"
    return out.select(*kept, again.alias(extra)).drop(extra)


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), by_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    2.0::double * source_size as cap
  from by_source
), levels as (
  select *, row_number() over (order by cap / weight, source nulls last) as k,
    (1.5::double * (sum(source_size) over ())::double
      - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0)) as level
  from weighted
), freed as (
  select *, min(case when level * weight <= cap then k end) over () as first_free from levels
), final as (
  select *, max(case when k = first_free then level end) over () as final_level from freed
), targets as (
  select source, source_size,
    coalesce(case when k < first_free then cap else least(weight * final_level, cap) end, 0.0)::double as target
  from final
), ranked as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0 end as expected,
    ('0x' || substr(md5('20240601:' || coalesce('=' || s.source, 'null')), 1, 8))::bigint::double / 4294967296.0::double as u,
    (row_number() over (partition by s.source order by s.size, coalesce(((s.doc_id % 1024) + 1024) % 1024, -1), s.doc_id nulls first) - 1)::double as r
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (floor((r + 1.0::double) * expected + u) - floor(r * expected + u)))::bigint as taken
from ranked
"""
