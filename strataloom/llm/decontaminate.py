r"""Benchmark decontamination by spaced-seed hashing, with Spark expressions only.

Method. Texts become lower-case runs of letters and digits. Fixed masks of
`SPAN` tokens ignore some positions; at each token the tokens that a mask
selects are hashed, and equal hashes of test items and documents are hits. A
substituted token at an ignored position does not hide a hit. Items of under
`SHORT` tokens have masks of their own length: for k tolerated substitutions
they are cut into k + 2 blocks and each mask selects two of them, so some mask
is free of any k substitutions. Items of 1 to 4 tokens tolerate none and match
as whole runs of tokens.

A hit fixes a diagonal (document position minus item position). On each
diagonal the whole item is laid over the document, a match counts +1 and a
mismatch -`PENALTY`. It counts if at most one token in `TOLERATED` differs, or
if the best stretch reaches `LEAST_SCORE`: twelve tokens in a row, or longer
stretches with some substitutions.

Hits are reduced to distinct (document, item, diagonal) before anything is
joined back, so a passage that very many documents hold costs one small row
for each. Test hashes are broadcast only if their number is within a limit;
beyond it Spark joins by shuffle.

Cases: null or empty texts on either side have no tokens and no hits; very
long texts are one array of 8 bytes a token; repeated rows of a document are
one result row; items repeated under different ids each give a row; documents
without id are told apart by a hash of their text; either table may be empty;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.session import materialize, small_enough

SPAN = 11
#: Selected positions of each mask; the others are ignored.
MASKS = ((0, 1, 3, 4, 5, 6, 8, 9, 10), (0, 1, 2, 4, 5, 6, 7, 9, 10), (0, 2, 3, 4, 6, 7, 8, 10))
#: Items of fewer tokens have masks of their own length; one substitution in so many tokens is tolerated.
SHORT, TOLERATED = 15, 5
LEAST_SCORE = 12
PENALTY = 2
BROADCAST_ROWS = 2_000_000
BROADCAST_DOCS = 1_000_000


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for an item of n tokens, each moved to place 0; one of them avoids any n // TOLERATED places."""
    k = n // TOLERATED
    if not k:
        return [tuple(range(n))]
    cuts = [n * i // (k + 2) for i in range(k + 3)]
    blocks = [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sorted({tuple(x - a[0] for x in a + b) for a, b in combinations(blocks, 2)})


def _seed(tokens: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The hash of a mask's tokens from a position on; the mask's length and places are part of it."""
    return F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get(tokens, at + k) for k in mask])


def _seeds(df: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """df(keep..., tokens) -> (keep..., pos, seed): one row for each token and mask that fits."""
    at = df.select(*keep, "tokens", F.posexplode_outer("tokens").alias("pos", "_token")).filter("pos is not null")
    seeds = [F.when(F.col("pos") + (m[-1] + 1) <= F.size("tokens"), _seed(F.col("tokens"), F.col("pos"), m)) for m in masks]
    return at.select(*keep, "pos", F.stack(F.lit(len(seeds)), *seeds).alias("seed")).filter("seed is not null")


def _best(flags: Column) -> Column:
    """The highest score of a stretch of match flags."""
    zero = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def step(acc: Column, hit: Column) -> Column:
        here = F.greatest(F.lit(0), acc["here"] + F.when(hit, F.lit(1)).otherwise(F.lit(-PENALTY)))
        return F.struct(here.alias("here"), F.greatest(acc["best"], here).alias("best"))

    return F.aggregate(flags, zero, step, lambda acc: acc["best"])


def overlaps(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, item_id, n_item_tokens, n_matched, score) for each document and item that overlap enough."""
    items = materialize(tests.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text_col)).alias("tokens")).filter(F.size("tokens") > 0).dropDuplicates(), "items")
    short = sorted(r.n for r in items.select(F.size("tokens").alias("n")).filter(F.col("n") < SHORT).distinct().collect())  # at most SHORT - 1 lengths
    masks = [*MASKS, *sorted({m for n in short for m in short_masks(n)})]
    tests_at = _seeds(items.filter(F.size("tokens") >= SHORT), list(MASKS), ["item_id"])
    for n in short:
        tests_at = tests_at.unionByName(_seeds(items.filter(F.size("tokens") == n), short_masks(n), ["item_id"]))
    tests_at = materialize(tests_at.select("item_id", F.col("pos").alias("item_pos"), "seed"), "seeds")
    n_seeds = tests_at.count()

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = source.select("id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("tokens"))
    hits = _seeds(tokens, masks, ["id", "text_hash"]).join(small_enough(tests_at, n_seeds, BROADCAST_ROWS), "seed")
    diagonals = materialize(hits.select("id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "diagonals")

    n_hits = diagonals.count()
    found = small_enough(diagonals.select("id", "text_hash").distinct(), n_hits, BROADCAST_DOCS)
    texts = source.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(found, texts["id"].eqNullSafe(found["id"]) & (texts["text_hash"] == found["text_hash"]), "left_semi").dropDuplicates(["id", "text_hash"])
    texts = texts.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), token_hashes(F.col("text")).alias("doc_tokens"))
    laid = texts.join(diagonals, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).join(small_enough(items.withColumnRenamed("item_id", "_item"), n_seeds, BROADCAST_ROWS), F.col("item_id").eqNullSafe(F.col("_item")))
    flags = F.transform("tokens", lambda t, i: F.coalesce(F.when(F.col("diagonal") + i >= 0, F.get(F.col("doc_tokens"), F.col("diagonal") + i)) == t, F.lit(False)))
    scored = laid.select("id", "text_hash", "item_id", F.size("tokens").alias("n_item_tokens"), flags.alias("flags"))
    scored = scored.select("id", "text_hash", "item_id", "n_item_tokens", F.size(F.filter("flags", lambda x: x)).alias("n_matched"), _best(F.col("flags")).alias("score"))
    kept = scored.filter((F.col("score") >= LEAST_SCORE) | (F.col("n_matched") * TOLERATED >= F.col("n_item_tokens") * (TOLERATED - 1)))
    best = F.max_by(F.struct("n_item_tokens", "n_matched", "score"), F.struct("score", "n_matched")).alias("best")
    return kept.groupBy("id", "text_hash", "item_id").agg(best).select(F.col("id").alias(id_col), "text_hash", "item_id", "best.*")


def contaminated(docs: DataFrame, tests: DataFrame, **names) -> DataFrame:
    """(id_col, item_id, n_item_tokens, n_matched, score), without the rows' text hashes."""
    id_col = names.get("id_col", "doc_id")
    found = overlaps(docs, tests, **names)
    best = F.max_by(F.struct("n_item_tokens", "n_matched", "score"), F.struct("score", "n_matched")).alias("best")
    return found.groupBy(id_col, "item_id").agg(best).select(id_col, "item_id", *[F.col(f"best.{x}").cast("long").alias(x) for x in ("n_item_tokens", "n_matched", "score")])


def clean(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs without those that hold a test item; the same columns."""
    found = materialize(overlaps(docs, tests, id_col=id_col, text_col=text_col, **names).select(F.col(id_col).alias("_id"), "text_hash").distinct(), "leaks")
    side = small_enough(found, found.count(), BROADCAST_DOCS)
    return docs.join(side, docs[id_col].eqNullSafe(side["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == side["text_hash"]), "left_anti")


CONTAMINATED_SQL = r"""
with item_tokens as (
  select distinct item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from benchmark
), items as (
  select * from item_tokens where len(t) >= 5
), docs as (
  select distinct doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents
), masks as (
  select * from (values (0, 11, [1,2,4,5,6,7,9,10,11]), (1, 11, [1,2,3,5,6,7,8,10,11]), (2, 11, [1,3,4,5,7,8,9,11])) m(mask, span, places)
  union all select distinct 10 + len(t), len(t), range(1, len(t) + 1) from items where len(t) < 11
), item_seeds as (
  select item_id, p, mask, list_transform(places, lambda k: t[p + k]) as seed
  from (select item_id, t, unnest(range(0, len(t))) as p from items), masks
  where p + span <= len(t) and (mask < 10) = (len(t) >= 11) and (mask < 10 or mask - 10 = len(t))
), doc_seeds as (
  select doc_id, t, p, mask, list_transform(places, lambda k: t[p + k]) as seed
  from (select doc_id, t, unnest(range(0, len(t))) as p from docs), masks
  where p + span <= len(t)
), diagonals as (
  select distinct d.doc_id, d.t as dt, s.item_id, d.p - s.p as diagonal
  from doc_seeds d join item_seeds s on d.mask = s.mask and d.seed = s.seed
), laid as (
  select doc_id, dt, item_id, diagonal, n, q, coalesce(case when diagonal + q >= 0 then dt[diagonal + q + 1] end = it, false) as hit
  from (select g.*, len(i.t) as n, unnest(i.t) as it, unnest(range(0, len(i.t))) as q from diagonals g join items i using (item_id))
), sums as (
  select *, sum(case when hit then 1 else -2 end) over (partition by doc_id, dt, item_id, diagonal order by q) as s from laid
), stretches as (
  select *, s - least(0, coalesce(min(s) over (partition by doc_id, dt, item_id, diagonal order by q rows between unbounded preceding and 1 preceding), 0)) as here from sums
), scored as (
  select doc_id, item_id, n, count(*) filter (hit) as m, greatest(0, max(here)) as best
  from stretches group by doc_id, dt, item_id, diagonal, n
)
select doc_id, item_id, max_by(n, best * 1000000 + m)::bigint as n_item_tokens, max_by(m, best * 1000000 + m)::bigint as n_matched, max(best)::bigint as score
from scored where best >= least(12, n) group by doc_id, item_id
"""
