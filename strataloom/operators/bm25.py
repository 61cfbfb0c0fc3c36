"""BM25 with a length floor, over token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.tables import B, K1, LENGTH_FLOOR, MIN_SCORE, TOP_K
from strataloom.sources.shared import write_out

BROADCAST_TERMS = 1_000_000


def term_counts(tokens: DataFrame, doc: str) -> DataFrame:
    """(doc, token, f, dl): tokens(doc, token) counted, with the document's length."""
    return with_lengths(tokens.groupBy(doc, "token").agg(F.count("*").alias("f")), doc)


def with_lengths(counted: DataFrame, doc: str) -> DataFrame:
    """counted(doc, token, f) with the document's length dl."""
    return counted.withColumn("dl", F.sum("f").over(Window.partitionBy(doc)))


def corpus_stats(counts: DataFrame, doc: str) -> DataFrame:
    """One row (n, avgdl) over documents with a token."""
    return counts.select(doc, "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def scores(queries: DataFrame, counts: DataFrame, *, query: str, doc: str) -> DataFrame:
    """(query, doc, score): sum over query tokens, repeated ones counted each time; zero scores are dropped.

    Only the document terms that some query holds are joined. The terms of the
    queries are broadcast if their number is within a limit. Then a document's
    terms stay in the task that sums its scores, and top_k() ranks there before
    anything moves: what is shuffled does not grow with queries times documents.
    """
    asked = write_out(queries.groupBy(query, "token").agg(F.count("*").alias("times")), "asked")
    counts = write_out(counts, "counts")  # read three times: for the hits, their frequencies and the corpus
    terms = asked.select("token").distinct()
    wanted = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    hits = counts.join(wanted, "token", "left_semi").repartition(doc)
    df = counts.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    stats = corpus_stats(counts, doc)
    weighted = asked.join(df, "token").crossJoin(F.broadcast(stats)).select(query, "token", "times", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    weighted = write_out(weighted, "weighted")
    weighted = F.broadcast(weighted) if weighted.count() <= BROADCAST_TERMS else weighted
    effective = F.greatest(F.col("dl"), F.col("avgdl") * LENGTH_FLOOR)
    part = F.col("times") * F.col("idf") * (F.col("f") * (K1 + 1.0)) / (F.col("f") + K1 * (1.0 - B + B * effective / F.col("avgdl")))
    return hits.join(weighted, "token").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def top_k(scored: DataFrame, *, by: list[str], doc: str, k: int = TOP_K, floor: float = MIN_SCORE) -> DataFrame:
    """The first k above the floor for each group, ties by document."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), doc))
    return scored.filter(F.col("score") >= floor).withColumn("rank", rank).filter(F.col("rank") <= k)


def cutoff(scores_desc: list[float], k: int = TOP_K, floor: float = MIN_SCORE) -> int:
    """How many of a descending list pass."""
    return min(k, sum(s >= floor for s in scores_desc))


def by_contract(members: DataFrame, scored: DataFrame, *, doc: str) -> DataFrame:
    """Members' scores inside each contract: (section, contract, doc, score) for top_k over both keys."""
    return scored.join(members, doc)
