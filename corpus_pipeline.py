"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing and token shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
Between the stages run() writes to the shared folder, so a lost executor costs
one stage's tasks at most.

Cases, for every stage: a null text is empty; a null id is a row of its own and
never the one that stays of a group that has ids; repeated rows are rows of
their own, but near-dedup keeps one of those that agree in id and text; ties are
broken by the least id; very long texts are read whole; an empty table gives an
empty table; columns beyond those of documents are kept as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import decontaminate, minhash, mixing, quality_rules, token_store
from strataloom.llm.session import materialize


#: Fewer cached pieces than the operator's default: workers here also carry what earlier stages loaded.
CACHED_PIECES = 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs, shingle=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in compressed shards, read back."""
    import public_tokenizers

    return token_store.tokenize(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2, pieces=CACHED_PIECES)


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("token ids", token_ids),
]

#: Near-dedup and tokenization have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
