"""Thin queries over the driver's tables: each applies one operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, chat, decontaminate, language_id, license_scan, minhash, mixing, quality_net, quality_rules, runs, suffix_dedup, token_store, trie


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL_CASE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every formatted conversation, and of conversation -7, whose texts hold control strings."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(case)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a network learned from labels.quality of the rows that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    return quality_net.score(docs, quality_net.fit(docs, _read(spark, sf_dir, "labels")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles learned from the rows that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the overlap; clean documents have no row."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of each document."""
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes or more of a document with a smaller id."""
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to compressed shards and read back."""
    import public_tokenizers

    return token_store.tokenize(_read(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in all documents; documents without any have no row."""
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each behind the first turns of its hundred's first conversation."""
    return trie.trie_of(trie.shared_heads(trie.sequences(_read(spark, sf_dir, "conversations"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, a tenth of which repeat a stretch of their own words, and the texts with runs collapsed."""
    return runs.digest(runs.find_runs(runs.with_repeats(_read(spark, sf_dir, "documents"))))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents by ranks of adjacent parts, and the texts that they decode to."""
    import public_tokenizers

    return bpe.digest(bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_classifier, op3_minhash, op4_language_id, op5_decontamination, op6_mixing, op7_suffix_dedup, op8_token_ids, op9_quality_rules, op10_license_scan, op11_prefix_trie, op12_periodic_runs, op13_bpe)}
SQL: dict[str, str] = {"op1_chat_format": chat.DIGEST_SQL, "op5_decontamination": decontaminate.CONTAMINATED_SQL, "op6_mixing": mixing.MIX_SQL, "op11_prefix_trie": trie.TRIE_SQL}
