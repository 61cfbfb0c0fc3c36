"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from strataloom.llm import mixing, quality_rules
from tests.llm.test_minhash import _brute


def test_stages(spark, sf, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(steps[0]) == Counter(r.doc_id for r in quality_rules.judge(start).filter("kept").collect())
    rows = [(r.doc_id, r.text) for r in steps[0].select("doc_id", "text").collect()]
    assert set(ids(steps[1])) == {i for i, (_, root) in _brute(rows, 5, 80, 100).items() if i == root}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    leaks = {r.doc_id for r in steps[1].collect() if any(tuple(w[k : k + 12]) in grams for w in [words(r.text)] for k in range(len(w) - 11))}
    assert set(ids(steps[1])) - set(ids(steps[2])) >= leaks
    want = Counter()
    for r in mixing.sample(steps[2]).collect():
        want[r.doc_id] += r.copies
    assert ids(steps[3]) == +want
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in steps[4].collect())
    assert got == Counter((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r in steps[3].collect() for x in [np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4")])


CASES = "doc_id long, text string, lang string, source string, n_chars long, _k int, _id string, spans string"


def test_stages_on_odd_rows(spark, sf):
    """Null ids and texts, empty and long texts, repeated rows, ties, and columns that clash with names inside the stages."""
    sentence = "the river town keeps its old stone bridge and the market opens early on most days of the year while boats pass below"
    words = sentence.split()
    text = lambda k: " ".join(random.Random(k).choices(words, k=60))
    rows = [(k, text(k), "en", "a", 5, 1, "x", "y") for k in range(12)]
    rows += [(None, text(40), "en", "a", None, None, None, None), (None, text(41), "en", None, 1, 1, "x", "y"), (None, None, None, None, None, None, None, None), (20, "", "en", "b", 0, 0, "", ""), (21, None, "en", "b", 0, 0, "", ""), (3, text(3), "en", "a", 5, 1, "x", "y"), (3, text(50), "en", "b", 5, 1, "x", "y"), (30, " ".join(text(k) for k in range(200, 900)), "en", "b", 9, 9, "z", "z")]
    docs = spark.createDataFrame(rows, CASES)
    key = lambda r: (r.doc_id, r.text)
    everything = Counter(map(key, docs.collect()))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).collect()
        if k == 4:
            assert Counter(r.doc_id for r in out) == Counter(i for i, _ in everything.elements())
            continue
        assert tuple(out[0].asDict()) == tuple(docs.columns)
        got = Counter(map(key, out))
        assert set(got) <= set(everything)
        if k == 0:
            assert (20, "") not in got and (21, None) not in got and got[3, text(3)] == 2 and got[None, text(40)] == 1
        if k == 1:
            assert got == Counter(set(everything))  # nothing alike but the repeated row
        if k == 2:
            assert got == everything
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []
