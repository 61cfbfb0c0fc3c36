from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

from strataloom.llm import minhash


def _brute(rows, shingle, num, den):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)} if len(words) >= shingle else ({tuple(words)} if words else set())
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **kw).collect()}


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(300)}" for _ in range(150)]
    for k in range(60):  # near copies that link in chains and stars
        words = list(base)
        for p in rng.choice(150, rng.integers(0, 9), replace=False):
            words[p] = f"x{rng.integers(10**6)}"
        rows.append((100_000 + k, " ".join(words)))
    for shingle, num in ((3, 85), (5, 80)):
        got = _run(spark, rows, shingle=shingle, num=num, den=100)
        want = _brute(rows, shingle, num, 100)
        assert {i: x[:2] for i, x in got.items()} == want
        assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_blocks_agree_with_one_unit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(80):
        words = list(base)
        for p in rng.choice(120, rng.integers(1, 8), replace=False):
            words[p] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(words)))
    whole = _run(spark, rows, shingle=3, num=85)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    assert _run(spark, rows, shingle=3, num=85) == whole
    assert {i: x[:2] for i, x in whole.items()} == _brute(rows, 3, 85, 100)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c"), (8, "A B  C"), (None, "a b c"), (None, "only here now"), (9, "long " * 60_000), (10, "long " * 59_000), (7, "a b c")]
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, digest string, bands binary")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=3, num=85).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (10, 1, 9, False), (None, 1, 7, False), (None, 1, None, True)]
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert _run(spark, []) == {}


def test_bands_follow_the_threshold():
    assert minhash.band_count(0.85) < minhash.band_count(0.8)
    assert (1 - 0.8**6) ** minhash.band_count(0.8) < 1e-8
