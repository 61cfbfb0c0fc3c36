from __future__ import annotations

import numpy as np
import pytest

from strataloom.llm import external_sort as es
from strataloom.llm import suffix_dedup as sd


def _order(text: bytes, depth: int, items: int | None = None):
    symbols = es.Symbols(names=False)
    symbols.append(np.frombuffer(text, np.uint8) + np.uint8(1))
    places, prefixes = [], []
    for rows, prefix in es.descending(symbols.finish(), depth, items=items):
        places += rows[:, 1].astype(int).tolist()
        prefixes += prefix.tolist()
    return places, prefixes


def _check(text: bytes, depth: int, items: int | None = None):
    places, prefixes = _order(text, depth, items)
    assert sorted(places) == list(range(len(text)))
    assert [text[i : i + depth] for i in places] == sorted((text[i : i + depth] for i in range(len(text))), reverse=True)
    for a, b, n in zip(places, places[1:], prefixes[1:], strict=False):
        x, y = text[a : a + depth], text[b : b + depth]
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_order_and_common_prefixes(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        _check(rng.integers(97, 97 + letters, rng.integers(1, 200)).astype(np.uint8).tobytes(), int(rng.choice([1, 3, 7, 50, 120])))


def test_recursion_and_spilling(monkeypatch):
    monkeypatch.setattr(es, "CHUNK", 64)
    rng = np.random.default_rng(0)
    for _ in range(10):
        words = [rng.integers(97, 100, rng.integers(1, 9)).astype(np.uint8).tobytes() for _ in range(30)]
        _check(b"".join(words[i] for i in rng.integers(0, 30, 300)), 50, items=100)


def test_shard_larger_than_its_queues(monkeypatch):
    """The queues of a shard of 6 MB spill at their default limit, and memory stays far below its 50 bytes of tuples for each byte."""
    import tracemalloc

    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    pieces = letters[: len(letters) // 60 * 60].reshape(-1, 60)
    pieces = np.concatenate([pieces, pieces[::2] ^ (np.arange(60) == 57)])  # every other one again, with another last letters
    spilled = []
    push = es.TupleQueue.push

    def counted(self, rows):
        push(self, rows)
        spilled.append(self.spilled)

    shard = sd.Shard()
    for k in range(0, len(pieces), 5000):
        part = pieces[k : k + 5000]
        n = len(part)
        shard.add(k, sd._pack([np.full(n, 60, "<u1"), sd._steps(np.arange(n)), sd._steps(np.arange(n) * 60), sd._steps(np.arange(n)), (k + np.arange(n)).astype("<i8"), part.astype(np.uint8).ravel()]))
    monkeypatch.setattr(es, "RESIDENT", 8 << 20)  # as if the shard were that much larger
    tracemalloc.start()
    es.TupleQueue.push = counted
    try:
        found = {}
        for block, payload in shard.removals():
            start, size = sd._unpack(payload, ("<u4", "<u4"))
            found |= {block + int(s) // 60: int(n) for s, n in zip(sd._whole(start), size, strict=True)}
    finally:
        es.TupleQueue.push = push
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    first = len(letters) // 60
    assert found == dict.fromkeys(range(first, len(pieces)), 57)
    assert max(spilled) > 0
    assert peak < 250 << 20


def _compare(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, mark int")
    got = sorted((tuple(r) for r in sd.digest(df).collect()), key=str)
    assert got == sorted(sd.brute_force(rows), key=str)


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    passage = "a passage of well over fifty bytes that several documents share, wörtlich. "
    for k in range(40):
        rows.append((1000 + k, f"start {k} {k * 7919} " + passage[k % 9 :] + passage * (k % 3) + f"end {k}"))
    _compare(spark, rows)


def test_edges(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "x" * 400), (7, long), (8, long[100:300] + "é" + long[:60]), (9, long[:49] + "!" + long[50:99]), (None, long[10:80]), (None, "only here " * 9), (10, "é" * 40), (11, "aé" + "é" * 30), (6, "x" * 90), (12, long), (12, long)]
    _compare(spark, rows)


def test_empty(spark):
    assert sd.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_do_not_follow_the_input():
    from strataloom.llm.suffix_dedup import layout

    assert layout(10**6) == (24, 1 << 20)
    assert all(layout(g * 10**9)[1] <= 8 << 20 for g in (1, 6, 30, 1000))
    assert layout(6 * 10**9)[0] == 1600
