"""Runs, byte-pair encoding and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import bpe, runs, trie
from strataloom.llm import queries as q

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- op12


def plain_runs(s: list, least: int, power: int) -> list[tuple[int, int, int]]:
    out, n = [], len(s)
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, power * p) and not any(all(s[i + k] == s[i + k + d] for k in range(size - d)) for d in range(1, p)):
                out.append((i, size, p))
            i = max(i + 1, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_text(text: str | None, least: int = 6, power: int = 4):
    words = WORD.findall((text or "").encode())
    found, gone = plain_runs(words, least, power), set()
    for a, size, p in found:
        gone |= set(range(a + p, a + size))
    return found, b" ".join(w for k, w in enumerate(words) if k not in gone)


def plain_repeats(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    words = WORD.findall((text or "").encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode()


@pytest.mark.parametrize("least, power", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_small_alphabets(least, power):
    rng = random.Random(power)
    for _ in range(3000):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
        if s and rng.random() < 0.5:
            a, p = rng.randrange(len(s)), rng.randint(1, 7)
            s = [s[i] if i < a else s[a + (i - a) % p] if a + (i - a) % p < len(s) else 0 for i in range(len(s))]
        want = plain_runs(s, least, power)
        assert runs.runs_of(s, least, power) == want
        parts = [(a + x, n, p) for a, b in runs._stretches(np.array(s, np.int64), np.array([0, len(s)]), least, power) for x, n, p in runs.runs_of(s[a:b], least, power)]
        assert parts == want


def test_long_periodic_texts_stay_linear():
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    nested = [1]
    for k in range(2, 9):
        nested = nested * 4 + [k]
    for s, n in (([7] * 100_000, 1), ([1, 2, 3] * 40_000, 1), (fib[-1], 0), (nested, 1365)):
        assert len(runs.runs_of(s)) == n


def test_find_runs_odd_rows(spark):
    long = "x y " * 30_000 + "z"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b a b a b a b a"), (4, "a b a b a b a b a"), (None, "q " * 7), (5, long), (6, "é é é é é é é"), (7, "a a a a a")]
    got = {}
    for r in runs.find_runs(spark.createDataFrame([(*r, "runs") for r in rows], "doc_id long, text string, collapsed string")).collect():
        got.setdefault((r.doc_id, r.n_words), []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert got[4, 9] == [([(0, 9, 2)], "a b")] * 2
    assert got[None, 7] == [([(0, 7, 1)], "q")] and got[6, 7] == [([(0, 7, 1)], "é")]
    assert got[5, 60_001] == [([(0, 60_000, 2)], "x y z")]
    assert got[1, 0] == got[2, 0] == got[3, 0] == [([], "")] and got[7, 5] == [([], "a a a a a")]
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op12_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in q.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    changed = 0
    for doc_id, text in docs:
        text = plain_repeats(doc_id, text)
        words = WORD.findall((text or "").encode())
        if len(words) > 1500:  # the plain form is quadratic
            found = [tuple(x) for x in runs.runs_of(np.unique(words, return_inverse=True)[1].tolist())]
            gone = {k for a, n, p in found for k in range(a + p, a + n)}
            kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        else:
            found, kept = plain_text(text)
        r = got[doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(found) and r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest()
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        changed += bool(found)
    assert changed > 3


# --- op13


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_of_the_library(vocabulary):
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(vocabulary), bpe.RankEncoder(vocabulary)
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "a", "the", "ing", " th", "'s", "'t", "1", "23", "é", "中", "...", ",", "<|endoftext|>", "<|endof", "😀", "́", "a" * 90, "ab" * 60, "The Theory"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    texts += [None, "", "x" * 70_000, "lorem " * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    flat, counts = ours.encode(pa.array(texts, pa.string()))
    decoded = ours.vocabulary.decode(flat, counts)
    ends = np.cumsum(counts)
    for text, end, n, back in zip(texts, ends, counts, decoded, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert flat[end - n : end].tolist() == want
        assert back.decode() == library.decode(want, skip_special_tokens=False)


def test_long_and_short_words_agree(vocabulary):
    voc = bpe.Vocabulary(vocabulary)
    rng = random.Random(6)
    for _ in range(400):
        symbols = voc.symbol[[ord(rng.choice("abethino")) for _ in range(rng.randint(1, 60))]]
        flat, counts = voc._merge_rows(symbols, np.array([0]), np.array([len(symbols)]))
        assert flat.tolist() == voc._merge_long(symbols).tolist() and counts.tolist() == [len(flat)]


def test_bpe_odd_rows(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "tie tie"), (3, "tie tie"), (4, "word " * 50_000)]
    out = bpe.encode_decode(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids long"), tokenizer=vocabulary)
    got = sorted(((r.doc_id or 0, r.decoded, len(r.ids)) for r in out.collect()), key=str)
    assert got == sorted(((i or 0, t or "", 4 * len(library.encode(t or "").ids)) for i, t in rows), key=str)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), tokenizer=vocabulary).count() == 0
    ids = spark.createDataFrame([(1, bytearray(np.array([50256, 60_000, 0], "<u4").tobytes())), (2, None)], "k long, ids binary")
    assert {r.k: r.decoded for r in bpe.decode(ids, tokenizer=vocabulary).collect()} == {1: "<|endoftext|>!", 2: ""}


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def test_op13_equals_the_library(spark, sf, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    got = {r.doc_id: tuple(r)[1:] for r in q.op13_bpe(spark, sf).collect()}
    want = {}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert got == want


# --- op11


def plain_trie(sequences: dict) -> set:
    members, children, below = defaultdict(list), defaultdict(list), {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        below[key] = (sum(below[k][0] for k in children[key]) or 1, own + sum(below[k][1] for k in children[key]))
    ends = lambda key, m: ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(key))))
    return {(min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children[key]), *below[key], hashlib.sha256(ends(key, m).encode()).hexdigest()) for key, m in members.items()}


def ordered(rows) -> dict:
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in by.items()}


@pytest.mark.parametrize("case", ["mixed", "one", "copies", "deep"])
def test_trie_against_plain_form(spark, case):
    rng = random.Random(case)
    rows = {
        "mixed": [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None, "é"])) for c in range(60) for t in range(rng.randint(1, 5))],
        "one": [(7, t, "u", "hello") for t in (None, 1, 2)],
        "copies": [(c, t, "u", f"turn {t}") for c in range(9000) for t in range(2)] + [(9001, 0, "u", "turn 0"), (9002, 0, "u", "else")],
        "deep": [(c, t, "u", "same" if t < 12 else f"{c} {t}") for c in range(3) for t in range(14)],
    }[case]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = [tuple(r) for r in trie.prefix_trie(turns).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(ordered(rows))


def test_trie_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (None, 0, "u", "a"), (2, None, None, None), (2, 1, "u", "long " * 50_000)]
    ids = spark.createDataFrame([(3,), (1,), (None,)], "conv_id long")
    got = {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, schema), ids=ids.union(spark.createDataFrame([(2,)], "conv_id long"))).collect()}
    assert got == plain_trie({1: (("u", "a"), ("u", "a")), 2: (("", ""), ("u", "long " * 50_000)), 3: ()})


def test_op11_equals_plain_form(spark, sf):
    own = ordered(tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    rebuilt = {c: own.get(c - c % 100, ())[: heads[c]] + v[heads[c] :] for c, v in own.items()}
    assert {tuple(r) for r in q.op11_prefix_trie(spark, sf).collect()} == plain_trie(rebuilt)
