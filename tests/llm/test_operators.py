"""Chat formatting, quality rules, network, language profiles, decontamination, mixing, tokens, licenses."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import chat, decontaminate, language_id, license_scan, mixing, quality_net, quality_rules, token_store
from strataloom.llm.license_texts import TEMPLATES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, src, "x", 1) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, kept string, size int")


def _sample(spark, sf):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


EDGES = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t", "en", "a"), (4, "word", None, "b"), (4, "word", None, "b"), (None, "no id here at all", "en", None), (6, "lang " * 30_000, "en", "a"), (7, "Ein Satz\nEin Satz\n", "de", "")]


# --- chat --------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["</turn>", "<turn/>", "<turn ", "\\", "\\l", "\\s", "<", ">", "\n", "turn", "/turn>", "a", "é", "### Assistant:", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a>b\n<turn"]), "".join(rng.choices(parts, k=rng.randrange(12)))) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100, 1, "assistant", None), (100, 1, "assistant", "b"), (100, None, None, "first"), (None, 0, "user", "x"), (101, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    merged = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")).first()
    assert merged.formatted == "<turn user>\na<turn/>b</turn>\n" and merged.loss_spans == []


# --- quality rules -----------------------------------------------------------------------------------


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rules_counts(spark, sf):
    rows = _sample(spark, sf) + EDGES + [(900, "a b\r\na b\r\n\n\n x\nx\n x", "en", "a"), (901, "p q r s t u v w " * 3 + "\n" + "Ω é # $", "en", "a")]
    got = quality_rules.judge(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *_base(t)) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {(r.doc_id, r.text) for r in quality_rules.accepted(_docs(spark, rows)).collect()}
    assert {i for i, _ in kept} == {r.doc_id for r in got if r.kept}


def test_quality_rules_verdicts(spark):
    sf = "/root/testdata/sf0.01"  # references need some text
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    good = [got[i].kept or got[i].base_failed for i, q in labels.items() if q == 1]
    bad = [got[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_js_distance_by_hand():
    p, q = np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
    assert quality_rules.js_distance(p, q)[0] == pytest.approx(1.0)
    assert quality_rules.js_distance(p, p)[0] == 0


def test_quality_rules_empty(spark):
    assert quality_rules.judge(_docs(spark, [])).collect() == []


# --- classifier --------------------------------------------------------------------------------------


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = (np.arange(n) % 250 + 1).astype(np.uint8)
        c = quality_net.chunks(data)
        assert sum(int((row[: quality_net.STEP] != 0).sum()) for row in c[:-1]) + int((c[-1] != 0).sum()) == n


def test_network_learns_and_repeats(spark, sf):
    """Held-out rows only: area under the curve and accuracy."""
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_net.score(docs, quality_net.fit(docs, labels, sample=400)).join(labels, "doc_id").filter("held_out and quality is not null").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert len(good) > 10 and len(bad) > 10
    assert np.mean([(x > y) + (x == y) / 2 for x in good for y in bad]) >= 0.95
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.85
    texts, y = [b"good words here", b"#### junk $$$$", b"other good words", b"%% $$ ##"] * 3, np.array([1, 0, 1, 0] * 3)
    data = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert quality_net.train(texts, y, epochs=3).score(*data).tolist() == quality_net.train(texts, y, epochs=3).score(*data).tolist()


def test_network_against_a_naive_convolution(monkeypatch):
    net = quality_net.Network(3)
    rng = np.random.default_rng(1)
    for n in (0, 5, 512, 513, 3000):
        raw = rng.integers(97, 123, n).astype(np.uint8)
        padded = np.zeros(max(1, -(-(n - 64) // 448)) * 448 + 64, np.uint8)
        padded[:n] = raw
        responses = []
        for a in range(0, len(padded) - 64, 448):
            e = net.p["embed"][padded[a : a + 512]]
            responses.append(np.array([[max(0.0, float((e[k : k + quality_net.WIDTH].ravel() * net.p["filters"][:, j]).sum() + net.p["bias"][j])) for j in range(quality_net.FILTERS)] for k in range(512 - quality_net.WIDTH + 1)]))
        features = np.concatenate([np.max([r.max(axis=0) for r in responses], axis=0), np.mean([r.mean(axis=0) for r in responses], axis=0)])
        want = net.probability(features[None].astype(np.float32))[0]
        assert abs(net.score(raw, np.array([0, n]))[0] - want) < 1e-4


def test_network_gradient(monkeypatch):
    monkeypatch.setattr(quality_net, "BLOCK", 3)  # documents over several blocks
    net = quality_net.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    texts = [quality_net.chunks(rng.integers(97, 110, n).astype(np.uint8)) for n in (40, 900, 2500)]
    y = np.array([1.0, 0.0, 1.0])
    _, g = net.gradient(texts, y)
    for name in ("embed", "filters", "bias", "w1", "b1", "w2", "b2"):
        flat, ids = net.p[name].reshape(-1), rng.integers(0, net.p[name].size, 6)
        if name == "embed":
            ids = 97 * quality_net.EMBED + ids % (13 * quality_net.EMBED)
        for i in ids.tolist():
            old, losses = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = old + step
                losses.append(net.gradient(texts, y)[0])
            flat[i] = old
            numeric = (losses[0] - losses[1]) / 2e-3
            assert abs(numeric - np.asarray(g[name]).reshape(-1)[i]) < 2e-3 + 0.05 * abs(numeric)


def test_network_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_net.score(_docs(spark, EDGES), quality_net.fit(_docs(spark, EDGES), none)).collect()
    assert {r.score for r in rows} == {0.5}


# --- languages ---------------------------------------------------------------------------------------


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    edge = language_id.predict(_docs(spark, [*EDGES, (8, "12 + 3", "en", "a")]), language_id.fit(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in edge if r.doc_id in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und")
    assert all(r.score == 0 for r in edge if r.lang_pred == "und")


def test_bundles_do_not_depend_on_batching(monkeypatch):
    texts = ["Hello there", "", None, "ça et là", "x" * 5000, "ab"]
    whole, _ = language_id.bundle(texts)
    single = np.stack([language_id.bundle([t])[0][0] for t in texts])
    assert np.allclose(whole, single)


# --- decontamination ---------------------------------------------------------------------------------


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    item = [word() for _ in range(40)]
    filler = lambda n: [word() for _ in range(n)]
    swapped = [w if k % 7 else word() for k, w in enumerate(item)]
    docs = [(1, " ".join(filler(30) + item + filler(10)), "en", "a"), (2, " ".join(filler(5) + swapped), "en", "a"), (3, " ".join(filler(200)), "en", "a"), (4, " ".join(filler(9) + item[10:24]).upper(), "en", "a"), (5, " ".join(item[:6] + filler(30)), "en", "a"), (6, "say one two three four five six now", "en", "a"), (7, None, "en", "a"), (None, " ".join(item), "en", "a"), (1, "clean text of the same id", "en", "a")]
    tests = spark.createDataFrame([(10, " ".join(item)), (11, "One two, three four five six"), (12, "a b"), (13, None), (14, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(_docs(spark, docs), tests).collect()}
    assert got == {(d, i) for d in (1, 2, 4, None) for i in (10, 14)} | {(6, 11)}
    left = decontaminate.clean(_docs(spark, docs), tests)
    assert sorted((r.doc_id, r.text[:5] if r.text else None) for r in left.collect() if r.doc_id) == sorted([(3, docs[2][1][:5]), (5, docs[4][1][:5]), (7, None), (1, "clean")], key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(_docs(spark, docs), none).count() == 0
    assert decontaminate.contaminated(_docs(spark, []), tests).count() == 0


# --- mixing ------------------------------------------------------------------------------------------


def _targets(sizes):
    """Rounds of resharing, as the rule is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        rest = left - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        capped |= over


def test_mixing(spark, sf):
    rows = _sample(spark, sf) + EDGES
    got = mixing.sample(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = _targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    key = lambda rs: Counter((r.doc_id, r.size, r.copies) for r in rs)
    assert key(got) == key(mixing.sample(_docs(spark, rows[::-1]).repartition(3)).collect())
    mixed = Counter(r.doc_id for r in mixing.mixed_rows(_docs(spark, rows)).collect())
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert mixed == +copies
    assert mixing.sample(_docs(spark, [])).count() == 0


# --- tokens ------------------------------------------------------------------------------------------


def test_pieces_equal_whole_texts():
    import public_tokenizers

    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'", "1", "<|endoftext|>", "\x1c", "\x85", "。", "Z!", " <|endoftext|> ", "\r\n", "😀", "-", "word.", " don't,", "ab" * 40]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(4000)]
    for k in range(0, len(texts), 400):
        if k == 2000:
            enc.rest(10)
        want = [e.ids for e in enc.tokenizer.encode_batch(texts[k : k + 400], add_special_tokens=False)]
        ids, counts = enc.encode(pa.array([*texts[k : k + 400], None]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [*want, []]


def test_token_store(spark, sf, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = _sample(spark, sf) + EDGES
    token_store.write_store(_docs(spark, rows), f"{tmp_path}/store", tokenizer=path, end_id=2)
    got = token_store.read_store(spark, f"{tmp_path}/store").collect()
    whole = Tokenizer.from_file(path)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, _, _ in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, *_), x in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    shard = spark.read.parquet(f"{tmp_path}/store/shards").first()
    dictionary = bytes(spark.read.parquet(f"{tmp_path}/store/dictionary").first().content)
    assert dictionary and next(token_store.read_shard(shard.content, dictionary, only=3)).tolist() == list(token_store.read_shard(shard.content, dictionary))[3].tolist()
    with pytest.raises(ValueError, match="dictionary"):
        next(token_store.read_shard(shard.content, b"other"))
    empty = token_store.tokenize(_docs(spark, []), tokenizer=path)
    assert empty.collect() == []
    token_store.write_store(_docs(spark, EDGES[:3]), f"{tmp_path}/small", tokenizer=path, end_id=2)
    assert len(spark.read.parquet(f"{tmp_path}/small/dictionary").first().content) >= 8
    assert sorted(r.n_tokens for r in token_store.read_store(spark, f"{tmp_path}/small").collect()) == sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in EDGES[:3])


# --- licenses ----------------------------------------------------------------------------------------


def test_license_scan(spark, sf):
    rows = _sample(spark, sf)
    got = license_scan.scan(_docs(spark, rows + EDGES)).collect()
    for (name, kind), text in TEMPLATES.items():
        if kind == "notice":
            assert {r.doc_id for r in got if (r.license, r.kind) == (name, kind)} >= {i for i, t, _, _ in rows if text in (t or "")}
    assert {r.doc_id for r in got} <= {i for i, t, _, _ in rows if re.search("licen|rights reserved", t or "", re.I)}


def test_license_words_decide(monkeypatch):
    scan = license_scan.Scanner().scan
    names = lambda t: {(n, k) for n, k, *_ in scan(t.encode())}
    assert names("Licensed under CC BY 4.0.") == {("CC-BY-4.0", "short notice")}
    assert names("Licensed under CC BY-SA 4.0.") == {("CC-BY-SA-4.0", "short notice")}
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == {("LGPL-3.0", "notice")}
    assert names("This work is licensed under the GNU General Public License, version 2.") == {("GPL-2.0", "notice")}
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        assert names(f"x y z {TEMPLATES[name, 'header']} more") == {(name, "header")}
    for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"):
        assert names(f"x {TEMPLATES[name, 'text']} y") == {(name, "text")}
    monkeypatch.setattr(license_scan, "WINDOW", 0.2)  # so that the first window holds a part only
    spaced = " ".join(w + " filler" for w in TEMPLATES["MIT", "text"].split())
    assert names(spaced) == {("MIT", "text")}


def test_every_language_is_learned(spark):
    """201 labels, and letters beyond a-z that are told apart."""
    letters = [chr(0x4E00 + 7 * k) + chr(0x4E03 + 7 * k) + chr(0x4E05 + 7 * k) for k in range(201)]
    rows = [(10 * k + j, " ".join([x * 2, x[::-1] * 3, x] * 5), f"l{k:03}") for k, x in enumerate(letters) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.fit(docs)
    assert len(profiles.langs) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5})
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, profiles).collect()}
    assert all(got[i] == lang for i, _, lang in rows if lang in profiles.langs)


def test_license_alignment():
    scan = license_scan.Scanner().scan
    mit = TEMPLATES["MIT", "text"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 9)
    found = {(n, k): (c, occ) for n, k, c, *_, occ in scan(f"before {edited} after {mit}".encode())}
    assert found["MIT", "text"][1] == 2 and found["MIT", "text"][0] == 1.0
    assert scan(b"the license under which released software goes to the mit") == []
    assert scan(b"Released under the MIT License. Released under the MIT License.")[0][-1] == 2
    assert license_scan.patience([b"a", b"x", b"b"], [b"a", b"b"]) == [(0, 0), (2, 1)]
