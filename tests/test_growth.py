"""Forms whose rows, shuffles and memory grow no faster than the input, against plain ones."""

from __future__ import annotations

import random
from collections import defaultdict

from strataloom.operators import contexts, graph, linking, names


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_features_are_counted_as_bits(spark):
    rng = random.Random(1)
    name = lambda k: f"F{k}"
    fr = [(name(rng.randrange(200)), f"R{rng.randrange(30)}") for _ in range(600)] + [(None, "R1"), (None, "R99")]
    fb = [(name(rng.randrange(200)), f"B{rng.randrange(40)}") for _ in range(300)]
    mb = [(f"m{rng.randrange(12)}", f"B{rng.randrange(45)}") for _ in range(90)]
    inside = [(f"l{k}", f"m{k % 15}") for k in range(60)] + [("R3", "m1"), ("l1", "m2")]
    want = defaultdict(set)
    for f, r in fr:
        want[f].add(f)
        want[r].add(f)
    for f, b in fb:
        want[f].add(f)
        want[b].add(f)
    of = defaultdict(set)
    for m, b in mb:
        of[m] |= {f for f, x in fb if x == b}
    for t, fs in [*of.items(), *((t, of[m]) for t, m in inside if m in of)]:
        want[t] |= fs
    tables = [spark.createDataFrame(r, s) for r, s in ((fr, "feature string, requirement string"), (fb, "feature string, behavior string"), (mb, "member string, behavior string"), (inside, "topic string, member string"))]
    got = {r.topic: (r.n_features, r.first_feature) for r in linking.feature_counts(*tables).collect()}
    assert got == {t: (len(fs), min((f for f in fs if f is not None), default=None)) for t, fs in want.items() if fs}


def test_panels_take_contexts_as_lists(spark):
    rng = random.Random(2)
    shown = [(rng.randrange(6), f"t{rng.randrange(12)}") for _ in range(60)]
    above = [(f"t{rng.randrange(12)}", f"t{rng.randrange(12)}") for _ in range(8)]
    told = [(f"t{rng.randrange(14)}", rng.randrange(3), rng.randrange(2), rng.randrange(5), k, rng.choice("AB")) for k in range(80)]
    want = defaultdict(lambda: [10**9, set()])
    for panel, topic in set(shown):
        if not any(t == topic and (panel, a) in shown for t, a in above):
            for t, scope, sub, ref, key, mention in told:
                if t == topic:
                    w = want[panel, scope, sub, ref]
                    w[0] = min(w[0], key)
                    w[1].add(mention)
    df = contexts.doc_panel(spark.createDataFrame(shown, "panel int, topic string"), spark.createDataFrame(above, "topic string, ancestor string"), spark.createDataFrame(told, "topic string, scope int, subscope int, ref int, sort_key int, mention string"))
    assert {(r.panel, r.scope, r.subscope, r.ref): [r.sort_key, set(r.mentions)] for r in df.collect()} == dict(want)
    assert "LeftAnti" not in _plan(df) and "LeftSemi" not in _plan(df)


def test_branches_are_counted_where_they_lie(spark):
    rows = [("f", 1, "If(then)"), ("f", 1, "If(else)"), ("f", 1, "If(then)"), ("f", 2, "If(then)"), ("g", 1, "For"), ("g", 1, "If(else)"), (None, 1, "If(then)")]
    df = contexts.branch_groups(spark.createDataFrame(rows, "owner string, block int, kind string"))
    got = {(r.owner, r.block, r.kind): r.has_sibling for r in df.collect()}
    assert got == {("f", 1, "If(then)"): True, ("f", 1, "If(else)"): True, ("f", 2, "If(then)"): False, ("g", 1, "For"): False, ("g", 1, "If(else)"): True, (None, 1, "If(then)"): False}
    assert "Join" not in _plan(df)


def test_listed_blocks_mark_references_beside_them(spark):
    refs = spark.createDataFrame([("a", "r1", ["x", "y"]), ("a", "r1", ["z"]), ("a", "r2", ["z"]), ("b", "r1", ["x"]), ("a", "r3", []), (None, "r4", ["x"])], "topic string, ref string, ancestors array<string>")
    listed = spark.createDataFrame([("a", "y"), ("a", "y"), (None, "x"), ("c", "q")], "topic string, ref string")
    for parts in (None, 3):
        df = contexts.undominated(refs, listed, parts)
        assert {(r.topic, r.ref) for r in df.collect()} == {("a", "r2"), ("b", "r1"), ("a", "r3"), (None, "r4")}
        assert df.columns == refs.columns
        assert _plan(df).count("Exchange hashpartitioning") <= 1


def test_references_and_typed_pairs_are_grouped_once(spark):
    refs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), (None, "c")], "src string, dst string")
    typed = spark.createDataFrame([("a", "c"), ("a", "c"), ("z", "y"), (None, "c")], "src string, dst string")
    df = graph.residual_references(refs, typed)
    assert sorted(df.collect(), key=str) == sorted([("a", "b"), ("b", "a"), (None, "c")], key=str)
    assert "Join" not in _plan(df)


def test_a_chain_is_resolved_once(spark, monkeypatch):
    monkeypatch.setattr(names, "MEMO", 3)
    known = spark.createDataFrame([("A.f", "1"), ("f", "2"), ("v", "3"), ("v", "4")], "name string, topic string")
    said = spark.createDataFrame([(1, "see A.f.v, f or x.A.f; see A.f.v"), (2, None), (3, ""), (4, "v")], "k int, text string")
    got = [tuple(r) for r in names.scan(said, known, key="k", text="text").orderBy("k", "pos").collect()]
    see, af, v = ("see", "unknown", None, 0), ("A.f", "resolved", "1", 1), ("v", "ambiguous", None, 2)
    want = [(0, see), (4, af), (8, v), (11, ("f", "resolved", "2", 1)), (13, ("or", "unknown", None, 0)), (16, ("x", "unknown", None, 0)), (18, af), (23, see), (27, af), (31, v)]
    assert got == [(1, i, start, *ref) for i, (start, ref) in enumerate(want)] + [(4, 0, 0, *v)]
