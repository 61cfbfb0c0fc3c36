"""Sparse ranks, components and folds against plain forms."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph, resolve


def _random_edges(seed: int, n: int, m: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), "Calls", rng.choice([0.5, 0.7, 1.0])) for _ in range(m)]


def _reached(pairs, nodes) -> dict:
    succ = defaultdict(set)
    for a, b in pairs:
        succ[a].add(b)
    out = {}
    for start in nodes:
        seen, work = {start}, [start]
        while work:
            for u in succ[work.pop()] - seen:
                seen.add(u)
                work.append(u)
        out[start] = seen
    return out


@pytest.fixture(params=["tasks", "rounds"])
def way(request, monkeypatch):
    """Both ways: whole parts in tasks, and rounds of joins for all that is larger."""
    if request.param == "rounds":
        monkeypatch.setattr(graph, "PART_EDGES", 0)
    return request.param


def test_ranks_of_targets_equal_full_ranks(spark):
    rows = _random_edges(2, 40, 90)
    edges = spark.createDataFrame(rows, "src long, dst long, kind string, w double")
    rng = random.Random(3)
    sets = {k: {rng.randrange(45): rng.choice([0.25, 1.0, 2.0]) for _ in range(rng.randint(1, 4))} for k in range(6)} | {6: {3: 0.0}}
    seeds = spark.createDataFrame([(k, n, w) for k, s in sets.items() for n, w in s.items()], "section long, node long, weight double")
    wanted = spark.createDataFrame([(k, n) for k in sets for n in range(0, 45, 2)], "section long, node long")
    pairs = seeds.select("section", F.col("node").alias("seed")).join(wanted.withColumnRenamed("node", "target"), "section").select("seed", "target").distinct()
    got = {(r.section, r.node): r["rank"] for r in graph.set_ranks(graph.kernels(edges, pairs), seeds, wanted, by="section").collect()}
    full = {(r.section, r.node): r["rank"] for r in graph.pagerank(edges, seeds, by="section").collect()}
    src, dst, w = (np.array(x) for x in zip(*[(a, b, c) for a, b, _, c in rows], strict=True))
    for k, s in sets.items():
        want = graph.pagerank_arrays(src, dst, w, s)
        for n in range(0, 45, 2):
            assert abs(got.get((k, n), 0.0) - float(want.get(n, 0.0))) < 1e-12
            assert abs(full.get((k, n), 0.0) - float(want.get(n, 0.0))) < 1e-12


def test_weak_components(spark):
    pairs = [(a, a + 1) for a in range(0, 3000) if a % 100 != 99] + [(5000, 5001), (5001, 5000), (7, 7), (8000, 8000)]
    got = {r.node: r.part for r in graph.weak_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: n // 100 * 100 for n in range(3000)} | {5000: 5000, 5001: 5000, 8000: 8000}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_layers_equal_plain_forms(spark, way, seed):
    pairs = {(a, b) for a, b, *_ in _random_edges(seed, 60, 75)}
    nodes = {x for p in pairs for x in p}
    far = _reached(pairs, nodes)
    comp = {n: min(m for m in far[n] if n in far[m]) for n in nodes}
    layer = dict.fromkeys(comp.values(), 0)
    for _ in nodes:
        for a, b in pairs:
            if comp[a] != comp[b]:
                layer[comp[b]] = max(layer[comp[b]], layer[comp[a]] + 1)
    got = {r.node: (r.component, r.layer) for r in graph.condense(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    assert got == {n: (c, layer[c]) for n, c in comp.items()}


def test_fold_equals_plain_form(spark, way):
    pairs = {(a, b) for a, b, *_ in _random_edges(5, 50, 60)}
    rng = random.Random(6)
    direct = [(rng.randrange(52), rng.choice("xyz"), rng.randrange(4)) for _ in range(40)]
    lift = {"origin": F.col("node"), "what": F.col("what"), "site": F.col("site")}
    args = spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.createDataFrame(direct, "node long, what string, site int")
    got = [(r.node, r.origin, r.what, r.site) for r in graph.fold_components(*args, lift=lift, dedup=[F.col("origin"), F.col("what")]).collect()]
    nodes = {x for p in pairs for x in p} | {n for n, *_ in direct}
    want = set()
    for n, seen in _reached(pairs, nodes).items():
        least = {}
        for origin, what, site in direct:
            if origin in seen:
                least[origin, what] = min(least.get((origin, what), site), site)
        want |= {(n, o, w, s) for (o, w), s in least.items()}
    assert len(got) == len(want) and set(got) == want
    # entries without their origin: one for each kind, wherever it comes from
    kinds = {(r.node, r.what) for r in graph.fold_components(*args, lift={"what": F.col("what")}, dedup=[F.col("what")]).collect()}
    assert kinds == {(n, w) for n, _, w, _ in want}


def test_long_chain_of_calls(spark):
    n = 50_000
    calls = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    direct = spark.createDataFrame([(n, "write"), (10, "read")], "node long, what string")
    got = graph.fold_components(calls, direct, lift={"what": F.col("what")}, dedup=[F.col("what")])
    assert got.count() == n + 1 + 11
    deep = graph.condense(calls)
    assert deep.filter("node = component").count() == n + 1 and deep.agg(F.max("layer")).first()[0] == n


def test_comments_are_resolved_by_their_scope_and_sure_names(spark):
    edges = graph.edges_of(spark.createDataFrame([("K1", "F1"), ("K1", "V1"), ("K2", "F2"), ("K2", "V2"), ("F1", "L1"), ("F9", "V9")], "src string, dst string"), "ContainsMember")
    comments = spark.createDataFrame([(1, "F1", "dev"), (2, "F9", "dev"), (3, "F1", "user"), (4, "F2", "dev"), (5, "F9", "dev")], "comment_id long, target string, author string")
    above = spark.createDataFrame([("F1", "K1", 1), ("F2", "K2", 1)], "topic string, node string, distance int")
    rows = [(c, 0, None, v, v.replace("V", "K")) for c in (1, 2, 3, 4) for v in ("V1", "V2")] + [(2, 1, "K2", None, None), (2, 2, "K2", None, None), (5, 0, None, "V1", None), (5, 0, None, "V2", None), (5, 1, None, None, None)]
    mentions = spark.createDataFrame(rows, "comment_id long, occurrence int, topic string, candidate string, scope string")
    got = {(r.comment_id, r.occurrence): (r.choice, r.phase, r.n_candidates) for r in resolve.resolve_comments(edges, comments, above, mentions, developers=["dev"]).collect()}
    assert got == {(1, 0): ("V1", "B", 2), (2, 0): ("V2", "B", 2), (4, 0): ("V2", "B", 2), (5, 0): (None, "E", 2)}


def test_seeds_of_comments(spark):
    chains = spark.createDataFrame([(1, f"T{d}", d) for d in range(9)], "section long, node string, distance int")
    known = spark.createDataFrame([(1, "T0"), (1, "T0"), (1, "X")], "section long, node string")
    got = {r.node: r.weight for r in resolve.comment_seeds(chains, known).collect()}
    assert got["T0"] == 2.0 and got["T1"] == 0.5 and got["X"] == 1.0 and min(got.values()) == 2.0**-resolve.MAX_SEED_DEPTH


def _plain_batches(groups, shared, limit):
    """Every group is weighed for every place of a batch."""
    left, out = list(groups), []
    while left:
        members = list(left.pop(0))
        while len(members) < limit:
            have = set().union(*(shared.get(m, set()) for m in members))
            sizes = [len(have & set().union(*(shared.get(m, set()) for m in g))) if len(members) + len(g) <= limit else 0 for g in left]
            if not sizes or max(sizes) == 0:
                break
            members += left.pop(sizes.index(max(sizes)))
        out.append(members)
    lone = [b for b in out if len(b) == 1 and not shared.get(b[0])]
    flat = [m for b in lone for m in b]
    return [b for b in out if b not in lone] + [flat[i : i + limit] for i in range(0, len(flat), limit)]


def test_batches_equal_plain_form():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 25)
        groups, k = [], 0
        while k < n:
            size = rng.choice([1, 1, 1, 2, 6])
            groups.append(list(range(k, k + size)))
            k += size
        shared = {m: set(rng.sample(range(8), rng.randint(0, 3))) for m in range(k)}
        assert graph.greedy_batches(groups, shared, 5) == _plain_batches(groups, shared, 5)


def test_merge_tree_goes_on_behind_its_last_round(spark, tmp_path):
    from strataloom.operators import steps

    rows = [(d, p, f"{d}{p}") for d, n in (("a", 7), ("b", 1), ("c", 2), ("d", 4)) for p in range(n)]
    asked = []

    def merge(pairs):
        asked.append(pairs.count())
        if len(asked) == 2:
            raise RuntimeError("broken off")
        return pairs.select("doc", "place", F.concat(F.lit("("), "left", "right", F.lit(")")).alias("body"))

    items = spark.createDataFrame(rows, "doc string, place int, body string")
    with pytest.raises(RuntimeError):
        steps.merge_tree(items, merge, by="doc", folder=f"{tmp_path}/run")
    got = {r.doc: r.body for r in steps.merge_tree(items.repartition(7), merge, by="doc", folder=f"{tmp_path}/run").collect()}
    assert got == {"a": "(((a0a1)(a2a3))((a4a5)a6))", "b": "b0", "c": "(c0c1)", "d": "((d0d1)(d2d3))"}
    assert asked == [6, 3, 3, 1]  # 6 pairs once; the second round twice, as it was broken off
