"""Queries run over their whole tables and chains to their ends, against plain forms."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from strataloom.operators import graph, relations
from strataloom.plans import graph_queries


def _plain_ranks(edges, seeds):
    """Personalised PageRank as a dense matrix: 30 rounds at 0.85."""
    nodes = sorted({x for e in edges for x in e} | set(seeds))
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in edges.items():
        m[at[b], at[a]] += w
    out = m.sum(axis=0)
    m[:, out > 0] /= out[out > 0]
    restart = np.zeros(len(nodes))
    for x, w in seeds.items():
        restart[at[x]] += w
    restart /= restart.sum()
    rank = restart
    for _ in range(30):
        rank = 0.15 * restart + 0.85 * (m @ rank + rank[out == 0].sum() * restart)
    return {x: rank[at[x]] for x in nodes}


def _plain_rounds(edges, refs, section):
    """{ref: (choice, phase, candidates)} of one section; refs {ref: {(candidate, scope)}}."""
    done = {}
    for _ in range(4):
        seeds = Counter({section: 1.0}) + Counter({c for c, _ in done.values()})
        ranks = _plain_ranks(edges, seeds)
        left = [r for r in refs if r not in done]
        picked = {}
        for r in left:
            best = sorted(((-round(ranks.get(c, 0.0), 9), c) for c in {c for c, _ in refs[r]}))
            first, second = -best[0][0], -best[1][0] if len(best) > 1 else 0.0
            if first > 0 and first / (first + second) >= 0.65:
                picked[r] = (best[0][1], "B")
        chosen = {r: c for r, (c, _) in {**done, **picked}.items()}
        by_scope = {r: defaultdict(set) for r in refs}
        for r in refs:
            for c, scope in refs[r]:
                if chosen.get(r, c) == c:
                    by_scope[r][scope].add(c)
        pins = defaultdict(set)
        for i, j in combinations(sorted(refs), 2):
            common = set(by_scope[i]) & set(by_scope[j])
            if len(common) == 1:
                a, b = (by_scope[x][next(iter(common))] for x in (i, j))
                if len(a) == len(b) == 1:
                    pins[i] |= a
                    pins[j] |= b
        new = picked | {r: (next(iter(pins[r])), "C") for r in left if r not in picked and len(pins[r]) == 1}
        if not new:
            break
        done |= new
    return {r: (*done.get(r, (None, "E")), len({c for c, _ in refs[r]})) for r in refs}


def test_resolve_rounds_takes_every_order(spark, tmp_path):
    rng = random.Random(3)
    customer = [(k, k % 3) for k in range(1, 6)]
    supplier = [(k, k % 4) for k in range(1, 9)]
    orders = [(k, rng.randrange(1, 6)) for k in range(1, 13)]
    lines = [(o, n, rng.randrange(1, 10), rng.randrange(1, 9)) for o, _ in orders for n in range(1, 5) for _ in range(rng.randrange(1, 4))]
    for name, rows, columns in (("customer", customer, ["c_custkey", "c_nationkey"]), ("supplier", supplier, ["s_suppkey", "s_nationkey"]), ("orders", orders, ["o_orderkey", "o_custkey"]), ("lineitem", lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])):
        pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / f"{name}.parquet")
    edges = Counter()
    for a, b, w in {(f"n{n}", f"c{c}", 1.0) for c, n in customer} | {(f"s{s}", f"p{p}", 0.8) for _, _, p, s in lines}:
        edges[a, b] += w
        edges[b, a] += w
    for a, b, w in {(f"c{c}", f"o{o}", 0.7) for o, c in orders} | {(f"o{o}", f"p{p}", 0.5) for o, _, p, _ in lines}:
        edges[a, b] += w
    refs = defaultdict(lambda: defaultdict(set))
    for o, n, p, s in lines:
        refs[o][n].add((f"p{p}", dict(supplier)[s]))
    want = {(o, r): v for o in refs for r, v in _plain_rounds(edges, refs[o], f"o{o}").items()}
    got = {(r.section, r.ref): (r.choice, r.phase, r.n_candidates) for r in graph_queries.resolve_rounds(spark, str(tmp_path)).collect()}
    assert {o for o, _ in got} == {o for o, _ in orders}
    assert {v[1] for v in want.values()} >= {"B", "E"}
    assert got == want


def test_long_conversations_keep_all_ancestors(spark):
    n = 300
    rows = [(k, k - 1 if k else None) for k in range(n)] + [(1000, None), (1001, 1000)]
    got = Counter((r.comment_id, r.ancestor, r.depth) for r in relations.parent_chain(spark.createDataFrame(rows, "comment_id long, parent long")).collect())
    assert got == Counter([(k, k - d, d) for k in range(n) for d in range(1, k + 1)] + [(1001, 1000, 1)])
    with pytest.raises(ValueError, match="cycle"):
        relations.parent_chain(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "comment_id long, parent long"))


def test_chains_are_followed_to_their_end(spark):
    rows = [(k, k - 1 if k > 1 else None) for k in range(1, 301)] + [(1001, 1002), (1002, 1003), (1003, 1001), (1004, 1002), (1005, 1004), (1006, 1006), (1007, 5000)]
    after = dict(rows)

    def end(topic):
        seen = set()
        while topic in after and topic not in seen:
            seen.add(topic)
            topic = topic if after[topic] is None else after[topic]
        return topic

    got = {r.topic: r.target for r in graph.follow_chain(spark.createDataFrame(rows, "topic long, next long")).collect()}
    assert got == {k: end(k) for k in after}


def test_counted_tokens_are_the_tokens(spark):
    from collections import Counter

    from strataloom.functions import text as t

    rows = [(1, "the parsedTree parsedTree HTTPServer2 acct acct x 7 _ tries"), (2, "parsedTree, addresses; usr"), (3, ""), (4, None), (5, "the of")]
    df = spark.createDataFrame(rows, "k long, s string")
    for code in (False, True):
        want = Counter((r.k, r.token) for r in t.tokens(df, "k", "s", code=code).collect())
        assert {(r.k, r.token): r.n for r in t.token_counts(df, "k", "s", code=code).collect()} == want


def test_scores_are_ranked_before_they_move(spark, sf):
    from strataloom.plans import text_queries

    plan = text_queries.bm25_top10(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = lambda word: [k for k, line in enumerate(plan) if word in line]
    # from the bottom: the sums of a document, the first ten of the task, then the shuffle by item
    partial = [k for k in at("WindowGroupLimit") if "Partial" in plan[k]]
    moved = [k for k in at("Exchange") if "item_id" in plan[k]]
    assert partial and moved and max(moved) < min(partial)


def test_counted_requirements_are_the_requirements(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from strataloom.operators import linking

    monkeypatch.setattr(linking, "TOPICS", 7)  # several chunks of topics
    rng = random.Random(3)
    pairs = lambda a, b, n, m, k: [(f"{a}{rng.randrange(n)}", f"{b}{rng.randrange(m)}") for _ in range(k)]
    features = spark.createDataFrame(pairs("t", "F", 30, 12, 90) + [("empty", "F99")], "topic string, feature string")
    held = spark.createDataFrame(pairs("F", "R", 10, 400, 900), "feature string, requirement string")
    section = spark.createDataFrame(pairs("t", "R", 40, 500, 60) + pairs("s", "R", 5, 50, 20), "topic string, requirement string")
    document = spark.createDataFrame(pairs("t", "R", 40, 500, 30), "topic string, requirement string")
    want = linking.requirements_of(features, held, section, document).groupBy("topic").agg(F.count("*").alias("n"), F.min("requirement").alias("first"))
    got = linking.requirement_counts(features, held, section, document)
    assert {tuple(r) for r in got.select("topic", "n_requirements", "first_requirement").collect()} == {tuple(r) for r in want.collect()}
