"""Trees cut where they are read, labels of kept nodes, subjects by labels, and rounds of ranks that are one job each."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from strataloom.functions.tables import ROUNDS
from strataloom.operators import graph, trees
from strataloom.plans import tree_queries
from strataloom.sources import kinds, syntax


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _tree(rng, depth: int, ids: list, known: float = 0.9) -> dict:
    kind = rng.choice(["FunctionCall", "Assignment", "Identifier", "TupleExpression", "MemberAccess", "IndexAccess", "FunctionDefinition", "UnaryOperation"])
    out = {"nodeType": kind, "name": rng.choice(["é", 'a"b', None, 5]), "operator": rng.choice(["=", "++", None]), "attr": {"x": [1, None]}}
    if rng.random() < known:
        out["id"] = ids.pop()
    for key in rng.sample(["expression", "components", "leftHandSide", "baseExpression", "arguments", "statements"], rng.randrange(4) if depth else 0):
        held = [None if rng.random() < 0.3 else _tree(rng, depth - 1, ids, known) for _ in range(rng.randrange(1, 4))]
        out[key] = held if key in ("components", "arguments", "statements") and any(held) else next((x for x in held if x), None)
    return out


def _files(spark, seed: int, known: float = 0.9):
    rng, ids = random.Random(seed), list(range(1, 5_000))
    rows = [(f"f{k}", json.dumps(_tree(rng, 4, ids, known))) for k in range(25)] + [("bad", '{"id": 1}'), ("odd", "["), ("none", None)]
    return spark.createDataFrame(rows, "file string, json string").coalesce(2)


def test_trees_are_cut_where_they_are_read(spark):
    files = _files(spark, 1)
    nodes = syntax.flatten(files)
    topics = nodes.filter("role = 'statements' or kind = 'FunctionCall'")
    drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None or k not in ("name", "operator")} if isinstance(x, dict) else [drop(v) for v in x] if isinstance(x, list) else x
    rows = lambda df: sorted((r.file, r.node_id, json.dumps(drop(json.loads(r.json)), sort_keys=True)) for r in df.collect())
    got = syntax.stubbed(files, kinds=["FunctionCall"], roles=["statements"])
    want = rows(trees.reassemble(nodes, topics))
    assert rows(got) == want and len(want) > 40
    assert "Exchange hash" not in _plan(got)


def test_kept_nodes_have_the_labels_of_whole_trees(spark):
    files = _files(spark, 2)
    columns = ["file", "enter", "leave", "kind", "role", "callable", "target.over", "base.up_id", "callee"]
    kept = syntax.flatten(files, columns, kinds=["Identifier"], roles=["arguments"])
    whole = syntax.flatten(files).filter("kind = 'Identifier' or role = 'arguments'").select("file", "enter", "leave", "role", "kind", "callable", F.struct("target.over").alias("target"), F.struct("base.up_id").alias("base"), "callee")
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert order(kept) == order(whole) and kept.count() > 20


def test_places_of_subjects_follow_from_labels(spark):
    nodes = syntax.flatten(_files(spark, 3, 1.0), ["file", "enter", "leave", "kind", "node_id"]).localCheckpoint()
    roots, calls = nodes.filter("kind = 'FunctionDefinition'"), nodes.filter("kind = 'FunctionCall'")
    subjects = nodes.filter("kind in ('Assignment', 'FunctionCall')")
    rows = lambda df: sorted(map(tuple, df.select("root", "place", "node_id").collect()))
    for barriers in (None, calls):
        got = trees.subjects_in_order(nodes, roots, subjects, barriers=barriers)
        walked = trees.walk(nodes, roots, barriers=barriers).filter("kind in ('Assignment', 'FunctionCall')").collect()
        want = {}
        for r in walked:
            ids = want.setdefault(r.root, {})
            ids[r.node_id] = min(r.enter, ids.get(r.node_id, r.enter))
        assert rows(got) == sorted((root, k, x) for root, ids in want.items() for k, x in enumerate(sorted(ids, key=lambda x: ids[x]))) and len(want) > 5  # noqa: B023
        assert "Join" not in _plan(got)


def test_all_groups_of_seed_sets_are_one_job_a_round(spark, monkeypatch):
    rng, written = random.Random(4), []
    links = spark.createDataFrame([(f"a{rng.randrange(30)}", f"a{rng.randrange(34)}", rng.choice([0.5, 1.0])) for _ in range(90)], "src string, dst string, w double")
    seeds = spark.createDataFrame([(k, f"a{rng.randrange(34)}", 1.0) for k in range(5) for _ in range(2)], "seed_set int, node string, weight double")
    ranks = lambda **more: {(r.seed_set, r.node): r["rank"] for r in graph.pagerank(links, seeds, **more).collect()}
    want = ranks()
    monkeypatch.setattr(graph, "ARRAY_EDGES", 0)
    monkeypatch.setattr(graph, "VECTOR_CELLS", 1)  # a group for each set
    plain = graph.write_out
    monkeypatch.setattr(graph, "write_out", lambda df, name="step": (written.append(name), plain(df, name))[1])
    got = ranks(written=True)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert written.count("ranks") == ROUNDS + 1 and "edges" not in written


def test_nodes_that_are_the_same_to_the_rules_are_judged_once(spark, monkeypatch):
    nodes = syntax.flatten(_files(spark, 5)).localCheckpoint()
    want = {(r.kind, r.field, r.reason): r.n for r in kinds.node_faults(nodes).groupBy("kind", "field", "reason").agg(F.count("*").alias("n")).collect()}
    judged, plain = [], kinds._judged
    monkeypatch.setattr(kinds, "_judged", lambda rows, keys: (judged.append(rows.count()), plain(rows, keys))[1])
    got = {(r.kind, r.field, r.reason): r.n for r in kinds.fault_counts(nodes).collect()}
    assert got == want and len(want) > 10
    assert judged[0] < nodes.count()


def test_texts_of_orders_are_those_of_the_sql(spark, tmp_path):
    lines = [(1, 2, 5, 6), (1, 1, 12, 3), (1, 1, 4, 100), (2, None, 7, 8), (3, 1, None, 2), (3, 2, 9, 9), (4, 1, None, None), (4, 7, 8, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 2), (10, 2), (3, 4)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.file: r.json for r in tree_queries._trees(spark, str(tmp_path)).collect()}
    text = tree_queries._trees_sql(lambda c, by: f"listagg({c}, ',') within group (order by {by})")
    want = {r.file: r.json for r in spark.sql(text.replace("from lineitem", "from tree_lineitem").replace("from supplier", "from tree_supplier")).collect()}
    assert got == want and len(got) == 6
