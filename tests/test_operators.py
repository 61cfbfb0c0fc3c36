"""Single operators on small hand-made inputs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as t
from strataloom.functions import topics as tp
from strataloom.operators import bm25, graph, relations, resolve, validators
from strataloom.sources import artifacts, project, syntax
from strataloom.streaming import events

PINNED = [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (1, 3, 1.0), (3, 1, 1.0), (4, 2, 0.7), (5, 2, 0.5)]


def _one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "parts"),
    [("computeShares", ["compute", "Shares"]), ("participation_id", ["participation", "id"]), ("PARTICIPATION_ID", ["PARTICIPATION", "ID"]), ("IERC20", ["IERC20"]), ("URLParser", ["URL", "Parser"]), ("parseURL", ["parse", "URL"]), ("_internalState", ["internal", "State"]), ("parse2Numbers", ["parse", "2", "Numbers"]), ("__", [])],
)
def test_identifier_split(spark, word, parts):
    assert _one(spark, t.split_identifier(F.lit(word))) == parts


@pytest.mark.parametrize(("word", "want"), [("processes", "process"), ("cries", "cri"), ("pass", "pass"), ("cats", "cat"), ("agreed", "agree"), ("need", "ne"), ("string", "str"), ("cry", "cri"), ("play", "play"), ("is", "is"), ("sing", "sing")])
def test_stem(spark, word, want):
    assert _one(spark, t.stem(F.lit(word))) == want


def test_code_tokens(spark):
    df = spark.createDataFrame([(1, "function updateBalance(address acc) external { balance[acc] += msg.value; }")], "k int, s string")
    got = {r.token for r in t.tokens(df, "k", "s", code=True).collect()}
    assert {"account", "addres", "increment", "amount", "sent"} & got >= {"account", "increment", "amount", "sent"}
    assert any(x.startswith("updat") for x in got) and any(x.startswith("balanc") for x in got)


def test_bm25_cases(spark):
    def score(docs, query):
        d = spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "doc int, token string")
        q = spark.createDataFrame([(1, w) for w in query], "q int, token string")
        return {r.doc: r.score for r in bm25.scores(q, bm25.term_counts(d, "doc"), query="q", doc="doc").collect()}

    s = score({1: ["stake", "deposit", "vault"], 2: ["transfer", "balance"], 3: ["stake", "reward", "claim"]}, ["stake", "reward"])
    assert max(s, key=s.get) == 3 and 2 not in s
    assert set(score({1: ["unrelated", "tokens", "here"], 2: ["match", "this"]}, ["match"])) == {2}
    s = score({1: ["match"], 2: ["match", "filler"], **{k: ["noise"] * 40 for k in range(3, 11)}}, ["match"])
    assert s[1] == s[2] < 2.0
    assert bm25.cutoff([5.0, 4.0, 3.0, 2.0, 1.5, 1.2, 0.5]) == 6 and bm25.cutoff([2.0] * 15) == 10


def test_pagerank_pinned_bits():
    src, dst, w = (np.array(x) for x in zip(*PINNED, strict=True))
    got = graph.pagerank_arrays(src, dst, w, {1: 1.0, 4: 0.3}, dtype=np.float32)
    assert [hex(np.float32(got[k]).view(np.uint32)) for k in range(1, 6)] == ["0x3ebcdf9a", "0x3e9dfcd4", "0x3e936a7c", "0x3d0dc8dc", "0x0"]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_pagerank_forms_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "ARRAY_EDGES", limit)
    monkeypatch.setattr(graph, "ROUNDS", 6 if limit == 0 else graph.ROUNDS)
    edges = spark.createDataFrame([(s, d, "Calls", w) for s, d, w in PINNED], "src long, dst long, kind string, w double")
    seeds = spark.createDataFrame([(0, 1, 1.0), (0, 4, 0.3), (1, 9, 2.0)], "seed_set int, node long, weight double")
    got = {(r.seed_set, r.node): r["rank"] for r in graph.pagerank(edges, seeds).collect()}
    src, dst, w = (np.array(x) for x in zip(*PINNED, strict=True))
    want = graph.pagerank_arrays(src, dst, w, {1: 1.0, 4: 0.3}, rounds=graph.ROUNDS)
    assert all(abs(got.get((0, k), 0.0) - v) < 1e-9 for k, v in want.items())  # what is not reached has no row
    assert got[1, 9] == pytest.approx(1.0)


def test_components_layers_batches(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (2, 3)], "src long, dst long")
    assert {r.node: r.component for r in graph.strong_components(pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r.component: r.layer for r in graph.layers(pairs).collect()} == {1: 0, 3: 1}
    assert graph.greedy_batches([[10], [20], [30]], {10: {99}, 20: {99}, 30: {99}}) == [[10, 20, 30]]
    assert [len(b) for b in graph.greedy_batches([[k] for k in range(10, 16)], {k: {99} for k in range(10, 16)})] == [5, 1]
    assert graph.greedy_batches([list(range(10, 17))], {}) == [list(range(10, 17))]
    assert graph.tarjan([1, 2, 3], {1: [2], 2: [3], 3: [1]}) == [[1, 2, 3]]
    calls = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4)], "audit int, callee long, caller long")
    members = spark.createDataFrame([(0, k) for k in (1, 2, 3, 4)], "audit int, member long")
    assert {r.member: r.layer for r in graph.call_batches(calls, members, by="audit").collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_effects(spark):
    calls = spark.createDataFrame([("A", "B", True), ("B", "A", False)], "caller string, callee string, in_try boolean")
    direct = spark.createDataFrame([("A", "revert", 21), ("B", "revert", 22)], "fn string, effect string, target int")
    got = {(r.fn, r.target) for r in relations.transitive_effects(calls, direct, keep_try=False).collect()}
    assert got == {("A", 21), ("B", 22), ("B", 21)}


def test_pins(spark):
    rows = [(1, 1, "a", "S"), (1, 2, "b", "S"), (2, 1, "a", "S"), (2, 1, "c", "S"), (2, 2, "b", "S"), (3, 1, "a", "S"), (3, 1, "x", "T"), (3, 2, "b", "S"), (3, 2, "y", "T")]
    df = spark.createDataFrame(rows, "section int, ref int, candidate string, scope string")
    assert {(r.section, r.ref): r.pin for r in relations.pinned(df).collect()} == {(1, 1): "a", (1, 2): "b"}


def test_resolution_picks_the_seeded_side(spark):
    edges = graph.edges_of(spark.createDataFrame([(10, 11), (20, 21)], "src long, dst long"), "ContainsMember")
    refs = spark.createDataFrame([(1, 4, 11, 10), (1, 4, 21, 20)], "section int, ref int, candidate long, scope long")
    seeds = spark.createDataFrame([(1, 10, 1.0)], "section int, node long, weight double")
    got = resolve.resolve_rounds(edges, refs, seeds).first()
    assert (got.choice, got.phase, got.n_candidates) == (11, "B", 2)


def test_topic_ids(spark):
    df = spark.createDataFrame([("N1",), ("S-3",), ("X1",), ("N",), ("",), (None,)], "c string")
    assert [(r.t.prefix, r.t.num_id, r.t.error) for r in df.select(tp.parse_topic(F.col("c")).alias("t")).collect()] == [("N", 1, None), ("S", -3, None), (None, None, "prefix"), (None, None, "number"), (None, None, "empty"), (None, None, "empty")]


def test_threat_answers(spark):
    body = [{"subject_topic": "N1", "conditions": [{"falsifies_condition": "C1", "threats": [{"description": "Overflow", "controlled_by": "any", "evidence_topics": ["N5", "N99"]}, {"description": "An attacker drains", "controlled_by": "x"}, {"description": " "}]}, {"falsifies_condition": "C9", "no_threat_rationale": "none"}, {"falsifies_condition": "C2"}]}, {"subject_topic": "N1", "conditions": []}, {"subject_topic": "N7", "conditions": []}]
    answers = spark.createDataFrame([(0, json.dumps(body)), (0, "no json")], "batch int, body string")
    subjects = spark.createDataFrame([(0, "N1")], "batch int, subject string")
    conditions = spark.createDataFrame([("N1", "C1"), ("N1", "C2")], "subject string, condition string")
    evidence = spark.createDataFrame([("N1", "N5")], "subject string, node string")
    good, lost = validators.threats(answers, subjects, conditions, evidence)
    assert [(r.description, r.evidence) for r in good.collect()] == [("Overflow", ["N5"])]
    assert sorted(r.reject for r in lost.collect()) == ["condition not on subject", "empty text", "names a party", "neither threats nor rationale", "repeated subject", "unexpected subject"]


def test_syntax_tree(spark):
    tree = {"id": 1, "nodeType": "SourceUnit", "nodes": [{"id": 2, "nodeType": "ContractDefinition", "name": "Vault", "nodes": [{"id": 3, "nodeType": "VariableDeclaration", "name": "total"}, {"id": 4, "nodeType": "FunctionDefinition", "name": "pay", "body": {"nodeType": "Block", "statements": [{"id": 5, "nodeType": "FunctionCall", "expression": {"id": 6, "nodeType": "Identifier", "name": "go", "referencedDeclaration": 9}}]}}]}]}
    nodes = syntax.flatten(spark.createDataFrame([("a.sol", json.dumps(tree))], "file string, json string")).cache()
    assert {r.topic: (r.kind, r.component, r.member) for r in syntax.declarations(nodes).collect()} == {2: ("Contract", None, None), 3: ("StateVariable", 2, None), 4: ("Function", 2, None)}
    assert [(r.caller, r.callee, r.in_try) for r in syntax.calls(nodes).collect()] == [(4, 9, False)]
    assert syntax.subtree(nodes, 4).count() == 4
    bad = spark.createDataFrame([("b", '{"id": 1}'), ("c", "no json"), ("d", '{"id": "x", "nodeType": "A"}'), ("a.sol", json.dumps(tree)), ("e", None), ("f", "[1]")], "file string, json string")
    assert {r.file: (r.path, r.field) for r in syntax.faults(bad).collect()} == {"b": ("$", "nodeType"), "c": ("$", ""), "d": ("$", "id"), "e": ("$", ""), "f": ("$", "")}
    assert {r.file for r in syntax.flatten(bad).select("file").distinct().collect()} == {"a.sol"}


def test_project_files(spark, tmp_path):
    (tmp_path / "scope.txt").write_text("./src/a.sol\n\n src/x/../b.sol \n")
    (tmp_path / "documents.txt").write_text("one.md\ntechnical: two.md\n\n")
    (tmp_path / "security.md").write_text("  \n")
    assert sorted(r.path for r in project.scope_list(spark, f"{tmp_path}/scope.txt").collect()) == ["src/a.sol", "src/b.sol"]
    assert [(r.path, r.is_technical) for r in project.document_list(spark, f"{tmp_path}/documents.txt").orderBy("pos").collect()] == [("one.md", False), ("two.md", True)]
    assert project.security_notes(spark, f"{tmp_path}/security.md") is None


def test_snapshot_report_steps(spark, tmp_path):
    topics = spark.createDataFrame([("N1", "Named", "a"), ("S1", "Feature", "f")], "topic string, variant string, text string")
    artifacts.write_snapshot(spark, {"topics": topics}, f"{tmp_path}/snap")
    assert [r.topic for r in artifacts.read_snapshot(spark, f"{tmp_path}/snap")["topics"].collect()] == ["N1"]
    with pytest.raises(ValueError, match="version"):
        artifacts.read_snapshot(spark, f"{tmp_path}/snap", version=11)
    artifacts.write_report(spark, "x", topics, f"{tmp_path}/report")
    again = artifacts.apply_report(spark, "x", topics.filter("topic = 'N1'"), f"{tmp_path}/report")
    assert sorted(r.topic for r in again.collect()) == ["N1", "S1"]
    runs = []
    steps = [("one", lambda tables: runs.append(1) or tables["topics"]), ("two", lambda tables: tables["one"].limit(1))]
    for _ in range(2):
        artifacts.run_steps(spark, steps, {"topics": topics}, f"{tmp_path}/steps")
    assert runs == [1]


def test_stream_pieces(spark):
    rows = spark.createDataFrame([("a", "N1", ["N2", "N1"], ["C1"])], "audit_id string, topic string, mentions array<string>, invalidated array<string>")
    assert [(r.topic, r.invalidated) for r in events.affected(rows).collect()] == [("N1", ["C1"]), ("N2", None)]


def test_annotator(spark):
    df = spark.createDataFrame([(1, "p")], "batch int, prompt string")
    assert validators.annotate(df, str.upper).first().body == "P"


def test_annotate_waits_and_gives_up(spark):
    from strataloom.operators import validators

    def busy(prompt):
        raise validators.Refused(3.0)

    row = validators.annotate(spark.createDataFrame([(1, "p")], "batch long, prompt string"), busy, retries=2, sleep=lambda s: None).first()
    assert row.body is None and row.error.startswith("Refused")


def test_late_rows_are_dropped(spark, tmp_path):
    """Four files in order of time, a batch each: the last one holds a row that is later than the watermark of the batch before."""
    import datetime as dt

    from strataloom.streaming import events as st

    schema = "ts timestamp, event_type string, value double"
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    for k, rows in enumerate([[(day(1, 1), "a", 1.0)], [(day(9), "a", 2.0)], [(day(9, 2), "a", 16.0)], [(day(1, 2), "a", 4.0), (day(9, 1), "a", 8.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/x{k}")
    (tmp_path / "in").mkdir()
    for k in range(4):
        next((tmp_path / f"x{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.window.start.day: (r.n, r.total) for r in st.drain_updates(st.windowed_counts(stream), "late", ["window", "event_type"]).collect()}
    assert got == {1: (1, 1.0), 9: (3, 26.0)}
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(schema).parquet(f"{tmp_path}/none")
    assert st.drain_updates(st.windowed_counts(empty), "empty", ["window", "event_type"]).collect() == []


def test_function_edges_cover(spark):
    """A direct write covers an effective one, a call covers a reference, loops and unnamed ends go."""
    from strataloom.operators import edges

    topics = spark.createDataFrame([(t,) for t in "fgvwe"], "topic string")
    rows = [("f", "call", "g"), ("f", "call", "f"), ("f", "write", "v"), ("f", "effective_write", "v"), ("f", "effective_write", "w"), ("f", "reference", "g"), ("f", "reference", "w"), ("f", "reference", "e"), ("f", "event", "x")]
    got = {(r.src, r.dst, r.kind) for r in edges.function_edges(spark.createDataFrame(rows, "fn string, stage string, target string"), topics).collect()}
    assert got == {("f", "g", "Calls"), ("f", "v", "WritesState"), ("f", "w", "WritesState"), ("f", "e", "References")}
