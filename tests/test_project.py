"""A project folder of several hundred files: trees, sources, documents in order, comments."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strataloom.sources import project, syntax


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for k in range(300):
        out, src = root / "out" / f"d{k % 7}" / f"S{k}.sol", root / "src" / f"d{k % 7}"
        out.mkdir(parents=True)
        src.mkdir(parents=True, exist_ok=True)
        (src / f"S{k}.sol").write_text(f"contract S{k} {{}}")
        tree = {"id": k, "nodeType": "SourceUnit", "absolutePath": f"src/d{k % 7}/S{k}.sol", "nodes": [{"id": 1000 + k, "nodeType": "ContractDefinition", "name": f"S{k}"}]}
        (out / f"S{k}.json").write_text(json.dumps({"abi": [], "ast": tree}))
        if k % 100 == 0:
            (out / f"T{k}.json").write_text(json.dumps({"ast": tree | {"id": 5000 + k}}))
    info = root / "out" / "build-info"
    info.mkdir()
    (info / "x.json").write_text(json.dumps({"ast": {"id": 1, "nodeType": "SourceUnit"}}))
    (root / "out" / "none.json").write_text("{}")
    docs = root / "docs"
    docs.mkdir()
    for k in range(120):
        (docs / f"p{k}.md").write_text("\n".join(f"line {k} {i}" for i in range(k % 5 + 1)))
    (root / "documents.txt").write_text("".join(f"{'technical: ' if k % 3 == 0 else ''}docs/./p{(k * 37) % 120}.md\n" for k in range(120)))
    return root


def test_trees_of_a_folder(spark, folder):
    trees = syntax.read_trees(spark, str(folder / "out"))
    rows = {r.file: r for r in trees.collect()}
    assert len(rows) == 303 and {f for f in rows if "#" in f} == {f"src/d{k % 7}/S{k}.sol#2" for k in (0, 100, 200)}
    assert json.loads(rows["src/d0/S0.sol"].json)["id"] == 0 and json.loads(rows["src/d0/S0.sol#2"].json)["id"] == 5000
    nodes = syntax.flatten(trees)
    assert nodes.count() == 606 and syntax.faults(trees).count() == 0
    texts = project.source_texts(spark, str(folder / "src"), "*.sol")
    found = syntax.with_sources(trees, texts, str(folder)).filter("file = 'src/d3/S10.sol'").first()
    assert found.text == "contract S10 {}"


def test_documents_in_listed_order_with_stable_ids(spark, folder):
    listed = project.document_list(spark, str(folder / "documents.txt"))
    want = [(k, f"docs/p{(k * 37) % 120}.md", k % 3 == 0) for k in range(120)]
    ids = []
    for n in (1, 13):
        docs = project.documents(spark, str(folder), listed.repartition(n))
        assert sorted((r.pos, r.path, r.is_technical) for r in docs.collect()) == want
        parts = docs.select("pos", F.posexplode(F.split("text", "\n")).alias("k", "line")).repartition(n, "line")
        ids.append({r.line: r.id for r in project.numbered(parts).collect()})
    assert ids[0] == ids[1]
    lines = [f"line {d} {i}" for k in range(120) for d in [(k * 37) % 120] for i in range(d % 5 + 1)]
    assert ids[0] == {line: k + 1 for k, line in enumerate(lines)}


def test_a_listed_document_that_is_missing(spark, folder, tmp_path):
    listed = spark.createDataFrame([(0, "docs/p1.md", False), (1, "docs/gone.md", True)], "pos int, path string, is_technical boolean")
    with pytest.raises(FileNotFoundError, match="gone"):
        project.documents(spark, str(folder), listed)
    assert [r.text is None for r in project.documents(spark, str(folder), listed, strict=False).orderBy("pos").collect()] == [False, True]


def test_hidden_comments_are_not_read(spark, tmp_path):
    spark.createDataFrame([(1, "active"), (2, "hidden"), (3, None)], "comment_id int, status string").write.parquet(f"{tmp_path}/c")
    assert {r.comment_id for r in project.comments(spark, f"{tmp_path}/c").collect()} == {1, 3}
