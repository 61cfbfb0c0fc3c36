"""Interval labels, accesses of statements, walks and reassembly against recursive forms."""

from __future__ import annotations

import json
import random

import pytest

from strataloom.operators import accesses as acc
from strataloom.operators import trees
from strataloom.sources import syntax


class Program:
    """Random syntax trees, and what a recursive walk of them finds."""

    def __init__(self, seed: int):
        self.rng, self.next, self.function = random.Random(seed), 100_000 * (seed + 1), 100_000 * (seed + 1)

    def node(self, kind: str, /, **fields) -> dict:
        self.next += 1
        return {"id": self.next, "nodeType": kind, **fields}

    def name(self) -> dict:
        return self.node(self.rng.choice(["Identifier", "Identifier", "IdentifierPath"]), name=self.rng.choice("abcd"), referencedDeclaration=self.rng.choice([*range(1, 9), self.function]))

    def place(self, deep: int) -> dict:
        k = self.rng.randrange(5) if deep else 0
        if k == 1:
            return self.node("MemberAccess", memberName="m", expression=self.place(deep - 1), referencedDeclaration=self.rng.choice([None, 50]))
        if k == 2:
            return self.node("IndexAccess", baseExpression=self.place(deep - 1), indexExpression=self.rng.choice([None, self.value(deep - 1)]))
        if k == 3:
            return self.node("TupleExpression", components=[self.rng.choice([None, self.place(deep - 1)]), self.place(deep - 1)])
        return self.value(deep - 1) if k == 4 else self.name()

    def value(self, deep: int) -> dict:
        k = self.rng.randrange(6) if deep > 0 else 0
        if k == 1:
            return self.call(deep)
        if k == 2:
            return self.node("BinaryOperation", operator="+", leftExpression=self.value(deep - 1), rightExpression=self.value(deep - 1))
        if k == 3:
            return self.node("UnaryOperation", operator=self.rng.choice(["++", "--", "delete", "!"]), subExpression=self.place(deep - 1))
        if k == 4:
            return self.node("Assignment", operator=self.rng.choice(["=", "+="]), leftHandSide=self.place(deep - 1), rightHandSide=self.value(deep - 1))
        return self.place(deep - 1) if k == 5 else self.name()

    def call(self, deep: int) -> dict:
        k = self.rng.randrange(6)
        callee = self.name()
        if k == 1:
            callee = self.node("MemberAccess", memberName="f", expression=self.value(deep - 1), referencedDeclaration=self.rng.choice([None, 60]))
        if k == 2:
            callee = self.node("FunctionCallOptions", expression=self.node("MemberAccess", expression=self.name(), referencedDeclaration=61), options=[self.value(deep - 1)])
        if k == 3:
            callee = self.node("Identifier", name=self.rng.choice(["require", "revert"]), referencedDeclaration=-18)
        if k == 4:
            callee = self.node("NewExpression", typeName=self.node("UserDefinedTypeName", pathNode=self.name()))
        kind = "typeConversion" if k == 5 else "functionCall"
        return self.node("FunctionCall", kind=kind, expression=callee, arguments=[self.value(deep - 1) for _ in range(self.rng.randrange(3))])

    def statement(self) -> dict:
        k = self.rng.randrange(5)
        if k == 0:
            return self.node("EmitStatement", eventCall=self.node("FunctionCall", kind="functionCall", expression=self.name(), arguments=[self.value(2)]))
        if k == 1:
            return self.node("RevertStatement", errorCall=self.node("FunctionCall", kind="functionCall", expression=self.node("MemberAccess", expression=self.name(), referencedDeclaration=self.rng.choice([None, 70])), arguments=[self.value(2)]))
        if k == 2:
            return self.node("TryStatement", externalCall=self.call(2), clauses=[])
        return self.node("ExpressionStatement", expression=self.value(4))

    def unit(self) -> dict:
        body = self.node("Block", statements=[self.statement() for _ in range(4)])
        returns = self.node("ParameterList", parameters=[self.node("VariableDeclaration", name="r") for _ in range(2)])
        function = self.node("FunctionDefinition", name="f", returnParameters=returns, body=body)
        function["id"] = self.function  # what some names refer to
        return self.node("SourceUnit", nodes=[self.node("ContractDefinition", name="C", nodes=[function])])


def preorder(tree: dict) -> list[dict]:
    out, work = [], [tree]
    while work:
        n = work.pop()
        out.append(n)
        kids = [x for v in n.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict) and "nodeType" in x]
        work += reversed(kids)
    return out


def children(n: dict) -> list[dict]:
    return [x for v in n.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict) and "nodeType" in x]


NAMED = ("Identifier", "IdentifierPath")


def refer(n):
    return n.get("referencedDeclaration") if n["nodeType"] in (*NAMED, "MemberAccess") else None


def builtin(n):
    e = n["expression"]
    e = e["expression"] if e["nodeType"] == "MemberAccess" else e
    return e["nodeType"] == "Identifier" and (e.get("referencedDeclaration") or 0) < 0


class Walk:
    """The rules as one recursive visitor with a mode for written places and callees."""

    def __init__(self, tree):
        self.at = {id(n): k for k, n in enumerate(preorder(tree))}
        self.out, self.reverts = [], []
        self.returns = {}
        for n in preorder(tree):
            if n["nodeType"] == "FunctionDefinition":
                self.returns[n["id"]] = [v["id"] for v in n["returnParameters"]["parameters"]]
        self.visit(tree, None)

    def put(self, access, n, target, s):
        self.out.append((s, self.at[id(n)], target, access))

    def base(self, n):
        if n["nodeType"] in NAMED:
            return n
        inner = {"MemberAccess": "expression", "IndexAccess": "baseExpression"}.get(n["nodeType"])
        return self.base(n[inner]) if inner else None

    def bases(self, n):
        if n["nodeType"] == "TupleExpression":
            return [b for x in n["components"] if x for b in self.bases(x)]
        return [b for b in [self.base(n)] if b]

    def seen(self, n, s, read=True):
        if refer(n) is not None and s is not None:
            self.put("reference", n, refer(n), s)
            if read:
                self.put("read", n, refer(n), s)

    def written(self, n, s):
        kind = n["nodeType"]
        if kind in NAMED or kind == "MemberAccess":
            self.seen(n, s, read=False)
            if kind == "MemberAccess":
                self.written(n["expression"], s)
        elif kind == "IndexAccess":
            self.written(n["baseExpression"], s)
            if n["indexExpression"]:
                self.visit(n["indexExpression"], s)
        elif kind == "TupleExpression":
            for x in n["components"]:
                if x:
                    self.written(x, s)
        else:
            self.visit(n, s)

    def callee(self, n, call, s, tried):
        kind = n["nodeType"]
        if kind == "FunctionCallOptions":
            self.callee(n["expression"], call, s, tried)
            for x in n["options"]:
                self.visit(x, s)
        elif kind in NAMED or kind == "MemberAccess":
            if refer(n) is not None:
                self.put("try" if tried else "call", call, refer(n), s)
                if s is not None:
                    self.put("reference", n, refer(n), s)
                    for r in self.returns.get(refer(n), []):
                        self.put("reference", call, r, s)
            if kind == "MemberAccess":
                self.visit(n["expression"], s)
        else:
            self.visit(n, s)

    def visit(self, n, s, statement=False, tried=False):
        kind = n["nodeType"]
        s = self.at[id(n)] if statement else s
        if kind == "FunctionCall" and n["kind"] == "functionCall":
            e = n["expression"]
            if e["nodeType"] == "Identifier" and e["name"] in ("require", "revert"):
                self.reverts.append((self.at[id(n)], e["name"], None))
            else:
                self.callee(e, n, s, tried)
            for x in n["arguments"]:
                self.visit(x, s)
        elif kind in ("EmitStatement", "RevertStatement"):
            call = n["eventCall"] if kind == "EmitStatement" else n["errorCall"]
            target = refer(call["expression"])
            if kind == "RevertStatement":
                self.reverts.append((self.at[id(n)], "revert", target))
            elif target is not None:
                self.put("event", call, target, s)
            for x in children(call):
                self.visit(x, s)
        elif kind == "Assignment":
            for b in self.bases(n["leftHandSide"]):
                self.put("write", n, b["referencedDeclaration"], s)
            (self.written if n["operator"] == "=" else self.visit)(n["leftHandSide"], s)
            self.visit(n["rightHandSide"], s)
        elif kind == "UnaryOperation" and n["operator"] in ("++", "--", "delete"):
            b = self.base(n["subExpression"])
            if b:
                self.put("write", n, b["referencedDeclaration"], s)
            (self.written if n["operator"] == "delete" else self.visit)(n["subExpression"], s)
        else:
            self.seen(n, s)
            for role, v in n.items():
                for x in v if isinstance(v, list) else [v]:
                    if isinstance(x, dict) and "nodeType" in x:
                        self.visit(x, s, role == "statements" or kind == "FunctionDefinition" and role == "returnParameters", role == "externalCall")


def values(n, returns) -> set:
    kind = n["nodeType"]
    if kind in NAMED or kind == "MemberAccess":
        return {refer(n)} - {None}
    if kind == "FunctionCall" and n["kind"] == "functionCall" and not builtin(n):
        e = n["expression"]
        while e["nodeType"] == "FunctionCallOptions":
            e = e["expression"]
        return set(returns.get(refer(e), []))
    kids = n["arguments"] if kind == "FunctionCall" else children(n)
    return set().union(*(values(x, returns) for x in kids))


@pytest.fixture(scope="module")
def programs(spark):
    units = [Program(seed).unit() for seed in range(60)]
    nodes = syntax.flatten(spark.createDataFrame([(str(k), json.dumps(u)) for k, u in enumerate(units)], "file string, json string")).cache()
    return units, nodes


def test_labels(programs):
    units, nodes = programs
    rows = {(r.file, r.enter): r for r in nodes.collect()}
    for k, u in enumerate(units):
        order = preorder(u)
        for i, n in enumerate(order):
            r = rows[str(k), i]
            assert (r.node_id, r.kind, r.leave - r.enter + 1) == (n["id"], n["nodeType"], len(preorder(n)))


def test_accesses_equal_a_recursive_walk(programs):
    units, nodes = programs
    got = sorted((r.file, r.statement if r.statement is not None else -1, r.site, r.target, r.access) for r in acc.accesses(nodes).collect())
    walks = [Walk(u) for u in units]
    want = sorted((str(k), s if s is not None else -1, site, target, access) for k, w in enumerate(walks) for s, site, target, access in w.out)
    assert got == want
    assert {a for *_, a in got} == {"reference", "read", "write", "call", "try", "event"}
    found = sorted((r.file, r.site, r.kind, r.error or 0) for r in acc.reverts(nodes).collect())
    assert found == sorted((str(k), *x[:2], x[2] or 0) for k, w in enumerate(walks) for x in w.reverts)


def test_value_references_equal_a_recursive_walk(programs):
    units, nodes = programs
    got = {(r.file, r.expression, r.target) for r in acc.value_references(nodes, nodes.filter("role = 'rightHandSide'")).collect()}
    want, indexes = set(), set()
    for k, u in enumerate(units):
        order = preorder(u)
        at = {id(n): i for i, n in enumerate(order)}
        returns = Walk(u).returns
        for n in order:
            if n["nodeType"] == "Assignment":
                want |= {(str(k), at[id(n["rightHandSide"])], t) for t in values(n["rightHandSide"], returns)}
                left = n["leftHandSide"]
                while left["nodeType"] in ("MemberAccess", "IndexAccess"):
                    if left["nodeType"] == "IndexAccess" and left["indexExpression"]:
                        indexes.add((str(k), at[id(n["leftHandSide"])], at[id(left["indexExpression"])]))
                    left = left["expression"] if left["nodeType"] == "MemberAccess" else left["baseExpression"]
    assert got == want
    kept = {(r.file, r.place, r.enter) for r in acc.index_expressions(nodes).collect()}
    assert indexes <= kept  # beside these, indexes inside the components of a tuple


def test_containment_join(spark):
    rng = random.Random(4)
    points = [(f, x) for f in "ab" for x in sorted(rng.sample(range(2**20), 300))] + [("a", 0), ("a", 2**31 - 2)]
    intervals = [(f, a, min(2**31 - 2, a + rng.choice([0, 1, 7, 1000, 2**19]))) for f in "ab" for a in rng.sample(range(2**20), 200)] + [("a", 0, 2**31 - 2)]
    got = sorted((r.file, r.enter, r.in_enter, r.in_leave) for r in trees.within(spark.createDataFrame(points, "file string, enter int"), spark.createDataFrame(intervals, "file string, enter int, leave int")).collect())
    assert got == sorted((f, x, a, b) for f, x in points for g, a, b in intervals if f == g and a <= x <= b)


def test_nested_intervals_equal_the_containment_join(programs):
    _, nodes = programs
    spans = nodes.filter("kind in ('FunctionCall', 'Assignment')").select("file", "enter", "leave", "node_id")
    points = nodes.select("file", "enter", "kind")
    key = lambda df: sorted((r.file, r.enter, r.kind, r.in_enter, r.in_leave, r.in_node_id) for r in df.collect())
    want = key(trees.within(points, spans))
    assert key(trees.nested(points, spans)) == want
    best = {}
    for file, enter, _, a, b, _ in want:
        best[file, enter] = max(best.get((file, enter), (-1, -1)), (a, b))
    got = {(r.file, r.enter): (r.in_enter, r.in_leave) for r in trees.innermost(points, spans).collect()}
    assert len(got) == points.count() and {k: v for k, v in got.items() if v[0] is not None} == best
    # a point is not copied for every size of block
    plan = trees.innermost(points, spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_only_the_columns_asked_for_are_made(spark, programs):
    units, nodes = programs
    made = spark.createDataFrame([(str(k), json.dumps(u)) for k, u in enumerate(units)], "file string, json string")
    few = syntax.flatten(made, ("leave", "file", "enter", "base", "roles"))
    assert few.columns == ["file", "enter", "leave", "base", "roles"]
    assert sorted(few.collect()) == sorted(nodes.select(*few.columns).collect())
    with pytest.raises(ValueError, match="nothing"):
        syntax.flatten(made, ("nothing",))


def test_an_odd_first_item_is_a_fault_of_its_file(spark):
    odd = {"nodeType": "Block", "id": 1, "statements": ["x", {"nodeType": "Break", "id": 2}]}
    good = {"nodeType": "Block", "id": 1, "statements": [{"nodeType": "Break", "id": 2}]}
    made = spark.createDataFrame([("odd", json.dumps(odd)), ("good", json.dumps(good))], "file string, json string").coalesce(1)
    assert [(r.file, r.node_id) for r in syntax.flatten(made).orderBy("enter").collect()] == [("good", 1), ("good", 2)]
    assert [(r.file, r.path) for r in syntax.faults(made).collect()] == [("odd", "$.statements[0]")]


def test_walks_with_barriers(programs):
    units, nodes = programs
    roots = nodes.filter("kind in ('FunctionDefinition', 'Assignment')")
    barriers = nodes.filter("kind = 'FunctionCall'")
    got = {}
    for r in trees.walk(nodes, roots, barriers=barriers).collect():
        got.setdefault((r.file, r.root), []).append((r.place, r.enter))
    for k, u in enumerate(units):
        order = preorder(u)
        at = {id(n): i for i, n in enumerate(order)}

        def walk(n, top):
            return [at[id(n)]] + ([] if n["nodeType"] == "FunctionCall" and n is not top else [x for c in children(n) for x in walk(c, top)])

        for n in order:
            if n["nodeType"] in ("FunctionDefinition", "Assignment"):
                assert [x for _, x in sorted(got[str(k), n["id"]])] == walk(n, n)
    subjects = nodes.filter("kind = 'UnaryOperation'").select("node_id")
    first = trees.subjects_in_order(nodes.filter("file = '7'"), nodes.filter("file = '7' and kind = 'FunctionDefinition'"), subjects)
    want = [n["id"] for n in preorder(units[7]) if n["nodeType"] == "UnaryOperation"]
    assert [r.node_id for r in first.orderBy("place").collect()] == list(dict.fromkeys(want))


def test_reassembly_is_the_identity(programs):
    units, nodes = programs
    assert {r.file: json.loads(r.json) for r in trees.reassemble(nodes).collect()} == {str(k): u for k, u in enumerate(units)}


def test_stubbed_trees_round_trip(programs):
    units, nodes = programs
    topics = nodes.filter("kind in ('FunctionDefinition', 'FunctionCall', 'ExpressionStatement')")
    parts = {(r.file, r.node_id): json.loads(r.json) for r in trees.reassemble(nodes, topics).collect()}
    assert len(parts) == topics.count() + len(units)

    def whole(file, x):
        if isinstance(x, list):
            return [whole(file, y) for y in x]
        if isinstance(x, dict):
            return whole(file, parts[file, x["stub"]]) if set(x) == {"stub"} else {k: whole(file, v) for k, v in x.items()}
        return x

    for k, u in enumerate(units):
        assert whole(str(k), parts[str(k), u["id"]]) == u


def test_population(programs):
    units, nodes = programs
    some = nodes.filter("kind = 'FunctionDefinition' and file in ('1', '2')")
    got = {(r.file, r.enter) for r in trees.population(nodes.filter("file < '3'"), some).collect()}
    want = set()
    for k, u in enumerate(units):
        if k in (1, 2):
            order = preorder(u)
            a = next(i for i, n in enumerate(order) if n["nodeType"] == "FunctionDefinition")
            want |= {(str(k), a + i) for i in range(len(preorder(order[a])))}
    assert got == want


def _plain_references(text: str, known: dict) -> list[tuple]:
    """A scan by code point: at each identifier the longest known dotted name, else the identifier."""
    word = lambda c: c.isascii() and (c.isalnum() or c in "_$")
    out, i, chain = [], 0, False
    while i < len(text):
        begins = word(text[i]) and not text[i].isdigit() and (i == 0 or not (word(text[i - 1]) or text[i - 1] == ".") or chain)
        if not begins:
            i, chain = i + 1, False
            continue
        ends, j = [], i
        while True:
            while j < len(text) and word(text[j]):
                j += 1
            ends.append(j)
            if j + 1 < len(text) and text[j] == "." and word(text[j + 1]) and not text[j + 1].isdigit():
                j += 1
            else:
                break
        hits = [e for e in ends if text[i:e] in known]
        end = max(hits, default=ends[0])
        out.append((i, text[i:end], known.get(text[i:end], 0)))
        chain = end < len(text) and text[end] == "." and end != ends[-1]
        i = end + 1 if chain else end
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_references_from_left_to_right(spark, monkeypatch, limit):
    from strataloom.operators import names

    monkeypatch.setattr(names, "TABLE_NAMES", limit)
    rng = random.Random(9)
    simple = ["a", "bb", "C", "$x", "_y", "go1"]
    known = {**{s: rng.choice([1, 1, 2]) for s in simple[:4]}, **{f"{a}.{b}": rng.choice([1, 2]) for a in simple for b in simple if rng.random() < 0.3}, "C.a.bb": 1, "unused.name": 3}
    rows = [(n, f"T{k}{n}") for n, many in known.items() for k in range(many)] + [(None, "T"), ("bb", None)]
    texts = ["".join(rng.choice([*simple, *simple, ".", ".", " ", "1", "é", "-"]) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["", None, "a.", ".a", "a..bb", "1a.bb", "C.a.bb.C"]
    got = {}
    for r in names.scan(spark.createDataFrame(list(enumerate(texts)), "section int, body string"), spark.createDataFrame(rows, "name string, topic string"), key="section", text="body").collect():
        got.setdefault(r.section, []).append((r.pos, r.start, r.reference, r.n_candidates, r.status, r.topic))
    for k, text in enumerate(texts):
        want = [(p, at, ref, n, ("unknown", "resolved", "ambiguous")[min(n, 2)], f"T0{ref}" if n == 1 else None) for p, (at, ref, n) in enumerate(_plain_references(text or "", known))]
        assert sorted(got.get(k, [])) == want


def test_panels_drop_what_stands_inside(spark):
    from strataloom.operators import contexts

    shown = spark.createDataFrame([(1, "A"), (1, "B"), (1, "B"), (1, "D"), (2, "B"), (2, "Z")], "panel int, topic string")
    above = spark.createDataFrame([("B", "A"), ("D", "X"), ("A", "R")], "topic string, ancestor string")
    ctx = spark.createDataFrame([("A", "s", None, 1, 5, "m"), ("B", "s", None, 2, 4, "m"), ("D", "s", None, 1, 3, "k"), ("D", "t", "u", 9, 1, "k")], "topic string, scope string, subscope string, ref int, sort_key int, mention string")
    got = {(r.panel, r.scope, r.subscope, r.ref, r.sort_key, tuple(r.mentions)) for r in contexts.doc_panel(shown, above, ctx).collect()}
    assert got == {(1, "s", None, 1, 3, ("k", "m")), (1, "t", "u", 9, 1, ("k",)), (2, "s", None, 2, 4, ("m",))}
    nest = contexts.nested_groups(ctx.select(ctx.topic, "scope", "subscope", "ref", "sort_key")).filter("topic = 'D'").first().groups
    assert [(g.scope, list(g.refs), [(x.subscope, list(x.refs)) for x in g.inner]) for g in nest] == [("t", [], [("u", [9])]), ("s", [1], [])]


def test_faults_and_types_of_nodes(spark):
    from strataloom.sources import kinds

    good = {"id": 1, "nodeType": "FunctionDefinition", "kind": "function", "stateMutability": "view", "visibility": "public", "virtual": None, "parameters": {"id": 2, "nodeType": "ParameterList", "parameters": []}, "returnParameters": {"id": 3, "nodeType": "ParameterList", "parameters": []}}
    bad = {"id": 4, "nodeType": "Assignment", "operator": "=>", "leftHandSide": {"id": 5, "nodeType": "Identifier", "name": "a"}, "extra": {"id": 6, "nodeType": "Strange"}}
    odd = {"id": 7, "nodeType": "FunctionCall", "kind": 5, "tryCall": "no", "names": [], "expression": {"id": 8, "nodeType": "MemberAccess", "memberName": "m", "referencedDeclaration": 9, "expression": {"id": 9, "nodeType": "Identifier", "name": "b", "referencedDeclaration": -1}}}
    nodes = syntax.flatten(spark.createDataFrame([(k, json.dumps(t)) for k, t in (("good", good), ("bad", bad), ("odd", odd))], "file string, json string")).cache()
    got = {(r.file, tuple(r.path), r.field, r.reason) for r in kinds.node_faults(nodes).collect()}
    assert got == {
        ("bad", (), "operator", "unknown value"), ("bad", (), "rightHandSide", "missing"), ("bad", (0,), "referencedDeclaration", "missing"), ("bad", (1,), None, "unknown kind"),
        ("odd", (), "kind", "not a STRING"), ("odd", (), "tryCall", "not a BOOLEAN"),
    }
    r = kinds.typed(nodes, "FunctionDefinition").first()
    assert (r.kind, r.stateMutability, r.visibility, r.implemented, r.virtual) == ("function", "view", "public", None, None)
    call = kinds.typed(nodes, "FunctionCall").first()
    assert (call.kind, call.tryCall, call.names) == (None, None, [])
