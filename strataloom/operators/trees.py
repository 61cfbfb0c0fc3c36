"""Trees as intervals: containment joins, pruned walks, populations and reassembly.

Nodes carry the labels of sources.syntax.flatten: `enter` numbers the nodes of a
file in preorder, `leave` is the last number below a node. b lies in a where
a.enter <= b.enter <= a.leave.

A containment join would compare all intervals of a file with all its points. So
intervals are cut into aligned blocks whose sizes are powers of two (at most two
of each size), and a point looks up the one block of each size that holds it:
an equi-join that meets every pair that contains one another exactly once, and no
other pair. Only sizes that some interval uses are looked up.

Intervals of one tree nest: of two, one holds the other or they share nothing. In
preorder the intervals that are open at a point then form a stack, and the one at a
level is the last that was opened at that level. So nested(), innermost() and
population() are windows over one dealing out by file, linear in rows and results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels are below 2 ** BITS.
BITS = 31


def _blocks(intervals: DataFrame) -> DataFrame:
    """One row (_size, _block) for each aligned block of [enter, leave]: at every size the odd one at the left and the even one at the right end."""
    a, b = F.col("_a").cast("long"), F.col("_b").cast("long") + 1

    def at(k):
        # ends in units of 2 ** k, after the smaller blocks at both ends were taken
        low = F.shiftright(a + F.lit((1 << k) - 1).cast("long"), k)
        high = F.shiftright(b, k)
        left = F.when((low < high) & (low % 2 == 1), F.struct(F.lit(k).alias("size"), low.alias("block")))
        right = F.when((low < high) & (high % 2 == 1) & ~((low % 2 == 1) & (low == high - 1)), F.struct(F.lit(k).alias("size"), (high - 1).alias("block")))
        return [left, right]

    pieces = F.filter(F.array(*[x for k in range(BITS) for x in at(k)]), lambda x: x.isNotNull())
    return intervals.withColumn("_p", F.explode(pieces)).select("*", F.col("_p.size").alias("_size"), F.col("_p.block").alias("_block")).drop("_p")


def within(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (file, enter, ...) joined with every interval (file, enter, leave, ...) that holds them, ends included; the interval's columns are prefixed with `in_`."""
    outer = intervals.select("file", F.col("enter").alias("_a"), F.col("leave").alias("_b"), *[F.col(c).alias(f"in_{c}") for c in intervals.columns if c != "file"])
    sizes = F.sequence(F.lit(0), F.lit(BITS - 1))
    looked = points.withColumn("_size", F.explode(sizes)).withColumn("_block", F.expr("shiftright(cast(enter as bigint), _size)"))
    cut = _blocks(outer).drop("_a", "_b")
    used = [r._size for r in cut.select("_size").distinct().collect()]  # BITS rows at most
    return looked.filter(F.col("_size").isin(used)).join(cut, ["file", "_size", "_block"]).drop("_size", "_block")


def _stack(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (_k = 1) and openings of nested intervals (_k = 0, the interval in _in) with the number of intervals that are open there in _level."""
    held = F.struct(*[F.col(c) for c in intervals.columns if c != "file"])
    opened = intervals.select("file", F.col("enter").alias("_at"), F.lit(0).alias("_k"), F.lit(1).alias("_d"), held.alias("_in"))
    closed = intervals.select("file", F.col("leave").alias("_at"), F.lit(2).alias("_k"), F.lit(-1).alias("_d"))
    own = points.withColumns({"_at": F.col("enter"), "_k": F.lit(1), "_d": F.lit(0)})
    rows = own.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("_at", "_k", F.col("_in.leave").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_level", F.sum("_d").over(before)).filter("_k < 2").drop("_d")


def _last_opened(rows: DataFrame) -> DataFrame:
    """Points with the interval in _in that is open at their _level; none at level 0."""
    before = Window.partitionBy("file", "_level").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_in", F.last("_in", ignorenulls=True).over(before)).filter("_k = 1").drop("_at", "_k", "_level")


def nested(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """What within() gives, for intervals of trees: one point stands once for each interval around it, and nothing else is made."""
    rows = _stack(points, intervals).filter("_level > 0")
    levels = F.when(F.col("_k") == 0, F.array("_level")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("_level")))
    pairs = _last_opened(rows.withColumn("_level", F.explode(levels)))
    return pairs.select(*points.columns, *[F.col(f"_in.{c}").alias(f"in_{c}") for c in intervals.columns if c != "file"])


def innermost(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (file, enter, ...) with the innermost interval of a tree that holds each, or none: in_enter and in_leave."""
    found = _last_opened(_stack(points, intervals.select("file", "enter", "leave")))
    return found.select(*points.columns, F.col("_in.enter").alias("in_enter"), F.col("_in.leave").alias("in_leave"))


def _below(nodes: DataFrame, roots: DataFrame, barriers: DataFrame | None) -> DataFrame:
    """nodes with the root (in_root, in_enter) of each walk that visits them, see walk()."""
    tops = roots.select("file", "enter", "leave", F.col("node_id").alias("root"))
    if barriers is None:
        return nested(nodes, tops)
    below = barriers.select("file", (F.col("enter") + 1).alias("enter"), "leave").filter("enter <= leave")
    behind = innermost(nodes, below).withColumnRenamed("in_enter", "_behind").drop("in_leave")
    return nested(behind, tops).filter(F.col("_behind").isNull() | (F.col("_behind") <= F.col("in_enter")))


def walk(nodes: DataFrame, roots: DataFrame, *, barriers: DataFrame | None = None) -> DataFrame:
    """(root, place, node columns): the nodes below each root (file, enter, leave, node_id), itself included, in preorder.

    `barriers` (file, enter, leave) end the walk: they are visited, what lies
    below them is not, unless the root lies below the same barrier itself.
    `place` numbers the nodes of a walk from 0.
    """
    place = F.row_number().over(Window.partitionBy("file", "in_enter").orderBy("enter")) - 1
    return _below(nodes, roots, barriers).select(F.col("in_root").alias("root"), place.alias("place"), *[F.col(c) for c in nodes.columns])


def subjects_in_order(nodes: DataFrame, roots: DataFrame, subjects: DataFrame, *, barriers: DataFrame | None = None) -> DataFrame:
    """(root, place, node_id): subjects (node_id) below each root in source order, each once.

    Subjects that have file and enter are taken as they are, others are looked up among
    the nodes; nothing else is dealt out, since places follow from labels.
    """
    columns = ["file", "enter", "node_id"]
    points = subjects if set(columns) <= set(subjects.columns) else nodes.join(subjects.select("node_id").distinct(), "node_id", "left_semi")
    found = _below(points.select(*columns), roots, barriers).select(F.col("in_root").alias("root"), "node_id", "enter").repartition("root")
    first = found.groupBy("root", "node_id").agg(F.min("enter").alias("_at"))
    return first.select("root", (F.row_number().over(Window.partitionBy("root").orderBy("_at")) - 1).alias("place"), "node_id")


def population(nodes: DataFrame, declarations: DataFrame) -> DataFrame:
    """The nodes at or below a declaration (file, enter, leave) in scope, each once."""
    spans = declarations.select("file", "enter", F.col("leave").alias("_reach"), F.lit(0).alias("_k"))
    rows = nodes.withColumn("_k", F.lit(1)).unionByName(spans, allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("enter", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_reach", F.max("_reach").over(before)).filter("_k = 1 and _reach >= enter").select(*nodes.columns)


def _own_text(c: str) -> Column:
    """The JSON of a node without the brace that closes it: its own fields, then its attributes."""
    fields = F.to_json(F.struct(F.when(F.col("node_id") > -100, F.col("node_id")).alias("id"), F.col("kind").alias("nodeType"), F.col("name").alias("name"), F.col("src").alias("src"), F.col("refers_to").alias("referencedDeclaration")))
    return F.concat(F.regexp_replace(fields, r"\}$", ""), F.when(F.col(c) == "{}", "").otherwise(F.concat(F.lit(","), F.regexp_replace(F.regexp_replace(c, r"^\{", ""), r"\}$", ""))))


def reassemble(nodes: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(file, node_id, json): the JSON tree of every file's root and, given `topics` (file, enter), of each topic.

    A topic inside another's tree stands there as the stub {"stub": id}; its own
    tree has the rest. Each node writes what opens it at `enter` and what closes
    it at `leave`; the pieces of a tree sorted by place (inner ends first) are its
    text, so there is one shuffle and no round for each level. Without topics this
    undoes flatten(), up to the order of keys.
    """
    columns = ["file", "enter", "leave", "node_id"]
    if topics is None:
        held = nodes.withColumns({"_tree": F.lit(0), "_top": F.col("up").isNull()})
        stubs = None
    else:
        named = topics if set(columns) <= set(topics.columns) else nodes.join(topics.select("file", "enter"), ["file", "enter"], "left_semi")
        spans = nodes.filter("up is null").select(*columns).unionByName(named.select(*columns)).distinct()
        held = innermost(nodes, spans).withColumns({"_tree": F.col("in_enter"), "_top": F.col("in_enter") == F.col("enter")})
        strict = spans.select("file", (F.col("enter") + 1).alias("enter"), "leave").filter("enter <= leave")
        stubs = innermost(held.filter("_top").select("file", "enter", "node_id", "before", "after"), strict).filter("in_enter is not null")
    whole = lambda c: F.when(F.col("_top"), "").otherwise(F.col(c))
    piece = lambda p, q, r, t: F.struct(p.alias("p"), F.lit(q).alias("q"), r.alias("r"), t.alias("t"))
    # order of pieces: by place; openings before endings, and of endings at one place the later opened first
    opens = piece(F.col("enter"), 0, F.lit(0), F.concat(whole("before"), _own_text("attrs")))
    closes = piece(F.col("leave"), 1, -F.col("enter"), F.concat(F.lit("}"), whole("after")))
    pieces = held.select("file", "_tree", F.when(F.col("_top"), F.col("node_id")).alias("node_id"), F.explode(F.array(opens, closes)).alias("_t"))
    if stubs is not None:
        text = F.concat("before", F.lit('{"stub":'), F.col("node_id").cast("string"), F.lit("}"), "after")
        pieces = pieces.unionByName(stubs.select("file", (F.col("in_enter") - 1).alias("_tree"), F.lit(None).cast("long").alias("node_id"), piece(F.col("enter"), 0, F.lit(0), text).alias("_t")))
    parts = pieces.groupBy("file", "_tree").agg(F.max("node_id").alias("node_id"), F.array_sort(F.collect_list("_t")).alias("_t"))
    return parts.select("file", "node_id", F.array_join(F.transform("_t", lambda x: x["t"]), "").alias("json"))
