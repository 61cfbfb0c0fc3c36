"""Typed weighted graphs: edges, personalized PageRank, closure, components, layers and batches.

Edges are rows (src, dst, kind, w). Loops over rounds cut their plan by a
written table each round. Where a graph's counted edges fit a task, tasks take
blocks of columns (seed sets, targets) with a copy of the edges each, or weakly
connected parts of the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from strataloom.functions.tables import BATCH_SIZE, DAMPING, EDGE_KINDS, ROUNDS
from strataloom.sources.shared import write_out

#: Above this many edges PageRank runs as joins.
ARRAY_EDGES = 4_000_000
#: Columns (seed sets or targets) of a block at most, and numbers in its matrix of nodes by columns.
BLOCK_COLUMNS, BLOCK_CELLS = 64, 16 << 20
#: Edges (and entries) of a weakly connected part that one task solves.
PART_EDGES = 2_000_000
#: Rows of small parts that are dealt to one task, about.
DEAL_ROWS = 500_000
#: Numbers that one step holds at once beside its matrices.
CELLS = 1 << 18
#: Nodes of a piece of a rank vector, and numbers of a vector at most (one set at least).
NODES, VECTOR_CELLS = 1 << 16, 1 << 25

Extractor = Callable[[dict[str, DataFrame]], DataFrame]


def edge_kinds(spark) -> DataFrame:
    """(kind, ord, w, both): the fixed kinds."""
    return spark.createDataFrame([(k, i, w, both) for i, (k, w, both) in enumerate(EDGE_KINDS)], "kind string, ord int, w double, both boolean")


def edges_of(pairs: DataFrame, kind: str) -> DataFrame:
    """(src, dst, kind, w) of pairs(src, dst), each once, mirrored if the kind goes both ways; no null ends."""
    w, both = next((w, both) for k, w, both in EDGE_KINDS if k == kind)
    one = pairs.filter("src is not null and dst is not null")
    if both:  # each pair once whichever way it stands, then both ways
        one = one.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        there, back = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ba"))
        out = one.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))))
    else:
        out = one.select("src", "dst").distinct()
    return out.select("src", "dst", F.lit(kind).alias("kind"), F.lit(w).alias("w"))


def build(tables: dict[str, DataFrame], extractors: list[tuple[Callable[[dict], bool], Extractor]]) -> DataFrame:
    """The union of every extractor that applies."""
    return reduce(DataFrame.unionByName, [extract(tables) for applies, extract in extractors if applies(tables)])


def residual_references(references: DataFrame, typed: DataFrame) -> DataFrame:
    """Reference pairs (src, dst) that no typed pair covers, each once; both sides are grouped together, and typed pairs may repeat."""
    sides = references.select("src", "dst", F.lit(0).alias("typed")).unionByName(typed.filter("src is not null and dst is not null").select("src", "dst", F.lit(1).alias("typed")))
    return sides.groupBy("src", "dst").agg(F.max("typed").alias("typed")).filter("typed = 0").select("src", "dst")


def in_order(edges: DataFrame) -> DataFrame:
    """Edges by source, destination and kind number."""
    number = F.coalesce(*[F.when(F.col("kind") == k, i) for i, (k, _, _) in enumerate(EDGE_KINDS)])
    return edges.withColumn("ord", number).orderBy("src", "dst", "ord")


def nodes_of(edges: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct sources, destinations and the given (node) tables."""
    parts = [edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node")), *more]
    return reduce(DataFrame.union, parts).distinct()


def out_weights(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("out_w"))


def pagerank_arrays(src: np.ndarray, dst: np.ndarray, w: np.ndarray, seeds: dict, *, dtype=np.float64, damping: float = DAMPING, rounds: int = ROUNDS) -> dict:
    """Ranks of one seed set over arrays; with float32 sums run in ascending node order (restart, dangling, predecessors)."""
    nodes = sorted(set(src.tolist()) | set(dst.tolist()) | set(seeds))
    total = sum(seeds.values())
    if not nodes or total <= 0:
        return {n: dtype(0) for n in nodes}
    at = {n: i for i, n in enumerate(nodes)}
    s = np.array([at[x] for x in src.tolist()], np.int64)
    d = np.array([at[x] for x in dst.tolist()], np.int64)
    w = w.astype(dtype)
    order = np.lexsort((s, d))
    s, d, w = s[order], d[order], w[order]
    out = np.zeros(len(nodes), dtype)
    np.add.at(out, s, w)
    restart = np.zeros(len(nodes), dtype)
    for n, v in seeds.items():
        restart[at[n]] = dtype(v) / dtype(total)
    rank, loose = restart.copy(), out <= 0
    for _ in range(rounds):
        dangling = dtype(0)
        for x in rank[loose]:
            dangling += x
        new = (dtype(1) - dtype(damping)) * restart + dtype(damping) * dangling * restart
        np.add.at(new, d, dtype(damping) * rank[s] * w / out[s])
        rank = new.astype(dtype)
    return dict(zip(nodes, rank, strict=True))


def edge_flow(edges: DataFrame) -> DataFrame:
    """(src, dst, q): parallel edges summed, q the share of the source's outgoing weight."""
    flow = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return flow.join(flow.groupBy("src").agg(F.sum("w").alias("out_w")), "src").select("src", "dst", (F.col("w") / F.col("out_w")).alias("q"))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)


class _Arrays:
    """One block's graph as arrays: names of the nodes, and rows of edges sorted by where they add up."""

    def __init__(self, edges: pa.Table, more: pa.ChunkedArray, *, back: bool):
        coded = _one(pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks, *more.chunks], more.type)).dictionary_encode()
        self.names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        n = edges.num_rows
        src, dst, w = code[:n], code[n : 2 * n], edges["w"].to_numpy()
        self.more, self.size = code[2 * n :], len(self.names)
        self.loose = np.ones(self.size, bool)
        self.loose[src] = False
        q = w / np.bincount(src, w, self.size)[src] if n else w
        to, frm = (src, dst) if back else (dst, src)
        order = np.argsort(to, kind="stable")
        self.frm, self.q = frm[order], q[order]
        self.to, self.first = np.unique(to[order], return_index=True)

    def step(self, x: np.ndarray) -> np.ndarray:
        """The damped sum over the edges of the rows of x (nodes by columns)."""
        out = np.zeros_like(x)
        if not len(self.frm):
            return out
        rows = max(1, CELLS // x.shape[1])
        for a in range(0, len(self.frm), rows):
            b = min(len(self.frm), a + rows)
            i, j = int(np.searchsorted(self.first, a, side="right")) - 1, int(np.searchsorted(self.first, b))
            out[self.to[i:j]] += np.add.reduceat(x[self.frm[a:b]] * (DAMPING * self.q[a:b, None]), np.maximum(self.first[i:j], a) - a, axis=0)
        return out


def _by_block(edges: DataFrame, rows: DataFrame, blocks: int) -> PandasCogroupedOps:
    """A copy of the edges for each block of columns, beside the block's rows; as many tasks as blocks, which are not merged."""
    copies = edges.select("src", "dst", "w").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return copies.repartition(2 * blocks, "_block").groupBy("_block").cogroup(rows.repartition(2 * blocks, "_block").groupBy("_block"))


def _blocks_of(columns: int, edges: int) -> int:
    """The number of blocks of columns: a block's matrix of nodes by columns stays near BLOCK_CELLS, taking as many nodes as edges."""
    return -(-columns // max(1, min(BLOCK_COLUMNS, BLOCK_CELLS // max(1, edges)))) or 1


def _rank_by_blocks(edges: DataFrame, n_edges: int, seeds: DataFrame, by: str, every: bool) -> DataFrame:
    sets = seeds.groupBy(by).agg(F.sum("weight").alias("total"))
    blocks = _blocks_of(sets.count(), n_edges)
    rows = seeds.groupBy(by, "node").agg(F.sum("weight").alias("weight")).join(sets, by).select(F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int").alias("_block"), F.col(by).alias("_by"), "node", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("r"))
    out = StructType([StructField("_by", seeds.schema[by].dataType), StructField("node", seeds.schema["node"].dataType), StructField("rank", DoubleType())])
    by_type = to_arrow_type(seeds.schema[by].dataType)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return to_arrow_schema(out).empty_table()
        g = _Arrays(left, right["node"], back=False)
        keys = _one(right["_by"]).dictionary_encode()
        column = keys.indices.to_numpy(zero_copy_only=False)
        restart = np.zeros((g.size, len(keys.dictionary)))
        np.add.at(restart, (g.more, column), right["r"].to_numpy())
        rank = restart.copy()
        for _ in range(ROUNDS):
            rank = g.step(rank) + (1 - DAMPING + DAMPING * rank[g.loose].sum(axis=0)) * restart
        at, k = np.nonzero(np.ones_like(rank) if every else rank + restart)
        return pa.table({"_by": keys.dictionary.take(pa.array(k)).cast(by_type), "node": g.names.take(pa.array(at)), "rank": rank[at, k]})

    return _by_block(edges, rows, blocks).applyInArrow(run, out).withColumnRenamed("_by", by)


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes + id: 0, 1, 2, ... without gaps; written."""
    rows = write_out(nodes.withColumn("_m", F.monotonically_increasing_id()), "nodes")
    part = F.shiftright("_m", 33)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).agg(F.count("*")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = rows.sparkSession.createDataFrame([(k, int(start)) for (k, _), start in zip(sizes, starts, strict=False)] or [(0, 0)], "_p long, _o long")
    return write_out(rows.join(F.broadcast(offsets), part == F.col("_p")).withColumn("id", F.col("_o") + F.col("_m") - F.shiftleft(F.col("_p"), 33)).drop("_m", "_p", "_o"), "numbered")


def _local(files: list[str]) -> pds.Dataset:
    return pds.dataset([f.removeprefix("file://") for f in files], format="parquet")


def _vector(files: list[str], group: int, size: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, mass at nodes without a way out) of a group's columns, from the pieces that a round has written."""
    ranks, lost = np.zeros((columns, size)), np.zeros(columns)
    for batch in _local(files).to_batches(columns=["block", "c", "at", "x", "lost"], filter=pds.field("group") == group, batch_size=16):
        for block, c, at, x, gone in zip(batch["block"].to_pylist(), batch["c"].to_pylist(), batch["at"], batch["x"], batch["lost"].to_pylist(), strict=True):
            x = np.frombuffer(x.as_buffer())
            piece = ranks[c, block * NODES : (block + 1) * NODES]
            piece[np.frombuffer(at.as_buffer(), np.int32) if at.is_valid else slice(None)] = x
            lost[c] += gone
    return ranks, lost


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]


def _packed(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """One row for a block of nodes: where sums of edges begin, sources and shares of the edges, nodes without a way out."""
    base = nodes["block"][0].as_py() * NODES
    loose = np.zeros(nodes.num_rows, bool)
    loose[nodes["id"].to_numpy() - base] = nodes["loose"].to_numpy()
    dst = edges["d"].to_numpy() - base
    order = np.argsort(dst, kind="stable")
    to, first = np.unique(dst[order], return_index=True)
    return pa.table([pa.array([base // NODES], pa.int64()), *_bytes(to.astype(np.int64), first.astype(np.int64), edges["s"].to_numpy()[order], edges["q"].to_numpy()[order], loose)], names=_PACKED)


_PACKED = ["block", "to", "first", "frm", "q", "loose"]


def _rank_by_vectors(edges: DataFrame, seeds: DataFrame, by: str, every: bool) -> DataFrame:
    """Each round's ranks are written as vectors in pieces of NODES nodes; a task reads those of its seed sets and sums the edges into its share of the pieces.

    Edges are numbered, packed by the block of their destination and then stay
    where they are: no row is shuffled in a round, and what a round writes is its
    ranks that are not 0. Seed sets form groups whose vectors have about VECTOR_CELLS
    numbers; all groups are one job a round, of about two tasks a core.
    """
    spark = edges.sparkSession
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("out_w"))
    numbered = _numbered(nodes_of(edges, seeds.select("node")).join(out, "node", "left"))
    size = numbered.count()
    sets = _numbered(seeds.select(by).distinct()).withColumnRenamed("id", "_set")
    n_sets = sets.count()
    count, width = -(-size // NODES) or 1, max(1, VECTOR_CELLS // max(1, size))
    groups = -(-n_sets // width) or 1
    shares = min(count, -(-2 * spark.sparkContext.defaultParallelism // groups))
    at = numbered.select("node", "id", "out_w")
    links = edges.join(at.select(F.col("node").alias("src"), F.col("id").alias("s"), "out_w"), "src").select("dst", "s", (F.col("w") / F.col("out_w")).alias("q")).join(at.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst").select(F.floor(F.col("d") / NODES).alias("block"), "d", "s", "q")
    blocks = at.select(F.floor(F.col("id") / NODES).alias("block"), "id", F.coalesce(F.col("out_w") <= 0, F.lit(True)).alias("loose"))
    packed = blocks.repartition(count, "block").groupBy("block").cogroup(links.repartition(count, "block").groupBy("block")).applyInArrow(_packed, "block long, to binary, first binary, frm binary, q binary, loose binary")
    share = F.pmod("block", F.lit(shares)).cast("int")
    packed = write_out(packed.withColumn("share", share).repartitionById(shares, "share"), "packed")
    total = F.sum("weight").over(Window.partitionBy(by))
    given = seeds.groupBy(by, "node").agg(F.sum("weight").alias("weight")).withColumn("r", F.when(total > 0, F.col("weight") / total).otherwise(0.0))
    placed = given.join(sets, by).join(at.select("node", "id"), "node").select(F.floor(F.col("_set") / width).alias("group"), (F.col("_set") % width).cast("int").alias("c"), F.floor(F.col("id") / NODES).alias("block"), (F.col("id") % NODES).cast("int").alias("i"), "r")
    restart = write_out(placed.withColumn("share", share).repartition(min(shares, 8), "share"), "restart")
    tasks, last = spark.range(0, groups * shares, 1, groups * shares), None
    for k in range(ROUNDS + 1):
        step = _round(packed.inputFiles(), restart.inputFiles(), last and last.inputFiles(), size, width, n_sets, shares, every, k == ROUNDS)
        last = write_out(tasks.mapInArrow(step, "group long, block long, c int, at binary, x binary, lost double"), "ranks")
    whole = last.select("group", "block", "c", "at", "x").mapInArrow(_ranks(width), "_set long, id long, rank double")
    return whole.join(at.select("node", "id"), "id").join(F.broadcast(sets) if n_sets <= 100_000 else sets, "_set").select(by, "node", "rank")


def _summed(x: np.ndarray, ranks: np.ndarray, live: np.ndarray, to: np.ndarray, first: np.ndarray, frm: np.ndarray, q: np.ndarray) -> None:
    """Adds to x (columns by nodes) the damped sums over the edges; those from nodes without a rank (not live) are passed over where they are many."""
    on = np.flatnonzero(live[frm])
    if 2 * len(on) < len(frm):
        cut = np.searchsorted(on, first)
        some = np.diff(np.append(cut, len(on))) > 0
        to, first, frm, q = to[some], cut[some], frm[on], q[on]
    for a in range(0, len(frm), CELLS):
        b = min(len(frm), a + CELLS)
        u, v = int(np.searchsorted(first, a, side="right")) - 1, int(np.searchsorted(first, b))
        at, part, starts = frm[a:b], DAMPING * q[a:b], np.maximum(first[u:v], a) - a
        for c in range(len(x)):
            x[c, to[u:v]] += np.add.reduceat(ranks[c].take(at) * part, starts)


def _round(packed: list[str], restart: list[str], last: list[str] | None, size: int, width: int, n_sets: int, shares: int, every: bool, final: bool) -> Callable:
    """One round for the numbers of tasks (group of sets and share of blocks); the restart itself where there is no round before. The final one keeps every seed, and all nodes if `every`."""
    names = ["group", "block", "c", "at", "x", "lost"]

    def pieces(group: int, share: int) -> Iterator[tuple]:
        columns = min(width, n_sets - group * width)
        seeds = _local(restart).to_table(filter=(pds.field("group") == group) & (pds.field("share") == share))
        blocks, i, c, r = (seeds[x].to_numpy() for x in ("block", "i", "c", "r"))
        if last is not None:
            ranks, lost = _vector(last, group, size, columns)
            live = ranks.any(axis=0)
        for batch in _local(packed).to_batches(columns=["block", *_PACKED[1:]], filter=pds.field("share") == share, batch_size=1):
            for k in range(batch.num_rows):
                view = lambda name, kind: np.frombuffer(batch[name][k].as_buffer(), kind)  # noqa: B023, E731
                block, loose = batch["block"][k].as_py(), view("loose", bool)
                x = np.zeros((columns, len(loose)))
                mine = np.flatnonzero(blocks == block)
                if last is None:
                    x[c[mine], i[mine]] = r[mine]
                else:
                    _summed(x, ranks, live, view("to", np.int64), view("first", np.int64), view("frm", np.int64), view("q", np.float64))
                    np.add.at(x, (c[mine], i[mine]), r[mine] * (1 - DAMPING + DAMPING * lost[c[mine]]))
                shown = x != 0
                if final:
                    shown[c[mine], i[mine]] = True
                for column in range(columns):
                    at = np.flatnonzero(shown[column])
                    if final and every or 2 * len(at) >= len(loose) and not final or len(at) == len(loose):
                        yield group, block, column, None, x[column].tobytes(), x[column, loose].sum()
                    elif len(at):
                        yield group, block, column, at.astype(np.int32).tobytes(), x[column, at].tobytes(), x[column, loose].sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for row in pieces(*divmod(k, shares)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=names)

    return run


def _ranks(width: int) -> Callable:
    """(_set, id, rank) of the pieces of the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, block, c, at, x in zip(*(batch.column(k) for k in range(5)), strict=True):
                x = np.frombuffer(x.as_buffer())
                i = np.frombuffer(at.as_buffer(), np.int32).astype(np.int64) if at.is_valid else np.arange(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), group.as_py() * width + c.as_py())), pa.array(i + block.as_py() * NODES), pa.array(x)], names=["_set", "id", "rank"])

    return run


def _rank_by_joins(flow: DataFrame, seeds: DataFrame, by: str) -> DataFrame:
    restart = seeds.groupBy(by, "node").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(by))
    restart = write_out(restart.withColumn("r", F.when(total > 0, F.col("weight") / total).otherwise(0.0)).select(by, "node", "r"), "restart")
    linked = flow.select(F.col("src").alias("node")).distinct()
    rank = restart.withColumnRenamed("r", "rank")
    for _ in range(ROUNDS):
        moved = rank.join(flow, rank["node"] == flow["src"]).groupBy(by, "dst").agg(F.sum(F.col("rank") * F.col("q")).alias("got")).withColumnRenamed("dst", "node")
        dangling = rank.join(linked, "node", "left_anti").groupBy(by).agg(F.sum("rank").alias("loose"))
        back = restart.join(dangling, by, "left").select(by, "node", (F.col("r") * (1 - DAMPING + DAMPING * F.coalesce("loose", F.lit(0.0)))).alias("got"))
        step = moved.select(by, "node", (F.col("got") * DAMPING).alias("got")).unionByName(back)
        rank = write_out(step.groupBy(by, "node").agg(F.sum("got").alias("rank")), "rank")
    return rank


def pagerank(edges: DataFrame, seeds: DataFrame, *, by: str = "seed_set", every: bool = False, written: bool = False) -> DataFrame:
    """(by, node, rank): 30 rounds at 0.85 for each seed set of seeds(by, node, weight); nodes that a set does not reach have no row, or 0 if `every`.

    Mass at nodes without outgoing weight returns through the seeds; a seed
    outside the graph has a rank; the seeds of a set whose weights sum to nothing
    have 0. Up to ARRAY_EDGES edges a task takes a block of seed sets and a copy
    of the edges, so that one pass of them serves all its sets; beyond that, and
    for up to BLOCK_COLUMNS sets, each round is a written vector and the edges stay
    packed by destination; for more sets the reached rows of all are joined with the
    edges each round. All give the same ranks. Edges that are `written` already are
    not written again.
    """
    edges = edges.select("src", "dst", "w") if written else write_out(edges.select("src", "dst", "w"), "edges")
    n = edges.count()
    if n <= ARRAY_EDGES:
        return _rank_by_blocks(edges, n, seeds, by, every)
    if seeds.select(by).distinct().count() <= BLOCK_COLUMNS:
        return _rank_by_vectors(edges, seeds, by, every)
    rank = _rank_by_joins(write_out(edge_flow(edges), "flow"), seeds, by)
    if not every:
        return rank
    zeros = nodes_of(edges).withColumn(by, F.explode(F.array(*[F.lit(r[0]) for r in seeds.select(by).distinct().collect()])))
    return zeros.join(rank, [by, "node"], "full").select(by, "node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def kernels(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, target, k, l) of pairs(seed, target): what a unit at the seed brings to the target, and to nodes without a way out, after 0 to 30 steps.

    The rank of a target is a sum over the steps of a set's seeds, so sets that
    share targets share the work: columns are targets, and one backward pass of the
    edges serves a block of them, however many sets ask (see set_ranks).
    """
    blocks = _blocks_of(pairs.select("target").distinct().count(), edges.count())
    rows = pairs.select(F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int").alias("_block"), "seed", "target").distinct()
    kind = pairs.schema["seed"].dataType
    numbers = ArrayType(DoubleType())
    out = StructType([StructField("seed", kind), StructField("target", kind), StructField("k", numbers), StructField("l", numbers)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return to_arrow_schema(out).empty_table()
        asked = pa.chunked_array([*right["seed"].chunks, *right["target"].chunks], right["seed"].type)
        g = _Arrays(left, asked, back=True)
        m = right.num_rows
        seed, target = g.more[:m], g.more[m:]
        tops, column = np.unique(target, return_inverse=True)
        x = np.zeros((g.size, len(tops) + 1))
        x[tops, np.arange(len(tops))] = 1.0
        x[g.loose, -1] = 1.0
        steps, lost = np.empty((m, ROUNDS + 1)), np.empty((m, ROUNDS + 1))
        for j in range(ROUNDS + 1):
            steps[:, j], lost[:, j] = x[seed, column], x[seed, -1]
            if j < ROUNDS:
                x = g.step(x)
        bounds = pa.array(np.arange(0, (m + 1) * (ROUNDS + 1), ROUNDS + 1, dtype=np.int32))
        return pa.table({"seed": right["seed"], "target": right["target"], "k": pa.ListArray.from_arrays(bounds, pa.array(steps.ravel())), "l": pa.ListArray.from_arrays(bounds, pa.array(lost.ravel()))})

    return _by_block(edges, rows, blocks).applyInArrow(run, out)


def set_ranks(known: DataFrame, seeds: DataFrame, wanted: DataFrame, *, by: str) -> DataFrame:
    """(by, node, rank) of wanted(by, node), by the kernels (seed, target, k, l) of its pairs with seeds(by, node, weight)."""
    total = seeds.groupBy(by).agg(F.sum("weight").alias("_total"))
    rows = wanted.select(by, "node").distinct().join(seeds.select(by, F.col("node").alias("seed"), "weight").groupBy(by, "seed").agg(F.sum("weight").alias("weight")), by).join(total.filter("_total > 0"), by)
    terms = rows.join(known.withColumnRenamed("target", "node"), ["seed", "node"]).groupBy(by, "node").agg(F.collect_list(F.struct((F.col("weight") / F.col("_total")).alias("w"), "k", "l")).alias("t"))
    out = StructType([wanted.schema[by], wanted.schema["node"], StructField("rank", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(2)
            if not len(t):
                continue
            inner, bounds = t.flatten(), t.offsets.to_numpy()[:-1] - t.offsets.to_numpy()[0]
            w = inner.field("w").to_numpy()[:, None]
            u, lost = (np.add.reduceat(w * inner.field(x).flatten().to_numpy().reshape(-1, ROUNDS + 1), bounds, axis=0) for x in ("k", "l"))
            # rank after n steps: u[n] plus what came back at the seeds after i steps, u[n - i] times `back[i - 1]`
            back, rank = np.zeros((len(t), ROUNDS)), u[:, ROUNDS].copy()
            for i in range(ROUNDS):
                at_ends = lost[:, i] + (back[:, :i] * lost[:, i - 1 :: -1][:, :i]).sum(axis=1) if i else lost[:, 0]
                back[:, i] = 1 - DAMPING + DAMPING * at_ends
                rank += back[:, i] * u[:, ROUNDS - 1 - i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rank)], names=batch.schema.names[:2] + ["rank"])

    return terms.mapInArrow(run, out)


def top_contributions(edges: DataFrame, ranks: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(dst, src, kind, contribution, place): the k largest rank * w / out of each target, then source and kind; zeros go unless all are zero."""
    flow = edges.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").join(out_weights(edges), "src")
    out = flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src", "left").withColumn("contribution", F.round(F.coalesce("rank", F.lit(0.0)) * F.col("w") / F.col("out_w"), 9))
    place = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("contribution"), "src", "kind"))
    return out.withColumn("place", place).filter((F.col("place") <= k) & ((F.col("contribution") > 0) | (F.col("place") == 1))).select("dst", "src", "kind", "contribution", "place")


def reach(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node): all nodes that each seed (root, node) reaches over pairs(src, dst), itself included.

    Semi-naive rounds: only new rows are joined, and found rows are kept as
    written tables.
    """
    pairs = write_out(pairs.select("src", "dst").distinct(), "pairs")
    new = write_out(seeds.select("root", "node").distinct(), "reach")
    found = [new]
    while True:
        seen = reduce(DataFrame.union, found)
        step = new.join(pairs, new["node"] == pairs["src"]).select("root", F.col("dst").alias("node")).distinct()
        new = write_out(step.join(seen, ["root", "node"], "left_anti"), "reach")
        if new.limit(1).count() == 0:
            return seen
        found.append(new)
        if len(found) > 8:
            found = [write_out(reduce(DataFrame.union, found), "reach")]


def closure(pairs: DataFrame) -> DataFrame:
    """(src, dst): dst is reached from src by one step or more."""
    first = pairs.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    return reach(pairs, first).select(F.col("root").alias("src"), F.col("node").alias("dst"))


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one partition to stars: every node with the least of the part that these links alone connect."""
    tables = list(batches)
    if not tables:
        return
    links = pa.Table.from_batches(tables)
    names, (a, b) = _coded(links["u"], links["v"])
    place = np.empty(len(names), np.int64)
    order = pc.sort_indices(names).to_numpy()
    place[order] = np.arange(len(names))
    up = list(range(len(names)))
    for x, y in zip(place[a].tolist(), place[b].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # a parent is less than its children, so it is settled before them
        up[x] = up[up[x]]
    root = np.array(up)
    far = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(order[far])), names.take(pa.array(order[root[far]]))], names=["u", "v"])


def weak_components(pairs: DataFrame) -> DataFrame:
    """(node, part): the least node of the weakly connected part around each node of pairs(src, dst).

    Every partition first joins what its own links connect. Then star contraction:
    each round links every node to the least of its neighbours and itself, seen
    first from the larger, then from the smaller side, until all links are stars;
    rounds grow with the logarithm of the longest path.
    """
    kind = pairs.schema["src"].dataType.simpleString()
    links = pairs.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links, before = write_out(links.mapInArrow(_local_stars, f"u {kind}, v {kind}").distinct(), "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        several = links.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        chained = links.join(links.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if now == before or not several.unionByName(chained).head(1):  # stars: each node has one link, to a node that has none
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = write_out(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        links = write_out(small, "links")
    stars = links.groupBy("u").agg(F.min("v").alias("part")).withColumnRenamed("u", "node")
    return nodes_of(pairs).join(stars, "node", "left").select("node", F.coalesce("part", "node").alias("part"))


def weak_parts(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, part) of nodes and of the ends of pairs; written."""
    every = nodes_of(pairs, nodes.select("node")).join(weak_components(pairs), "node", "left")
    return write_out(every.select("node", F.coalesce("part", "node").alias("part")), "parts")


def _large(rows: DataFrame) -> DataFrame | None:
    """(part) of the parts with more than PART_EDGES rows, or None."""
    large = rows.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > PART_EDGES).select("part")
    return write_out(large, "large-parts") if large.head(1) else None


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """rows + _deal: parts dealt to tasks, many small ones to each; an answer for several parts at once is that of each."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism + total // DEAL_ROWS
    return rows.withColumn("_deal", F.pmod(F.xxhash64("part"), F.lit(tasks)))


def _condensed(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(component, layer) of each node 0..n-1: components are numbered as they close, so after all that they reach; the layer is the longest path from a source."""
    order = np.argsort(src, kind="stable")
    heads, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, comp = [0] * n, [0] * n, [-1] * n
    at, count, closed, stack = first[:n], 0, 0, []
    for start in range(n):
        if index[start]:
            continue
        path = [start]
        count += 1
        index[start] = low[start] = count
        stack.append(start)
        while path:
            v = path[-1]
            if at[v] < first[v + 1]:
                u = heads[at[v]]
                at[v] += 1
                if not index[u]:
                    count += 1
                    index[u] = low[u] = count
                    stack.append(u)
                    path.append(u)
                elif comp[u] < 0:
                    low[v] = min(low[v], index[u])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                while True:
                    u = stack.pop()
                    comp[u] = closed
                    if u == v:
                        break
                closed += 1
    component = np.array(comp, np.int64)
    a, b = component[src], component[dst]
    outer = a != b
    layer = [0] * closed
    links = sorted(set(zip((-a[outer]).tolist(), b[outer].tolist(), strict=True)))  # sources first: what closed last
    for x, y in links:
        layer[y] = max(layer[y], layer[-x] + 1)
    return component, np.array(layer, np.int64)[component] if n else component


def _coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """(distinct values, the places of each column's values among them)."""
    coded = _one(pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type)).dictionary_encode()
    cuts = np.cumsum([len(x) for x in columns])[:-1]
    return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts)


def condense(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component, layer): the least node of each strong component, and the longest path of components that ends at it.

    A strong component lies inside a weakly connected part, so parts of up to
    PART_EDGES edges are solved each in one task by one depth-first pass, linear in
    the edges. Larger parts are coloured: every node takes the least node that
    reaches it, and those that reach back to their colour's node inside the colour
    are its component; the others go on. No closure is written either way.
    """
    parts = weak_parts(pairs, nodes_of(pairs) if nodes is None else nodes)
    edges = write_out(pairs.select("src", "dst").distinct().join(parts.withColumnRenamed("node", "src"), "src").select("part", "src", "dst"), "part-edges")
    large = _large(edges)
    small = (lambda df: df) if large is None else (lambda df: df.join(large, "part", "left_anti"))
    out = StructType([StructField("node", parts.schema["node"].dataType), StructField("component", parts.schema["node"].dataType), StructField("layer", IntegerType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, (node, src, dst) = _coded(left["node"], right["src"], right["dst"])
        order = pc.sort_indices(names).to_numpy()
        comp, layer = _condensed(src, dst, len(names))
        least = np.full(int(comp.max(initial=-1)) + 1, -1)
        place = order[::-1]
        least[comp[place]] = place  # the least name of a component is written last
        return pa.table({"node": names.take(pa.array(node)), "component": names.take(pa.array(least[comp[node]])), "layer": pa.array(layer[node], pa.int32())})

    total = parts.count() + edges.count()
    done = _dealt(small(parts), total).groupBy("_deal").cogroup(_dealt(small(edges), total).groupBy("_deal")).applyInArrow(run, out)
    if large is None:
        return done
    wide = write_out(edges.join(large, "part", "left_semi").select("src", "dst"), "wide")
    comp = _coloured(wide, parts.join(large, "part", "left_semi").select("node"))
    return done.unionByName(comp.join(_layers(wide, comp), "component").select("node", "component", "layer"))


def _coloured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) by forward-backward colouring; rounds grow with the longest shortest path."""
    left = write_out(nodes.select("node").distinct(), "left")
    links = write_out(pairs.filter("src != dst").distinct(), "links")
    found = []
    while left.head(1):
        colour = write_out(left.select("node", F.col("node").alias("c")), "colour")
        while True:  # the least colour that arrives
            came = links.join(colour, links["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
            step = write_out(colour.join(came, colour["node"] == came["dst"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "colour")
            colour = step.select("node", "c")
            if not step.filter("moved").head(1):
                break
        inside = links.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").filter("c = d").select("c", F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.filter("node = c").select(F.col("c").alias("root"), "node")
        members = write_out(reach(inside.select("src", "dst"), roots).join(colour, "node").filter("root = c").select("node", F.col("c").alias("component")), "members")
        found.append(members)
        left = write_out(left.join(members, "node", "left_anti"), "left")
        links = write_out(links.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), "links")
    return write_out(reduce(DataFrame.unionByName, found), "components") if found else left.select("node", F.col("node").alias("component"))


def _layers(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, layer) by rounds: as many as the longest path has components."""
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("a")), comp.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    links = write_out(pairs.join(a, "src").join(b, "dst").filter("a != b").select("a", "b").distinct(), "condensed")
    level = write_out(comp.select("component").distinct().withColumn("layer", F.lit(0)), "layers")
    while True:
        up = links.join(level, links["a"] == level["component"]).groupBy("b").agg((F.max("layer") + 1).alias("up"))
        new = write_out(level.join(up, level["component"] == up["b"], "left").select("component", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer"), (F.coalesce("up", F.lit(0)) > F.col("layer")).alias("moved")), "layers")
        level = new.select("component", "layer")
        if not new.filter("moved").head(1):
            return level


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component): component is the least node that reaches it and is reached from it."""
    return condense(pairs).select("node", "component")


def layers(pairs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, layer): the longest path, in components, from one without predecessors."""
    if components is None:
        return condense(pairs).select("component", "layer").distinct()
    return _layers(pairs, write_out(components, "components"))


def fold_components(pairs: DataFrame, direct: DataFrame, *, lift: dict[str, Column], dedup: list[Column], parts: DataFrame | None = None) -> DataFrame:
    """(node, the columns of `lift`): what each node and all that it reaches over pairs(src, dst) have in `direct` (node, ...).

    `lift` makes an entry of a direct row, its columns by name (the origin is
    F.col("node")); entries that agree in `dedup`, expressions over the lifted
    columns, are one: the least of them, by all columns. Members of a strong
    component share one set, and edges inside it add nothing.

    Entries are numbered, and sets of numbers travel from callees to callers, each
    node's component once: in one pass for each weakly connected part of at most
    PART_EDGES edges and entries, by rounds of new (entry, node) rows for larger
    ones. What is written is edges and results, no closure.
    """
    lifted = direct.select("node", *[c.alias(k) for k, c in lift.items()])
    keys = [c.alias(f"_k{i}") for i, c in enumerate(dedup)]
    entries = lifted.select("node", F.struct(*[k for k in lift]).alias("e"), *keys)
    names = [f"_k{i}" for i in range(len(dedup))]
    # one number for each entry of a node; equal keys from different nodes are settled on the result
    local = entries.groupBy("node", *names).agg(F.min("e").alias("e"))
    local = write_out(local.select("node", "e", *names, F.monotonically_increasing_id().alias("n")), "entries")
    parts = weak_parts(pairs, local) if parts is None else parts
    kind = parts.schema["node"].dataType
    out = StructType([StructField("node", kind), StructField("n", LongType())])
    held = local.join(parts, "node").select("part", F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), "n")
    edges = pairs.select("src", "dst").distinct().join(parts.withColumnRenamed("node", "src"), "src").select("part", "src", "dst", F.lit(None).cast("long").alias("n"))
    rows = write_out(held.unionByName(edges), "part-rows")

    def fold(table: pa.Table) -> pa.Table:
        is_edge = pc.is_valid(table["dst"])
        batches = list(_folded(table.filter(pc.invert(is_edge)), table.filter(is_edge), to_arrow_schema(out)))
        return pa.Table.from_batches(batches, to_arrow_schema(out))

    large = _large(rows)
    small = rows if large is None else rows.join(large, "part", "left_anti")
    found = _dealt(small, rows.count()).groupBy("_deal").applyInArrow(fold, out)
    if large is not None:
        wide = write_out(rows.join(large, "part", "left_semi"), "wide")
        back = wide.filter("dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = found.unionByName(reach(back, wide.filter("dst is null").select(F.col("n").alias("root"), F.col("src").alias("node"))).select("node", F.col("root").alias("n")))
    result = found.join(local.select("n", "e", *names), "n").groupBy("node", *names).agg(F.min("e").alias("e"))
    return result.select("node", "e.*")


def _folded(entries: pa.Table, edges: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(node, n) of one part: sets of entry numbers from callees to callers; a component's set goes when its last caller has it."""
    names, (owner, src, dst) = _coded(entries["src"], edges["src"], edges["dst"])
    comp, _ = _condensed(src, dst, len(names))
    count = int(comp.max(initial=-1)) + 1
    a, b = comp[src], comp[dst]
    outer = a != b
    links = np.unique(np.stack([a[outer], b[outer]]), axis=1) if outer.any() else np.zeros((2, 0), np.int64)
    first = np.searchsorted(links[0], np.arange(count + 1))
    waiting = np.bincount(links[1], minlength=count)
    order = np.argsort(comp[owner], kind="stable")
    own, numbers = np.searchsorted(comp[owner][order], np.arange(count + 1)), entries["n"].to_numpy()[order]
    member = np.argsort(comp, kind="stable")
    of = np.searchsorted(comp[member], np.arange(count + 1))
    sets: dict[int, np.ndarray] = {}
    kept_names, kept_n, size = [], [], 0
    for c in range(count):  # components close after all that they reach
        parts = [numbers[own[c] : own[c + 1]]]
        for callee in links[1][first[c] : first[c + 1]].tolist():
            parts.append(sets[callee])
            waiting[callee] -= 1
            if not waiting[callee]:
                del sets[callee]
        whole = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.unique(parts[0])
        if waiting[c]:
            sets[c] = whole
        if len(whole):
            who = member[of[c] : of[c + 1]]
            kept_names.append(np.repeat(who, len(whole)))
            kept_n.append(np.tile(whole, len(who)))
            size += len(kept_n[-1])
        if size > 1 << 20 or c == count - 1 and size:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(kept_names))), pa.array(np.concatenate(kept_n))], schema=schema)
            kept_names, kept_n, size = [], [], 0


def tarjan(nodes: list, succ: dict) -> list[list]:
    """Strong components in the order in which they close, nodes and successors visited ascending; no recursion."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in nodes:
        if start in index:
            continue
        work = [(start, iter(succ.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for u in it:
                if u not in index:
                    index[u] = low[u] = len(index)
                    stack.append(u)
                    on.add(u)
                    work.append((u, iter(succ.get(u, ()))))
                    break
                if u in on:
                    low[v] = min(low[v], index[u])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        u = stack.pop()
                        on.discard(u)
                        part.append(u)
                        if u == v:
                            break
                    out.append(sorted(part))
    return out


def greedy_batches(groups: list[list], shared: dict, limit: int = BATCH_SIZE) -> list[list]:
    """Groups of one layer packed into batches of at most `limit` members; each batch grows by the group that shares most callees with it, the first of equal ones.

    An index from callee to groups keeps the shared numbers of a growing batch, so
    only groups that share something are looked at.
    """
    wants = [set().union(*(shared.get(m, set()) for m in g)) for g in groups]
    users: dict = {}
    for k, want in enumerate(wants):
        for callee in want:
            users.setdefault(callee, []).append(k)
    used, out = [False] * len(groups), []
    for first in range(len(groups)):
        if used[first]:
            continue
        members, callees, common, k = [], set(), {}, first
        while True:
            used[k] = True
            common.pop(k, None)
            members += groups[k]
            for callee in wants[k] - callees:
                callees.add(callee)
                users[callee] = [j for j in users[callee] if not used[j]]
                for j in users[callee]:
                    common[j] = common.get(j, 0) + 1
            fits = [(-n, j) for j, n in common.items() if len(members) + len(groups[j]) <= limit]
            if len(members) >= limit or not fits:
                break
            k = min(fits)[1]
        out.append(members)
    lone = [b for b in out if len(b) == 1 and not shared.get(b[0])]
    rest = [b for b in out if not (len(b) == 1 and not shared.get(b[0]))]
    flat = [m for b in lone for m in b]
    return rest + [flat[i : i + limit] for i in range(0, len(flat), limit)]


def call_batches(calls: DataFrame, members: DataFrame, *, by: str) -> DataFrame:
    """(by, layer, batch, member): components by layer, packed by shared callees; one group of `by` (an audit) is one task.

    calls(by, callee, caller); members(by, member). The packing is greedy and
    so sequential inside an audit; audits run side by side.
    """
    kind = members.schema["member"].dataType.simpleString()
    by_kind = members.schema[by].dataType.simpleString()

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        everyone = sorted(nodes.member.tolist())
        succ: dict = {}
        callees: dict = {}
        for callee, caller in sorted(set(zip(links.callee, links.caller, strict=True))):
            if callee != caller:
                succ.setdefault(callee, []).append(caller)
                callees.setdefault(caller, set()).add(callee)
        known = set(everyone)
        parts = tarjan(everyone, {k: [x for x in v if x in known] for k, v in succ.items() if k in known})
        of = {m: i for i, p in enumerate(parts) for m in p}
        layer = dict.fromkeys(range(len(parts)), 0)
        for i in range(len(parts) - 1, -1, -1):  # components close after their successors
            for m in parts[i]:
                for caller in succ.get(m, ()):
                    if of.get(caller, i) != i:
                        layer[of[caller]] = max(layer[of[caller]], layer[i] + 1)
        rows = []
        for depth in sorted(set(layer.values())):
            for b, batch in enumerate(greedy_batches([parts[i] for i in range(len(parts)) if layer[i] == depth], callees)):
                rows += [(key[0], depth, b, m) for m in batch]
        return pd.DataFrame(rows, columns=[by, "layer", "batch", "member"])

    return members.groupBy(by).cogroup(calls.groupBy(by)).applyInPandas(run, f"{by} {by_kind}, layer int, batch int, member {kind}")


def follow_chain(topics: DataFrame) -> DataFrame:
    """(topic, target): the end of each chain of `next`, by pointer jumping until no row changes; a walk into a cycle ends where it enters it.

    After more jumps than there are topics the rows that still move run in
    cycles. The topics they stand on then are just those of the cycles.
    """
    start = write_out(topics.select("topic", F.coalesce("next", "topic").alias("target")), "chain")
    at, hops, n = start, 1, start.count()
    while True:
        hop = at.select(F.col("topic").alias("target"), F.col("target").alias("further"))
        step = write_out(at.join(hop, "target", "left").select("topic", F.coalesce("further", "target").alias("further"), "target"), "chain")
        if step.filter("further != target").limit(1).count() == 0:
            return at
        if hops > n:
            break
        at, hops = step.select("topic", F.col("further").alias("target")), 2 * hops
    ring = write_out(at.select(F.col("target").alias("topic")).distinct(), "ring")  # chain ends and topics of cycles
    cut = start.join(ring.withColumn("_stop", F.lit(True)), "topic", "left").select("topic", F.when(F.col("_stop"), F.col("topic")).otherwise(F.col("target")).alias("next"))
    return follow_chain(cut)
