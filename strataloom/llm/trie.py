r"""The prefix trie of conversations by partition refinement.

Method. Equal conversations are one representative (the smallest id) with a
number of copies. All representatives start in one class. Each round splits every
active class by its next turn: one aggregation counts the new classes, one join
tells the members theirs. A class with one representative retires: the rest of
its conversation is a chain of nodes with one child each, written without further
rounds. A representative that ends inside a class ends at that class's node.
There are as many rounds as turns that two different conversations share. At the
end the inner nodes are folded back from the deepest round to the root, each
parent summing its children's leaves and savings.

A class is named by its smallest member, so (member, depth) names a node. Turns
are compared by the SHA-256 of role and text, with the role's length in front.
The ids that end at a node may be many (copies of one conversation): sorted pieces
of them are joined wherever they lie, and one stream over the pieces of a node
makes the digest, so no task holds more than a piece.

Cases: turns are ordered by their order value (null first), then by role and
digest; a null role or text is empty; repeated rows are turns of their own; rows
without conversation id are left out; an id given without turns ends at the root;
an empty table gives an empty trie; other columns are ignored. A conversation's
digests are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.session import materialize, tidy

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: The digest of a node at which no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids in one piece of a list of ends.
PIECE = 4096


def sequences(turns: DataFrame, *, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns array<struct<digest, chars>>): each conversation's turns in order, texts as digest and number of code points."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(order_col).alias("o"), role.alias("r"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    packed = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return packed.select("conv", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (whole, conv) rows to (whole, first, ids): comma-joined ids of at most PIECE conversations."""
    for batch in batches:
        out = []
        for whole, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda r: r[0]):
            ids = [r[1] for r in rows]
            out += [(whole, ids[i], ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["whole", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (whole, ends_sha256); a node's pieces may run over many batches."""
    at, running = None, None
    for batch in batches:
        done = []
        for whole, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if running is not None and whole == at:
                running.update(b",")
            else:
                if running is not None:
                    done.append((at, running.hexdigest()))
                at, running = whole, hashlib.sha256()
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["whole", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["whole", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(whole, ends_sha256) of members (whole, conv): SHA-256 of the ids of each `whole`, ascending, joined by commas."""
    dealt = members.select("whole", "conv").repartitionByRange("whole", "conv").sortWithinPartitions("whole", "conv")
    pieces = dealt.mapInArrow(tidy(_pieces), "whole binary, first long, ids string")
    return pieces.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(tidy(_digests), "whole binary, ends_sha256 string")


def _refine(reps: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(inner nodes of each depth, retired representatives, ended representatives)."""
    root = reps.agg(F.min("rep").alias("node"), F.count("*").alias("n_reps"), F.sum("copies").alias("n_convs")).filter("n_reps > 0")
    levels = [materialize(root.select("node", F.lit(None).cast("long").alias("parent"), "n_reps", "n_convs", F.lit(0).cast("long").alias("chars")), "trie-level")]
    first = levels[0].select("node", "n_reps").first()
    start = reps.select("rep", "copies", "whole", "turns", F.lit(first and first.node).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(first.n_reps if first else 0).cast("long").alias("n_reps"))
    split, depth = start, 0
    retired, ended = [], []
    while True:
        retired.append(split.filter("n_reps = 1").select("rep", "copies", "whole", "turns", "parent", F.lit(depth).cast("long").alias("top")))
        active = split.filter("n_reps > 1").select("rep", "copies", "whole", "turns", F.col("node").alias("parent"))
        levels[-1] = levels[-1].filter("n_reps > 1")
        if not levels[-1].head(1):
            return levels[:-1], _union(retired), _union(ended)
        ended.append(active.filter(F.size("turns") == depth).select("whole", "copies", "rep", F.col("parent").alias("node"), F.lit(depth).cast("long").alias("depth")))
        going = active.filter(F.size("turns") > depth).withColumn("digest", F.element_at("turns", depth + 1)["digest"])
        parts = going.groupBy("parent", "digest").agg(F.min("rep").alias("node"), F.count("*").alias("n_reps"), F.sum("copies").alias("n_convs"), F.max(F.element_at("turns", depth + 1)["chars"]).alias("chars"))
        parts = materialize(parts, "trie-level")
        split = materialize(going.join(parts.select("parent", "digest", "node", "n_reps"), ["parent", "digest"]).select("rep", "copies", "whole", "turns", "node", "parent", "n_reps"), "trie-split")
        levels.append(parts.select("node", "parent", "n_reps", "n_convs", "chars"))
        depth += 1


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _chains(retired: DataFrame) -> DataFrame:
    """The nodes of retired representatives: one for each turn from their top on."""
    size = F.size("turns").cast("long")
    rows = retired.select("rep", "copies", "whole", "parent", "top", size.alias("n"), F.explode(F.sequence(F.col("top"), size)).alias("depth"), F.col("turns"))
    chars = F.when(F.col("depth") > 0, F.element_at("turns", F.greatest(F.col("depth"), F.lit(1)).cast("int"))["chars"]).otherwise(0)
    return rows.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("copies").alias("n_convs"),
        F.when(F.col("depth") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * chars).alias("own"), F.when(F.col("depth") == F.col("n"), F.col("whole")).alias("whole"),
    )


def trie_of(seqs: DataFrame) -> DataFrame:
    """The nodes (NODES) of the trie of sequences (conv, turns)."""
    seqs = materialize(seqs.withColumn("whole", F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").cast("binary"), 256))), "trie-sequences")
    groups = materialize(seqs.groupBy("whole").agg(F.min("conv").alias("rep"), F.count("*").alias("copies")), "trie-copies")
    reps = seqs.drop("whole").join(groups, seqs["conv"] == groups["rep"]).select("rep", "copies", "whole", "turns")
    levels, retired, ended = _refine(materialize(reps, "trie-reps"))
    many = ends(seqs.join(groups.filter("copies > 1").select("whole"), "whole", "left_semi"))

    alone = F.when(F.col("whole").isNotNull(), F.sha2(F.col("_end").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS))

    def with_ends(nodes: DataFrame) -> DataFrame:
        """ends_sha256 of the copies that end at a node; of one representative's own id where it has no copies."""
        return nodes.join(many, "whole", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", alone))

    # chains: savings are sums from a node to the end, which only copies have
    chains = _chains(retired).withColumn("_end", F.col("conv_id"))
    lone = chains.filter("n_convs = 1").withColumn("saved_tokens", F.lit(0).cast("long"))
    down = "sum(own) over (partition by conv_id order by depth desc rows unbounded preceding)"
    copied = materialize(chains.filter("n_convs > 1").withColumn("saved_tokens", F.expr(down)), "trie-chains")
    names = [c.split()[0] for c in NODES.split(", ")]
    out = lone.withColumn("ends_sha256", alone).select(names).unionByName(with_ends(copied).select(names))

    # inner nodes, from the deepest level back to the root; a chain's top is a child like any other
    totals = F.when(F.col("copies") > 1, (F.col("copies") - 1) * F.aggregate(F.slice("turns", F.greatest(F.col("top"), F.lit(1)).cast("int"), F.size("turns") + 1), F.lit(0).cast("long"), lambda a, t: a + t["chars"])).otherwise(0)
    tops = materialize(retired.filter("parent is not null").select("parent", "top", F.lit(1).cast("long").alias("n_leaves"), totals.cast("long").alias("saved_tokens")), "trie-tops")
    inner, children = [], None
    for depth in range(len(levels) - 1, -1, -1):
        below = tops.filter(F.col("top") == depth + 1).select("parent", "n_leaves", "saved_tokens")
        if children is not None:
            below = below.unionByName(children)
        sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")).withColumnRenamed("parent", "node")
        level = levels[depth].join(sums, "node").select("node", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", "n_children", "n_leaves", ((F.col("n_convs") - 1) * F.col("chars") + F.col("below")).alias("saved_tokens"))
        level = materialize(level, "trie-fold")
        inner.append(level)
        children = level.select("parent", "n_leaves", "saved_tokens")
    if inner:
        nodes = _union(inner).join(ended.select("node", "depth", "whole", F.col("rep").alias("_end")), ["node", "depth"], "left")
        out = out.unionByName(with_ends(nodes).select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *names[3:]))
    return out


def prefix_trie(turns: DataFrame, *, ids: DataFrame | None = None, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes (NODES) of the trie of conversations; `ids` (conv_col) adds conversations that may have no turns."""
    seqs = sequences(turns, conv_col=conv_col, order_col=order_col, role_col=role_col, text_col=text_col)
    if ids is not None:
        known = ids.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv")).distinct()
        empty = F.expr("cast(array() as array<struct<digest: binary, chars: bigint>>)")
        seqs = known.join(seqs, "conv", "left").select("conv", F.coalesce("turns", empty).alias("turns"))
    return trie_of(seqs)


def shared_heads(seqs: DataFrame, *, every: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of the conversation at the multiple of `every` below their id; h is the CRC-32 of the id's digits modulo `most`."""
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).cast("int")
    base = F.col("conv") - F.col("conv") % every
    heads = seqs.filter(F.col("conv") % every == 0).select(F.col("conv").alias("_base"), F.slice("turns", F.lit(1), F.lit(most - 1)).alias("_head"))
    joined = seqs.withColumn("_base", base).join(heads, "_base", "left")
    empty = F.expr("cast(array() as array<struct<digest: binary, chars: bigint>>)")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.size("turns"))).otherwise(empty)
    return joined.select("conv", F.concat(F.slice(F.coalesce("_head", empty), F.lit(1), h), own).alias("turns"))


TRIE_SQL = r"""
with tbl as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256))::bigint as i))),
ids as (select c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 as h from (select distinct conv_id as c from conversations where conv_id is not null), tbl),
turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null),
sizes as (select c, count(*) as n from turns group by c),
rebuilt as (
  select ids.c, k, r, t from ids join turns b on b.c = ids.c - ids.c % 100 and k <= h
  union all select ids.c, k - h + least(h, coalesce(n, 0)), r, t from ids join turns o on o.c = ids.c and k > h left join sizes on sizes.c = ids.c - ids.c % 100),
pre as (
  select c, k as d, string_agg(sha256(length(r)::varchar || ':' || r || t), '') over (partition by c order by k) as key, length(t) as chars from rebuilt
  union all select c, 0, '', 0 from ids),
nodes as (select d, key, min(c) as c, count(*) as n, max(chars) as chars from pre group by d, key),
kids as (select d - 1 as d, left(key, 64 * (d::int - 1)) as key, count(*) as n from nodes where d > 0 group by 1, 2),
subtree as (
  select p.d, p.key, count(*) filter (kids.n is null) as leaves, sum((x.n - 1) * x.chars) as saved
  from nodes x left join kids on kids.d = x.d and kids.key = x.key join pre p on p.c = x.c and p.d <= x.d group by 1, 2),
ends as (select d, key, sha256(string_agg(c::varchar, ',' order by c)) as hex from (select *, max(d) over (partition by c) as last from pre) where d = last group by 1, 2)
select nodes.c as conv_id, nodes.d::bigint as depth, up.c as parent_conv_id, nodes.n as n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, coalesce(hex, sha256('')) as ends_sha256
from nodes join subtree s on s.d = nodes.d and s.key = nodes.key left join kids on kids.d = nodes.d and kids.key = nodes.key
left join ends on ends.d = nodes.d and ends.key = nodes.key left join nodes up on up.d = nodes.d - 1 and up.key = left(nodes.key, greatest(64 * (nodes.d::int - 1), 0)) and nodes.d > 0
"""
