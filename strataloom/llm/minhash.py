"""Near-duplicate groups by circulant MinHash.

Method. A text's set of word shingles is mapped by a first permutation (a
mixed 64-bit hash folded onto 2**22 places) and one further permutation pi,
used circularly shifted: coordinate k of the signature is the least
pi[place - k] over the set. Two permutations thus give all coordinates, and
the coordinates of one shingle are a contiguous slice of pi. Bands of six
coordinates are bucketed; the number of bands follows from the threshold so
that a pair at the threshold is missed with a chance below 1e-8.

Linking. Equal sets are one class from the start. Buckets give star links
(no pairs within a bucket), their components are the candidate groups, and
inside each group *all* pairs are settled on full sets: intersection sizes are
matrix products over the shared shingles. A group too large for one task is
cut into blocks and each pair of blocks is one unit of work, so nothing is
capped and no task holds more than two blocks. Only a spanning forest of the
true links leaves a task.

Results are exact for every pair that meets in at least one bucket or
candidate group.

Cases: a null or empty text (or one without words) has an empty set, size 0,
and is its own component; a text shorter than a shingle is one shingle; rows
without id take part in groups but never name one (component_id null if
nobody else is there); repeated rows are in the same component and each is
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.components import connected_components
from strataloom.llm.session import HELD, materialize, small_enough, spread, tidy
from strataloom.llm.textkernel import mix, shingle_sets, slices, text_bytes, word_hashes, word_spans

PLACES = 1 << 22
ROWS_PER_BAND = 6
MISS_CHANCE = 1e-8
BROADCAST_ROWS = 1_000_000
#: A unit of exact work holds at most twice this many shingles or texts.
BLOCK_SHINGLES = 400_000
BLOCK_TEXTS = 1024

_PI: dict[int, np.ndarray] = {}
HELD.append(_PI)


def band_count(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS_CHANCE) -> int:
    """Bands needed so that a pair at the threshold shares no band with a chance of at most `miss`."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _shifted(width: int) -> np.ndarray:
    """Row p holds pi[p], pi[p-1], ... pi[p-width+1] circularly (reversed order, which is only a naming of coordinates)."""
    if width not in _PI:
        pi = np.random.default_rng(41).permutation(PLACES).astype(np.int32)
        _PI[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[-(width - 1) :], pi]), width)
    return _PI[width]


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """All coordinates of one non-empty set."""
    table = _shifted(width)
    places = (mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(PLACES - 1)).astype(np.int64)
    out = None
    for i in range(0, len(places), 4096):
        low = table[places[i : i + 4096]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One 64-bit bucket key for each text and band."""
    n, width = signatures.shape
    parts = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        key = mix(key + parts[:, :, k] + np.uint64(k + 1))
    return mix(key + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, 1 << 20):
        part = data[offsets[i] : offsets[j]]
        starts, ends, bounds = word_spans(part, offsets[i : j + 1] - offsets[i])
        yield i, j, *shingle_sets(word_hashes(part, starts, ends), bounds, size)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(size: int, bands: int):
    width = bands * ROWS_PER_BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, flat, offsets in _sets(batch.column(1), size):
                sizes = np.diff(offsets)
                sets = [flat[offsets[k] : offsets[k + 1]] for k in range(j - i)]
                full = [s for s in sets if len(s)]
                keys = band_keys(np.stack([signature(s, width) for s in full])).ravel() if full else np.zeros(0, np.int64)
                places = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(places), pa.array(keys))],
                    names=["id", "n_shingles", "digest", "bands"],
                )

    return run


def _wanted_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, flat, offsets in _sets(batch.column(0), size):
                sets = [s for k in range(j - i) if len(s := flat[offsets[k] : offsets[k + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by matrix products over the shingles that at least two sets hold."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.empty(len(flat), bool)
    first[:1] = True
    np.not_equal(flat[1:], flat[:-1], out=first[1:])
    number = np.cumsum(first) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)
    total = int(shared.sum())
    step = min(max(1, total), max(64, (1 << 23) // n))
    for at in range(0, total, step):
        a, b = np.searchsorted(number, [at, at + step])
        m = np.zeros((n, step), np.float32)
        m[owner[a:b], number[a:b] - at] = 1
        out += m @ m.T
    return out


def linked_roots(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the least index that it reaches by links with den * intersection >= num * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    inter = _overlaps(sets).astype(np.float64)
    link = den * inter >= num * (sizes[:, None] + sizes[None, :] - inter)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                near = link[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(near)
                root[front] = i
    return root


def _settle(num: int, den: int):
    """Input sorted by unit: (unit, digest, shingles). Output: (unit, digest, root)."""

    def close(unit: str, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        rows.sort()
        root = linked_roots([np.frombuffer(s, np.uint64) for _, s in rows], num, den)
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(rows), pa.string()), pa.array([d for d, _ in rows], pa.binary()), pa.array([rows[r][0] for r in root], pa.binary())], names=["unit", "digest", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for u, d, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit and rows:
                    yield close(unit, rows)
                    rows = []
                unit = u
                rows.append((d, s))
        if rows:
            yield close(unit, rows)

    return run


def _candidate_links(buckets: DataFrame) -> DataFrame:
    """Star links (u, v) of buckets(bucket, digest) with at least two members."""
    totals = materialize(buckets.groupBy("bucket").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    pairs = totals.filter("n = 2").select(F.col("low").alias("u"), F.col("high").alias("v"))
    more = totals.filter("n > 2").select("bucket", "low")
    stars = buckets.join(small_enough(more, more.count(), BROADCAST_ROWS), "bucket").select(F.col("low").alias("u"), F.col("digest").alias("v"))
    return pairs.unionByName(stars).filter("u != v").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row; links have den * intersection >= num * union."""
    id_type = docs.schema[id_col].dataType
    described = T.StructType([T.StructField("id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(spread(source).mapInArrow(tidy(_describe(shingle, band_count(num / den))), described), "minhash")

    full = rows.filter("digest is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "classes")
    links = _candidate_links(classes.select("digest", F.explode("bands").alias("bucket")))
    groups = connected_components(links)  # node, root

    member = materialize(groups.join(classes.select(F.col("digest").alias("node"), "low_id", "n"), "node"), "members")
    n_members = member.count()
    block = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    dealt = member.join(block, "root").select(F.col("node").alias("digest"), "root", "low_id", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("mine"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("mine"))))
    dealt = dealt.withColumn("other", other)
    units = dealt.select("digest", "blocks", F.concat_ws("/", F.hex("root"), F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string")).alias("unit"))

    wanted = member.select("low_id").distinct()
    texts = source.join(small_enough(wanted, n_members, BROADCAST_ROWS), source["id"].eqNullSafe(wanted["low_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_wanted_sets(shingle)), "digest binary, shingles binary").dropDuplicates(["digest"])
    work = units.join(sets, "digest").select("unit", "digest", "shingles").repartition("unit").sortWithinPartitions("unit")
    settled = materialize(work.mapInArrow(tidy(_settle(num, den)), "unit string, digest binary, root binary"), "settled")

    # A group of one unit is final; the units of a cut group are joined by their forests.
    whole = settled.filter(F.col("unit").endswith("/0/0"))
    forests = settled.filter(~F.col("unit").endswith("/0/0")).select(F.col("digest").alias("u"), F.col("root").alias("v"))
    cut = forests.limit(1).count() > 0
    final = whole.select(F.col("digest").alias("node"), "root")
    if cut:
        final = final.unionByName(connected_components(forests).select("node", "root"))
    named = classes.select("digest", "low_id", "copies").join(final.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    low = named.groupBy("root").agg(F.min("low_id").alias("component_id"), F.sum("copies").alias("size")).filter("size > 1")
    labels = materialize(named.join(low, "root").select("digest", "component_id", "copies"), "labels")
    return _attach(rows, labels, id_col)


def _attach(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Give each row its label; classes that hold over 1 in 200 rows (so fewer than 200 classes) are broadcast, which keeps their copies in place."""
    total = rows.count()
    hot = labels.filter(F.col("copies") * 200 > total).select("digest", F.struct("component_id").alias("hot"))
    rest = labels.filter(F.col("copies") * 200 <= total).select("digest", F.struct("component_id").alias("rest"))
    base = rows.select("id", "n_shingles", "digest").join(F.broadcast(hot), "digest", "left")
    # rows without a further partner get a key of their own, so that hot or empty ones are not dealt to one task
    cold = F.when(F.col("hot").isNull(), F.col("digest"))
    out = base.withColumn("key", F.coalesce(cold, F.concat(F.lit("row "), F.xxhash64("id").cast("string")).cast("binary"))).join(rest.withColumnRenamed("digest", "key"), "key", "left")
    found = F.coalesce("hot", "rest")
    component = F.when(found.isNull(), F.col("id")).otherwise(found["component_id"])
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs with one row of each group, the one with the least id; the same columns.

    A row is known by its id and a hash of its text, so repeated or missing
    ids do not mix up rows; of rows that agree in both, one stays.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), mark.alias("mark"))
    found = materialize(near_duplicates(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), id_col="_key", text_col="_text", **rule), "groups")
    total, keys, gone = found.agg(F.count("*"), F.count_distinct("_key"), F.count_if(~F.col("kept"))).first()
    side = small_enough(found.filter("not kept").select(F.col("_key.id").alias("_id"), F.col("_key.mark").alias("_mark")).distinct(), gone, BROADCAST_ROWS)
    out = docs.join(side, docs[id_col].eqNullSafe(side["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == side["_mark"]), "left_anti")
    return out if keys == total else out.dropDuplicates([id_col, text_col])
