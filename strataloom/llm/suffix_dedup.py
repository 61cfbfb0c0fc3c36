r"""Exact removal of repeated byte strings by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id. Strings are judged on the input.

Blocks. Texts are first written as blocks of a few megabytes, bucketed by block
number, so that what later stages find for a block joins it without moving the
texts, and rows are known by block and place: no ids or hashes tell them apart.

Sharding. Equal strings must meet in one shard. Every window of `length` bytes
takes its 12-byte gram with the least hash (the leftmost of equals) as its
anchor; consecutive windows with one anchor are one fragment, and the anchor
decides the shard. Two equal windows agree on half of the bytes around the
anchor on its left or on its right. So hashes of these half contexts go around
first (equal hashes of different contexts only cost time), and only fragments
that share one with another document send their bytes. Equal fragments of a
block travel once with the list of their places, so a passage that very many
documents share stays small.

Sorting. A shard's distinct fragments are one text on disk, whose suffixes come
in order with their common prefixes by external induced sorting
(external_sort.py); neighbours that agree in `length` bytes form groups, and the
least document of a group decides for all its places. Memory is bounded by the
limits below, not by the shard: fragments are made distinct in batches of
`BATCH_BYTES`, and what is known of each place of the text lies on disk.

The number of shards grows with the input up to `MOST_SMALL`, then the shards
grow; blocks grow with the number of shards, so the rows between the stages
(blocks times shards) stay in proportion to the input.

Cases: null texts are empty; texts shorter than `length` keep everything;
repeated rows of one id never remove each other (no id is smaller); a null id
counts as the greatest number; very long texts are cut into fragments like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.external_sort import Scratch, Symbols, descending, zeros
from strataloom.llm.session import fresh_path, materialize, spread, tidy
from strataloom.llm.textkernel import _BYTE_CODE, _powers, mix, slices, text_bytes

LENGTH = 50
GRAM = 12
#: Shards: one for each SHARD_TEXT bytes of input, which one task sorts in memory; beyond MOST_SMALL of them shards
#: grow up to LARGE_TEXT bytes of input, sorted on disk, before there are more of them.
LEAST_SHARDS, MOST_SMALL = 24, 1600
SHARD_TEXT, LARGE_TEXT = 3_600_000, 4 << 30
#: Bytes of a block: 40 kilobytes for each shard, within bounds; and bytes of a block that are cut into fragments at once.
#: A task that cuts a block holds up to 25 bytes for each of its bytes, so the upper bound does not follow the input.
BLOCK_BYTES, MOST_BLOCK_BYTES, BLOCK_SHARE = 1 << 20, 8 << 20, 40 << 10
STRETCH = 2 << 20
BUCKET_BYTES = 256 << 20
BATCH_BYTES = 64 << 20
#: Contexts that are compared in memory, and parts into which more are dealt on disk first.
CONTEXT_ROWS, CONTEXT_PARTS = 2_000_000, 64
LAST = np.iinfo(np.int64).max
#: The byte that ends each fragment of a shard's text; UTF-8 never has it.
END = 0xFE


# --- blocks --------------------------------------------------------------------------------------


def _block(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(0).combine_chunks()
            data, offsets = text_bytes(table.column(1))
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(np.diff(offsets), pa.int32())), pa.array([data.tobytes()], pa.binary())],
                names=["ids", "sizes", "data"],
            )

        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, size):
                if total and total + offsets[j] - offsets[i] > size:
                    yield close()
                    held, total = [], 0
                held.append(batch.slice(i, j - i))
                total += int(offsets[j] - offsets[i])
        if held:
            yield close()

    return run


def _blocks(texts: DataFrame, size: int, buckets: int) -> DataFrame:
    """(block, ids, sizes, data), written in buckets of block."""
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType
    out = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])
    name = f"strataloom_blocks_{uuid.uuid4().hex}"
    made = spread(texts).mapInArrow(tidy(_block(size)), out).withColumn("block", F.monotonically_increasing_id())
    made.write.bucketBy(buckets, "block").option("path", fresh_path(spark, "blocks")).option("compression", "zstd").option("parquet.block.size", 8 << 20).saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and the plan knows them
    return blocks


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, row, block, ids as numbers, bytes, offsets) of each block; columns block, ids, sizes, data."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column(1)[k].values.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
            data = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint8)
            yield batch, k, batch.column(0)[k].as_py(), ids, data, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


# --- fragments -----------------------------------------------------------------------------------


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])] if len(starts) else data[:0]


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, left context, right context, row, place in the buffer, bytes) of all fragments of a buffer of texts.

    A context is a hash of the anchor and the bytes on one side that one of two
    equal windows' halves must hold; 0 where the fragment is too short for it.
    """
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.uint64)
        return (none, none, none, *(none.astype(np.int64),) * 3)
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:-1], out=run[1:])
    place_bits = np.uint64(max(1, int(len(data)).bit_length()))
    gram = mix((run[GRAM:] - run[:-GRAM]) * down[: len(data) - GRAM + 1])
    least = (gram >> place_bits << place_bits) | np.arange(len(gram), dtype=np.uint64)
    width = length - GRAM + 1
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    row = np.repeat(np.arange(len(sizes)), windows)
    window = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(total)
    anchor = (least[window] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    bytes_ = np.diff(np.append(at, total)) + length - 1
    place, anchor, row = window[at], anchor[at], row[at]
    half = (length - GRAM + 1) // 2

    def context(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        fits = (a >= place) & (b <= place + bytes_)
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        return np.where(fits, mix((run[b] - run[a]) * down[a] + np.uint64(salt)) | np.uint64(1 << 32), np.uint64(0))

    return gram[anchor], context(anchor - half, anchor + GRAM, 3), context(anchor, anchor + GRAM + half, 5), row, place, bytes_


def block_fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """fragments() of a whole block, in stretches of whole texts."""
    found = []
    for i, j in slices(offsets, STRETCH):
        key, left, right, row, place, size = fragments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
        found.append((key, left, right, row + i, place + offsets[i], size))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else list(fragments(data, offsets, length))


def _pack(arrays: list[np.ndarray]) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return head + zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(payload: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    import zstandard

    sizes = np.frombuffer(payload[: 8 * len(kinds)], "<i8").tolist()
    raw = zstandard.ZstdDecompressor().decompress(payload[8 * len(kinds) :])
    out, at = [], 0
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress well; np.cumsum undoes it modulo 2**32."""
    return np.diff(x.astype("<u4"), prepend=np.uint32(0)).astype("<u4")


def _whole(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32).astype(np.int64)


def _by_shard(key: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its fragments in order) of the shards that have any."""
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each distinct string in order of appearance, number of each string) of strings that lie side by side."""
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(data)])
    number = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.full(int(number.max()) + 1, len(number))
    np.minimum.at(first, number, np.arange(len(number)))
    return first, number


#: Left and right contexts, least and greatest id of distinct context pairs; pair, place and length of fragments (the first two as differences).
_ASK = ("<u4", "<u4", "<i8", "<i8", "<u4", "<u4", "<u1")
#: The shard; places (as differences) and lengths of the fragments that are shared.
_ANSWER = ("<u4", "<u4", "<u1")
#: Lengths of distinct fragments; fragment, place and row of places (as differences); ids of rows; fragment bytes.
_SEND = ("<u1", "<u4", "<u4", "<u4", "<i8", "u1")


def _batch_of(blocks: list[int], names: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "shard", "payload"])


def _ask(shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block, ids, data, offsets in _read_blocks(batches):
            key, left, right, row, place, size = block_fragments(data, offsets, length)
            pair = (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))
            names, payloads = [], []
            for s, p in _by_shard(key, shards):
                _, one, number = np.unique(pair[p], return_index=True, return_inverse=True)
                owner = ids[row[p]]
                low, high = np.full(len(one), LAST), np.full(len(one), -LAST - 1)
                np.minimum.at(low, number, owner)
                np.maximum.at(high, number, owner)
                names.append(s)
                payloads.append(_pack([*((c[p[one]] >> np.uint64(32)).astype("<u4") for c in (left, right)), low, high, _steps(number), _steps(place[p]), size[p].astype("<u1")]))
            if names:
                yield _batch_of([block] * len(names), names, payloads)

    return run


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, k, block, ids, data, offsets in _read_blocks(batches):
        names, payloads = [], []
        for blob in batch.column(4)[k].as_py():
            shard, place, size = _unpack(blob, _ANSWER)
            place, size = _whole(place), size.astype(np.int64)
            first, number = _distinct(_gather(data, place, size), size)
            rows, at = np.unique(np.searchsorted(offsets, place, "right") - 1, return_inverse=True)
            names.append(int(shard[0]))
            payloads.append(_pack([size[first].astype("<u1"), _steps(number), _steps(place), _steps(at), ids[rows], _gather(data, place[first], size[first])]))
        yield _batch_of([block] * len(names), names, payloads)


class SharedContexts:
    """The fragments of one shard that share a context with another document; many contexts are compared part by part from disk."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = [[], []]
        self.size = 0
        self.parts: list[list[Scratch]] = []
        self.n = 0

    def add(self, payload: bytes) -> None:
        left, right, low, high = _unpack(payload, _ASK)[:4]
        entry = np.arange(self.n, self.n + len(left), dtype=np.uint64)
        self.n += len(left)
        for side, context in enumerate((left, right)):
            rows = np.stack([context.astype(np.uint64), entry, low.view(np.uint64), high.view(np.uint64)], axis=1)
            self.held[side].append(rows[context != 0])
        self.size += len(left)
        if self.size > CONTEXT_ROWS:
            self._deal()

    def _deal(self) -> None:
        self.parts = self.parts or [[Scratch("<u8", 4) for _ in range(CONTEXT_PARTS)] for _ in range(2)]
        for side, held in enumerate(self.held):
            rows = np.concatenate(held)
            part = rows[:, 0] % np.uint64(CONTEXT_PARTS)
            order = np.argsort(part, kind="stable")
            for k, x in enumerate(np.split(rows[order], np.searchsorted(part[order], np.arange(1, CONTEXT_PARTS)))):
                self.parts[side][k].append(x)
        self.held, self.size = [[], []], 0

    def _sets(self) -> Iterator[np.ndarray]:
        """All rows of some contexts at a time."""
        if not self.parts:
            yield from (np.concatenate(held) for held in self.held if held)
            return
        self._deal()
        for side in self.parts:
            for store in side:
                yield store.read(0, store.n)
                store.close()

    def shared(self) -> np.ndarray:
        """A flag for each entry, on disk if there are many."""
        out = zeros(np.bool_, self.n)
        for rows in self._sets():
            if len(rows):
                rows = rows[np.argsort(rows[:, 0])]
                first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
                several = np.minimum.reduceat(rows[:, 2].view(np.int64), first) < np.maximum.reduceat(rows[:, 3].view(np.int64), first)
                out[rows[np.repeat(several, np.diff(np.append(first, len(rows)))), 1].astype(np.int64)] = True
        return out


def _answer(shard: int, payloads: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For each block the places and lengths of its fragments that are shared."""
    contexts, kept = SharedContexts(), []
    for block, payload in payloads:
        start = contexts.n
        contexts.add(payload)
        number, place, size = _unpack(payload, _ASK)[4:]
        places = Scratch("<u4", 2)
        places.append(np.stack([number, place], axis=1))
        sizes = Scratch("<u1")
        sizes.append(size)
        kept.append((block, start, places, sizes))
    flags = contexts.shared()
    for block, start, places, sizes in kept:
        number, place = places.read(0, places.n).T
        keep = flags[start + _whole(number)]
        if keep.any():
            yield block, _pack([np.array([shard], "<u4"), _steps(_whole(place)[keep]), sizes.read(0, sizes.n)[keep]])
        places.close()
        sizes.close()


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Shard:
    """The fragments of one shard, in batches on disk, and what the suffix order says of them."""

    def __init__(self, length: int = LENGTH, items: int | None = None):
        self.length, self.items = length, items
        self.text = Symbols(names=False)
        self.held: list[tuple[int, list[np.ndarray]]] = []
        self.size = 0
        #: For each batch: first distinct fragment, their lengths and least ids, and the places of each block.
        self.batches: list[tuple[int, np.ndarray, np.ndarray, list[tuple[int, Scratch, int, int]]]] = []
        self.starts, self.lows = Scratch("<i8"), Scratch("<i8")

    def add(self, block: int, payload: bytes) -> None:
        self.held.append((block, _unpack(payload, _SEND)))
        self.size += len(self.held[-1][1][5])
        if self.size > BATCH_BYTES:
            self.close()

    def close(self) -> None:
        """Make the fragments that are held distinct and write them to the text."""
        if not self.held:
            return
        sizes = np.concatenate([x[0] for _, x in self.held]).astype(np.int64)
        data = np.concatenate([x[5] for _, x in self.held])
        first, number = _distinct(data, sizes)
        low = np.full(len(first), LAST)
        base, stores = 0, []
        for block, (n, frag, place, at, ids, _) in self.held:
            frag = number[base + _whole(frag)]
            base += len(n)
            owner = ids[_whole(at)]
            np.minimum.at(low, frag, owner)
            store = Scratch("<i8", 3)
            store.append(np.stack([frag, _whole(place), owner], axis=1))
            stores.append((block, store))
        sizes_, where = sizes[first], (np.cumsum(sizes) - sizes)[first]
        out = np.full(int((sizes_ + 1).sum()), END + 1, np.uint8)
        to = np.cumsum(sizes_ + 1) - (sizes_ + 1)
        out[np.repeat(to - (np.cumsum(sizes_) - sizes_), sizes_) + np.arange(sizes_.sum())] = _gather(data, where, sizes_) + np.uint8(1)
        self.starts.append(self.text.n + to)
        self.lows.append(low)
        self.batches.append((self.text.n, sizes_, low, stores))
        self.text.append(out)
        self.held, self.size = [], 0

    def winners(self) -> np.ndarray:
        """For each place of the text the number of the fragment with the least id whose window is equal, plus 1; 0 where that is its own. On disk."""
        starts, lows = self.starts.view(), self.lows.view()
        out = zeros("<u4", self.text.n)
        ends = np.append(starts[1:], self.text.n)
        owner = zeros("<u4", self.text.n)
        for i in range(0, len(starts), 1 << 18):
            j = min(len(starts), i + (1 << 18))
            owner[starts[i] : ends[j - 1]] = np.repeat(np.arange(i, j, dtype=np.uint32), np.diff(np.append(starts[i:j], ends[j - 1])))
        held: list[np.ndarray] = []
        prefix_left = 255

        def settle(place: np.ndarray, new: np.ndarray) -> None:
            """Groups that begin where `new`; all of them are whole."""
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            place, group = place[many], group[many]
            if len(place):
                frag = owner[place]
                low = np.asarray(lows[frag])
                by = np.lexsort((low, group))
                head = by[np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))]
                best = head[np.searchsorted(group[head], group)]
                other = low[best] < low
                out[place[other]] = frag[best[other]] + 1

        for rows, prefix in descending(self.text.finish(), self.length, items=self.items):
            place = rows[:, 1].astype(np.int64)
            frag = owner[place]
            window = np.flatnonzero(ends[frag] - 1 - place >= self.length)
            if not len(window):
                prefix_left = min(prefix_left, int(prefix.min()))
                continue
            heads = np.concatenate([[0], window[:-1] + 1])
            low = np.minimum.reduceat(prefix[: window[-1] + 1], heads)
            low[0] = min(low[0], prefix_left)
            prefix_left = int(prefix[window[-1] + 1 :].min()) if window[-1] + 1 < len(prefix) else 255
            place, new = place[window], low < self.length
            last = np.flatnonzero(new)
            if len(last):  # the groups up to the last beginning are whole
                k = int(last[-1])
                settle(np.concatenate([*held, place[:k]]), np.concatenate([np.arange(sum(map(len, held))) == 0, new[:k]]) if held else np.append(True, new[1:k])[:k])
                held = [place[k:]]
            else:
                held.append(place)
        if held:
            whole = np.concatenate(held)
            settle(whole, np.arange(len(whole)) == 0)
        return out

    def removals(self) -> Iterator[tuple[int, bytes]]:
        """(block, packed places and lengths) of all stretches to remove that this shard finds."""
        self.close()
        if not self.text.n:
            return
        winner, lows = self.winners(), self.lows.view()
        for base, sizes, low, stores in self.batches:
            to = np.cumsum(sizes + 1) - (sizes + 1)
            windows = sizes - self.length + 1
            first = np.cumsum(windows) - windows
            best = np.asarray(winner[base : base + int((sizes + 1).sum())])[np.repeat(to - first, windows) + np.arange(windows.sum())].astype(np.int64)
            smallest = np.repeat(low, windows)
            better = np.flatnonzero(best)
            smallest[better] = lows[best[better] - 1]
            least, most = np.minimum.reduceat(smallest, first), np.maximum.reduceat(smallest, first)
            for block, store in stores:
                frag, place, owner = store.read(0, store.n).T
                store.close()
                here = owner > least[frag]
                frag, place, owner = frag[here], place[here], owner[here]
                whole = owner > most[frag]
                starts, lengths = [place[whole]], [sizes[frag[whole]]]
                some = np.flatnonzero(~whole)
                if len(some):
                    n = windows[frag[some]]
                    at = np.repeat(first[frag[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    gone = smallest[at] < np.repeat(owner[some], n)
                    # a gap after each fragment keeps its runs apart
                    spaced = np.zeros(len(gone) + len(some), bool)
                    spot = np.arange(len(gone)) + np.repeat(np.arange(len(some)), n)
                    spaced[spot] = gone
                    a, b = _runs(spaced)
                    which = np.searchsorted(np.cumsum(n + 1), a, "right")
                    starts.append(place[some][which] + a - (np.cumsum(n + 1) - (n + 1))[which])
                    lengths.append(b - a + self.length - 1)
                starts, lengths = np.concatenate(starts), np.concatenate(lengths)
                if len(starts):
                    order = np.argsort(starts, kind="stable")
                    yield block, _pack([_steps(starts[order]), lengths[order].astype("<u4")])


def _per_shard(solve):
    """Apply solve to the (block, payload) rows of each shard of an input that is sorted by shard, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, b, p.as_py()) for batch in batches for b, s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            shard = ahead[0]

            def own() -> Iterator[tuple[int, bytes]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:  # noqa: B023 - used up before the shard changes
                    yield ahead[1], ahead[2]
                    ahead = next(rows, None)

            mine = own()
            for block, payload in solve(shard, mine):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])
            for _ in mine:
                pass

    return run


def _judge(length: int):
    def solve(_: int, payloads: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        shard = Shard(length)
        for block, payload in payloads:
            shard.add(block, payload)
        yield from shard.removals()

    return solve


def _cut(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, _, _, data, offsets in _read_blocks(batches):
            gone = np.zeros(len(data) + 1, np.int32)
            for blob in batch.column(4)[k].as_py() or ():
                start, size = _unpack(blob, ("<u4", "<u4"))
                start = _whole(start)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + size, -1)
            # a block has fewer than 2 ** 31 bytes
            drop = np.cumsum(gone[:-1], dtype=np.int32, out=gone[:-1]) > 0
            del gone
            sizes = np.diff(offsets)
            before = lambda marks: np.concatenate([np.zeros(1, np.int32), np.cumsum(marks, dtype=np.int32)])[offsets].astype(np.int64)
            removed = np.diff(before(drop))
            begins = drop.copy()
            begins[1:] &= ~drop[:-1]
            heads = offsets[:-1][sizes > 0]
            begins[heads] = drop[heads]  # matches never cross documents
            spans = np.diff(before(begins))
            kept = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1)[k].values.cast(id_type), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(kept), pa.py_buffer(data[~drop])])],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def layout(total: int) -> tuple[int, int]:
    """Number of shards and bytes of a block for so many bytes of text."""
    shards = max(LEAST_SHARDS, min(MOST_SMALL, int(total // SHARD_TEXT) + 1), int(total // LARGE_TEXT) + 1)
    return shards, min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, shards * BLOCK_SHARE))


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept bytes) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, size = layout(total)
    blocks = _blocks(texts, size, max(LEAST_SHARDS, int(total // BUCKET_BYTES) + 1))
    packed, answers = "block long, shard int, payload binary", "block long, payload binary"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(shards, "shard").sortWithinPartitions("shard", "block")

    def beside(rows: DataFrame, name: str, how: str) -> DataFrame:
        side = materialize(rows.groupBy(F.col("block").alias("_block")).agg(F.collect_list("payload").alias(name)), name)
        # the blocks stay where they are: their buckets are the partitions of the join
        return blocks.join(side.hint("shuffle_hash"), F.col("block") == F.col("_block"), how).select("block", "ids", "sizes", "data", name)

    asked = dealt(blocks.select("block", "ids", "sizes", "data").mapInArrow(tidy(_ask(shards, length)), packed))
    wanted = beside(asked.mapInArrow(tidy(_per_shard(_answer)), answers), "wanted", "inner")
    found = dealt(wanted.mapInArrow(tidy(_send), packed)).mapInArrow(tidy(_per_shard(_judge(length))), answers)
    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("id", id_type), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return beside(found, "spans", "left").mapInArrow(tidy(_cut(to_arrow_type(id_type))), out).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, **names) -> DataFrame:
    """The counts, and a hash of what is kept."""
    out = cut_repeats(docs, **names)
    return out.select(names.get("id_col", "doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same digest for small inputs, by a dictionary of all strings."""
    least: dict[bytes, int] = {}
    raws = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            least[s] = min(least.get(s, LAST), i)
    out = []
    for (i, raw), (own, _) in zip(raws, rows, strict=True):
        drop = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if least[raw[k : k + length]] < i:
                drop[k : k + length] = True
        kept = np.frombuffer(raw, np.uint8)[~drop].tobytes()
        out.append((own, len(raw), int(drop.sum()), len(_runs(drop)[0]) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return out
