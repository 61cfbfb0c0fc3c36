r"""Suffixes of a text on disk in order, with common prefixes, by external induced sorting.

The text is a file of symbols; suffixes are told apart by their first `depth`
bytes. As in induced sorting, the leftmost S suffixes are ordered first: their
substrings are sorted and named, and where names repeat, the string of names is
ordered by recursion. Then a priority queue of suffix tuples induces the L
suffixes from them in ascending order, and a second one all S suffixes from the
L suffixes in descending order.

A tuple carries its suffix's first symbol and order of arrival (the key), its
place, the symbols before it (so that inducing reads the text only now and
then), and common-prefix values. A queue is a set of sorted runs: at most
`ITEMS` tuples in its own memory, the others in arrays that are read in blocks and
lie in unnamed files of the task beyond `RESIDENT` bytes. Tuples are taken in chunks of whole symbols, and
what a chunk's tuples induce inside it is put in its place at once; a symbol
with more tuples than a chunk is taken in parts.

Common prefixes. Neighbours that arrived from one chunk share one symbol more
than the least common prefix between the two suffixes that induced them. For
neighbours from different chunks a tuple also carries that least value from its
chunk's start and to its chunk's end; a table of chunk minima gives the rest.
Where two kinds of tuples meet (seeds, induced ones, those that a chunk has put
in), or two names, the texts are compared in words of eight bytes.

Chunks get short where single suffixes induce one another in a chain (one text
that repeats a short pattern very often); many short texts with an end mark
each, as this package sorts, have no long chains.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of arrays that a task keeps in memory before more of them go to files.
RESIDENT = 160 << 20
#: Tuples (of 32 bytes) that a queue keeps in memory, tuples taken at once, and runs in files before they are merged.
ITEMS = 1 << 19
CHUNK = 1 << 15
RUNS = 8
SEED = np.uint64(1 << 33)
SHIFT = np.uint64(34)
_8, _16, _24, _56 = (np.uint64(k) for k in (8, 16, 24, 56))
_BYTE = np.uint64(0xFF)
_WORD = np.uint64(0xFFFFFFFF)


class Scratch:
    """An append-only array: in memory while all arrays of the task take less than `RESIDENT` bytes, else in an unnamed file."""

    resident = 0

    def __init__(self, kind, width: int = 1):
        self.kind, self.width, self.n = np.dtype(kind), width, 0
        self.item = self.kind.itemsize * width
        self.file = None
        self.parts: list[np.ndarray] = []

    def append(self, values: np.ndarray) -> None:
        if not values.size:
            return
        values = np.ascontiguousarray(values, self.kind).reshape(-1)
        self.n += values.size // self.width
        if self.file is None and Scratch.resident + values.nbytes <= RESIDENT:
            Scratch.resident += values.nbytes
            self.parts.append(values.copy())
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(buffering=0)  # noqa: SIM115 - unnamed, gone with the task
            held, self.parts = self.parts, []
            for x in held:
                self._write(x)
                Scratch.resident -= x.nbytes
        self._write(values)

    def _write(self, values: np.ndarray) -> None:
        raw = memoryview(values).cast("B")
        while len(raw):
            raw = raw[self.file.write(raw) :]

    def _whole(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0] if self.parts else np.zeros(0, self.kind)

    def read(self, i: int, j: int) -> np.ndarray:
        if self.file is None:
            out = self._whole()[i * self.width : j * self.width]
        else:
            size, at, parts = (j - i) * self.item, i * self.item, []
            while size:
                parts.append(os.pread(self.file.fileno(), size, at))
                size, at = size - len(parts[-1]), at + len(parts[-1])
            out = np.frombuffer(b"".join(parts), self.kind)
        return out if self.width == 1 else out.reshape(-1, self.width)

    def view(self) -> np.ndarray:
        """The array for reads at scattered places, a mapping of the file if it is in one."""
        return self._whole() if self.file is None else np.memmap(self.file, self.kind, "r", shape=(self.n,))

    def close(self) -> None:
        Scratch.resident -= sum(x.nbytes for x in self.parts)
        self.parts = []
        if self.file is not None:
            self.file.close()

    def __del__(self) -> None:
        if self.parts:
            self.close()


def zeros(kind, n: int) -> np.ndarray:
    """An array to be filled at scattered places, mapped to an unnamed file if it is large."""
    if n * np.dtype(kind).itemsize <= RESIDENT // 8:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Symbols:
    """Symbols 1, 2, ... (0 ends the text) in a file; bytes, or names of four bytes."""

    def __init__(self, names: bool):
        self.size = 4 if names else 1
        self.per = 8 // self.size
        self.bits = np.uint64(8 * self.size)
        self.mask = np.uint64((1 << (8 * self.size)) - 1)
        self.store = Scratch("u1")
        self.store.append(np.zeros(8, np.uint8))
        self.n = 0

    def append(self, symbols: np.ndarray) -> None:
        self.store.append((symbols.astype(">u4") if self.size == 4 else symbols.astype(np.uint8)).view(np.uint8))
        self.n += len(symbols)

    def finish(self) -> Symbols:
        self.store.append(np.zeros(16, np.uint8))
        raw = self.store.view()
        self.words = np.ndarray(((len(raw) - 8) // self.size + 1,), ">u8", raw, strides=(self.size,))
        return self

    def word(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes of symbols from each place on, the first on top; zeros beyond the end."""
        at = np.minimum(at, self.n + self.per) + self.per
        return self.words[np.minimum(at, len(self.words) - 1)].astype(np.uint64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The symbols before each place, the nearest at the bottom."""
        return self.words[at].astype(np.uint64)

    def at(self, at: np.ndarray) -> np.ndarray:
        return self.word(at) >> np.uint64(64 - 8 * self.size)

    def block(self, i: int, j: int) -> np.ndarray:
        raw = self.store.read(8 + i * self.size, 8 + j * self.size)
        return (raw if self.size == 1 else raw.view(">u4")).astype(np.int64)

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Equal bytes of pairs of suffixes of a byte text, `depth` at most."""
        out = np.zeros(len(a), np.uint8)
        left = np.flatnonzero((a < self.n) & (b < self.n))
        for k in range(0, depth, 8):
            x = self.word(a[left] + k) ^ self.word(b[left] + k)
            same = x == 0
            lead = np.zeros(len(x), np.int64)
            y = x
            for step in (32, 16, 8):
                small = y < np.uint64(1 << (64 - step))
                lead += np.where(small, step // 8, 0)
                y = np.where(small, y << np.uint64(step), y)
            ends = np.minimum(a[left], b[left])  # a text that is over has no more equal bytes
            out[left] = np.minimum(np.minimum(k + np.where(same, 8, lead), depth), np.maximum(self.n - np.maximum(a[left], b[left]), 0))
            left = left[same & (ends + k + 8 <= self.n)]
            if not len(left):
                break
        return out


# --- queues --------------------------------------------------------------------------------------


class _Memory:
    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.n = len(rows)

    def peek(self, k: int) -> np.ndarray:
        return self.rows[:k]

    def drop(self, k: int) -> None:
        self.rows = self.rows[k:]
        self.n -= k


class _File:
    """A sorted run in a file, read in blocks."""

    def __init__(self, store: Scratch):
        self.store, self.at, self.n = store, 0, store.n
        self.held = np.zeros((0, 4), np.uint64)

    def peek(self, k: int) -> np.ndarray:
        k = min(k, self.n)
        if len(self.held) < k:
            more = max(k, CHUNK)
            self.held = self.store.read(self.at, min(self.store.n, self.at + more))
        return self.held[:k]

    def drop(self, k: int) -> None:
        self.held = self.held[k:]
        self.at += k
        self.n -= k
        if not self.n:
            self.store.close()


class Backwards(_File):
    """The seeds of a phase: a file of (first symbol, place, symbols before, common prefix with the row before) in reverse."""

    def __init__(self, store: Scratch, text: Symbols, top: int | None, places: np.ndarray | None = None):
        super().__init__(store)
        self.text, self.top, self.places = text, top, places
        self.last = np.uint64(0)
        self.order = np.uint64(0)

    def peek(self, k: int) -> np.ndarray:
        k = min(k, self.n)
        if len(self.held) < k:
            more = min(max(k, CHUNK), self.n) - len(self.held)
            have = len(self.held)
            raw = self.store.read(self.n - have - more, self.n - have)[::-1]
            rows = np.empty((more, 4), np.uint64)
            if self.places is None:
                rows[:, 1:3], symbol, info = raw[:, 1:3], raw[:, 0], raw[:, 3]
                count = info >> _56 << _56
            else:  # an order of names: look up what they stand for
                rows[:, 1] = self.places[raw[:, 1].astype(np.int64)]
                rows[:, 2], symbol, info = 0, self.text.at(rows[:, 1].astype(np.int64)), raw[:, 3]
                count = np.uint64(0)
            prefix = info & _BYTE
            rows[:, 3] = np.concatenate([[self.last], prefix[:-1]]) << _16 | count
            self.last = prefix[-1]
            if self.top is not None:
                symbol = np.uint64(self.top) - symbol
            rows[:, 0] = symbol << SHIFT | SEED | (self.order + np.arange(more, dtype=np.uint64))
            self.order += np.uint64(more)
            self.held = np.concatenate([self.held, rows]) if have else rows
        return self.held[:k]


class TupleQueue:
    """A priority queue of tuples (rows of four 64-bit numbers) by their first number, filled and emptied in bulk."""

    def __init__(self, items: int | None = None):
        self.items = items or ITEMS
        self.memory: list[_Memory] = []
        self.files: list[_File] = []
        self.spilled = 0

    def add_run(self, run: _File) -> None:
        self.files.append(run)

    def push(self, rows: np.ndarray) -> None:
        """Add rows sorted by key."""
        if not len(rows):
            return
        self.memory = [m for m in self.memory if m.n]
        while self.memory and self.memory[-1].n <= 2 * len(rows):
            rows = _merged([self.memory.pop().rows, rows])
        self.memory.append(_Memory(rows))
        if sum(m.n for m in self.memory) > self.items:
            store = Scratch("u8", 4)
            rows = _merged([m.rows for m in self.memory])
            store.append(rows)
            self.spilled += len(rows)
            self.memory = []
            self.files = [f for f in self.files if f.n]
            plain = [f for f in self.files if type(f) is _File]
            if len(plain) >= RUNS:
                store = self._merge_files([*plain, _File(store)])
                self.files = [f for f in self.files if type(f) is not _File]
            self.files.append(_File(store))

    @staticmethod
    def _merge_files(runs: list[_File]) -> Scratch:
        queue, out = TupleQueue(), Scratch("u8", 4)
        queue.files = runs
        while len(rows := queue.front(CHUNK)):
            out.append(rows)
            queue.drop(rows[-1, 0])
        return out

    def total(self) -> int:
        return sum(r.n for r in (*self.memory, *self.files))

    def front(self, k: int) -> np.ndarray:
        """The first rows in order, about k; rows of equal keys are never parted. Nothing if the queue is empty."""
        runs = [r for r in (*self.memory, *self.files) if r.n]
        while runs:
            peeks = [r.peek(k) for r in runs]
            ends = [p[-1, 0] for p, r in zip(peeks, runs, strict=True) if len(p) < r.n]
            if ends:
                least = min(ends)
                peeks = [p[: np.searchsorted(p[:, 0], least, "left")] for p in peeks]
            total = sum(map(len, peeks))
            if total:
                if total > 2 * k:
                    bound = np.partition(np.concatenate([p[:, 0] for p in peeks]), k)[k]
                    cut = [p[: np.searchsorted(p[:, 0], bound, "left")] for p in peeks]
                    peeks = cut if sum(map(len, cut)) else peeks
                return _merged([p for p in peeks if len(p)])
            k *= 2
        return np.zeros((0, 4), np.uint64)

    def drop(self, key: np.uint64) -> None:
        """Forget all rows up to this key, which front() has shown."""
        for r in (*self.memory, *self.files):
            while r.n:
                rows = r.peek(CHUNK)
                k = int(np.searchsorted(rows[:, 0], key, "right"))
                if k:
                    r.drop(k)
                if k < len(rows) or not k:
                    break


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    rows = np.concatenate(parts)
    return rows[np.argsort(rows[:, 0], kind="stable")]


# --- inducing ------------------------------------------------------------------------------------


class _Ranges:
    """Minima over ranges of a growing or fixed list of bytes."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min of values[a:b] for each pair; 255 where the range is empty."""
        out = np.full(len(a), 255, np.uint8)
        size = b - a
        level = np.zeros(len(a), np.int64)
        some = size > 0
        level[some] = np.frexp(size[some])[1] - 1
        for k in np.unique(level[some]).tolist():
            here = np.flatnonzero(some & (level == k))
            out[here] = np.minimum(self.levels[k][a[here]], self.levels[k][b[here] - (1 << k)])
        return out


class _ChunkMinima:
    """The least common prefix inside each chunk, for ranges of chunks."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = [np.zeros(256, np.uint8)]
        self.n = 0

    def add(self, value: int) -> None:
        if self.n == len(self.levels[0]):
            self.levels = [np.concatenate([x, np.zeros_like(x)]) for x in self.levels]
        k, at = 0, self.n
        self.levels[0][at] = value
        while at + 1 >= 2 << k:  # level k + 1 holds the minimum of the 2**(k+1) chunks that end here
            if len(self.levels) == k + 1:
                self.levels.append(np.zeros_like(self.levels[0]))
            self.levels[k + 1][at] = min(self.levels[k][at], self.levels[k][at - (1 << k)])
            k += 1
        self.n += 1

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min over the chunks after a and before b."""
        out = np.full(len(a), 255, np.uint8)
        size = b - a - 1
        some = size > 0
        level = np.zeros(len(a), np.int64)
        level[some] = np.frexp(size[some])[1] - 1
        for k in np.unique(level[some]).tolist():
            here = np.flatnonzero(some & (level == k))
            out[here] = np.minimum(self.levels[k][b[here] - 1], self.levels[k][a[here] + (1 << k)])
        return out


#: Levels of recursion over names up to the next leftmost S suffix; below them a thirtieth or less of the text is left,
#: which is named by the first `depth` bytes.
LEVELS = 2
#: Steps of induction that are put into one chunk; where a chain is longer, the chunk gets shorter.
STEPS = 48


def _look(text: Symbols, rows: np.ndarray, top: int | None) -> tuple[np.ndarray, ...]:
    """(place, seed, symbols before, their number, symbol to induce, whether it is induced) of tuples."""
    place, seed = rows[:, 1].astype(np.int64), (rows[:, 0] & SEED) != 0
    return place, seed, *_preceding(text, top, rows[:, 0] >> SHIFT, place, seed, rows[:, 2].copy(), (rows[:, 3] >> _56).astype(np.int64))


def _preceding(text: Symbols, top: int | None, symbol: np.ndarray, place: np.ndarray, seed: np.ndarray, carry: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    empty = np.flatnonzero(count == 0)
    carry[empty] = text.before(place[empty])
    count[empty] = text.per
    previous = carry & text.mask
    wanted = previous if top is None else np.uint64(top) - previous
    return carry, count, wanted, (previous > 0) & ((wanted > symbol) | ((wanted == symbol) & ~seed))


def _insertions(text: Symbols, top: int | None, limit: np.uint64, symbol: np.ndarray, place: np.ndarray, seed: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """All tuples of whole symbols with those that they induce below `limit`, in order; None if chains are long.

    A tuple that is induced here stands behind those that were there before and
    in front of seeds, in the order of what induced it.
    """
    parts = [(symbol, place, seed, *rest)]
    parents = [np.full(len(symbol), -1)]
    base, steps = 0, 0
    while True:
        symbol_, place_, _, carry, count, wanted, induces = parts[-1]
        at = np.flatnonzero(induces & (wanted < limit))
        if not len(at):
            break
        if steps == STEPS:
            return None
        none = np.zeros(len(at), bool)
        parts.append((wanted[at], place_[at] - 1, none, *_preceding(text, top, wanted[at], place_[at] - 1, none, carry[at] >> text.bits, count[at] - 1)))
        parents.append(base + at)
        base += len(symbol_)
        steps += 1
    if not steps:
        return np.arange(len(symbol)), symbol, place, seed, *rest
    whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
    parent = np.concatenate(parents)
    above = np.arange(len(parent))
    keys = [whole[0] << np.uint64(31)]
    for _ in range(steps):
        up = parent[above]
        root = up < 0
        keys.append(np.where(root, np.where(whole[2][above], np.uint64(1 << 30), np.uint64(0)), whole[0][np.maximum(up, 0)]))
        above = np.where(root, above, up)
    keys[1] = keys[0] | keys[1]
    del keys[0]
    by = np.lexsort([above, *keys[::-1]])
    return by, *(x[by] for x in whole)


def _induce(text: Symbols, base: Symbols, origin: np.ndarray | None, weights, top: int | None, queue: TupleQueue, depth: int, seeds_count: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Empty a queue that holds the seeds: (tuples, common prefix of each with the one before), in the queue's order, without seeds unless they count.

    `top` is the largest symbol in the descending phase, None in the ascending one.
    """
    minima = _ChunkMinima()
    arrivals = np.uint64(1)
    before: tuple | None = None
    pending = 255
    big = np.uint64(1 << 30)
    ask = CHUNK
    while len(rows := queue.front(ask)):
        key = rows[:, 0]
        symbol = key >> SHIFT
        place, seed, carry, count, wanted, induces = _look(text, rows, top)
        n = len(rows)
        inside_ = None
        limit = symbol[-1] + np.uint64(n == queue.total())
        while limit > symbol[0]:  # whole symbols: what they induce among themselves is put in its place at once
            n = int(np.searchsorted(symbol, limit, "left"))
            inside_ = _insertions(text, top, limit, *(x[:n] for x in (symbol, place, seed, carry, count, wanted, induces)))
            ask = min(CHUNK, 2 * ask) if inside_ else max(64, n // 2)
            if inside_:
                break
            limit = symbol[n // 8]
        else:
            n = int(np.searchsorted(symbol, symbol[0], "right"))
        if inside_ is None:  # a part of one symbol: what comes to it is behind, but for seeds
            least = np.minimum.accumulate(np.where(induces[:n], wanted[:n], big))
            late = np.flatnonzero((symbol[1:n] == least[:-1]) & seed[1:n])
            n = int(late[0]) + 1 if len(late) else n
        queue.drop(key[n - 1])
        info = rows[:n, 3]
        if inside_ is None:
            place, symbol, seed, carry, count, wanted, induces = place[:n], symbol[:n], seed[:n], carry[:n], count[:n], wanted[:n], induces[:n]
            inserted = np.zeros(n, bool)
        else:
            by, symbol, place, seed, carry, count, wanted, induces = inside_
            inserted = by >= n
            info = info[np.minimum(by, n - 1)]
            n = len(by)
        induces = induces & (wanted >= limit) if inside_ is not None else induces
        # common prefixes with the tuple before
        if before is None:
            head_symbol, head_seed, head_chunk, head_tail, head_place = big, True, 0, 0, -1
        else:
            head_symbol, head_seed, head_chunk, head_tail, head_place = before
        earlier_symbol = np.concatenate([np.array([head_symbol], np.uint64), symbol[:-1]])
        earlier_seed = np.concatenate([[head_seed], seed[:-1]])
        chunk = ((info >> _24) & _WORD).astype(np.int64)
        tail = (info & _BYTE).astype(np.uint8)
        same = symbol == earlier_symbol
        prefix = np.zeros(n, np.uint8)
        inner = ((info >> _16) & _BYTE).astype(np.uint8)
        joint = inserted.copy()
        joint[1:] |= inserted[:-1]
        both = same & (seed == earlier_seed) & ~joint
        prefix[both] = inner[both]
        cross = np.flatnonzero(both & ~seed & (inner == 255))
        if len(cross):
            earlier_chunk = np.concatenate([[head_chunk], chunk[:-1]])[cross]
            earlier_tail = np.concatenate([np.array([head_tail], np.uint8), tail[:-1]])[cross]
            start = ((info >> _8) & _BYTE).astype(np.uint8)[cross]
            low = np.minimum(np.minimum(earlier_tail, start), minima.between(earlier_chunk, chunk[cross]))
            shown = symbol[cross] if top is None else np.uint64(top) - symbol[cross]
            prefix[cross] = np.minimum(low.astype(np.int64) + (1 if weights is None else weights[shown.astype(np.int64)]), depth)
        direct = np.flatnonzero(~both) if weights is not None else np.flatnonzero(same & ~both)
        if len(direct):
            earlier_place = np.concatenate([[head_place], place[:-1]])[direct]
            here = place[direct]
            known = earlier_place >= 0
            if origin is not None:
                earlier_place, here = origin[np.maximum(earlier_place, 0)], origin[here]
            prefix[direct] = np.where(known, base.common(earlier_place, here, depth), 0)
        # what is induced
        at = np.flatnonzero(induces)
        number = minima.n
        if len(at):
            order = at[np.argsort(wanted[at], kind="stable")]
            to = wanted[order]
            alike = np.flatnonzero(to[1:] == to[:-1]) + 1
            inside = np.full(len(order), 255, np.int64)
            if len(alike):
                low = _Ranges(prefix).least(order[alike - 1] + 1, order[alike] + 1)
                shown = to[alike] if top is None else np.uint64(top) - to[alike]
                inside[alike] = np.minimum(low.astype(np.int64) + (1 if weights is None else weights[shown.astype(np.int64)]), depth)
            starts = np.minimum.accumulate(prefix)
            ends = np.append(np.minimum.accumulate(prefix[::-1])[::-1][1:], np.uint8(255))
            fresh = np.empty((len(order), 4), np.uint64)
            fresh[:, 0] = to << SHIFT | (arrivals + np.arange(len(order), dtype=np.uint64))
            fresh[:, 1] = place[order] - 1
            fresh[:, 2] = carry[order] >> text.bits
            fresh[:, 3] = (count[order] - 1).astype(np.uint64) << _56 | np.uint64(number) << _24 | inside.astype(np.uint64) << _16 | starts[order].astype(np.uint64) << _8 | ends[order]
            arrivals += np.uint64(len(order))
            queue.push(fresh)
        minima.add(int(prefix.min()))
        before = symbol[-1], bool(seed[-1]), int(chunk[-1]), int(tail[-1]), int(place[-1])
        out = np.empty((n, 4), np.uint64)
        out[:, 0] = symbol if top is None else np.uint64(top) - symbol
        out[:, 1], out[:, 2], out[:, 3] = place, carry, count.astype(np.uint64) << _56
        if not seeds_count:
            keep = np.flatnonzero(~seed)
            if not len(keep):
                pending = min(pending, int(prefix.min()))
                continue
            heads = np.concatenate([[0], keep[:-1] + 1])
            low = np.minimum.reduceat(prefix[: keep[-1] + 1], heads)
            low[0] = min(low[0], pending)
            pending = int(prefix[keep[-1] + 1 :].min()) if keep[-1] + 1 < n else 255
            out, prefix = out[keep], low
        out[:, 3] |= prefix
        yield out, prefix


# --- leftmost S suffixes -------------------------------------------------------------------------


def _leftmost(text: Symbols, cap: int, whole: bool) -> tuple[Scratch, Scratch, int]:
    """Places of leftmost S suffixes and symbols of each that name it, in descending order, and the largest symbol.

    A name covers the substring up to the next leftmost S suffix, that one's run
    of equal symbols and the symbol behind the run, so no name is the beginning
    of another; beyond `cap` symbols it is cut. With `whole` every name has `cap`
    symbols.
    """
    places, sizes = Scratch("i8"), Scratch("i8")
    top, following_small, run, edge = 0, True, 1, text.n
    star_end = text.n + 1
    step = 1 << 18
    pending: int | None = None
    for b in range(text.n, 0, -step):
        a = max(0, b - step)
        t = np.append(text.block(a, b), text.block(b, b + 1) if b < text.n else 0)
        top = max(top, int(t.max()))
        differs = np.flatnonzero(t[:-1] != t[1:])
        size = np.diff(differs, prepend=-1)
        small = np.empty(len(t), bool)
        length = np.empty(len(t), np.int64)
        if len(differs):
            upto = differs[-1] + 1
            end = np.repeat(differs, size)
            small[:upto] = t[end] < t[end + 1]
            length[:upto] = end - np.arange(upto) + 1
        else:
            upto = 0
        small[upto:] = following_small
        length[upto:] = np.arange(len(t) - 1 - upto, -1, -1) + run
        # a place is a leftmost S suffix if the one before it is L; the first place of the block waits for the next block
        found = np.flatnonzero(small[1:] & ~small[:-1]) + 1 + a
        found = found[found < edge]
        if pending is not None and pending not in found:
            pending = None
        if len(found):
            lengths = length[found - a]
            nexts = np.append((found + lengths + 1)[1:], star_end)
            if found[-1] == b:  # decided now, with the run that was seen in the block behind
                nexts[-1] = star_end
            size = np.minimum(np.minimum(cap if whole else nexts - found, cap), text.n + 1 - found)
            places.append(found[::-1])
            sizes.append(size[::-1])
            star_end = int(found[0] + lengths[0] + 1)
            edge = int(found[0])
        following_small, run = bool(small[0]), int(length[0])
    return places, sizes, top


def _name(text: Symbols, places: np.ndarray, sizes: np.ndarray, m: int, items: int | None) -> tuple[Scratch, np.ndarray, int]:
    """Sort the substrings: (order of substrings, name of each by ascending place, number of names)."""
    queue = TupleQueue(items)
    step = CHUNK
    for i in range(0, m, step):
        place = np.asarray(places[m - min(m, i + step) : m - i])[::-1]
        size = np.asarray(sizes[m - min(m, i + step) : m - i])[::-1]
        rows = np.empty((len(place), 4), np.uint64)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = _cut(text.word(place), size, text), np.arange(i, i + len(place)), place, size
        queue.push(rows[np.argsort(rows[:, 0], kind="stable")])
    order, names = Scratch("u8", 4), zeros(">u4", m)
    count = 0
    while len(rows := queue.front(2 * CHUNK)):
        queue.drop(rows[-1, 0])
        rows = rows.copy()
        new = np.append(True, rows[1:, 0] != rows[:-1, 0])
        k = text.per
        while True:
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            open_ = np.flatnonzero(many & (rows[:, 3] > np.uint64(k)))
            if not len(open_):
                break
            word = _cut(text.word(rows[open_, 2].astype(np.int64) + k), rows[open_, 3].astype(np.int64) - k, text)
            by = np.lexsort((word, group[open_]))
            rows[open_] = rows[open_[by]]
            word = word[by]
            apart = np.append(False, (word[1:] != word[:-1]) & (group[open_][1:] == group[open_][:-1]))
            new[open_[apart]] = True
            k += text.per
        number = count + np.cumsum(new)
        count = int(number[-1])
        names[rows[:, 1].astype(np.int64)] = number
        kept = np.zeros((len(rows), 4), np.uint64)
        kept[:, 0], kept[:, 1] = number, rows[:, 1]
        order.append(kept)
    return order, names, count


def _cut(word: np.ndarray, size: np.ndarray, text: Symbols) -> np.ndarray:
    """Words with only their first `size` symbols."""
    over = np.clip(text.per - size, 0, text.per)
    keep = np.where(over >= text.per, np.uint64(0), ~np.uint64(0))
    shift = (np.minimum(over, text.per - 1) * int(text.bits)).astype(np.uint64)
    return (word >> shift << shift) & keep


class _Sorted(_File):
    """Names that need no recursion: seeds in the order of their names, as Backwards gives them."""

    def __init__(self, store: Scratch, text: Symbols, base: Symbols, origin: np.ndarray | None, places: np.ndarray, depth: int):
        super().__init__(store)
        self.text, self.base, self.origin, self.places, self.depth = text, base, origin, places, depth
        self.read = 0
        self.last = -1

    def peek(self, k: int) -> np.ndarray:
        k = min(k, self.n)
        if len(self.held) < k:
            more = min(max(k, CHUNK), self.n) - len(self.held)
            raw = self.store.read(self.read, self.read + more)
            place = self.places[raw[:, 1].astype(np.int64)]
            whole = place if self.origin is None else self.origin[place]
            earlier = np.append(self.last, whole[:-1])
            rows = np.zeros((more, 4), np.uint64)
            rows[:, 0] = self.text.at(place) << SHIFT | SEED | np.arange(self.read, self.read + more, dtype=np.uint64)
            rows[:, 1] = place
            rows[:, 3] = np.where(earlier < 0, 0, self.base.common(np.maximum(earlier, 0), whole, self.depth)).astype(np.uint64) << _16
            self.last = int(whole[-1])
            self.read += more
            self.held = np.concatenate([self.held, rows]) if len(self.held) else rows
        return self.held[:k]


class _Star:
    """Ascending places of leftmost S suffixes, kept in descending order on disk."""

    def __init__(self, places: np.ndarray):
        self.places = places

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return np.asarray(self.places[len(self.places) - 1 - at])


class _Origin:
    """Places of names in the byte text, through the levels of recursion."""

    def __init__(self, star: _Star, outer, n: int, end: int):
        self.star, self.outer, self.n, self.end = star, outer, n, end

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        inside = at < self.n
        out = np.full(len(at), self.end, np.int64)
        place = self.star[at[inside]]
        out[inside] = place if self.outer is None else self.outer[place]
        return out


class _Weights:
    """Bytes by which a name advances at most `depth`, by name."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getitem__(self, names: np.ndarray) -> np.ndarray:
        return np.asarray(self.values[names]).astype(np.int64)


def descending(text: Symbols, depth: int, *, items: int | None = None, base: Symbols | None = None, origin=None, weights=None, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tuples whose second number is the place, common prefix with the tuple before) of all suffixes, last one first.

    Suffixes that agree in `depth` bytes may stand in any order.
    """
    if not text.n:
        return
    base = base or text
    cap = -(-depth // (1 << level)) + 1
    last = level >= LEVELS or 2 << level >= depth  # names of `depth` bytes, which need no further recursion
    places, sizes, top = _leftmost(text, cap, last)
    m = places.n
    low = TupleQueue(items)
    end = np.zeros((1, 4), np.uint64)
    end[0] = SEED, text.n, 0, 0
    low.push(end)
    if m:
        star = _Star(places.view())
        order, names, count = _name(text, places.view(), sizes.view(), m, items)
        if count == m or last:
            low.add_run(_Sorted(order, text, base, origin, star, depth))
        else:
            order.close()
            reduced = Symbols(names=True)
            advance = zeros("u1", count + 1)
            for i in range(0, m, CHUNK):
                here = np.asarray(names[i : i + CHUNK])
                reduced.append(here)
                j = np.arange(i, i + len(here) + 1)
                where = np.append(star[j[:-1]], star[j[-1:]] if j[-1] < m else text.n)
                if origin is not None:
                    where = origin[where]
                advance[here.astype(np.int64)] = np.minimum(np.diff(where), depth)
            reduced.finish()
            inner = _Origin(star, origin, m, base.n)
            sorted_names = Scratch("u8", 4)
            for rows, _ in descending(reduced, depth, items=items, base=base, origin=inner, weights=_Weights(advance), level=level + 1):
                sorted_names.append(rows)
            low.add_run(Backwards(sorted_names, text, None, star))
    larger = Scratch("u8", 4)
    for rows, _ in _induce(text, base, origin, weights, None, low, depth, False):
        larger.append(rows)
    high = TupleQueue(items)
    high.add_run(Backwards(larger, text, top))
    yield from _induce(text, base, origin, weights, top, high, depth, True)
