"""Vectorised byte kernels shared by the text operators.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of all
texts lie in one numpy buffer, so cost is a few passes over the bytes and no
Python loop runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strataloom.llm.session import HELD

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


_BYTE_CODE = _random_words(256, 20240517)
_MULT = _random_words(16, 7) | np.uint64(1)
_BASE = int(_random_words(1, 99)[0] | np.uint64(5))
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}
HELD.append(_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown as needed."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = -(-n // 65536) * 65536
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the total) of the maximal runs of bytes outside `space` (0x20 and 0x09-0x0D)."""
    solid = ~space[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased if fold)."""
    code = _BYTE_CODE[_FOLD] if fold else _BYTE_CODE
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(code[data] * up[:-1], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[15])


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, with offsets.

    A text with fewer than `size` words has one shingle, its whole sequence;
    a text without words has none.
    """
    n = len(bounds) - 1
    total = len(words)
    flat = np.zeros(max(0, total - size + 1), dtype=np.uint64)
    for k in range(size):
        flat += words[k : k + len(flat)] * _MULT[k]
    flat = mix(flat + np.uint64(size))
    out, offsets = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= size:
            s = np.sort(flat[a : b - size + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif b > a:
            s = mix((words[a:b] * _MULT[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            s = flat[:0]
        out.append(s)
        offsets[i + 1] = offsets[i] + len(s)
    return (np.concatenate(out) if out else flat[:0]), offsets


def slices(batch_offsets: np.ndarray, limit: int):
    """Ranges of rows whose bytes stay near `limit`, so that work arrays stay small; a longer row is alone."""
    i, n = 0, len(batch_offsets) - 1
    while i < n:
        j = int(np.searchsorted(batch_offsets, batch_offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
