r"""Runs: maximal periodic stretches of words, by Lyndon arrays on an ordered alphabet.

Method (after Ellert and Fischer's linear-time runs). For an order of the words,
the longest Lyndon word that starts at a place ends before the next smaller
suffix. One pass from left to right finds these edges with a stack of pending
places; every comparison of two suffixes keeps how far they match. A match that
follows from the two matches beside it is not compared again, one that lies
inside the farthest match so far is taken over from its mirror image there, and
only what lies beyond is compared symbol by symbol. Every run has a Lyndon root
under this order or its reverse, and the edge at the first copy of the root
gives the run: what matches behind the edge, and fewer symbols than the period
before it. There are no suffix arrays or trees and no hashes of substrings.

Only stretches that can hold a run of the asked exponent are searched. In a run
of period q and exponent k each word but the first q was last seen at most q
words before, so it lies in a stretch of m words, each seen at most m / (k - 1)
words before. Such stretches (with q words before them) are found for a whole
Arrow batch by one sort of its words, without loss.

A run is a stretch with smallest period q and at least max(least, power * q)
words that no neighbouring word extends; words are the maximal runs of bytes
other than 0x20 and 0x09-0x0D, compared as bytes, and numbered from 0.

Cases: a null or empty text, or one without words, has no runs and collapses to
an empty text; very long texts are searched whole; runs may overlap, and a word
goes if any run holds it behind that run's first period; repeated rows and null
ids are rows like any other; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.session import spread, tidy
from strataloom.llm.textkernel import _SPACE, slices, text_bytes, word_spans

LEAST = 6
POWER = 4
#: Bytes of text that are searched at once.
STRETCH = 2 << 20
#: Symbols that are compared one by one before blocks of them are.
STEPS = 24
#: Rounds in which stretches shrink; what is left is searched.
ROUNDS = 12

RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def _matched(s: list[int], flat: np.ndarray, a: int, b: int, have: int) -> int:
    """How many symbols the suffixes at a < b have in common, given that `have` match."""
    n, k = len(s), have
    stop = min(n - b, have + STEPS)
    while k < stop and s[a + k] == s[b + k]:
        k += 1
    if k < stop or b + k == n:
        return k
    block = 64
    while b + k < n:
        m = min(block, n - b - k)
        differ = flat[a + k : a + k + m] != flat[b + k : b + k + m]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, block = k + m, 2 * block
    return k


def lyndon_edges(s: list[int]) -> tuple[list[int], list[int]]:
    """(next smaller suffix of each place, symbols that match there); the end of the text is smaller than every symbol."""
    n, flat = len(s), np.array(s, np.int64)
    after, match = [n] * n, [0] * n
    before, match_before = [-1] * n, [0] * n
    far_l = far_r = far_end = 0  # the match that reaches farthest: suffixes far_l and far_r agree up to far_end
    for r in range(1, n):
        left, have, exact = r - 1, 0, False
        while left >= 0:
            if not exact:
                if left >= far_r and r + have < far_end:
                    shift = far_r - far_l
                    a, b = left - shift, r - shift
                    if after[a] == b:
                        have, exact = (match[a], True) if match[a] < far_end - r else (far_end - r, False)
                    elif before[b] == a:
                        have, exact = (match_before[b], True) if match_before[b] < far_end - r else (far_end - r, False)
                if not exact:
                    have = _matched(s, flat, left, r, have)
                    if r + have > far_end:
                        far_l, far_r, far_end = left, r, r + have
            if r + have < n and s[left + have] < s[r + have]:
                before[r], match_before[r] = left, have
                break
            after[left], match[left] = r, have
            # the suffix that comes before `left` matches r as far as both match `left`, and further only if these are equal
            exact = match_before[left] != have
            have = min(match_before[left], have)
            left = before[left]
    return after, match


def runs_of(s: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, power * period) symbols, by start and period; power is 2 at least."""
    found, n, top = set(), len(s), max(s, default=0)
    for order in (s, [top - x for x in s]):
        after, match = lyndon_edges(order)
        for i, (j, m) in enumerate(zip(after, match, strict=True)):
            p = j - i
            need = max(least, power * p)
            if j == n or m + 2 * p - 1 < need:
                continue
            t = 0
            while t < p and t < i and s[i - t - 1] == s[j - t - 1]:
                t += 1
            if t < p and t + p + m >= need:
                found.add((i - t, p, t + p + m))
    return [(start, length, p) for start, p, length in sorted(found)]


def _stretches(words: np.ndarray, first: np.ndarray, least: int, power: int) -> Iterator[tuple[int, int]]:
    """Disjoint ranges of places that hold every run of the asked size; `first` are the texts' bounds."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(text * (int(words.max(initial=0)) + 1) + words, kind="stable")
    same = (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])
    back = np.full(n, n + 1, np.int64)  # distance to the same word before
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(back <= n)
    head = tail = at
    for _ in range(ROUNDS):
        if not len(at):
            return
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) > 0)) + 1
        head, tail = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + 1
        size = np.repeat(tail - head, np.diff(np.concatenate([[0], cut, [len(at)]])))
        keep = (back[at] * (power - 1) <= size) & (size * power >= least * (power - 1))
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) > 0)) + 1
    head, tail = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + 1
    head = np.maximum(head - (tail - head) // (power - 1), first[text[head]])
    head = np.minimum.accumulate(head[::-1])[::-1]  # a long stretch may reach back over shorter ones
    begins = np.flatnonzero(np.concatenate([[True], head[1:] >= tail[:-1]]))
    yield from zip(head[begins].tolist(), tail[np.append(begins[1:], len(tail)) - 1].tolist(), strict=True)


def _search(texts: pa.Array, least: int, power: int) -> list[pa.Array]:
    """[n_words, runs, collapsed] of a column of texts."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    size = ends - starts
    packed = data[~_SPACE[data]]
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found, places, drop = [], [], np.zeros(len(words) + 1, np.int64)
    for a, b in _stretches(words, first, least, power):
        base = int(first[np.searchsorted(first, a, side="right") - 1])
        for start, length, p in runs_of(words[a:b].tolist(), least, power):
            found.append((a + start - base, length, p))
            places.append(a + start)
            drop[a + start + p] += 1
            drop[a + start + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    run_bounds = np.searchsorted(np.array(places, np.int64), first).astype(np.int32)
    columns = np.array(found, np.int64).reshape(-1, 3).T
    runs = pa.ListArray.from_arrays(pa.array(run_bounds), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["start", "length", "period"]))
    return [pa.array(np.diff(first).astype(np.int64)), runs, _joined(packed, size, first, keep)]


def _joined(packed: np.ndarray, size: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    kept = np.concatenate([[0], np.cumsum(keep)])
    last = np.flatnonzero(keep)[kept[first[1:]][kept[first[1:]] > kept[first[:-1]]] - 1]  # the last kept word of each text
    behind = np.cumsum(size + 1) - 1  # where the blank behind each word stands
    spaced = np.full(int(behind[-1]) + 1 if len(size) else 0, 0x20, np.uint8)
    letter = np.ones(len(spaced), bool)
    letter[behind] = False
    spaced[letter] = packed
    hold = np.repeat(keep, size + 1)
    hold[behind[last]] = False
    ends = np.concatenate([[0], np.cumsum(hold)])
    edge = np.concatenate([[0], behind + 1])[first]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(ends[edge].astype(np.int64)), pa.py_buffer(spaced[hold])).cast(pa.string())


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """(id_col, n_words, runs array<struct<start, length, period>> by start and period, collapsed): the runs of every whole text, and the text with each run reduced to its first period."""
    if power < 2:
        raise ValueError("a run has an exponent of at least 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, STRETCH):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_search(batch.column(1).slice(i, j - i), least, power)], names=["id", "n_words", "runs", "collapsed"])

    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return source.mapInArrow(tidy(run), out).withColumnRenamed("id", id_col)


def with_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, where the text of each tenth id (by the CRC-32 h of its digits) repeats a stretch of its own words from some word to its end; a null id or text stays as it is."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")

    def let(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        bounds = F.struct((g % n).alias("a"), (F.floor((n - g % n) / (3 + g % 8)).cast("long") + 1).alias("p"))
        place = lambda i, x: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        return let(bounds, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i, x).cast("int"))), " "))

    words = F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col(text_col)))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), changed).otherwise(F.col(text_col)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return rows.select(id_col, "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
