r"""Quality rules: counting rules and distribution divergence.

Method. A document's character-class histogram and common-word histogram are
compared with the same histograms of each language by Jensen-Shannon distance
(base 2, so 0 to 1). The references are counted over all documents, by their
language label: the character classes, and every word that makes up at least
`COMMON_SHARE` of a language's words, plus one class for all other words. So a
language has at most 1 / COMMON_SHARE common words, and both tables grow only
with the number of labels. Every label with `LEAST_WORDS` words has a
reference, however much other text there is. A document is held against every
reference (labels may be wrong or missing) and the nearest counts: it is
rejected if its best sum of both distances is over `MOST_TOTAL`, or its best
character distance is over `MOST_CHARS`. A document whose own label has too few
words for a reference is not held against those of other languages: both
distances count as 0 and the counting rules decide. Short texts say little
about a distribution: under `MIN_WORDS`
words the word distance counts as 0, and under `MIN_CHARS` characters the
character distance too.

Besides there are counting rules: too few words, or too many words in
repeated 8-word windows.

Cases: a null text is an empty text and fails for its few words; a text of one
huge line or word is counted like any other; a null language takes part in the
counts of no reference but is judged; rows without id and repeated rows are
judged each on its own; without any reference (no labelled text) only the
counting rules decide; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.session import materialize, spread, tidy
from strataloom.llm.textkernel import _BYTE_CODE, _MULT, _SPACE, _powers, mix, slices, text_bytes, word_hashes, word_spans

WINDOW = 8
MIN_BASE_WORDS = 20
MOST_REPEATED_PERCENT = 30
COMMON_SHARE = 0.002
LEAST_WORDS = 1000
MIN_WORDS = 40
MIN_CHARS = 120
MOST_CHARS = 0.34
MOST_TOTAL = 0.62

SYMBOLS = "#*$%&|<>"
#: Character classes: lower case, upper case, digit, blank, line end, sentence mark, other mark, symbol, other letter (first byte of a longer code point), control.
N_CLASSES = 10


def _classes() -> np.ndarray:
    out = np.full(256, 9, np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    for chars, k in ((" \t\v\f", 3), ("\n\r", 4), (".,;:", 5), ("!?'\"()-_/@[]{}+=~`^\\", 6), (SYMBOLS, 7)):
        out[[ord(c) for c in chars]] = k
    out[0xC0:] = 8
    out[0x80:0xC0] = -1
    return out


_CLASS = _classes()
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def _twice(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first) for each key within its owner; owners ascend."""
    mixed = mix(keys + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.empty(len(s), bool), np.empty(len(s), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def class_histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n) * N_CLASSES, np.diff(offsets))
    seen = kind >= 0
    return np.bincount(owner[seen] + kind[seen], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def base_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(bounds), "word_chars": _per_text(lead & ~_SPACE[data], offsets), "n_symbols": _per_text(_SYMBOL[data], offsets)}

    # lines: spans between newlines inside each text
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets[:-1]] = True
    begin = np.flatnonzero(cut[: len(data)])
    finish = np.append(begin[1:], len(data))[: len(begin)]
    finish = np.where((finish > begin) & (data[np.maximum(finish - 1, 0)] == 10), finish - 1, finish) if len(begin) else finish
    has_word = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish = begin[has_word], finish[has_word]
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:-1], out=run[1:])
    key = mix((run[finish] - run[begin]) * down[begin] + (finish - begin).astype(np.uint64) * _MULT[14])
    owner = np.searchsorted(offsets, begin, side="right") - 1
    out["n_dup_lines"] = np.bincount(owner[_twice(key, owner)[1]], minlength=n)

    total = len(words)
    flat = np.zeros(max(0, total - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        flat += words[k : k + len(flat)] * _MULT[k]
    owner = np.repeat(np.arange(n), np.diff(bounds))[: len(flat)]
    at = np.flatnonzero(np.arange(len(flat)) + WINDOW <= bounds[owner + 1])
    at = at[_twice(flat[at], owner[at])[0]]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(edge[:-1]) > 0, bounds)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of two count tables (broadcast)."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-300)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


class References:
    """Class and common-word counts of each language, as arrays that go to the tasks."""

    def __init__(self, classes: dict[str, list[int]], words: dict[str, dict[int, int]], totals: dict[str, int]):
        self.langs = sorted(classes)
        self.classes = np.array([classes[x] for x in self.langs], float).reshape(len(self.langs), N_CLASSES)
        self.keys, self.counts = [], []
        for x in self.langs:
            keys = np.array(sorted(words.get(x, {})), np.int64)
            counts = [words[x][k] for k in keys.tolist()] if len(keys) else []
            self.keys.append(keys.view(np.uint64)[np.argsort(keys.view(np.uint64))])
            counts = np.array(counts, float)[np.argsort(keys.view(np.uint64))] if len(keys) else np.zeros(0)
            self.counts.append(np.append(counts, totals[x] - counts.sum()))

    def distances(self, histogram: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class distance, word distance), each text by language."""
        n = len(bounds) - 1
        chars = js_distance(histogram[:, None, :].astype(float), self.classes[None])
        chars[histogram.sum(axis=1) < MIN_CHARS] = 0
        owner = np.repeat(np.arange(n), np.diff(bounds))
        word = np.zeros((n, len(self.langs)))
        for k, (keys, counts) in enumerate(zip(self.keys, self.counts, strict=True)):
            at = np.searchsorted(keys, words)
            known = keys[np.minimum(at, len(keys) - 1)] == words if len(keys) else np.zeros(len(words), bool)
            at = np.where(known, at, len(keys))
            width = len(keys) + 1
            for i in range(0, n, 512):
                j = min(n, i + 512)
                a, b = bounds[i], bounds[j]
                table = np.bincount((owner[a:b] - i) * width + at[a:b], minlength=(j - i) * width).reshape(j - i, width)
                word[i:j, k] = js_distance(table.astype(float), counts[None])
        word[np.diff(bounds) < MIN_WORDS] = 0
        return chars, word


def _pieces(column: pa.Array):
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, 1 << 20):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = word_spans(part, own)
        yield i, j, part, own, starts, ends, bounds


def _count_references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): kind 0 a class, 1 a word; counted for each stretch of text before they leave the task."""
    for batch in batches:
        langs = np.array([x if x is not None else "" for x in batch.column(0).to_pylist()], object)
        for i, j, part, own, starts, ends, bounds in _pieces(batch.column(1)):
            words = word_hashes(part, starts, ends)
            histogram = class_histogram(part, own)
            sizes = np.diff(bounds)
            for lang in sorted({x for x in langs[i:j] if x}):
                mine = langs[i:j] == lang
                keys, counts = np.unique(words[np.repeat(mine, sizes)], return_counts=True)
                classes = histogram[mine].sum(axis=0)
                key = np.concatenate([np.arange(N_CLASSES), keys.view(np.int64)])
                kind = np.concatenate([np.zeros(N_CLASSES, np.int32), np.ones(len(keys), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(kind), pa.array(key), pa.array(np.concatenate([classes, counts]).astype(np.int64))], names=["lang", "kind", "key", "n"])


def language_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> References:
    """Counts over all documents; what reaches the driver is at most 1 / COMMON_SHARE words for each label of LEAST_WORDS words."""
    source = spread(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang != ''"))
    counts = source.mapInArrow(tidy(_count_references), "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "references")
    by_lang = counts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_WORDS)
    large = {r.lang: r.total for r in by_lang.collect()}
    classes: dict[str, list[int]] = {x: [0] * N_CLASSES for x in large}
    words: dict[str, dict[int, int]] = {x: {} for x in large}
    common = (F.col("kind") == 0) | (F.col("n") >= COMMON_SHARE * F.col("total"))
    for r in counts.join(F.broadcast(by_lang), "lang").filter(common).select("lang", "kind", "key", "n").collect():
        if r.kind == 0:
            classes[r.lang][r.key] = r.n
        else:
            words[r.lang][r.key] = r.n
    return References(classes, words, large)


def _judge(references: References):
    known = set(references.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = np.array([not x or x in known for x in batch.column(2).to_pylist()], bool)
            for i, j, part, own, starts, ends, bounds in _pieces(batch.column(1)):
                base = base_counts(part, own, starts, ends, bounds, word_hashes(part, starts, ends, fold=False))
                failed = (base["n_words"] < MIN_BASE_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
                if references.langs:
                    chars, word = references.distances(class_histogram(part, own), word_hashes(part, starts, ends), bounds)
                    near = (chars + word).argmin(axis=1)
                    char_js, word_js = (np.where(judged[i:j], x[np.arange(j - i), near], 0.0) for x in (chars, word))
                else:
                    char_js = word_js = np.zeros(j - i)
                kept = ~failed & (char_js <= MOST_CHARS) & (char_js + word_js <= MOST_TOTAL)
                cols = [batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in base.values()), *(pa.array(x) for x in (char_js, word_js, failed, kept))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", *base, "char_js", "word_js", "base_failed", "kept"])

    return run


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, five counts, char_js, word_js, base_failed, kept) for each row."""
    references = language_references(docs, text_col=text_col, lang_col=lang_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in names), *(T.StructField(x, T.DoubleType()) for x in ("char_js", "word_js")), *(T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept"))]
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    return source.mapInArrow(tidy(_judge(references)), T.StructType(fields)).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that the rules reject; the same columns, nothing is joined back."""
    references = language_references(docs, text_col=text_col, lang_col=lang_col)
    judge_batch = _judge(references)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = batch.column(at), batch.column(lang_at).cast(pa.string())
            kept = [x.column(9) for x in judge_batch(iter([pa.RecordBatch.from_arrays([text, text, lang], names=["id", "text", "lang"])]))]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return spread(docs).mapInArrow(tidy(run), docs.schema)
