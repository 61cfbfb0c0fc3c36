r"""Language identification by hyperdimensional profiles.

Method. Every letter has a random vector of +1 and -1. The trigram of
letters a, b, c is bound by rotating and multiplying: rot(rot(a)) * rot(b) * c.
A document's vector bundles (adds) the vectors of all its trigrams, a language
prototype bundles the unit vectors of its sample documents, less the mean of
all prototypes' directions, and a document takes the language with the highest
cosine. Letters are compared in lower case; all characters that are no letters
are one blank, and every text has a blank on both sides.

Learning takes at most `SAMPLE` labelled documents of each label (those with
the least hash of their id); every label is learned, and the prototypes (two
kilobytes each) go to the tasks.
Every text is read whole, in learning and in prediction.

Cases: a null text, or one without a letter, is `und` with score 0; a text of
one letter has one trigram; very long texts are counted in stretches; null
labels teach nothing; a null id counts as held out; repeated rows get equal
results; without any labelled text everything is `und`; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.quality_net import held_out
from strataloom.llm.session import spread, tidy
from strataloom.llm.textkernel import mix

SIZE = 512
SAMPLE = 400
SEED = 5
UNKNOWN = "und"
STRETCH = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of +1 and -1 of each code point (0 is the blank), from a mixed hash of the code point."""
    word = np.arange(SIZE // 64, dtype=np.uint64)
    bits = mix(mix(points.astype(np.uint64)[:, None] + np.uint64(SEED << 32)) + word * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * 2 - 1)[:, :SIZE]


def trigram_vectors(points: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams whose letters are given as places in `points`."""
    letters = letter_vectors(points)
    twice, once = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (twice[a] * once[b] * letters[c]).astype(np.float32)


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(vector, has a letter) of each text."""
    out = np.zeros((len(texts), SIZE), np.float32)
    lettered = np.zeros(len(texts), bool)
    group: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        text = np.frombuffer("".join(f" {t} " for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.where(_letters()[text], text, np.uint32(0))
        there = np.zeros(0x110000, bool)
        there[found] = True
        there[0] = True
        points = np.flatnonzero(there)
        kind = (np.cumsum(there) - 1)[found]
        sizes = np.array([len(t) + 2 for _, t in group])
        owner = np.repeat(np.arange(len(group)), sizes)
        k = len(points)
        code = (kind[:-2] * k + kind[1:-1]) * k + kind[2:]
        fine = (owner[:-2] == owner[2:]) & (code > 0)
        if k**3 <= 1 << 24:
            used = np.zeros(k**3, bool)
            used[code[fine]] = True
            known = np.flatnonzero(used)
            at = (np.cumsum(used) - 1)[code[fine]]
        else:
            known, at = np.unique(code[fine], return_inverse=True)
        vectors = trigram_vectors(points, known // (k * k), known // k % k, known % k)
        own = owner[:-2][fine]
        cuts = np.searchsorted(own, np.arange(0, len(group) + 1, 32))
        cuts = np.append(cuts, len(own)) if len(group) % 32 else cuts
        for b in range(0, len(group), 32):
            lo, hi = cuts[b // 32], cuts[b // 32 + 1]
            n = min(32, len(group) - b)
            table32 = np.bincount((own[lo:hi] - b) * len(known) + at[lo:hi], minlength=n * len(known)).reshape(n, -1).astype(np.float32)
            some = np.flatnonzero(table32.any(axis=0))
            sums = table32[:, some] @ vectors[some]
            for (i, _), v in zip(group[b : b + n], sums, strict=True):
                out[i] += v
        for (i, _), has in zip(group, np.logical_or.reduceat(kind > 0, np.concatenate([[0], np.cumsum(sizes)[:-1]])), strict=True):
            lettered[i] |= has

    for i, text in enumerate(texts):
        low = (text or "").lower()
        for k in range(0, max(1, len(low)), STRETCH):
            group.append((i, low[k : k + STRETCH]))
            size += len(group[-1][1])
            if size >= STRETCH:
                flush()
                group, size = [], 0
    if group:
        flush()
    return out, lettered


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


class Profiles:
    """Language prototypes."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.langs = sorted(sums)
        units = _unit(np.array([sums[x] for x in self.langs], np.float32).reshape(len(self.langs), SIZE))
        self.mean = units.mean(axis=0) if len(self.langs) > 1 else np.zeros(SIZE, np.float32)
        self.prototypes = _unit(units - self.mean)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        vectors, lettered = bundle(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = _unit(_unit(vectors) - self.mean) @ self.prototypes.T
        best = cosine.argmax(axis=1)
        scores = np.where(lettered, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], scores


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Prototypes from a bounded sample of labelled rows that are not held out."""
    keys = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & ~held_out("_id"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = keys.withColumn("_place", place).filter(F.col("_place") <= sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.join(chosen.select("_id", "_lang").distinct(), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi").select("lang", "text").coalesce(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, lettered = bundle(batch.column(1).to_pylist())
            for lang, v, ok in zip(batch.column(0).to_pylist(), _unit(vectors), lettered, strict=True):
                if ok:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in sorted(rows.mapInArrow(tidy(run), "lang string, v array<double>").collect(), key=str):
        total[r.lang] = total.get(r.lang, 0) + np.array(r.v)
    return Profiles(total)


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = profiles.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    source = spread(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(tidy(run), out).withColumnRenamed("id", id_col)
