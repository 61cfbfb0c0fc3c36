r"""License scan by patience alignment.

Method. Words are lower-case runs of letters and digits. A text is aligned to
a template like this: equal words at both ends are matched, the words that
occur exactly once in both sides are anchors, the longest increasing
subsequence of their positions is kept, and the gaps between kept anchors are
aligned in the same way. The share of the template's words that are matched in
one dense stretch of the text is the coverage; from `LEAST_COVERAGE` on the
license is reported. A notice of under `SHORT` words must stand word for word,
and where templates meet in the text only the one with the most matched words is
reported, so a word like "Lesser" or a version number decides.

Where to align. For each template a set of seed words is fixed such that the
other words make up less than `LEAST_COVERAGE` of it, so every stretch that
covers enough holds a seed. Each place of a seed opens a window of a few
template lengths around it, which grows while the matched stretch reaches its edge (places inside a stretch that is already reported
are done). The seed's place is an anchor itself where a window has no other,
as when a notice stands there twice. Texts without any seed are passed over by
one vectorised lookup of word hashes.

Cases: null and empty texts have no words; very long texts cost one window
for each seed place; repeated rows give equal results; a null id is reported
like any other; licenses that occur several times are one row with a count; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.license_texts import TEMPLATES
from strataloom.llm.session import spread, tidy
from strataloom.llm.textkernel import slices, text_bytes, word_hashes, word_spans

LEAST_COVERAGE = 0.8
#: Unmatched words in a row that end a stretch, and the first window on each side of a seed in template lengths.
LONGEST_GAP = 12
WINDOW = 1.5
#: Templates of fewer words must stand word for word.
SHORT = 15
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
#: Words too common to be seeds if others will do.
_COMMON = frozenset("the of and to a in is for this be or any by with under not on as are it you at all that from".split())


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (by first item) whose second items increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        back.append(at[i - 1] if i else -1)
        tails[i : i + 1] = [b]
        at[i : i + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[bytes], b: list[bytes], fixed: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), ascending in both. `fixed` is used as an anchor if there is no other at the top."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b), fixed)]
    while work:
        a0, a1, b0, b1, hint = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: j for j in range(b0, b1) if in_b[w := b[j]] == 1 and in_a.get(w) == 1}
        anchors = _increasing([(i, once[a[i]]) for i in range(a0, a1) if a[i] in once])
        if not anchors and hint and a0 <= hint[0] < a1 and b0 <= hint[1] < b1:
            anchors = [hint]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(x[0] + 1, y[0], x[1] + 1, y[1], None) for x, y in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def densest(matched: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest stretch of matches without a gap of over LONGEST_GAP words in the text."""
    best: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for m in matched:
        if run and m[0] - run[-1][0] > LONGEST_GAP + 1:
            run = []
        run.append(m)
        if len(run) > len(best):
            best = list(run)
    return best


class Scanner:
    def __init__(self, templates: dict[tuple[str, str], str] | None = None, least: float = LEAST_COVERAGE):
        self.least = least
        self.templates = [(name, kind, words_of(text.encode())) for (name, kind), text in sorted((templates or TEMPLATES).items())]
        self.by_seed: dict[bytes, list[int]] = {}
        for t, (_, _, words) in enumerate(self.templates):
            counts = Counter(words)
            left = len(words)
            for w in sorted(counts, key=lambda w: (w in _COMMON, counts[w], -len(w), w)):
                if left < least * len(words):
                    break
                left -= counts[w]
                self.by_seed.setdefault(w, []).append(t)
        joined = b" ".join(sorted(self.by_seed))
        starts, ends, _ = word_spans(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), _OTHER)
        self.seed_hashes = np.sort(word_hashes(np.frombuffer(joined, np.uint8), starts, ends))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold a seed word at all."""
        starts, ends, bounds = word_spans(data, offsets, _OTHER)
        hashes = word_hashes(data, starts, ends)
        hit = self.seed_hashes[np.minimum(np.searchsorted(self.seed_hashes, hashes), len(self.seed_hashes) - 1)] == hashes
        run = np.concatenate([[0], np.cumsum(hit)])
        return run[bounds[1:]] > run[bounds[:-1]]

    def scan(self, text: bytes) -> list[tuple[str, str, float, int, int, int, int]]:
        """(license, kind, coverage, matched words, first word, words spanned, occurrences) of each template found."""
        words = words_of(text)
        found: list[tuple[int, int, int, int]] = []  # matched words, first and last word, template
        done: dict[int, int] = {}
        for at, w in enumerate(words):
            for t in self.by_seed.get(w, ()):
                if at >= done.get(t, 0):
                    run = self._around(words, at, t, done.get(t, 0))
                    if run:
                        found.append((len(run), run[0][0], run[-1][0], t))
                        done[t] = run[-1][0] + 1
        # of templates that meet in the text the one with the most matched words stands there
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], x[1], len(self.templates[x[3]][2]), x[3])):
            if all(x[2] < y[1] or x[1] > y[2] for y in kept):
                kept.append(x)
        best: dict[int, tuple] = {}
        for n, first, last, t in sorted(kept, key=lambda x: x[1]):
            row = (n / len(self.templates[t][2]), n, first, last - first + 1)
            old = best.get(t)
            best[t] = (*max(row, old[:4], key=lambda r: (r[0], -r[2])), old[4] + 1) if old else (*row, 1)
        return [(*self.templates[t][:2], *row) for t, row in sorted(best.items())]

    def _around(self, words: list[bytes], at: int, t: int, least: int) -> list[tuple[int, int]]:
        """The stretch around the seed word at `at` that covers template t, or nothing. The window grows while the stretch reaches its edge."""
        template = self.templates[t][2]
        reach = int(WINDOW * len(template)) + LONGEST_GAP
        while True:
            lo, hi = max(least, at - reach), min(len(words), at + reach + 1)
            best: list[tuple[int, int]] = []
            for place in [j for j, x in enumerate(template) if x == words[at]]:
                run = densest(patience(words[lo:hi], template, (at - lo, place)))
                if len(run) > len(best):
                    best = run
                if self._covers(best, template):
                    break
            best = [(lo + i, j) for i, j in best]
            edge = best and ((lo > least and best[0][0] - lo <= LONGEST_GAP) or (hi < len(words) and hi - best[-1][0] <= LONGEST_GAP + 1))
            if not edge or (self._covers(best, template) and len(best) == len(template)):
                return best if self._covers(best, template) else []
            reach *= 2

    def _covers(self, run: list[tuple[int, int]], template: list[bytes]) -> bool:
        """A short notice must stand word for word, since each of its words may decide which license it names."""
        if len(template) < SHORT:
            return len(run) == len(template) and run[-1][0] - run[0][0] == len(template) - 1
        return len(run) >= self.least * len(template)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[tuple[str, str], str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(id_col, license, kind, coverage, n_matched, first_word, n_words, occurrences): one row for each row of docs and template found."""
    scanner = Scanner(templates, least)
    names = ["license", "kind", "coverage", "n_matched", "first_word", "n_words", "occurrences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows, owner = [], []
            for i, j in slices(offsets, 1 << 22):
                for k in np.flatnonzero(scanner.candidates(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])).tolist():
                    found = scanner.scan(data[offsets[i + k] : offsets[i + k + 1]].tobytes())
                    rows += found
                    owner += [i + k] * len(found)
            kinds = [pa.string(), pa.string(), pa.float64(), *[pa.int64()] * 4]
            cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *cols], names=["id", *names])

    fields = [T.StringType(), T.StringType(), T.DoubleType(), *[T.LongType()] * 4]
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in zip(names, fields, strict=True))])
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(tidy(run), out).withColumnRenamed("id", id_col)
