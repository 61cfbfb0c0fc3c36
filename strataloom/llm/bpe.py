r"""Byte-pair encoding and decoding with a contiguous array of ranks.

Method. A short word is a row of part ids and a row of the ranks of adjacent
parts, both contiguous. The least rank of the row is searched (the leftmost of
equal ones), the boundary behind it is deleted by moving the rest of the row one
place to the left, and the ranks of the two neighbouring pairs are refreshed;
a row without a rank is finished. Many distinct words are rows of one matrix, so
that every step is a few numpy calls over all of them. Words of more than
SHORT bytes, where moving the row would cost the square of its length, keep the
boundaries in linked arrays and the ranks in a heap instead.

The pre-tokenizer of the tokenizers library cuts texts into words; what merges
them, and what decodes, is written here. Equal words are merged once for each
worker (see token_store.Encoder). Ids are serialized as little-endian unsigned
32-bit integers.

Tokenizer files: byte-level BPE without normalizer, dropout, affixes and added
prefix blank; added tokens without strip or single-word flags. Truncation and
padding of a file are not applied. Anything else raises ValueError, since its
result would differ from the library's.

Cases: a null or empty text has no ids and decodes to an empty text; texts are
never cut; an added token inside a text is its id; ids that no token has decode
to nothing; bytes that are not UTF-8 decode to U+FFFD; a null id column, repeated
rows and an empty table are rows like any other; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.session import spread, tidy
from strataloom.llm.textkernel import slices, text_bytes
from strataloom.llm.token_store import CACHED_WORDS, MARKS, ODD, RESTING_WORDS, STRETCH, Encoder

#: Longest word in bytes that is merged as a row of the matrix.
SHORT = 64
#: Cells of a matrix of words.
CELLS = 1 << 17
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Vocabulary:
    """Merges by rank, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, before, decoder = config["model"], config.get("pre_tokenizer") or {}, config.get("decoder") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or config.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.added = {x["content"]: x["id"] for x in config.get("added_tokens", [])}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or any(c.isspace() for c in x["content"]) for x in config.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that change the text around them")
        vocab = model["vocab"]
        symbols = byte_symbols()
        if missing := [s for s in symbols if s not in vocab]:
            raise ValueError(f"{path} has no token for {len(missing)} bytes")
        #: id of the token of each byte, by the character that stands for it
        self.symbol = np.zeros(512, np.int32)
        self.symbol[[ord(s) for s in symbols]] = [vocab[s] for s in symbols]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(max(vocab.values()), max(self.added.values(), default=0)) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.lexsort((np.arange(len(keys)), keys))
        order = order[np.concatenate([keys[order][1:] != keys[order][:-1], [True]])] if len(keys) else order  # of a pair that stands twice, the last
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        byte = {s: b for b, s in enumerate(symbols)}
        pieces = [b""] * self.size
        for token, i in [*vocab.items(), *self.added.items()]:
            pieces[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.lengths = np.array([*map(len, pieces), 0], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_RANK if they do not merge (negative ids never do)."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK) if len(self.keys) else np.full(key.shape, NO_RANK)

    def merge(self, words: list[str], kind: np.dtype) -> list[bytes]:
        """Serialized ids of words that are written in byte symbols."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        begin = np.cumsum(size) - size
        out = [b""] * len(words)
        order = np.argsort(size, kind="stable")
        ends = size[order]
        i, short = 0, int(np.searchsorted(ends, SHORT, side="right"))
        while i < short:
            wide = int(np.searchsorted(ends, max(ends[i] + 1, ends[i] * 5 // 4), side="right"))
            j = min(short, wide, i + max(1, CELLS // max(1, int(ends[i]))))
            rows = order[i:j]
            flat, counts = self._merge_rows(symbols, begin[rows], size[rows])
            raw, cuts = flat.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(counts) * kind.itemsize]).tolist()
            for r, a, b in zip(rows.tolist(), cuts[:-1], cuts[1:], strict=True):
                out[r] = raw[a:b]
            i = j
        for r in order[short:].tolist():
            out[r] = self._merge_long(symbols[begin[r] : begin[r] + size[r]]).astype(kind).tobytes()
        return out

    def _merge_rows(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each): scan for the least rank, delete a boundary, refresh its neighbours."""
        width = int(size.max()) if len(size) else 0
        if width == 0:
            return np.zeros(0, np.int32), size
        column = np.arange(width)
        part = np.where(column < size[:, None], symbols[np.minimum(begin[:, None] + column, len(symbols) - 1)], -1).astype(np.int32)
        rank = np.full(part.shape, NO_RANK, np.int32)
        rank[:, :-1] = self.ranks(part[:, :-1], part[:, 1:])
        done = part.copy()
        live = np.arange(len(size))
        while len(live):
            k = rank.argmin(axis=1)
            row = np.arange(len(live))
            best = rank[row, k]
            open_ = best != NO_RANK
            if not open_.all():
                done[live[~open_]] = part[~open_]
                live, part, rank, k, best = live[open_], part[open_], rank[open_], k[open_], best[open_]
                if not len(live):
                    break
                row = np.arange(len(live))
            part[row, k] = self.made[best]
            behind = column[None, :-1] > k[:, None]  # what moves one place to the left
            part[:, :-1] = np.where(behind, part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            part[:, -1], rank[:, -1] = -1, NO_RANK
            after = np.minimum(k + 1, width - 1)
            rank[row, k] = np.where(k + 1 < width, self.ranks(part[row, k], part[row, after]), NO_RANK)
            before = np.maximum(k - 1, 0)
            rank[row, before] = np.where(k > 0, self.ranks(part[row, before], part[row, k]), rank[row, before])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """A word beyond SHORT: boundaries as links, ranks in a heap; equal ranks leftmost first."""
        n = len(symbols)
        part = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks(symbols[:-1], symbols[1:])
        heap = [(r, k) for k, r in enumerate(rank.tolist()) if r != NO_RANK]
        rank = rank.tolist() + [NO_RANK]
        heapq.heapify(heap)
        made, pair = self.made.tolist(), {}

        def look(a: int, b: int) -> int:
            if (a, b) not in pair:
                pair[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return pair[a, b]

        while heap:
            r, k = heapq.heappop(heap)
            if part[k] < 0 or rank[k] != r:
                continue
            gone = after[k]
            part[k], part[gone] = made[r], -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0:
                    rank[left] = look(part[left], part[after[left]]) if after[left] < n else NO_RANK
                    if rank[left] != NO_RANK:
                        heapq.heappush(heap, (rank[left], left))
        return np.array([p for p in part if p >= 0], np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids."""
        ids = np.where(ids < self.size, ids, self.size).astype(np.int64)  # the last length is 0: no such token
        span = self.lengths[ids]
        run = np.concatenate([[0], np.cumsum(span)])
        flat = np.empty(run[-1], np.uint8)
        for a in range(0, len(ids), 1 << 17):
            b = min(len(ids), a + (1 << 17))
            flat[run[a] : run[b]] = self.bytes[np.repeat(self.first[ids[a:b]] - run[a:b], span[a:b]) + np.arange(run[a], run[b])]
        raw, cuts = flat.tobytes(), run[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class RankEncoder(Encoder):
    """The encoder of token_store with words merged by Vocabulary in place of the library."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary = Vocabulary(path)
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.by_word = True
        self.kind = np.dtype("<u2" if self.vocabulary.size <= 1 << 16 else "<u4")
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.odd = re.compile("|".join([r"(?<![^\n ])[^\S\n ]|[^\S\n](?![^\n])", *map(re.escape, added)]))
        self.marks = MARKS & ~np.isin(np.arange(256), list("".join(added).encode()))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _merge_each(self, cut: list[list[str]]) -> list[bytes]:
        """Serialized ids of lists of words; equal words are merged once."""
        words = list(dict.fromkeys(w for ws in cut for w in ws))
        ids = dict(zip(words, self.vocabulary.merge(words, self.kind), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for ws in cut]

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        """Whole texts: cut at added tokens, then by the pre-tokenizer."""
        out = []
        for text in texts:
            parts, at = [], 0
            for m in self.special.finditer(text) if self.special else ():
                parts += [text[at : m.start()], m.group()]
                at = m.end()
            parts.append(text[at:])
            plain = self._merge_each([[w for w, _ in self.cut(t)] for t in parts[::2]])
            marks = [np.array([self.vocabulary.added[t]], self.kind).tobytes() for t in parts[1::2]]
            out.append(b"".join(x for both in zip(plain, [*marks, b""], strict=True) for x in both))
        return out

    def _learn(self, words: list[bytes]) -> None:
        blank = [w for w in words if w.isspace()]
        solid = [w for w in words if not w.isspace()]
        if self.odd.search(b"\n".join(solid).decode()):
            odd = {w for w in solid if self.odd.search(w.decode())}
            self.young.update(dict.fromkeys(odd, ODD))
            solid = [w for w in solid if w not in odd]
        for i in range(0, len(solid), 4096):
            block = solid[i : i + 4096]
            cut: list[list[str]] = [[]]
            for w, _ in self.cut(b"\n".join(block).decode()):
                if w == "Ċ":  # the newline between two words
                    cut.append([])
                else:
                    cut[-1].append(w)
            self.young.update(zip(block, self._merge_each(cut), strict=True))
        self.young.update(zip(blank, self._merge_each([[w for w, _ in self.cut(b.decode())] for b in blank]), strict=True))


_ENCODERS: dict[str, RankEncoder] = {}


def rank_encoder(path: str, pieces: int = CACHED_WORDS) -> RankEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = RankEncoder(path)
    _ENCODERS[path].limit = pieces
    return _ENCODERS[path]


def _binary(values: list[bytes], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.binary()).cast(kind)


def _run(path: str, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(path, pieces)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            for i, j in slices(offsets, STRETCH):
                flat, counts = enc.encode(texts.slice(i, j - i))
                raw, cuts = flat.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts) * 4]).tolist()
                ids = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                decoded = enc.vocabulary.decode(flat, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(ids, pa.binary()), _binary(decoded, pa.string())], names=["id", "ids", "decoded"])
        enc.rest(RESTING_WORDS)

    return run


def encode_decode(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", pieces: int = CACHED_WORDS) -> DataFrame:
    """(id_col, ids, decoded): serialized ids of every whole text, and the text that they decode to; `pieces` bounds a worker's cache, not the result."""
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(tidy(_run(tokenizer, pieces)), out).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """The columns of `encoded` and decoded: the text of each row's serialized ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_encoder(tokenizer).vocabulary
        for batch in batches:
            raw = [x or b"" for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            texts = vocabulary.decode(np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
