r"""Token ids in compressed binary shards with short-document access.

Method. Texts are encoded by a tokenizer file (its path is a parameter), an
end id is appended, and each document's ids are serialized (little-endian,
two bytes each if every id of the vocabulary fits, else four) and compressed
*separately* with one zstandard dictionary, trained on serialized id arrays of
a bounded sample of documents. The dictionary's SHA-256 stands in every shard,
and an index of offsets lets a reader open one document by one short read.

Shard layout (little-endian):

    8 bytes   "TOKSHRD1"
    32 bytes  SHA-256 of the dictionary (of nothing, if there is none)
    4 bytes   bytes per id       4 bytes  number of documents n
    n * 16    index: offset of the frame after the index, number of ids
    ...       frames

Shards are rows of a Parquet table (part, shard, ids of the documents, content)
in the shared folder: Spark's commit protocol makes a retried task harmless,
and any store that Spark writes to will do. Documents ascend by id over parts
and shards: the frames, not the texts, are range partitioned. `start` (the ids
of all documents before one) follows from sums over parts and shards.

Encoding. For a byte-level pre-tokenizer without normalizer, texts are cut at
white space as that pre-tokenizer cuts them, and each worker encodes equal
words once (see Encoder). The words themselves are encoded by the tokenizers
library, and any other kind of tokenizer file encodes whole texts.

Cases: a null or empty text holds the end id only; very long texts are one
frame; rows without id come first; repeated rows are documents of their own,
ordered by their contents; an empty table gives an empty store; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.session import fresh_path, materialize, small_enough, spread, tidy
from strataloom.llm.textkernel import _SPACE, slices, text_bytes

MAGIC = b"TOKSHRD1"
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Documents whose ids train the dictionary, and the bytes that each gives at most (from a place that its id decides).
SAMPLE_DOCUMENTS = 2000
SAMPLE_BYTES = 16 << 10
SHARD_BYTES = 1 << 20
PART_BYTES = 8 << 20
#: Words that a worker keeps at most while it encodes and between tasks; beyond that the older half goes.
CACHED_WORDS = 900_000
RESTING_WORDS = 500_000
#: Bytes of text that are cut into words at once.
STRETCH = 2 << 20
BROADCAST_ROWS = 1_000_000
#: Bytes that a pre-tokenizer always parts from a letter before them, and what the encoder holds for an odd word.
MARKS = np.isin(np.arange(256), list(b".,;:!?$#*&%"))
LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
ODD = b""


class Encoder:
    """Ids of texts by the tokenizers library, equal words encoded once.

    ASCII white space cuts a text into words. What the pre-tokenizer makes of a
    gap of k white space characters before a word is one piece of the first
    k - 1 and, if the last is a blank, that blank in front of the word, else a
    piece of its own; a gap that ends a text is one piece. So a text's ids are
    those of its gaps and (blank-prefixed) words, in order; marks behind a letter
    are words of their own, as they are to the pre-tokenizer. Texts with a word that begins or ends with other white space, or that holds an added token,
    are encoded whole.
    """

    limit = CACHED_WORDS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        before = json.loads(before.__getstate__()) if before is not None else {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        added = [x.content for x in tokens]
        loose = [x for x in tokens if any(c.isspace() for c in x.content) or x.lstrip or x.rstrip or x.single_word]
        self.by_word = plain and self.tokenizer.normalizer is None and not loose and not self.tokenizer.truncation and not self.tokenizer.padding
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.odd = re.compile("|".join([r"(?<![^\n ])[^\S\n ]|[^\S\n](?![^\n])", *map(re.escape, added)]))
        self.marks = MARKS & ~np.isin(np.arange(256), list("".join(added).encode()))
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.blank[[i for x, i in self.tokenizer.get_vocab().items() if x.startswith("\u0120")]] = True
        #: word, with a blank before it if there was one -> its serialized ids; ODD for an odd word. Two generations.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def rest(self, most: int) -> None:
        """Keep at most about `most` words between tasks."""
        if len(self.young) > most // 2:
            self.old, self.young = (self.young, {}) if len(self.young) <= most else ({}, {})
        elif len(self.young) + len(self.old) > most:
            self.old = {}

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that are not known yet."""
        solid = [w for w in words if not w.isspace()]
        joined = b"\n".join(solid).decode()
        if self.odd.search(joined):
            ends = list(accumulate(len(t) + 1 for t in joined.split("\n")))
            odd = {bisect_right(ends, m.start()) for m in self.odd.finditer(joined)}
            self.young.update((solid[k], ODD) for k in odd)
            solid = [w for k, w in enumerate(solid) if k not in odd]
        glued = [w for w in solid if w[0] == 0x20]
        # words behind a blank begin with the one token that holds it, so many are encoded as one text and cut there
        for i in range(0, len(glued), 2000):
            block = glued[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(block).decode()], add_special_tokens=False)[0].ids, self.kind)
            heads = np.flatnonzero(self.blank[ids]) if len(ids) else np.zeros(0, np.int64)
            if len(heads) == len(block) and heads[0] == 0:
                raw, ends = ids.tobytes(), (np.append(heads, len(ids)) * self.kind.itemsize).tolist()
                self.young.update(zip(block, [raw[x:y] for x, y in pairwise(ends)], strict=True))
            else:
                self.young.update(zip(block, self._encode_each([w.decode() for w in block]), strict=True))
        single = [w for w in solid if w[0] != 0x20] + [w for w in words if w.isspace()]
        self.young.update(zip(single, self._encode_each([w.decode() for w in single]), strict=True))

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Serialized ids of distinct words, ODD for an odd one."""
        if len(self.young) + len(words) > self.limit // 2 and len(self.young) > len(self.old):
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            kept = [words[k] for k in missing]
            again = list(map(self.old.get, kept))
            self.young.update((w, x) for w, x in zip(kept, again, strict=True) if x is not None)
            new = [w for w, x in zip(kept, again, strict=True) if x is None]
            if new:
                self._learn(new)
            for k, w in zip(missing, kept, strict=True):
                found[k] = self.young[w]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of a column; a null text is empty."""
        if not self.by_word:
            found = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return (np.concatenate(found) if found else np.zeros(0, self.kind)), np.array([len(x) for x in found], np.int64)
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        begin = self._pieces(data, offsets)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        raw, cuts = coded.dictionary.buffers()[2].to_pybytes(), np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        ids = self._known([raw[x:y] for x, y in pairwise(cuts)])
        index = coded.indices.to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(begin, offsets)
        odd = [k for k, x in enumerate(ids) if x is ODD]
        if odd:
            flags = np.zeros(len(ids), bool)
            flags[odd] = True
            run = np.concatenate([[0], np.cumsum(flags[index])])
            odd = np.flatnonzero(run[bounds[1:]] > run[bounds[:-1]]).tolist()
            for k in odd:  # such a text is encoded whole; its pieces give nothing
                ids.append(self._encode_each([texts[k].as_py()])[0])
            index = index.copy()
            for j, k in enumerate(odd):
                index[bounds[k] : bounds[k + 1]] = -1
                index[bounds[k]] = len(ids) - len(odd) + j
            ids.append(b"")  # for -1
        size = self.kind.itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        flat = np.frombuffer(b"".join(ids), self.kind)
        span = lengths[index]
        run = np.concatenate([[0], np.cumsum(span)])
        first = np.cumsum(lengths) - lengths
        out = np.empty(run[-1], self.kind)
        for a in range(0, len(index), 1 << 17):  # in steps, so that the lists of places stay small
            b = min(len(index), a + (1 << 17))
            out[run[a] : run[b]] = flat[np.repeat(first[index[a:b]] - run[a:b], span[a:b]) + np.arange(run[a], run[b])]
        return out, run[bounds[1:]] - run[bounds[:-1]]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The places where a piece (a word with its blank, or part of a gap) begins, ascending."""
        solid = ~_SPACE[data]
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        flag = np.zeros(len(data), bool)
        flag[1:] = solid[:-1] & ~solid[1:]  # a gap begins
        word = np.zeros(len(data), bool)
        word[1:] = solid[1:] & ~solid[:-1]
        word[heads] = False
        word = np.flatnonzero(word)
        flag[word - 1] = True  # the last character of a gap before a word
        flag[word[data[word - 1] != 0x20]] = True
        flag[heads] = True
        mark = np.flatnonzero(self.marks[data[1:]])  # marks right behind a letter; Latin letters with accents are 0xC3 and one byte
        last, lead = data[mark], data[mark - 1]
        letter = LETTERS[last] | ((lead == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7) & (mark > 0))
        flag[mark[letter] + 1] = True
        return np.flatnonzero(flag)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, pieces: int = CACHED_WORDS) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = pieces
    return _ENCODERS[path]


def _encoded(column: pa.Array, path: str, end_id: int, pieces: int = CACHED_WORDS) -> Iterator[np.ndarray]:
    """The ids of each text with the end id, in stretches of a few megabytes."""
    enc = encoder(path, pieces)
    _, offsets = text_bytes(column)
    for i, j in slices(offsets, STRETCH):
        flat, counts = enc.encode(column.slice(i, j - i))
        end = enc.kind.type(end_id)
        yield from (np.append(x, end) for x in np.split(flat, np.cumsum(counts)[:-1]))


def _kind(width: int) -> str:
    return f"<u{width}"


def train_dictionary(docs: DataFrame, path: str, end_id: int, pieces: int = CACHED_WORDS) -> bytes:
    """A dictionary from the documents with the least hashes of their ids.

    Where there is too little to train on, it is the samples themselves (one end
    id at least), which zstandard takes as a dictionary of plain content.
    """
    import zstandard

    chosen = docs.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
    texts = docs.join(F.broadcast(chosen.withColumnRenamed("id", "_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi").orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(SAMPLE_DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids in _encoded(batch.column(0), path, end_id, pieces):
                raw = ids.tobytes()
                at = zlib.crc32(raw) % (len(raw) // SAMPLE_BYTES + 1) * SAMPLE_BYTES
                out.append(raw[at : at + SAMPLE_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["raw"])

    samples = [bytes(r.raw) for r in texts.select("text").mapInArrow(tidy(run), "raw binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, np.array([end_id], encoder(path).kind).tobytes()[:1]) if samples else np.full(8, end_id, encoder(path).kind).tobytes()


def _grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined to some of at least this many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _compress(path: str, end_id: int, dictionary: bytes, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in _grouped(batches, STRETCH):
            ids = batch.column(0)
            frames, counts, done = [], [], 0
            size = 0
            for tokens in _encoded(batch.column(1), path, end_id, pieces):
                frames.append(packer.compress(tokens.tobytes()))
                counts.append(len(tokens))
                size += len(frames[-1])
                if size > SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(frames)), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])
                    done += len(frames)
                    frames, counts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([ids.slice(done, len(frames)), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])
        if pieces < CACHED_WORDS:  # a caller short of memory: the worker lives on, and what it has loaded with it
            _ENCODERS.clear()
        else:
            encoder(path, pieces).rest(RESTING_WORDS)

    return run


def pack_shard(frames: list[bytes], counts: list[int], width: int, dictionary_hash: bytes) -> bytes:
    index = np.zeros((len(frames), 2), "<u8")
    index[1:, 0] = np.cumsum([len(x) for x in frames])[:-1]
    index[:, 1] = counts
    return b"".join([MAGIC, dictionary_hash, np.array([width, len(frames)], "<u4").tobytes(), index.tobytes(), *frames])


def read_shard(content: bytes, dictionary: bytes, only: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each document of a shard, or of one of them, which reads that frame alone."""
    import zstandard

    view = memoryview(content)
    if bytes(view[:8]) != MAGIC or bytes(view[8:40]) != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    width, n = np.frombuffer(view[40:48], "<u4").tolist()
    index = np.frombuffer(view[48 : 48 + 16 * n], "<u8").reshape(n, 2).astype(np.int64)
    ends = np.append(index[1:, 0], len(view) - 48 - 16 * n)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for k in range(n) if only is None else [only]:
        a, b = 48 + 16 * n + int(index[k, 0]), 48 + 16 * n + int(ends[k])
        ids = np.frombuffer(opener.decompress(view[a:b], max_output_size=int(index[k, 1]) * width), _kind(width))
        if len(ids) != index[k, 1]:
            raise ValueError("a frame is damaged")
        yield ids.astype("<u4")


def _shards(width: int, dictionary_hash: bytes, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, rows, size = 0, 0, [], 0

        def close() -> pa.RecordBatch:
            content = pack_shard([x[2] for x in rows], [x[1] for x in rows], width, dictionary_hash)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(x[1] for x in rows)], pa.int64()), pa.array([[x[0] for x in rows]], pa.list_(id_type)), pa.array([content], pa.binary())], names=["part", "shard", "n_tokens", "ids", "content"])

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                rows.append(row)
                size += len(row[2])
                if size > SHARD_BYTES:
                    yield close()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield close()

    return run


def write_store(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", pieces: int = CACHED_WORDS) -> None:
    """Encode every text and write dictionary and shards below `path`; `pieces` bounds a worker's cache, not the result."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    dictionary = train_dictionary(source, tokenizer, end_id, pieces)
    width = encoder(tokenizer).kind.itemsize
    mark = hashlib.sha256(dictionary)
    spark.createDataFrame([(mark.hexdigest(), bytearray(dictionary), width, end_id)], "sha256 string, content binary, bytes_per_id int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())])
    frames = materialize(source.mapInArrow(tidy(_compress(tokenizer, end_id, dictionary, pieces)), frames), "frames")
    total = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    dealt = frames.repartitionByRange(int(total // PART_BYTES) + 1, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "n", "frame")
    shards = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("content", T.BinaryType())])
    dealt.select(F.spark_partition_id().alias("part"), "id", "n", "frame").mapInArrow(tidy(_shards(width, mark.digest(), to_arrow_type(id_type))), shards).write.parquet(f"{path}/shards")


def _read_back(dictionary: bytes, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, content, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, crcs = [], []
                for tokens in read_shard(content, dictionary):
                    counts.append(len(tokens))
                    crcs.append(zlib.crc32(tokens.tobytes()))
                starts = base + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(starts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_store(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files."""
    from pyspark.sql.pandas.types import to_arrow_type

    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().content)
    shards = spark.read.parquet(f"{path}/shards")
    id_type = shards.schema["ids"].dataType.elementType
    sums = shards.select("part", "shard", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.join(parts, "part").select("part", "shard", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))
    rows = shards.select("part", "shard", "ids", "content").join(small_enough(base, shards.count(), BROADCAST_ROWS), ["part", "shard"]).select("ids", "content", "base")
    out = T.StructType([T.StructField("id", id_type), *(T.StructField(x, T.LongType()) for x in ("start", "n_tokens", "ids_crc32"))])
    return rows.mapInArrow(tidy(_read_back(dictionary, to_arrow_type(id_type))), out).withColumnRenamed("id", id_col)


def tokenize(docs: DataFrame, *, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", pieces: int = CACHED_WORDS) -> DataFrame:
    """Write a store to a fresh folder and read it back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer=tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, pieces=pieces)
    return read_store(docs.sparkSession, path, id_col=id_col)
