r"""Quality classifier: a byte-level convolutional network in numpy.

Method. A text's UTF-8 bytes are cut into overlapping chunks that cover all of
it. Bytes are embedded, `FILTERS` learned filters of `WIDTH` bytes slide over
each chunk byte by byte, and each filter's rectified response is pooled by its
maximum over all chunks of the document; its mean over the chunks stands beside
it, which tells a few hits from many. A small hidden layer combines both into
one probability. Everything is trained by Adam on the labelled sample, with a
fixed seed; the whole text of each of its documents takes part in every pass.

Learning takes at most `SAMPLE` labelled documents (those with the least hash
of their id among the permitted ones, of equal ids that of their text). Where
labels of one id contradict each other it counts as good.

Cases: a null or empty text is one chunk of padding and gets the score that
the network gives to it; a text shorter than a chunk is padded; very long
texts are scored in stretches of chunks; a null id is scored and counts as
held out; repeated rows get equal scores; null labels are no labels; without
labels, or with labels of one class only, every score is the share of good
labels (0.5 if there are none); empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.session import spread, tidy
from strataloom.llm.textkernel import text_bytes

SAMPLE = 600
EPOCHS = 10
CHUNK = 512
STEP = 448  # neighbours share 64 bytes
EMBED = 6
WIDTH = 8
FILTERS = 24
HIDDEN = 16
SEED = 11
THRESHOLD = 0.3
_AT = np.arange(0, CHUNK - WIDTH + 1)
#: Chunks whose responses are in memory at once.
BLOCK = 128


def chunks(data: np.ndarray) -> np.ndarray:
    """(n, CHUNK) bytes; 0 is padding. Every byte of the text is in a chunk."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    """The trained weights; plain arrays, so that it travels to the tasks."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "w1": rng.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)),
            "b1": np.zeros(HIDDEN),
            "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift, self.scale = np.zeros(2 * FILTERS, np.float32), np.ones(2 * FILTERS, np.float32)
        self.constant: float | None = None

    def _windows(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]  # n, CHUNK, EMBED
        n = len(x)
        view = np.lib.stride_tricks.as_strided(e, (n, len(_AT), WIDTH * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(view).reshape(n * len(_AT), WIDTH * EMBED)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Chunk features: maximum and mean of each filter over the chunk."""
        out = np.empty((len(x), 2 * FILTERS), np.float32)
        for i in range(0, len(x), 64):
            h = self._windows(x[i : i + 64]) @ self.p["filters"] + self.p["bias"]
            h = np.maximum(h, 0).reshape(-1, len(_AT), FILTERS)
            out[i : i + 64, :FILTERS], out[i : i + 64, FILTERS:] = h.max(axis=1), h.mean(axis=1)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Of document features."""
        if self.constant is not None:
            return np.full(len(features), self.constant)
        f = (features - self.shift) / self.scale
        z = np.tanh(f @ self.p["w1"] + self.p["b1"]) @ self.p["w2"] + self.p["b2"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each text of a buffer."""
        n = len(offsets) - 1
        features = np.zeros((n, 2 * FILTERS), np.float64)
        held, owner, size = [], [], 0

        def flush() -> None:
            pooled = self.pooled(np.concatenate(held))
            heads = np.concatenate([[0], np.cumsum([c for _, c in owner])[:-1]]).astype(np.int64)
            tops = np.maximum.reduceat(pooled[:, :FILTERS], heads, axis=0)
            sums = np.add.reduceat(pooled[:, FILTERS:].astype(np.float64), heads, axis=0)
            for (i, _), top, total in zip(owner, tops, sums, strict=True):
                features[i, :FILTERS] = np.maximum(features[i, :FILTERS], top)
                features[i, FILTERS:] += total

        totals = np.ones(n)
        for i in range(n):
            c = chunks(data[offsets[i] : offsets[i + 1]])
            totals[i] = len(c)
            for k in range(0, len(c), 2048):
                held.append(c[k : k + 2048])
                owner.append((i, len(held[-1])))
                size += len(held[-1])
                if size >= 1024:
                    flush()
                    held, owner, size = [], [], 0
        if held:
            flush()
        features[:, FILTERS:] /= totals[:, None]
        return self.probability(features.astype(np.float32))

    def gradient(self, texts: list[np.ndarray], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, its gradient) of documents given as chunks; long ones are gone through in blocks, twice."""
        p = self.p
        counts = np.array([len(c) for c in texts])
        owner = np.repeat(np.arange(len(texts)), counts)
        x = np.concatenate(texts)
        kept = len(x) <= BLOCK
        steps = [(i, min(len(x), i + BLOCK)) for i in range(0, len(x), BLOCK)]
        pooled = np.empty((len(x), 2 * FILTERS), np.float32)
        place = np.empty((len(x), FILTERS), np.int64)
        for i, j in steps:
            win = self._windows(x[i:j])
            h = np.maximum(win @ p["filters"] + p["bias"], 0).reshape(j - i, len(_AT), FILTERS)
            place[i:j] = h.argmax(axis=1)
            pooled[i:j, :FILTERS] = np.take_along_axis(h, place[i:j, None], 1)[:, 0]
            pooled[i:j, FILTERS:] = h.mean(axis=1)
        heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
        top = np.maximum.reduceat(pooled[:, :FILTERS], heads, axis=0)
        mean = np.add.reduceat(pooled[:, FILTERS:], heads, axis=0) / counts[:, None]
        # the first chunk of each document that holds a filter's maximum gets its gradient
        hit = pooled[:, :FILTERS] == top[owner]
        run = np.cumsum(hit, axis=0)
        before = np.concatenate([np.zeros((1, FILTERS), np.int64), run])[heads]
        hit &= run - before[owner] == 1
        f = ((np.concatenate([top, mean], axis=1) - self.shift) / self.scale).astype(np.float32)
        t = np.tanh(f @ p["w1"] + p["b1"])
        z = np.clip(t @ p["w2"] + p["b2"], -30, 30)
        loss = float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * labels))
        dz = (1 / (1 + np.exp(-z)) - labels) / len(texts)
        g = {"w2": t.T @ dz, "b2": dz.sum(keepdims=True)}
        dt = dz[:, None] * p["w2"] * (1 - t * t)
        g["w1"], g["b1"] = f.T @ dt, dt.sum(axis=0)
        dfeature = (dt @ p["w1"].T) / self.scale
        dtop, dmean = dfeature[:, :FILTERS], dfeature[:, FILTERS:] / counts[:, None] / len(_AT)
        g["filters"], g["bias"], g["embed"] = np.zeros_like(p["filters"]), np.zeros(FILTERS, np.float32), np.zeros((256, EMBED))
        for i, j in steps:
            if not kept:
                win = self._windows(x[i:j])
                h = np.maximum(win @ p["filters"] + p["bias"], 0).reshape(j - i, len(_AT), FILTERS)
            dh = np.repeat(dmean[owner[i:j], None], len(_AT), axis=1).astype(np.float32)
            chunk, filter_ = np.nonzero(hit[i:j])
            dh[chunk, place[i + chunk, filter_], filter_] += dtop[owner[i + chunk], filter_]
            dh = (dh * (h > 0)).reshape(-1, FILTERS)
            g["filters"] += win.T @ dh
            g["bias"] += dh.sum(axis=0)
            dwin = (dh @ p["filters"].T).reshape(j - i, len(_AT), WIDTH, EMBED)
            de = np.zeros((j - i, CHUNK, EMBED), np.float32)
            for k in range(WIDTH):
                de[:, _AT + k] += dwin[:, :, k]
            flat = x[i:j].ravel()
            g["embed"] += np.stack([np.bincount(flat, de[:, :, k].ravel(), 256) for k in range(EMBED)], axis=1)
        return loss, g


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = SEED, batch: int = 48, rate: float = 4e-3) -> Network:
    """Fit a network; deterministic for equal input."""
    net = Network(seed)
    labels = np.asarray(labels, np.float32)
    if len(texts) == 0 or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(texts) else 0.5
        return net
    rng = np.random.default_rng(seed + 1)
    every = [chunks(np.frombuffer(t, np.uint8)) for t in texts]
    first = np.array([np.concatenate([x[:, :FILTERS].max(axis=0), x[:, FILTERS:].mean(axis=0)]) for x in (net.pooled(c) for c in every)])
    net.shift, net.scale = first.mean(axis=0), first.std(axis=0) + 1e-3
    p = net.p
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            _, g = net.gradient([every[d] for d in docs], labels[docs])
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.9 * step / total)
            for k, v in p.items():
                m, s = moment[k]
                grad = g[k].astype(np.float32).reshape(v.shape) + 1e-4 * v
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                v -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """Train on at most `sample` labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    # ids whose text is missing give no row; a few spare ones make up for them
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    got = rows.select("id", F.col("text").cast("binary").alias("raw"), F.col("_label").cast("int").alias("label")).orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(sample).collect()
    got.sort(key=lambda r: (str(r.id), bytes(r.raw)))
    return train([bytes(r.raw) for r in got], np.array([r.label for r in got], np.float32))


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(net.score(*text_bytes(batch.column(2))))], names=["id", "held_out", "score"])

    return run


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row."""
    source = spread(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")))
    out = source.mapInArrow(tidy(_score(net)), T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]))
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
