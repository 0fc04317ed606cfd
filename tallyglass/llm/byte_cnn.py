"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector;
learned filters run over the chunk and their best response in it is kept (max pooling). A document is the
maximum and the mean of its chunks' vectors, and a small dense layer combines them into one probability.

Training runs on the driver over at most `sample` labelled documents of each class (those of least id hash
among texts of at most `sample_bytes`), with the class sizes of all labelled documents put back into the bias.
Scoring is one map over all rows; chunks are cut out in pieces of a fixed number, so that beside a text only
its pooled vectors (one of 192 bytes for 192 bytes of text) are held.

Defined results: null text counts as empty; an empty text is one chunk of padding; repeated rows score
alike; an id with several labels has the least, one with several texts teaches the least; without labels of both classes every score is the known share of label 1 (0.5 without any); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks

CHUNK, STRIDE = 256, 192
FILTER, HOP, VECTOR, FILTERS, DENSE = 8, 4, 8, 48, 24
PLACES = (CHUNK - FILTER) // HOP + 1
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH = 1500, 1 << 15, 6, 32
PIECE = 512
PREDICT = 0.3


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all chunks of the documents, ends of their documents, and the number of chunks of each document."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(offsets[:-1], counts) + step * STRIDE, np.repeat(offsets[1:], counts), counts


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The chunks at the given places, padded with byte 0 behind their documents."""
    at = starts[:, None] + np.arange(CHUNK)
    chunks = np.take(data, np.minimum(at, len(data) - 1)) if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(at < ends[:, None], chunks, np.uint8(0))


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the documents and the number of chunks of each."""
    starts, ends, counts = places(offsets)
    return cut_out(data, starts, ends), counts


class ByteNet:
    """The network's weights with forward pass and training."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = {
            "bytes": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
            "filters": draw(FILTER * VECTOR, FILTERS),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "dense": draw(2 * FILTERS, DENSE),
            "dense_bias": np.zeros(DENSE, np.float32),
            "out": draw(DENSE, 1),
            "out_bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def _patches(self, chunks: np.ndarray) -> np.ndarray:
        seen = np.take(self.w["bytes"], chunks.ravel(), axis=0).reshape(len(chunks), CHUNK * VECTOR)
        view = np.lib.stride_tricks.sliding_window_view(seen, FILTER * VECTOR, axis=1)[:, :: HOP * VECTOR]
        return np.ascontiguousarray(view).reshape(-1, FILTER * VECTOR)

    def pool(self, chunks: np.ndarray) -> np.ndarray:
        """Best response of every filter in each chunk (before bias and rectifier, which keep order)."""
        best = (self._patches(chunks) @ self.w["filters"]).reshape(len(chunks), PLACES, FILTERS).max(axis=1)
        return np.maximum(best + self.w["filter_bias"], 0)

    def combine(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.concatenate([top, mean], axis=1) @ self.w["dense"] + self.w["dense_bias"], 0)
        z = (hidden @ self.w["out"] + self.w["out_bias"])[:, 0].astype(float) + self.shift
        return 1 / (1 + np.exp(-z))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, counts = places(offsets)
        pieces = (slice(i, i + PIECE) for i in range(0, len(starts), PIECE))
        pooled = np.concatenate([self.pool(cut_out(data, starts[p], ends[p])) for p in pieces])
        bounds = np.cumsum(counts) - counts
        top = np.maximum.reduceat(pooled, bounds, axis=0)
        mean = np.add.reduceat(pooled, bounds, axis=0) / counts[:, None].astype(np.float32)
        return self.combine(top, mean)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[dict, float]:
        w = self.w
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        chunks, counts = chunked(np.frombuffer(b"".join(texts), np.uint8), offsets)
        patches = self._patches(chunks)
        response = (patches @ w["filters"]).reshape(len(chunks), PLACES, FILTERS)
        place = response.argmax(axis=1)
        raw = np.take_along_axis(response, place[:, None], axis=1)[:, 0] + w["filter_bias"]
        pooled = np.maximum(raw, 0)
        bounds = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        top = np.maximum.reduceat(pooled, bounds, axis=0)
        mean = np.add.reduceat(pooled, bounds, axis=0) / counts[:, None]
        both = np.concatenate([top, mean], axis=1)
        pre = both @ w["dense"] + w["dense_bias"]
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip((hidden @ w["out"] + w["out_bias"])[:, 0], -30, 30)))
        loss = -np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))
        d = ((p - labels) / len(texts))[:, None].astype(np.float32)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        d = (d @ w["out"].T) * (pre > 0)
        g |= {"dense": both.T @ d, "dense_bias": d.sum(0)}
        d = d @ w["dense"].T
        is_top = pooled == top[owner]
        ties = np.add.reduceat(is_top.astype(np.float32), bounds, axis=0)
        d = d[owner, :FILTERS] * is_top / ties[owner] + (d[:, FILTERS:] / counts[:, None])[owner]
        d = (d * (raw > 0)).astype(np.float32)
        g["filter_bias"] = d.sum(0)
        rows = np.arange(len(chunks))[:, None] * PLACES + place
        g["filters"] = np.empty_like(w["filters"])
        into = np.zeros((len(chunks), CHUNK, VECTOR), np.float32)
        shape = w["filters"].T.reshape(FILTERS, FILTER, VECTOR)
        for f in range(FILTERS):
            g["filters"][:, f] = d[:, f] @ patches[rows[:, f]]
            back = d[:, f, None, None] * shape[f]
            at = place[:, f, None] * HOP + np.arange(FILTER)
            into[np.arange(len(chunks))[:, None], at] += back
        flat = chunks.ravel()
        g["bytes"] = np.stack([np.bincount(flat, into[:, :, k].ravel(), 256) for k in range(VECTOR)], axis=1)
        return g, float(loss)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                g, _ = self.gradients([texts[k] for k in part], labels[part])
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ByteNet:
    """A network fitted to a bounded sample of the labelled documents that aren't held out: at most `sample` of each
    class, drawn among texts of at most `sample_bytes`."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    net = ByteNet()
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        net.w["out"][:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    order = F.xxhash64(F.lit(1), "doc_id")
    fits = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes).where(~held_out(F.col("doc_id")))
    able = known.join(fits.select("doc_id"), "doc_id", "left_semi")
    picked = [able.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    drawn = picked[0].union(picked[1])  # 2 * sample rows at most
    texts = fits.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toArrow()
    if not rows.num_rows:
        return net
    ids = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    texts = [rows.column("text")[int(i)].as_py().encode() for i in ids]
    y = rows.column("quality").to_numpy()[ids].astype(float)
    net.fit(texts, y)
    drawn_odds = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
    net.shift = float(np.log(sizes[1] / sizes[0]) - np.log(drawn_odds))
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    net = train(docs, labels, sample, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                score = shared.value.score(block.data, block.offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"))
