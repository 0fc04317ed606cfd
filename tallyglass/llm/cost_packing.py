"""Cost-balanced packing of documents into fixed-length training sequences.

A document's ids come from a public tokenizer, then `END`. Rows are dealt into groups of about
`GROUP_BYTES` of text (the number of groups follows the corpus), and each group is packed by itself:
pieces in descending length go to the sequence of lowest cost (linear plus quadratic attention cost of
its pieces) that still has room. A piece that fits nowhere whole is cut to fill the cheapest open
sequence and its rest is dealt again, so a group pads less than one sequence. Ids cross the one shuffle
as unsigned 16-bit arrays. Texts are encoded word by word through a bounded cache of word ids: the
tokenizer splits at white space, so this gives the ids of the whole text.

Rows are dealt by the hash of doc_id and text. Rows repeating both more than `REPEATS` times would meet in
one group, so they are counted with map-side combine and dealt out anew by their number.

Defined results: null or empty text is the single id END; a null doc_id is packed like any other and stays
null; repeated rows are packed each; documents longer than a sequence fill whole sequences and their rest is
packed like a short one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .words import Block, blocks, distinct, span_hash

LENGTH = 4096
END = 2
GROUP_BYTES = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SEQUENCES = 1 << 20  # more than any group has
CACHE_WORDS = 1_000_000
REPEATS = 256
JOINED = 500


class WordEncoder:
    """Ids of words by a tokenizer file, remembered by word hash in sorted arrays."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool))

    def learn(self, block: Block, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Remember the ids of a block's new words. Returns the different words (hashes), which of them each
        word is, and their places in the sorted arrays."""
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        words, first, which = distinct(hashes)
        at, known = self.places(words)
        new = np.flatnonzero(~known)
        if not len(new):
            return words, which, at
        raw = block.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        flat, counts = self._encoded(texts)
        into = np.searchsorted(self.keys, words[new])
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.keys = np.insert(self.keys, into, words[new])
        self.starts = np.insert(self.starts, into, begin)
        self.counts = np.insert(self.counts, into, counts)
        self.flat = np.concatenate([self.flat, flat])
        return words, which, self.places(words)[0]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each word; words go to the tokenizer many at a time."""
        flat, counts = [], []
        for i in range(0, len(texts), JOINED):
            part = texts[i : i + JOINED]
            got = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            begin = np.cumsum(lengths + 1) - lengths - 1
            first = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            owner = np.searchsorted(begin, first, side="right") - 1
            inside = first < (begin + lengths)[owner]  # the newlines between words may have ids of their own
            counts.append(np.bincount(owner[inside], minlength=len(part)))
            flat.append(np.array(got.ids, np.uint16)[inside])
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, block: Block, end: int, mark: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents, each closed by `end`, and the offsets of the documents.
        With `mark`, it is added to the first id of every word (and ids are 32 bits wide)."""
        return self.encode_words(block, end, mark)[:2]

    def encode_words(self, block: Block, end: int, mark: int = 0) -> tuple[np.ndarray, ...]:
        """What `encode` returns, the hashes of the different words, and of every word which one it is and its document."""
        starts, ends, owner = block.words()
        words, which, places = self.learn(block, span_hash(block.prefix_hash(), starts, ends), starts, ends)
        at = places[which]
        counts, begin = self.counts[at], self.starts[at]
        sums = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        ids = self.flat[np.arange(sums[-1]) + np.repeat(begin - sums[:-1], counts)]
        doc_ends = sums[np.searchsorted(owner, np.arange(block.n), side="right")]
        if mark:
            ids = ids.astype(np.uint32)
            ids[sums[:-1][counts > 0]] += np.uint32(mark)
        ids = np.insert(ids, doc_ends, ids.dtype.type(end))
        offsets = np.concatenate(([0], doc_ends + np.arange(1, block.n + 1)))
        return ids, offsets, words, which, owner


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, plain: bool = False) -> WordEncoder:
    """One encoder for each tokenizer and use in a Python worker."""
    key = (path, plain)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def balance(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence), longest first to the cheapest sequence with room."""
    total = int(lengths.sum())
    room = np.full(-(-total // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    pieces = []
    heap = [(-min(n, capacity), i, 0, n) for i, n in enumerate(lengths.tolist()) if n]
    heapq.heapify(heap)
    while heap:
        _, doc, start, left = heapq.heappop(heap)
        size = min(left, capacity)
        fits = room >= size
        if fits.any():
            to = int(np.argmin(np.where(fits, cost, np.inf)))
        else:
            to = int(np.argmin(np.where(room > 0, cost, np.inf)))
            size = int(room[to])
        pieces.append((doc, start, size, to))
        room[to] -= size
        cost[to] += LINEAR * size + QUADRATIC * size * size
        if left > size:
            heapq.heappush(heap, (-min(left - size, capacity), doc, start + size, left - size))
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("text").cast("string").alias("tg_text")).withColumn("tg_hash", F.xxhash64("doc_id", "tg_text"))
    sizes = cut(rows.groupBy("tg_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("tg_text")).alias("b")))
    total = sizes.agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    groups = max(1, -(-((total.b or 0) + 64 * (total.n or 0)) // GROUP_BYTES))
    rows = rows.withColumn("tg_copy", F.lit(0))
    if (total.most or 0) > REPEATS:  # fewer than one row in REPEATS is on this list
        often = cut(sizes.where(F.col("n") > REPEATS).select("tg_hash"))
        often = F.broadcast(often) if often.count() <= 100_000 else often
        again = rows.join(often, "tg_hash", "left_semi").groupBy("doc_id", "tg_text", "tg_hash").agg(F.count(F.lit(1)).alias("n"))
        again = again.withColumn("tg_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*rows.columns)
        rows = rows.join(often, "tg_hash", "left_anti").select(*rows.columns).union(again)
    dealt = T.StructType([T.StructField("doc_id", kind), T.StructField("tg_group", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            for block in blocks(batch.column("tg_text")):
                ids, offsets = words.encode(block, end)
                raw = pa.py_buffer(ids.tobytes())
                part = batch.slice(block.first, block.n)
                packed = pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer((offsets * 2).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tg_group"), packed], names=dealt.names)

    group = F.pmod(F.xxhash64("tg_hash", "tg_copy"), F.lit(groups)).cast("long")
    rows = rows.select("doc_id", group.alias("tg_group"), "tg_text").mapInArrow(encode, dealt)
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def balanced(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.select(["doc_id", "ids"]), [("doc_id", "ascending"), ("ids", "ascending")]))
        texts = table.column("ids").to_pylist()
        lengths = np.array([len(x) // 2 for x in texts])
        pieces = sorted(balance(lengths, capacity), key=lambda x: x[3])
        used: dict[int, int] = {}
        out = []
        for doc, start, size, to in pieces:
            ids = np.frombuffer(texts[doc], np.uint16)[start : start + size].astype("<u4")
            out.append((start, size, zlib.crc32(ids.tobytes()), int(lengths[doc]), key[0].as_py() * SEQUENCES + to, used.get(to, 0)))
            used[to] = used.get(to, 0) + size
        ids = table.column("doc_id").take(pa.array([p[0] for p in pieces]))
        return pa.table([ids, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=schema.names)

    return rows.groupBy("tg_group").applyInArrow(balanced, schema)
