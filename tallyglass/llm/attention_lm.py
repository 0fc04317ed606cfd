"""Language-model scores: a causal self-attention model on subword ids beside a word unigram base.

Texts are lower-cased (A-Z); every word is encoded by a public byte-level tokenizer, its first id marked
as opening a word, and a text ends with one end symbol. So symbols and words determine each other, and the
symbols' probabilities multiply to the text's. One pass encodes every document once and gathers, from all
training documents, word counts (by hash bucket) and symbol counts.
Training is data-parallel and reads every context window of every training document: the encoded documents
(long ones in pieces) are dealt by row number and place to rounds and to shards whose number follows the
corpus; in its round every shard takes optimizer steps from the shared weights until it has read all its
windows, `STEPS` at least, and the results are averaged by Spark in two levels; the driver holds one set of
weights. This holds for tables of every size.

Scoring is one map over the encoded rows, which carry their doc_id from the one pass on: overlapping windows
score every id once with batched masked attention. The base score looks words up in the `HEAD` most frequent
(a bounded table); all other words meet the whole count table by hash bucket.

Defined results: null text is the end token alone; null doc_id counts as training; repeated rows count
and score each; without training documents N is 0 and the model keeps its start weights; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention_net as net
from .cost_packing import encoder
from .shared import cut
from .words import LOWER, Block, blocks, mix, packed, span_hash, unpacked

IDS = 50_257
SYMBOLS = 2 * IDS
END = 50_256
SHARD_WINDOWS = 1 << 18
ROUNDS = [0.04, 0.025, 0.015, 0.0075]
STEPS, BATCH = 128, 512
SCORE_WINDOWS = 4096
#: Symbols of a longer training document are learned in pieces of this many (whole windows).
PIECE = 2048 * net.SCORED
#: Added to the count of every symbol without a slot.
INNER = 0.3
HEAD = 1 << 18
BUCKET_BYTES = 8 << 20
GATHER_BYTES = 2 << 20
#: Hash that stands for the end token.
END_WORD = np.uint64(0x5EED0F0DD5EED0F0)


def lowered(batch, column: str) -> Iterator[Block]:
    for block in blocks(batch.column(column), GATHER_BYTES):
        yield Block(block.first, LOWER[block.data], block.offsets)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, owner = block.words()
    return span_hash(block.prefix_hash(), starts, ends), owner


def counted(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their counts (or sums of weights)."""
    if weights is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes, kind="stable")
        hashes, weights = hashes[order], weights[order]
    edges = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
    sums = np.diff(edges) if weights is None else np.add.reduceat(weights, edges[:-1])
    return hashes[edges[:-1]], sums


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    where = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


def coded(symbols: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each document's symbols as bytes: 16-bit ids, then one bit for each that opens a word."""
    opens = symbols >= IDS
    ids = np.where(opens, symbols - np.uint32(IDS), symbols).astype("<u2")
    edges = offsets.tolist()
    return pa.array([ids[i:j].tobytes() + np.packbits(opens[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())


def decoded(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """All symbols of a run of documents."""
    parts = []
    for data, n in zip(column.to_pylist(), sizes.tolist(), strict=True):
        ids = np.frombuffer(data, "<u2", n).astype(np.int64)
        ids += IDS * np.unpackbits(np.frombuffer(data, np.uint8, offset=2 * n), count=n).astype(np.int64)
        parts.append(ids)
    return np.concatenate(parts)


GATHERED = "kind int, bucket long, n long, a binary, b binary"


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ["kind", "bucket", "n", "a", "b", "doc_id"]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), id_type)], names=names)


def gather(texts: DataFrame, tokenizer_path: str, buckets: int) -> DataFrame:
    """From row, doc_id, training, text: word counts (kind 0) and symbol counts (1) of the training documents,
    and every document's symbols and lower-cased text (3, held-out ones 4; its row number as bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, True)
        symbols = np.zeros(SYMBOLS, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush_words(id_type):
            keys, sums = counted(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            order, bounds = by_bucket(keys, buckets)
            keys, sums = keys[order], sums[order].astype(np.int64)
            parts = [(b, slice(bounds[b], bounds[b + 1])) for b in np.flatnonzero(np.diff(bounds)).tolist()]
            return _rows([(0, b, s.stop - s.start, packed(np.diff(keys[s], prepend=np.uint64(0))), packed(sums[s])) for b, s in parts], id_type)

        for batch in batches:
            learn = np.asarray(batch.column("training").to_numpy(zero_copy_only=False), bool)
            docs = batch.column("doc_id")
            for block in lowered(batch, "text"):
                use = learn[block.first : block.first + block.n]
                ids, offsets, words_met, which, owner = words.encode_words(block, END, IDS)
                rows = batch.column("row").slice(block.first, block.n)
                symbols_of = coded(ids, offsets)
                text_of = pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer(block.offsets.astype(np.int32).tobytes()), pa.py_buffer(block.data.tobytes())])
                columns = [pa.array(np.where(use, 3, 4).astype(np.int32)), rows, pa.array(np.diff(offsets)), symbols_of, text_of, docs.slice(block.first, block.n)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "n", "a", "b", "doc_id"])
                if not use.any():
                    continue
                times = np.bincount(which[use[owner]], minlength=len(words_met))
                held.append((np.append(words_met[times > 0], END_WORD), np.append(times[times > 0], use.sum())))
                symbols += np.bincount(ids[np.repeat(use, np.diff(offsets))], minlength=SYMBOLS)
                if sum(len(h) for h, _ in held) > 1_500_000:
                    yield flush_words(docs.type)
        if held:
            yield flush_words(docs.type)
        if symbols.any():
            yield _rows([(1, int(symbols.sum() % spread(buckets)), SYMBOLS, packed(symbols), b"")], docs.type)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"{GATHERED}, doc_id {kind}")


def word_counts(gathered: DataFrame) -> DataFrame:
    """(bucket, h, c): how often each word occurs in the training documents."""

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.cumsum(unpacked(d, n, np.uint64)) for d, n in zip(frame["a"], frame["n"], strict=True)])
        c = np.concatenate([unpacked(d, n, np.int64) for d, n in zip(frame["b"], frame["n"], strict=True)])
        h, c = counted(h, c)
        return pd.DataFrame({"bucket": key[0], "h": h.view(np.int64), "c": c})

    return gathered.where("kind = 0").groupBy("bucket").applyInPandas(add, "bucket long, h long, c long")


def spread(buckets: int) -> int:
    """Over how many first sums the symbol counts of all tasks go; it follows the corpus."""
    return max(64, buckets // 64)


def _summed(parts: DataFrame, kind, width: int) -> np.ndarray | None:
    """Sum of equally long packed arrays; parts: bucket (below width), n, a. Sums of a bucket first, then of 64 sums
    each, as often as it takes, so that no task adds more than a few."""

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpacked(d, n, kind).astype(np.int64 if kind == np.int64 else np.float64) for d, n in zip(frame["a"], frame["n"], strict=True))
        return pd.DataFrame({"bucket": [key[0] // 64], "n": [len(total)], "a": [packed(total.astype(kind))]})

    schema = "bucket long, n long, a binary"
    sums = parts.groupBy("bucket").applyInPandas(add, schema)
    while width > 1:
        width = -(-width // 64)
        sums = sums.groupBy("bucket").applyInPandas(add, schema)
    rows = sums.collect()
    return unpacked(rows[0].a, rows[0].n, kind) if rows else None


DEALT = "row long, key long, place long, n long, a binary"


def dealt(gathered: DataFrame, shards: int, apart: bool = True) -> DataFrame:
    """All symbols of the training documents, once: row, key (hash of id and symbols), place (piece of a long
    document), n, a, and the shard and turn (round; null for every round unless apart) that learn them. Key and place
    decide both, so a table learns alike however it is split."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n = one.column("n").to_numpy()
                symbols = decoded(one.column("a"), n).astype(np.uint32)
                cuts = np.append(np.arange(0, n[0], PIECE), n[0])
                m = len(cuts) - 1
                same = [pa.array(np.repeat(one.column(c).to_numpy(), m)) for c in ("row", "key")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(m)), pa.array(np.diff(cuts)), coded(symbols, cuts)], names=["row", "key", "place", "n", "a"])

    rows = gathered.where("kind = 3").select(F.col("bucket").alias("row"), F.xxhash64("doc_id", "a").alias("key"), F.lit(0).cast("long").alias("place"), "n", "a")
    every = rows.where(F.col("n") <= PIECE).union(rows.where(F.col("n") > PIECE).mapInArrow(pieces, DEALT))
    turn = F.pmod(F.xxhash64("key", "place"), F.lit(len(ROUNDS))) if apart else F.lit(None).cast("long")
    return every.withColumns({"shard": F.pmod(F.xxhash64("place", "key"), F.lit(shards)), "turn": turn})


def _step(turn: int, rate: float, shared, slots: np.ndarray):
    """The work of one shard in one round: from the shared weights to its own, ready to be summed."""

    def step(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "place"])  # the same start however the rows arrive
        sizes = frame["n"].to_numpy()
        ids = decoded(pa.array(frame["a"], pa.binary()), sizes)
        x, y, live, _ = net.windows(slots[ids], np.concatenate(([0], np.cumsum(sizes))))
        steps = max(STEPS, -(-len(x) // BATCH))
        new, _ = net.train(shared.value, x, y, live, steps, BATCH, rate, seed=turn * 1_000_003 + int(key[0]))
        values = np.append(new, np.float32(1))
        return pd.DataFrame({"bucket": [int(key[0]) // 64], "n": [len(values)], "a": [packed(values)]})

    return step


def fit(pieces: DataFrame, slots: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """Rounds of training on every shard, each followed by averaging."""
    context = pieces.sparkSession.sparkContext
    for turn, rate in enumerate(ROUNDS):
        step = _step(turn, rate, context.broadcast(w), slots)
        mine = pieces.where(F.col("turn").isNull() | (F.col("turn") == turn)).select("shard", "key", "place", "n", "a")
        total = _summed(mine.groupBy("shard").applyInPandas(step, "bucket long, n long, a binary"), np.float32, -(-shards // 64))
        if total is not None:
            w = (total[:-1] / total[-1]).astype(np.float32)
    return w


def text_scores(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", (~held_out).alias("training"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    buckets = max(1, -(-total // BUCKET_BYTES))
    shards = max(1, -(-total // (3 * net.SCORED * SHARD_WINDOWS)))
    gathered = cut(gather(rows.withColumn("row", F.monotonically_increasing_id()), tokenizer_path, buckets))
    counts = cut(word_counts(gathered))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    below = size.n + 0.1 * (size.v + 1)
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).select("h", "c").toArrow()
    head_keys = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(head_keys)
    symbols = _summed(gathered.where("kind = 1").select("bucket", "n", "a"), np.int64, spread(buckets))
    symbols = np.zeros(SYMBOLS, np.int64) if symbols is None else symbols
    opens = np.arange(SYMBOLS) >= IDS
    slots = np.where(opens, net.RARE, net.RARE_INSIDE)
    own = net.seats(symbols, opens)
    slots[own] = net.TAKEN
    inner, rare = np.zeros(SYMBOLS), []
    for kind in (net.RARE, net.RARE_INSIDE):
        mine = slots == kind
        rare.append(float(symbols[mine].sum()))
        inner[mine] = np.log10((symbols[mine] + INNER) / (symbols[mine] + INNER).sum())
    filled = np.full(net.SLOTS, -1, np.int64)
    filled[net.TAKEN] = symbols[own]
    w = net.start_weights(filled, *rare)
    w = net.tables(net.views(fit(dealt(gathered, shards), slots, w, shards)))
    shared = spark.sparkContext.broadcast((head_keys[order], top.column("c").to_numpy()[order], slots, inner, w))
    end_count = counts.where(F.col("h") == int(np.int64(END_WORD.view(np.int64)))).first()
    end_known = int(end_count is not None)
    end_part = float(np.log10(((end_count.c if end_count else 0) + 0.1) / below))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, row long, bucket long, n long, base double, known long, score double, a binary, b binary, c binary, held boolean, doc_id {id_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often, slots, inner, w = shared.value
        part = np.log10((often + 0.1) / below)
        tail: list[tuple] = []
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), *[pa.binary()] * 3, pa.bool_()]
        names = ["kind", "row", "bucket", "n", "base", "known", "score", "a", "b", "c", "held", "doc_id"]

        def flush(doc_kind):
            h, row, n = (np.concatenate(c) for c in zip(*tail, strict=True))
            tail.clear()
            order, bounds = by_bucket(h, buckets)
            h, row, n = h[order], row[order], n[order]
            out = [(1, 0, b, bounds[b + 1] - bounds[b], 0.0, 0, 0.0, *(packed(c[bounds[b] : bounds[b + 1]]) for c in (h, row, n)), None) for b in np.flatnonzero(np.diff(bounds)).tolist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), doc_kind)], names=names)

        for batch in batches:
            ids_of_rows = batch.column("bucket").to_numpy(zero_copy_only=False)
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            held = pa.array(batch.column("kind").to_numpy(zero_copy_only=False) == 4)
            docs_of = batch.column("doc_id")
            for block in blocks(batch.column("b")):
                row = ids_of_rows[block.first : block.first + block.n]
                hashes, owner = word_hashes(block)
                n_words = np.bincount(owner, minlength=block.n)
                base, known = np.full(block.n, end_part), np.full(block.n, end_known)
                if len(hashes):
                    at = np.searchsorted(keys, hashes)
                    at[at == len(keys)] = 0
                    hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                    if len(keys):
                        base += np.bincount(owner[hit], part[at[hit]], block.n)
                        known += np.bincount(owner[hit], minlength=block.n)
                    miss = ~hit
                    pair = mix(hashes[miss] + mix(owner[miss].astype(np.uint64)))
                    order = np.argsort(pair)
                    cuts = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
                    first = order[cuts[:-1]]
                    tail.append((hashes[miss][first], row[owner[miss][first]], np.diff(cuts).astype(np.int32)))
                mine = sizes[block.first : block.first + block.n]
                ids, offsets = decoded(batch.column("a").slice(block.first, block.n), mine), np.concatenate(([0], np.cumsum(mine)))
                x, y, live, doc = net.windows(slots[ids], offsets)
                score = np.add.reduceat(inner[ids], offsets[:-1])
                for i in range(0, len(x), SCORE_WINDOWS):
                    some = slice(i, i + SCORE_WINDOWS)
                    got = net.log10_probabilities(w, x[some], y[some])
                    got *= live[some]
                    score += np.bincount(doc[some], got.sum(axis=1, dtype=np.float64), block.n)
                blank = pa.nulls(block.n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(block.n, np.int32)), pa.array(row), pa.array(np.zeros(block.n, np.int64)), pa.array(n_words + 1), pa.array(base), pa.array(known), pa.array(score), blank, blank, blank, held.slice(block.first, block.n), docs_of.slice(block.first, block.n)],
                    names=names,
                )
                if sum(len(t[0]) for t in tail) > 500_000:
                    yield flush(docs_of.type)
        if sum(len(t[0]) for t in tail):
            yield flush(docs_of.type)

    scored = cut(gathered.where("kind >= 3").select("kind", "bucket", "n", "a", "b", "doc_id").mapInArrow(run, schema))

    def look_up(key, asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"row": [], "more": [], "found": []})
        h, row, n = (np.concatenate([unpacked(d, m, k) for d, m in zip(asked[c], asked["n"], strict=True)]) for c, k in (("a", np.uint64), ("b", np.int64), ("c", np.int32)))
        keys = table["h"].to_numpy().view(np.uint64) if len(table) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys, often = keys[order], (table["c"].to_numpy()[order] if len(table) else np.zeros(0, np.int64))
        c = np.zeros(len(h), np.int64)
        if len(keys):
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = keys[at] == h
            c[hit] = often[at[hit]]
        rows_, where = np.unique(row, return_inverse=True)
        more = np.bincount(where, n * np.log10((c + 0.1) / below))
        return pd.DataFrame({"row": rows_, "more": more, "found": np.bincount(where, n * (c > 0)).astype(np.int64)})

    asked = scored.where("kind = 1").select("bucket", "n", "a", "b", "c")
    tails = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(look_up, "row long, more double, found long")
    tails = tails.groupBy("row").agg(F.sum("more").alias("more"), F.sum("found").alias("found"))
    met = scored.where("kind = 0").select("row", "doc_id", "held", "n", "base", "known", "score").join(tails, "row", "left")
    return met.select(
        "doc_id",
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
