"""Line dedup by content-defined chunks of lines.

Lines (newline-separated) are hashed; a rolling hash over `WINDOW` neighbouring line hashes sets a chunk boundary
wherever it vanishes modulo `DIVISOR` (or after `MAX_LINES`), so boundaries move with the content and an
inserted line shifts nothing behind the next boundary. Multi-line chunks that occur more than once in the
corpus lose every occurrence but the first (lowest doc_id, then position), after comparing bytes with the first.

One cut of a text finds a repeated passage only from its first boundary to its last one. Therefore a text is cut at
several `LEVELS`, each with a rolling hash of its own that puts the boundary before its window or behind it:
levels of the first kind find where a passage begins from its own lines, those of the second where it ends. The chunks of all
levels are looked for alike; what any of them removes goes. Passages of two or three lines may fall between the
boundaries of every level and stay; README has the shares.

Only hashes are shuffled to find repeats; texts travel for repeated chunks alone. The later copies meet the
first one's bytes in a join with one row per hash, whose hot side adaptive execution splits.

Defined results: null text counts as empty and has no chunks; single-line chunks stay; blank lines are lines; rows
repeating both doc_id and text are one document and treated alike; a later copy that overlaps the first one loses
what lies beyond it; every line removed has an equal one that stays; a document that loses all lines has empty
text (`drop_repeated_lines` drops it); an empty table gives no rows; other columns are carried untouched, whatever
their names; null ids are an id like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .words import Block, blocks, mix, ngram_hash, span_hash

WINDOW = 2
DIVISOR = 2
MAX_LINES = 16
#: Rolling hashes: number, and how many lines behind the window's first one the boundary lies.
LEVELS = [(seed, behind) for seed in range(3) for behind in (0, WINDOW)]


def chunk_bounds(keys: np.ndarray, owner: np.ndarray, level: tuple[int, int]) -> np.ndarray:
    """Indexes of the first line of every chunk of a level, for the line hashes of a block."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    seed, behind = level
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    rolled = mix(ngram_hash(keys, WINDOW) + np.uint64(seed))
    at = np.flatnonzero(rolled % np.uint64(DIVISOR) == 0)
    at = at[owner[at] == owner[at + WINDOW - 1]] + behind  # windows inside one document
    first[at[at < n]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    extra = [np.arange(s, s + z, MAX_LINES) for s, z in zip(starts[sizes > MAX_LINES], sizes[sizes > MAX_LINES], strict=True)]
    return np.union1d(starts, np.concatenate(extra)) if extra else starts


def block_chunks(block: Block) -> tuple[np.ndarray, ...]:
    """(document, start byte, end byte, hash) of the different multi-line chunks of all levels of a block."""
    starts, ends = block.lines()
    owner = block.owner(starts)
    sums = block.prefix_hash()
    keys = span_hash(sums, starts, ends)
    spans = []
    for level in LEVELS:
        firsts = chunk_bounds(keys, owner, level)
        lasts = np.append(firsts[1:], len(starts)) - 1
        many = lasts > firsts
        spans.append(firsts[many] * (len(starts) + 1) + lasts[many])
    firsts, lasts = np.divmod(np.unique(np.concatenate(spans)), len(starts) + 1)
    a, b = starts[firsts], ends[lasts]
    return owner[firsts], a, b, span_hash(sums, a, b)


KEY = ["tg_id", "tg_text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("tg_id"), F.xxhash64(text).alias("tg_text_hash"), text.alias("tg_text"))


def chunks(docs: DataFrame, with_text: bool) -> DataFrame:
    """tg_id, tg_text_hash, tg_start, tg_end, tg_hash (and tg_chunk) of every multi-line chunk."""
    rows = _keyed(docs)
    fields = [rows.schema["tg_id"], rows.schema["tg_text_hash"], *[T.StructField(c, T.LongType()) for c in ("tg_start", "tg_end", "tg_hash")]]
    schema = T.StructType(fields + [T.StructField("tg_chunk", T.BinaryType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("tg_text")):
                owner, a, b, keys = block_chunks(block)
                part = batch.slice(block.first, block.n)
                columns = [part.column(c).take(pa.array(owner)) for c in KEY]
                columns += [pa.array(a - block.offsets[owner]), pa.array(b - block.offsets[owner]), pa.array(keys.view(np.int64))]
                if with_text:
                    raw = block.data.tobytes()
                    columns.append(pa.array([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(tg_id, tg_text_hash, tg_spans): the stretches of bytes whose lines go, for each affected document."""
    order = F.struct("tg_id", "tg_start", "tg_text_hash")
    hashes = chunks(docs, False).groupBy("tg_hash").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    twice = cut(hashes.where(~F.col("lo").eqNullSafe(F.col("hi"))).select("tg_hash", F.col("lo").alias("tg_first")))
    few = twice.count() <= 200_000
    found = chunks(docs, True).join(F.broadcast(twice) if few else twice, "tg_hash")
    found = cut(found)
    # written, so that the join meets plain exchanges, of which adaptive execution splits a hot one
    first = cut(found.where(order.eqNullSafe(F.col("tg_first"))).groupBy("tg_hash").agg(F.first("tg_chunk").alias("tg_bytes")))
    later = found.where(~order.eqNullSafe(F.col("tg_first"))).join(first, "tg_hash")
    later = later.where(F.col("tg_chunk") == F.col("tg_bytes"))
    here = F.col("tg_id").eqNullSafe(F.col("tg_first.tg_id")) & (F.col("tg_text_hash") == F.col("tg_first.tg_text_hash"))
    beyond = F.col("tg_first.tg_start") + F.octet_length("tg_chunk")
    start = F.when(here, F.greatest("tg_start", beyond)).otherwise(F.col("tg_start"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct(start.alias("a"), F.col("tg_end").alias("b"))).alias("tg_spans"))


def covered(starts: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Which line starts lie in one of the stretches."""
    a, b = (np.array(sorted(s[c] for s in spans)) for c in "ab")
    return np.searchsorted(a, starts, "right") > np.searchsorted(b, starts, "right")


def strip_lines(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of docs, the stripped text, and counts of lines and of removed lines."""
    keyed = docs.select(*columns, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tg_text_hash"), F.col("doc_id").alias("tg_id"), F.col("text").cast("string").alias("tg_text"))
    gone = cut(repeated_chunks(docs))
    on = [keyed[c].eqNullSafe(gone[c]) for c in KEY]
    gone_side = F.broadcast(gone) if gone.count() <= 50_000 else gone
    met = keyed.join(gone_side, on, "left").select(*columns, "tg_text", "tg_spans")
    fields = [keyed.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField("tg_kept", T.StringType()), T.StructField("tg_lines", T.LongType()), T.StructField("tg_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("tg_spans").to_pylist()
            for block in blocks(batch.column("tg_text")):
                starts, _ = block.lines()
                owner = block.owner(starts)
                n_lines = np.bincount(owner, minlength=block.n).astype(np.int64)
                raw = block.data.tobytes()
                kept, removed = [], np.zeros(block.n, np.int64)
                bounds = np.searchsorted(owner, np.arange(block.n + 1))
                for i in range(block.n):
                    o, e = int(block.offsets[i]), int(block.offsets[i + 1])
                    spans = every[block.first + i]
                    if not spans:
                        kept.append(raw[o:e])
                        continue
                    own = starts[bounds[i] : bounds[i + 1]]
                    gone = covered(own - o, spans)
                    removed[i] = gone.sum()
                    edges = [*own.tolist(), e]
                    kept.append(b"".join([raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone).tolist()]))
                part = batch.slice(block.first, block.n)
                arrays = [part.column(c) for c in columns]
                arrays += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines), pa.array(removed)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return met.mapInArrow(run, schema)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_kept_bytes and the SHA-256 of what is left, for every row."""
    out = strip_lines(docs, ["doc_id"])
    return out.select(
        "doc_id",
        F.col("tg_lines").alias("n_lines"),
        F.col("tg_removed").alias("n_removed_lines"),
        F.octet_length("tg_kept").cast("long").alias("n_kept_bytes"),
        F.sha2("tg_kept", 256).alias("kept_sha256"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with stripped texts and n_chars to match; documents that lost every line go."""
    row = docs.select("doc_id", "text", F.struct(*docs.columns).alias("tg_row"))
    out = strip_lines(row, ["tg_row"]).where("tg_removed = 0 or tg_removed < tg_lines")
    changed = F.col("tg_removed") > 0
    fields = {c: F.col("tg_row")[c] for c in docs.columns}
    fields["text"] = F.when(changed, F.col("tg_kept")).otherwise(fields["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(changed, F.length("tg_kept").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*[v.alias(c) for c, v in fields.items()])
