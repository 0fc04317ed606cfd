"""Removal of byte windows that repeat anywhere: a depth-limited radix sort of suffixes.

Only the first `width` bytes of a suffix matter, so suffixes are ordered digit by digit, most significant
first, and a suffix leaves as soon as no other shares its digits so far; groups left after the last digit
are exactly the repeated windows.

1. First digit, by a shuffle: each window's anchor, the `ANCHOR`-byte string of least hash inside it
   (leftmost on ties). Equal windows have equal anchors at equal offsets, and neighbouring windows share
   an anchor, so about one position in eighty travels instead of all. Anchors that occur once leave.
2. For anchors that repeat, the bytes of their windows travel to the anchor's bucket, where the windows
   are sorted by (anchor, offset) and then by `DIGIT`-byte digits.
3. Anchors found more than `HOT` times don't meet in one place: their windows take all digits at once, as
   one hash.
Anchors and hot windows are counted alike: a task packs what it found in lots, a lot sends each different
hash once with its count to the hash's bucket, the bucket answers every lot with one byte a hash, and the
places of repeated ones are read off inside the lot (windows as merged runs). So a string found in a third
of all texts adds one entry a lot, however often it occurs in it.
Texts that are equal as a whole are one document here; a text with copies is repeated all over, so it is
compared with others but sends no runs.

Digits are compared by 64-bit hash.

Defined results: null text counts as empty; texts shorter than `width` keep everything; repeated rows are
copies; the empty remainder has the SHA-256 of no bytes; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .words import STEP, Block, blocks, mix, packed, powers, repeated, span_hash, unpacked

WIDTH = 200
ANCHOR = 40
DIGIT = 50
HOT = 1 << 14
BUCKET_ANCHORS = 1 << 19
BUCKET_CONTEXTS = 10_000
SLICE_WINDOWS = 1_000_000
LOT_ANCHORS = 400_000
LOT_WINDOWS = 1_000_000
FEW_KEYS = 250_000
#: Low bits that hold a place; the same for all texts, so that near ties break alike everywhere.
PLACE_BITS = np.uint64(31)


def anchors(block: Block, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(document, anchor position, anchor hash, first window, last window) for every anchor of a block."""
    n = len(block.data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), none, none
    sums = block.prefix_hash()
    starts = np.arange(n - ANCHOR + 1)
    hashes = span_hash(sums, starts, starts + ANCHOR)
    least = (hashes >> PLACE_BITS << PLACE_BITS) | starts.astype(np.uint64)
    span, have = width - ANCHOR + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    ends = np.zeros(n + 1, bool)
    windows = []
    for lo, hi in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        if hi - lo >= width:
            windows.append(np.arange(lo, hi - width + 1))
    if not windows:
        return none, none, none.astype(np.uint64), none, none
    windows = np.concatenate(windows)
    at = (least[windows] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = windows[np.append(new[1:], len(windows)) - 1]
    at = at[new]
    return block.owner(at), at, hashes[at], windows[new], last


KEY = ["k1", "k2"]
LOT = "lot long, bucket long, n long, m long, keys binary, counts binary, texts binary, places binary"
#: Bucket number of the row that lists a lot's texts.
OWN = -1


def _ints(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _lot(found: list[tuple], k1: np.ndarray, k2: np.ndarray, lone: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One lot of (hash, text, place) as rows: each bucket's different hashes with their counts and, in the
    same order, texts and places; and one row (OWN) with the keys of the texts."""
    h, text, place = (np.concatenate(c) for c in zip(*found, strict=True))
    where = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, where))  # stable: places of a hash stay in order
    h, text, place = h[order], text[order], place[order]
    bounds = np.searchsorted(where[order], np.arange(buckets + 1))
    number = uuid.uuid4().int >> 65
    rows = [(number, OWN, len(k1), 0, packed(k1), packed(k2), packed(lone), b"")]
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        s = slice(bounds[b], bounds[b + 1])
        edges = np.flatnonzero(np.concatenate(([True], h[s][1:] != h[s][:-1], [True])))
        keys, counts = h[s][edges[:-1]], np.diff(edges)
        rows.append((number, b, len(keys), int(edges[-1]), packed(np.diff(keys, prepend=np.uint64(0))), packed(counts), packed(text[s]), packed(place[s])))
    kinds = [pa.int64()] * 4 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LOT.split(", ")])


class _Lots:
    """Collects what a task finds and hands it on in lots."""

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most = buckets, most
        self.clear()

    def clear(self) -> None:
        self.found, self.keys, self.size, self.texts = [], [], 0, 0

    def add(self, h: np.ndarray, doc: np.ndarray, place: np.ndarray, k1: np.ndarray, k2: np.ndarray, lone: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            self.found.append((h, (doc + self.texts).astype(np.int32), place.astype(np.int32)))
            self.keys.append((k1, k2, lone))
            self.texts += len(k1)
            self.size += len(h)
        if self.size > self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            yield _lot(self.found, *(np.concatenate(c) for c in zip(*self.keys, strict=True)), self.buckets)
        self.clear()


def _answers(lots: DataFrame) -> DataFrame:
    """(lot, bucket, answer): one byte for each hash a lot sent: 0 found once in all, 1 repeated, 2 hot."""

    def count(key, frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["n"].to_numpy()
        h = np.concatenate([np.cumsum(unpacked(d, n, np.uint64)) for d, n in zip(frame["keys"], sizes, strict=True)])
        c = np.concatenate([unpacked(d, n, np.int64) for d, n in zip(frame["counts"], sizes, strict=True)])
        order = np.argsort(h)
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        group = np.cumsum(new) - 1
        total = np.zeros(len(h), np.int64)
        total[order] = np.bincount(group, c[order]).astype(np.int64)[group]
        says = (total > 1).astype(np.uint8) + (total > HOT)
        ends = np.cumsum(sizes)
        return pd.DataFrame({"lot": frame["lot"], "bucket": key[0], "answer": [packed(says[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]})

    sent = lots.where(F.col("bucket") != OWN).select("lot", "bucket", "n", "keys", "counts")
    return sent.groupBy("bucket").applyInPandas(count, "lot long, bucket long, answer binary")


def _told(lots: DataFrame) -> DataFrame:
    """lot, bucket, and the texts, places and answers of every find of a repeated hash; OWN rows as they are."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                says = np.repeat(unpacked(r["answer"], r["n"], np.uint8), unpacked(r["counts"], r["n"], np.int64))
                on = says > 0
                text, place = (unpacked(r[c], r["m"], np.int32)[on] for c in ("texts", "places"))
                if len(text):
                    out.append((r["lot"], r["bucket"], len(text), packed(text), packed(place), packed(says[on])))
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["lot", "bucket", "n", "a", "b", "c"])

    kept = lots.select("lot", "bucket", "n", "m", "counts", "texts", "places").join(_answers(lots), ["lot", "bucket"])
    finds = kept.mapInArrow(tell, "lot long, bucket long, n long, a binary, b binary, c binary")
    own = lots.where(F.col("bucket") == OWN).select("lot", "bucket", "n", F.col("keys").alias("a"), F.col("counts").alias("b"), F.col("texts").alias("c"))
    return finds.union(own)


def _of_lot(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """k1, k2, lone of a lot's texts, then text, place and answer of its repeated finds."""
    own = frame[frame["bucket"] == OWN].iloc[0]
    keys = [unpacked(own[c], own["n"], k) for c, k in (("a", np.int64), ("b", np.int64), ("c", bool))]
    rest = frame[frame["bucket"] != OWN]
    read = lambda c, k: np.concatenate([np.zeros(0, k), *(unpacked(d, n, k) for d, n in zip(rest[c], rest["n"], strict=True))])
    return (*keys, read("a", np.int32), read("b", np.int32), read("c", np.uint8))


def _repeated_anchors(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """(k1, k2, ats, hot): the anchors of each text that are found at least twice, hot ones apart."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = _Lots(buckets, LOT_ANCHORS)
        for batch in batches:
            k1, k2, lone = _ints(batch, "k1"), _ints(batch, "k2"), _ints(batch, "lone")
            for block in blocks(batch.column("text")):
                doc, at, h, _, _ = anchors(block, width)
                mine = slice(block.first, block.first + block.n)
                yield from lots.add(h, doc, at - block.offsets[doc], k1[mine], k2[mine], lone[mine])
        yield from lots.rest()

    def lists(key, frame: pd.DataFrame) -> pd.DataFrame:
        k1, k2, _, text, place, says = _of_lot(frame)
        order = np.lexsort((place, says, text))
        text, place, says = text[order], place[order], says[order]
        edges = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (says[1:] != says[:-1]), [True]))) if len(text) else np.zeros(1, np.int64)
        first = edges[:-1]
        ats = [place[a:b].astype(np.int64) for a, b in zip(first.tolist(), edges[1:].tolist(), strict=True)]
        return pd.DataFrame({"k1": k1[text[first]], "k2": k2[text[first]], "hot": says[first] == 2, "ats": ats})

    lots = cut(texts.mapInArrow(deal, LOT))
    return _told(lots).groupBy("lot").applyInPandas(lists, "k1 long, k2 long, hot boolean, ats array<long>")


def _selected(batches: Iterator[pa.RecordBatch], width: int):
    """Blocks with the anchors that are listed in the batch's `ats` column."""
    for batch in batches:
        k1, k2, lone = _ints(batch, "k1"), _ints(batch, "k2"), _ints(batch, "lone")
        lists = batch.column("ats")
        sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("text")):
            doc, at, h, lo, hi = anchors(block, width)
            i, j = block.first, block.first + block.n
            mine = values[ends[i] - sizes[i] : ends[j - 1]]
            owner = np.repeat(np.arange(block.n), sizes[i:j])
            wanted = np.isin(at, mine + block.offsets[owner])
            yield block, k1[i:j], k2[i:j], lone[i:j], doc[wanted], at[wanted], h[wanted], lo[wanted], hi[wanted]


def _contexts(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """Bytes of the windows around repeated anchors, packed by bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            h, k1, k2, lone, at, lo, hi, start = (np.concatenate([x[c] for x in held]) for c in range(8))
            which = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            where = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            bounds = np.searchsorted(where[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(bounds)):
                s = order[bounds[b] : bounds[b + 1]]
                body = b"".join(held[which[i]][8][start[i] : start[i] + hi[i] - lo[i] + width] for i in s)
                rows.append((int(b), len(s), len(body), *(packed(c[s]) for c in (h, k1, k2, lone, at - lo, lo, hi - lo)), pa.compress(body, codec="zstd", asbytes=True)))
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 8)
            names = ["bucket", "n", "bytes", "h", "k1", "k2", "lone", "shift", "lo", "more", "body"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for block, k1, k2, lone, doc, at, h, lo, hi in _selected(batches, width):
            if len(at):
                base = block.offsets[doc]
                held.append((h, k1[doc], k2[doc], lone[doc], at - base, lo - base, hi - base, lo, block.data.tobytes()))
                size += int((hi - lo + width).sum())
            if size > 12_000_000:
                size = 0
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(deal, "bucket long, n long, bytes long, h binary, k1 binary, k2 binary, lone binary, shift binary, lo binary, more binary, body binary")


def relative_sums(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Running polynomial sums in which every context counts its own places from 0."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = powers(int(places.max()) + 1 if len(places) else 1)[places]
    values *= data.astype(np.uint64) + np.uint64(1)
    np.cumsum(values, out=sums[1:])
    return sums


def window_passes(keys: np.ndarray, sums: np.ndarray, starts: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the windows whose group survives all digits, most significant first. A window starts at
    `starts` in the bytes and at `places` in its context."""
    alive = np.flatnonzero(repeated(keys))
    keys = keys[alive]
    inverse = powers(width + 1 + (int(places.max()) if len(places) else 0), inverse=True)
    for digit in range(0, width, DIGIT):
        if not len(alive):
            break
        a = starts[alive] + digit
        body = (sums[a + min(DIGIT, width - digit)] - sums[a]) * inverse[places[alive] + digit]
        keys = mix(keys * STEP + mix(body))
        again = repeated(keys)
        alive, keys = alive[again], keys[again]
    return alive


def _sorted_windows(contexts: DataFrame, width: int) -> DataFrame:
    """(k1, k2, a, b): byte runs covered by repeated windows, from the contexts of each bucket."""

    def order(key, frame: pd.DataFrame) -> pd.DataFrame:
        kinds = {"h": np.uint64, "lone": bool}
        cols = {c: np.concatenate([unpacked(d, n, kinds.get(c, np.int64)) for d, n in zip(frame[c], frame["n"], strict=True)]) for c in ("h", "k1", "k2", "lone", "shift", "lo", "more")}
        body = b"".join(pa.decompress(d, n, codec="zstd", asbytes=True) for d, n in zip(frame["body"], frame["bytes"], strict=True))
        out = []
        sizes = cols["more"] + width
        begin = np.cumsum(sizes) - sizes
        by_anchor = np.argsort(cols["h"], kind="stable")
        h = cols["h"][by_anchor]
        edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        lo = 0
        while lo < len(edges) - 1:  # whole anchors at a time, a few million windows together
            hi = lo + 1
            while hi < len(edges) - 1 and sizes[by_anchor[edges[lo] : edges[hi + 1]]].sum() < SLICE_WINDOWS:
                hi += 1
            part = by_anchor[edges[lo] : edges[hi]]
            lo = hi
            local_sizes = sizes[part]
            local_begin = np.cumsum(local_sizes) - local_sizes
            data = np.frombuffer(b"".join(body[b : b + s] for b, s in zip(begin[part].tolist(), local_sizes.tolist(), strict=True)), np.uint8)
            sums = relative_sums(data, np.arange(len(data)) - np.repeat(local_begin, local_sizes))
            h, shift, more = cols["h"][part], cols["shift"][part], cols["more"][part]
            found = []
            slices = 1 + int((more + 1).sum()) // SLICE_WINDOWS
            for s in range(slices):  # windows at different offsets from their anchor never meet
                step0 = (shift - s) % slices
                count = np.maximum((more - step0) // slices + 1, 0)
                which = np.repeat(np.arange(len(part)), count)
                step = step0[which] + slices * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                keys = mix(h[which] + (shift[which] - step).astype(np.uint64))
                alive = window_passes(keys, sums, local_begin[which] + step, step, width)
                found.append(np.stack([which[alive], step[alive]]))
            w, step = np.concatenate(found, axis=1)
            lone = cols["lone"][part][w]
            w, step = w[lone], step[lone]
            by_place = np.lexsort((step, w))
            w, p = w[by_place], cols["lo"][part][w[by_place]] + step[by_place]
            if not len(w):
                continue
            new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1))))
            last = np.append(new[1:], len(w)) - 1
            out.append(np.stack([cols["k1"][part][w[new]], cols["k2"][part][w[new]], p[new], p[last] + width]))
        k1, k2, a, b = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pd.DataFrame({"k1": k1, "k2": k2, "a": a, "b": b})

    return contexts.groupBy("bucket").applyInPandas(order, "k1 long, k2 long, a long, b long")


def _hot_windows(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """The same around hot anchors: window hashes counted lot by lot, repeated windows merged to runs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = _Lots(buckets, LOT_WINDOWS)
        for block, k1, k2, lone, doc, _, _, lo, hi in _selected(batches, width):
            count = hi - lo + 1
            p = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            which = np.repeat(doc, count)
            h = span_hash(block.prefix_hash(), p, p + width)
            yield from lots.add(h, which, p - block.offsets[which], k1, k2, lone)
        yield from lots.rest()

    def runs(key, frame: pd.DataFrame) -> pd.DataFrame:
        k1, k2, lone, text, place, _ = _of_lot(frame)
        text, place = text[lone[text]], place[lone[text]].astype(np.int64)
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)))) if len(text) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(text))[: len(new)] - 1
        return pd.DataFrame({"k1": k1[text[new]], "k2": k2[text[new]], "a": place[new], "b": place[last] + width})

    lots = cut(texts.mapInArrow(deal, LOT))
    return _told(lots).groupBy("lot").applyInPandas(runs, "k1 long, k2 long, a long, b long")


def _with_lists(texts: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(*KEY, "ats").dropDuplicates(KEY)  # rows repeating id and text have equal lists
    return _only(texts, found.select(*KEY)).join(found, KEY)


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    keys = cut(keys)
    return texts.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, KEY, "left_semi")


def strip(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept and its SHA-256 for texts joined with runs to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b in zip(batch.column("text").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                raw = text.encode()
                parts, at, n_spans, removed, reach = [], 0, 0, 0, -1
                for i, j in sorted(zip(a, b, strict=True)):
                    if i > reach:
                        parts.append(raw[at:i])
                        n_spans += 1
                        removed += j - i
                        reach = j
                    elif j > reach:
                        removed += j - reach
                        reach = j
                    at = reach
                parts.append(raw[at:])
                kept = b"".join(parts)
                rows.append((removed, n_spans, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *columns], names=["k1", "k2", "n_removed", "n_spans", "kept", "kept_sha256"])

    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    met = docs.join(lists, KEY).select(*KEY, "text", F.col("runs.a").alias("a"), F.col("runs.b").alias("b"))
    return met.mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary, kept_sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    base = base.select("*", F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keys = cut(base.select("doc_id", row.alias("row"), *KEY, "n", F.sha2("text", 256).alias("sha")))
    classes = cut(keys.groupBy(*KEY, "n").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")))
    copied = classes.where("copies > 1").select(*KEY, F.col("row").alias("first"))
    copied = F.broadcast(copied) if copied.count() <= FEW_KEYS else copied
    texts = base.where(F.col("n") >= width).withColumn("row", row).join(copied, KEY, "left").where("first is null or row = first")
    texts = texts.select(*KEY, F.col("first").isNull().alias("lone"), "text")
    total = classes.where(F.col("n") >= width).agg(F.sum("n")).first()[0] or 0
    found = cut(_repeated_anchors(texts, max(1, -(-total // (BUCKET_ANCHORS * 80))), width))
    many = found.groupBy("hot").agg(F.sum(F.size("ats")).alias("n")).collect()
    many = {r.hot: r.n for r in many}
    spans = _sorted_windows(_contexts(_with_lists(texts, found.where("not hot")), max(1, -(-many.get(False, 0) // BUCKET_CONTEXTS)), width), width)
    if many.get(True):
        windows = many[True] * (width - ANCHOR) // 2
        spans = spans.union(_hot_windows(_with_lists(texts, found.where("hot")), max(1, -(-windows // LOT_WINDOWS)), width))
    spans = cut(spans)
    stripped = strip(_only(texts, spans.select(*KEY).distinct()), spans).drop("kept")
    stripped = cut(stripped)
    met = keys.join(classes.select(*KEY, "copies"), KEY).join(stripped, KEY, "left")
    all_gone = (F.col("copies") > 1) & (F.col("n") >= width)
    pick = lambda gone, part, none: F.when(all_gone, gone).otherwise(F.coalesce(part, none))
    return met.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        pick(F.col("n"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(NOTHING), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )
