"""Similarity join on sets of word n-grams: adaptive multi-match prefix filtering, exact verification.

1. Documents with equal shingle sets form a class, numbered on its own; the row of its lowest doc_id goes on.
2. Shingle frequencies over all classes, counted in hash buckets whose number follows the corpus; the
   `FREQUENT` most frequent (a bounded table) go last in the global order, all others keep hash order.
3. Of a set of s shingles at least o = ceil(t * s) lie in any partner, so two partners share at least L of
   their first s - o + L shingles. Each document picks the L of least estimated cost (entries plus
   prefix frequencies over L squared): a prefix of rare shingles stays short, one that meets frequent shingles grows
   and asks for correspondingly more matches. For a pair, min(L) of the two must be shared, and as many
   as the pair's own overlap needs beyond the longer of the two suffixes.
4. Postings with two or more documents give first one candidate for each document: the posting's lowest
   id. Verified links already join most near copies. Then every remaining pair of documents in different
   components that shares enough prefix shingles is a candidate. Pairs inside one component add nothing to
   the result, so groups of thousands of near copies never meet all against all. Postings of one group lie together,
   and their pairs are counted lot by lot.
5. Verification recomputes both shingle sets from the whole texts. The remaining candidates stay packed lists,
   one for each document and block of partners; a tile (block, block) gets each text that its lists name once,
   and tries a pair only while its tile has not joined the two.

Defined results: lower-cased A-Z; fewer words than n: the whole sequence is the one shingle; null, empty
or blank text: empty set, linked with nothing; repeated rows and equal sets share a component; an id with
several texts has the links of each of them; ids keep their type, and the lowest is the least of that type; a null id links like any other, and its component is null only
where no document of the component has an id; an empty table gives no rows; other columns are ignored.
`one_of_each` keeps one row of every component of texts (here a shared id is no link): that of the lowest
doc_id, null last. Empty sets are linked with nothing: of rows repeating id and text one stays, with null ids all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import cut
from .words import LOWER, STEP, Block, blocks, mix, ngram_hash, packed, span_hash, unpacked

N = 5
PERCENT = 75
FREQUENT = 1 << 18
LEAST_FREQUENT = 8
MOST_MATCHES = 8
BUCKET_SHINGLES = 1 << 20
#: Tables of up to this many short rows are broadcast.
FEW_ROWS = 400_000
FINGERPRINT_BITS = 44
#: A posting of more documents is met in tiles of this many by this many, a group of postings in blocks of so many entries
#: at most; one of more than GROUP_LEAST is cut into up to GROUP_PARTS smaller blocks, so that no task meets it alone.
POSTING_BLOCK, GROUP_ENTRIES, GROUP_LEAST, GROUP_PARTS = 1 << 12, 1 << 17, 1 << 13, 16
#: Shingles of the documents that share a block of candidates, and how many are compared at a time.
BLOCK_SHINGLES, TOGETHER = 1 << 19, 1 << 18
#: Pairs of texts whose sets a task holds at a time.
TEXTS_TOGETHER = 512
#: Bytes of texts that a task holds before it verifies the tiles that are whole.
TILE_BYTES = 8 << 20
PAIRS_TOGETHER = 500_000
#: Hashes and index entries that a task holds before it packs them by bucket.
HASH_LOT, ENTRY_LOT = 1_000_000, 500_000


def shingle_sets(block: Block, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document of a block, and the documents' offsets."""
    starts, ends, owner = block.words()
    hashes = span_hash(block.prefix_hash(LOWER), starts, ends)
    grams = ngram_hash(hashes, n)
    first = owner[: len(grams)]
    whole = first == owner[n - 1 :][: len(grams)]
    grams, first = grams[whole], first[whole]
    words = np.bincount(owner, minlength=block.n)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        bounds = np.searchsorted(owner, np.arange(block.n + 1))
        extra = []
        for i in short:
            h = np.uint64(words[i])
            for w in hashes[bounds[i] : bounds[i + 1]]:
                h = mix(np.array([h]) * STEP + w)[0]
            extra.append(h)
        grams = np.concatenate([grams, np.array(extra, np.uint64)])
        first = np.concatenate([first, short])
        order = np.argsort(first, kind="stable")
        grams, first = grams[order], first[order]
    bounds = np.searchsorted(first, np.arange(block.n + 1))
    parts, offsets = [], np.zeros(block.n + 1, np.int64)
    for i in range(block.n):
        part = np.sort(grams[bounds[i] : bounds[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        offsets[i + 1] = offsets[i] + len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def set_keys(texts: DataFrame) -> DataFrame:
    """id, h (hash of the text), n (set size) and two hashes of the whole set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                grams, offsets = shingle_sets(block)
                sums = np.zeros((2, len(grams) + 1), np.uint64)
                np.cumsum(grams, out=sums[0, 1:])
                np.cumsum(mix(grams + STEP), out=sums[1, 1:])
                keys = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
                part = [batch.column(c).slice(block.first, block.n) for c in ("id", "h")]
                yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(offsets)), *(pa.array(k.view(np.int64)) for k in keys)], names=["id", "h", "n", "k1", "k2"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, h long, n long, k1 long, k2 long")


def _frequencies(texts: DataFrame, buckets: int) -> DataFrame:
    """(fp, n): shingle fingerprints found in at least LEAST_FREQUENT sets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            all_fp = np.sort(np.concatenate(held))
            where = (all_fp % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            bounds = np.searchsorted(where[order], np.arange(buckets + 1))
            fps = all_fp[order]
            rows = [(b, int(hi - lo), packed(np.diff(fps[lo:hi], prepend=np.uint64(0)))) for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if hi > lo]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "n", "fps"])

        for batch in batches:
            for block in blocks(batch.column("text")):
                grams, _ = shingle_sets(block)
                if len(grams):
                    held.append(grams >> np.uint64(64 - FINGERPRINT_BITS))
                if sum(map(len, held)) > HASH_LOT:
                    yield flush()
        if held:
            yield flush()

    def count(key, frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(np.concatenate([np.cumsum(unpacked(d, n, np.uint64)) for d, n in zip(frame["fps"], frame["n"], strict=True)]))
        edges = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1], [True])))
        counts = np.diff(edges)
        often = counts >= LEAST_FREQUENT
        return pd.DataFrame({"fp": fps[edges[:-1]][often].view(np.int64), "n": counts[often]})

    dealt = texts.mapInArrow(deal, "bucket long, n long, fps binary")
    return dealt.groupBy("bucket").applyInPandas(count, "fp long, n long")


def choose_prefix(costs: np.ndarray, size: int, percent: int) -> tuple[int, int]:
    """Prefix length and matches asked for, given frequencies in the global order."""
    overlap = -(-size * percent // 100)
    base = size - overlap
    most = min(MOST_MATCHES, overlap)
    matches = np.arange(1, most + 1)
    candidates = np.cumsum(costs[: base + most] - 1)[base:]
    best = int(np.argmin(base + matches + candidates / (matches * matches)))
    return base + best + 1, best + 1


def _index(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, percent: int) -> DataFrame:
    """Packed prefix entries by bucket: fingerprint, id, size, matches."""
    context = texts.sparkSession.sparkContext
    table = context.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = table.value
        held: list[tuple] = []

        def flush():
            fp, ids, size, need = (np.concatenate(c) for c in zip(*held, strict=True))
            where = (fp % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((fp, where))
            bounds = np.searchsorted(where[order], np.arange(buckets + 1))
            fp, ids, size, need = fp[order], ids[order], size[order], need[order]
            rows = []
            for b in np.flatnonzero(np.diff(bounds)):
                s = slice(bounds[b], bounds[b + 1])
                rows.append((int(b), int(s.stop - s.start), packed(np.diff(fp[s], prepend=np.uint64(0))), packed(ids[s]), packed(size[s]), packed(need[s])))
            held.clear()
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "n", "fps", "ids", "sizes", "needs"])

        for batch in batches:
            all_ids = batch.column("id").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                grams, offsets = shingle_sets(block)
                fps = grams >> np.uint64(64 - FINGERPRINT_BITS)
                cost = np.ones(len(fps), np.int64)
                if len(keys) and len(fps):
                    at = np.searchsorted(keys, fps)
                    at[at == len(keys)] = 0
                    hit = keys[at] == fps
                    cost[hit] = counts[at[hit]]
                for i in range(block.n):
                    s = slice(offsets[i], offsets[i + 1])
                    size = s.stop - s.start
                    if not size:
                        continue
                    order = np.argsort(cost[s], kind="stable")  # within a count, hash order
                    length, need = choose_prefix(cost[s][order], int(size), percent)
                    chosen = np.unique(fps[s][order[:length]])
                    m = len(chosen)
                    need = max(1, need - (length - m))
                    held.append((chosen, np.full(m, all_ids[block.first + i], np.int64), np.full(m, size, np.int32), np.full(m, need, np.uint8)))
                if sum(len(h[0]) for h in held) > ENTRY_LOT:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(deal, "bucket long, n long, fps binary, ids binary, sizes binary, needs binary")


def _postings(index: DataFrame, percent: int) -> DataFrame:
    """Entries (fp, id, size, need, low) of every shingle that two or more documents of like size index;
    low is the posting's lowest id."""

    def gather(key, frame: pd.DataFrame) -> pd.DataFrame:
        cols = []
        for name, kind in (("fps", np.uint64), ("ids", np.int64), ("sizes", np.int32), ("needs", np.uint8)):
            parts = [unpacked(d, n, kind) for d, n in zip(frame[name], frame["n"], strict=True)]
            cols.append(np.concatenate([np.cumsum(p) for p in parts] if name == "fps" else parts))
        fp, ids, size, need = cols
        order = np.lexsort((ids, fp))
        fp, ids, size, need = fp[order], ids[order], size[order], need[order]
        new = np.concatenate(([True], fp[1:] != fp[:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        low = ids[np.flatnonzero(new)][group]
        low_size = size[np.flatnonzero(new)][group]
        return pd.DataFrame({"fp": fp[many].view(np.int64), "id": ids[many], "size": size[many], "need": need[many].astype(np.int32), "low": low[many], "low_size": low_size[many]})

    return index.groupBy("bucket").applyInPandas(gather, "fp long, id long, size int, need int, low long, low_size int")


CROSS = "x long, y long, id long, n long, bs binary"


def _cross_pairs(entries: DataFrame, percent: int, buckets: int, parts: int) -> DataFrame:
    """Pairs of one posting's documents from different components, where enough postings are shared: for each
    document (id) and tile (x, y) of two among `parts` blocks one packed list (bs) of n partners.
    Postings go by their lowest component, so that those of one group of copies lie together and its pairs are counted
    where they meet; groups of many entries and long postings are dealt in tiles (block, block). A task counts
    `PAIRS_TOGETHER` at a time, document by document, and hands on packed lists. The blocks of `parts` hold documents
    whose postings have the same lowest component, as far as they are few enough."""

    def meet(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["c0", "x", "y", "fp", "comp", "id"], kind="stable")
        c0, x, y, fp, part, ids, comp, size, need, home = (frame[c].to_numpy().astype(np.int64) for c in ("c0", "x", "y", "fp", "part", "id", "comp", "size", "need", "home"))
        rest = -(-size * percent // 100) - need  # shingles behind the prefix
        tile = np.concatenate(([True], (c0[1:] != c0[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        posting = tile | np.concatenate(([True], fp[1:] != fp[:-1]))
        ends = np.append(np.flatnonzero(posting)[1:], len(fp))[np.cumsum(posting) - 1]
        block = posting | np.concatenate(([True], comp[1:] != comp[:-1]))
        after = np.append(np.flatnonzero(block)[1:], len(fp))[np.cumsum(block) - 1]
        partners = ends - after  # a row meets the rows of its posting behind its own component
        tile = np.cumsum(tile)
        order = np.lexsort((ids, tile))  # a document's rows of a tile together
        order = order[partners[order] > 0]
        own = np.zeros(len(fp), np.int64)
        own[order] = np.cumsum(np.concatenate(([True], (tile[order[1:]] != tile[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])))[: len(order)])
        known, doc = np.unique(ids, return_inverse=True)
        rows, lo = [], 0
        sums = np.cumsum(partners[order])
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + PAIRS_TOGETHER, side="right")))
            count = partners[order[lo:hi]]
            i = np.repeat(order[lo:hi], count)
            j = after[i] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lo = hi
            like = (size[i] * percent <= 100 * size[j]) & (size[j] * percent <= 100 * size[i]) & ((x[i] == y[i]) | (part[i] != part[j]))
            i, j = i[like], j[like]
            pair = own[i] * len(known) + doc[j]
            sort = np.argsort(pair, kind="stable")
            first = np.flatnonzero(_changes(pair[sort]))
            shared = np.diff(np.append(first, len(pair)))
            i, j = i[sort][first], j[sort][first]
            overlap = -(-(size[i] + size[j]) * percent // (100 + percent))
            asked = np.maximum(np.minimum(need[i], need[j]), overlap - np.maximum(rest[i], rest[j]))
            edges = np.append(np.flatnonzero(_changes(own[i])), len(i)).tolist()
            rows += [(int(ids[i[s]]), int(home[i[s]]), e - s, packed(ids[j[s:e]]), packed(home[j[s:e]]), packed(shared[s:e]), packed(asked[s:e])) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(rows, columns=["a", "of_a", "n", "bs", "of_bs", "shared", "asked"])

    def settle(key, frame: pd.DataFrame) -> pd.DataFrame:
        a, of_a = (np.repeat(frame[c].to_numpy(), frame["n"].to_numpy()) for c in ("a", "of_a"))
        b, of_b, shared, asked = (np.concatenate([unpacked(d, n, np.int64) for d, n in zip(frame[c], frame["n"], strict=True)]) for c in ("bs", "of_bs", "shared", "asked"))
        order = np.lexsort((b, of_b, a))
        a, of_a, b, of_b, shared, asked = (c[order] for c in (a, of_a, b, of_b, shared, asked))
        first = np.flatnonzero(_changes(a) | _changes(b))
        enough = first[np.add.reduceat(shared, first) >= asked[first]]
        a, of_a, b, of_b = (c[enough] for c in (a, of_a, b, of_b))
        edges = np.append(np.flatnonzero(_changes(a) | _changes(of_b)), len(a)).tolist()
        rows = [(int(min(of_a[lo], of_b[lo])), int(max(of_a[lo], of_b[lo])), int(a[lo]), hi - lo, packed(b[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(rows, columns=["x", "y", "id", "n", "bs"])

    some = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    mixed = entries.groupBy("fp").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("rows")).where("c0 <> c1")
    mixed = cut(mixed.select("fp", "c0", "rows"))
    spread = F.least(F.sum("rows") / GROUP_LEAST, F.lit(GROUP_PARTS).cast("double"))
    tiles = F.ceil(F.greatest(F.sum("rows") / GROUP_ENTRIES, F.max("rows") / POSTING_BLOCK, spread)).cast("long")
    wide = cut(mixed.groupBy("c0").agg(tiles.alias("parts"), F.sum("rows").alias("rows")).where("parts > 1"))
    met = cut(entries.join(mixed.select("fp", "c0"), "fp"))
    homes = met.groupBy("id").agg(F.min("c0").alias("c0"), F.min("size").alias("size"))
    heavy = cut(homes.groupBy("c0").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("long").alias("subs")).where("subs > 1"))
    sub = F.pmod(F.xxhash64("id"), some(F.col("subs")))
    homes = homes.join(F.broadcast(heavy), "c0", "left").select("id", F.pmod(F.xxhash64("c0", sub), F.lit(parts).cast("long")).alias("home"))
    left = met.join(homes, "id").join(F.broadcast(wide), "c0", "left").withColumn("parts", some(F.col("parts")))
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = left.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    dealt = buckets + (wide.agg(F.sum(F.col("rows") * F.col("parts"))).first()[0] or 0) // GROUP_ENTRIES
    left = left.withColumn("bucket", F.pmod(F.xxhash64("c0", "x", "y"), F.lit(dealt)))
    left = left.select("bucket", "c0", "x", "y", "fp", "part", "id", "comp", "size", "need", "home")
    lists = cut(left.groupBy("bucket").applyInPandas(meet, "a long, of_a long, n long, bs binary, of_bs binary, shared binary, asked binary"))
    pairs = lists.agg(F.sum("n")).first()[0] or 0
    again = lists.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(max(buckets, -(-pairs // PAIRS_TOGETHER)))))
    return again.groupBy("bucket").applyInPandas(settle, CROSS)


def _changes(c: np.ndarray) -> np.ndarray:
    """Where a column's runs of equal values begin."""
    return np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS_TOGETHER) for whole in batches for at in range(0, whole.num_rows, TEXTS_TOGETHER)):
            sides = []
            for name in ("ta", "tb"):
                sets = []
                for block in blocks(batch.column(name)):
                    grams, offsets = shingle_sets(block)
                    sets += [grams[offsets[i] : offsets[i + 1]] for i in range(block.n)]
                sides.append(sets)
            keep = []
            for x, y in zip(*sides, strict=True):
                if not len(x) or not len(y):
                    keep.append(False)
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _new_links(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links among the pairs that whole tiles list, enough to join all that these pairs link. Rows of `table`: lists
    (id, n, bs) and texts (id, text) of all documents that the lists name."""
    given = table.filter(pc.is_valid(table.column("text")))
    ids, first = np.unique(given.column("id").to_numpy(), return_index=True)
    sets, sizes = [], []
    for block in blocks(given.column("text").take(pa.array(first))):
        grams, offsets = shingle_sets(block)
        sets.append(grams)
        sizes.append(np.diff(offsets))
    lists = table.filter(pc.is_valid(table.column("bs")))
    if not lists.num_rows:
        return [], []
    grams, size = np.concatenate(sets), np.concatenate(sizes)
    start = np.cumsum(size) - size
    joined = np.arange(len(ids))
    left, right = [], []
    for a, n, bs in zip(lists.column("id").to_pylist(), lists.column("n").to_pylist(), lists.column("bs").to_pylist(), strict=True):
        i = int(np.searchsorted(ids, a))
        mine = grams[start[i] : start[i] + size[i]]
        others = np.searchsorted(ids, unpacked(bs, n, np.int64))
        while len(others := others[joined[others] != joined[i]]):
            some = others[: max(1, int(np.searchsorted(np.cumsum(size[others]), TOGETHER)))]
            others = others[len(some) :]
            edges = np.cumsum(size[some]) - size[some]
            theirs = grams[np.repeat(start[some] - edges, size[some]) + np.arange(size[some].sum())]
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), edges)
            for j in some[100 * both >= percent * (size[i] + size[some] - both)].tolist():
                if joined[j] != joined[i]:
                    left.append(a)
                    right.append(int(ids[j]))
                    joined[joined == joined[j]] = joined[i]
    return left, right


def verify_lists(lists: DataFrame, texts: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Verified pairs (a, b) out of `_cross_pairs`, enough to join all that its pairs link."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, own, n = (batch.column(c).to_numpy() for c in ("x", "y", "id", "n"))
            partners = [unpacked(d, m, np.int64) for d, m in zip(batch.column("bs").to_pylist(), n.tolist(), strict=True)]
            tile = np.stack([np.append(x, np.repeat(x, n)), np.append(y, np.repeat(y, n)), np.concatenate([own, *partners])])
            tile = tile[:, np.lexsort(tile[::-1])]
            if tile.shape[1]:
                tile = tile[:, np.concatenate(([True], (tile[:, 1:] != tile[:, :-1]).any(axis=0)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in tile], names=["x", "y", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            a, b = _new_links(table, percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.nbytes for t in held) > TILE_BYTES:
                table = pa.concat_tables(held)
                x, y = (table.column(c).to_numpy() for c in ("x", "y"))
                begun = int(np.argmax((x == x[-1]) & (y == y[-1])))
                if begun:  # the last tile may go on
                    yield links(table.slice(0, begun))
                held = [table.slice(begun)]
        if held:
            yield links(pa.concat_tables(held))

    dealt = lists.repartition(buckets, "x", "y")
    wanted = dealt.mapInArrow(named, "x long, y long, id long").distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    given = wanted.join(texts, "id").select("x", "y", "id", nothing("long").alias("n"), nothing("binary").alias("bs"), "text")
    rows = lists.withColumn("text", nothing("string")).unionByName(given)
    return rows.repartition(buckets, "x", "y").sortWithinPartitions("x", "y").mapInArrow(run, "a long, b long")


SET = ["k1", "k2", "n"]


def _sets(keys: DataFrame) -> DataFrame:
    """One row for each set that isn't empty: its number `node`, lowest id, and the row that stands for it
    (rep: blank, id, h, rows repeating both)."""
    rows = keys.where("n > 0").groupBy("id", "h", *SET).agg(F.count(F.lit(1)).alias("rows"))
    rep = F.min(F.struct(F.col("id").isNull().alias("blank"), "id", "h", "rows")).alias("rep")
    return cut(rows.groupBy(*SET).agg(rep, F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()))


def _links(texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Verified links (a, b) between the nodes of `sets`, enough to join all that are linked; None without sets."""
    total = sets.agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"), F.max("rep.rows").alias("r")).first()
    if not total.s:
        return None
    buckets = max(1, -(-total.s // BUCKET_SHINGLES))
    reps = sets.select("node", F.col("rep.id").alias("rid"), F.col("rep.h").alias("rh"), F.col("rep.rows").alias("rows"))
    reps = F.broadcast(reps) if total.c <= FEW_ROWS else reps
    met = texts.join(reps, F.col("id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh"))).select(F.col("node").alias("id"), "text", "rows")
    mine = met.select("id", "text")
    if total.r > 1:
        again = met.where("rows > 1").groupBy("id").agg(F.first("text").alias("text"))
        mine = met.where("rows = 1").select("id", "text").union(cut(again))
    top = _frequencies(mine, buckets).orderBy(F.desc("n"), "fp").limit(FREQUENT).toArrow()
    fp = top.column("fp").to_numpy().view(np.uint64)
    order = np.argsort(fp)
    frequent = (fp[order], top.column("n").to_numpy()[order])
    entries = cut(_postings(_index(mine, frequent, buckets, percent), percent))
    ids = entries.select("id").distinct()
    ids = cut(ids)
    ids = F.broadcast(ids) if ids.count() <= 4 * FEW_ROWS else ids
    wanted = cut(mine.join(ids, "id", "left_semi"))
    like = f"size * {percent} <= 100 * low_size and low_size * {percent} <= 100 * size"
    stars = entries.where("id <> low").where(like).select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(verify(stars, wanted, percent))
    comp = components(links, "a", "b")
    placed = entries.join(comp, entries.id == comp.node, "left").select("fp", "id", "size", "need", F.coalesce("component", "id").alias("comp"))
    lists = cut(_cross_pairs(placed, percent, 4 * buckets, max(1, -(-total.s // BLOCK_SHINGLES))))
    return links.union(cut(verify_lists(lists, wanted, percent, buckets)))


def _classed(sets: DataFrame, links: DataFrame | None) -> DataFrame:
    """sets with `class`, the number of their component."""
    if links is None:
        return sets.withColumn("class", F.col("node"))
    comp = cut(components(links, "a", "b")).withColumnRenamed("node", "placed")
    return sets.join(comp, sets.node == comp.placed, "left").select(*sets.columns, F.coalesce("component", "node").alias("class"))


def near_duplicate_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (lowest doc_id reachable by links) for every row of docs."""
    texts = _texts(docs)
    keys = cut(set_keys(texts))
    sets = _sets(keys)
    links = _links(texts, sets, percent)
    if links is not None:  # an id with several texts joins them
        several = keys.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct(*SET)).alias("s0"), F.max(F.struct(*SET)).alias("s1")).where("s0 <> s1")
        several = cut(keys.where("n > 0").join(several.select("id"), "id", "left_semi").select("id", *SET).distinct())
        numbered = cut(several.join(sets.select(*SET, "node"), SET).select("id", "node"))
        least = numbered.groupBy("id").agg(F.min("node").alias("a"))
        links = links.union(numbered.join(least, "id").where("a <> node").select("a", F.col("node").alias("b")))
    classed = cut(_classed(sets, links))
    top = classed.groupBy("class").agg(F.min("id").alias("top"))
    out = keys.join(classed.join(top, "class").select(*SET, "top"), SET, "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("top", "id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each near-duplicate component: that of the lowest doc_id."""
    texts = _texts(docs)
    keys = cut(set_keys(texts))
    sets = _sets(keys)
    best = _classed(sets, _links(texts, sets, percent)).groupBy("class").agg(F.min("rep").alias("rep")).select("rep.id", "rep.h", "rep.rows")
    # of empty sets those with null ids stay all, so they count as met once
    empty = keys.where("n = 0").groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows"))
    empty = empty.withColumn("rows", F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.col("rows")))
    kept = cut(best.union(empty).select(F.col("id").alias("tg_id"), F.col("h").alias("tg_h"), F.col("rows").alias("tg_rows")))
    size = kept.agg(F.count(F.lit(1)).alias("c"), F.max("tg_rows").alias("r")).first()
    kept = F.broadcast(kept) if size.c <= FEW_ROWS else kept
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]
    text = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct(*docs.columns).alias("tg_row"), F.col("doc_id").alias("tg_doc"), text.alias("tg_text"), F.xxhash64(*plain).alias("tg_order"))
    on = F.col("tg_doc").eqNullSafe(F.col("tg_id")) & (F.col("tg_text") == F.col("tg_h"))
    once = rows.join(kept.where("tg_rows = 1"), on, "left_semi").select("tg_row.*")
    if (size.r or 1) == 1:
        return once
    again = rows.join(kept.where("tg_rows > 1"), on)
    one = again.groupBy("tg_id", "tg_h").agg(F.min_by("tg_row", "tg_order").alias("tg_row"))
    return once.union(one.select("tg_row.*"))
