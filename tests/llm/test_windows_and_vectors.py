import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyglass.llm import embedding_dedup, radix_dedup
from tallyglass.llm.words import Block


def window_brute(rows, width=200):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + width] for _, r in raws for i in range(len(r) - width + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~mask].tobytes()
        out.append((d, len(r), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("which", ["documents", "odd"])
def test_windows_equal_brute_force(which, hot, request, monkeypatch):
    if hot:
        monkeypatch.setattr(radix_dedup, "HOT", 2)
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in radix_dedup.repeated_windows(docs).collect())
    assert got == window_brute(rows)


def test_window_passes_in_slices():
    """Slices by offset find what one pass over all windows finds."""
    import pandas as pd

    from tallyglass.llm.words import packed

    rng = np.random.default_rng(3)
    body, cols = b"", {c: [] for c in ("h", "k1", "k2", "lone", "shift", "lo", "more")}
    common = bytes(rng.integers(97, 100, 360).astype(np.uint8))
    for i in range(40):
        text = bytearray(common)
        if i % 2:
            text[rng.integers(0, 360)] = 65
        more = int(rng.integers(0, 161))
        shift = int(rng.integers(0, more + 1))
        start = 100 - shift if shift <= 100 else 0
        piece = bytes(text)[start : start + more + 200]
        more = len(piece) - 200
        body += piece
        for c, v in (("h", 1 + i % 3), ("k1", i), ("k2", 0), ("lone", i % 5 > 0), ("shift", 100 - start), ("lo", 0), ("more", more)):
            cols[c].append(v)
    row = {"bucket": 0, "n": 40, "bytes": len(body), "body": __import__("pyarrow").compress(body, codec="zstd", asbytes=True)}
    kinds = {"h": np.uint64, "lone": bool}
    row |= {c: packed(np.array(v, kinds.get(c, np.int64))) for c, v in cols.items()}

    class Grouped:
        def groupBy(self, *_):
            return self

        def applyInPandas(self, f, _):
            return sorted(map(tuple, f((0,), pd.DataFrame([row])).to_numpy().tolist()))

    whole = radix_dedup._sorted_windows(Grouped(), 200)
    radix_dedup.SLICE_WINDOWS, kept = 300, radix_dedup.SLICE_WINDOWS
    try:
        assert radix_dedup._sorted_windows(Grouped(), 200) == whole
    finally:
        radix_dedup.SLICE_WINDOWS = kept
    assert whole


def test_windows_of_random_repeats(spark):
    rng = np.random.default_rng(5)
    words = [f"s{i}" for i in range(50)]
    parts = [" ".join(rng.choice(words, int(rng.integers(30, 120)))) for _ in range(12)]
    rows = [(i, " é ".join(rng.choice(parts, int(rng.integers(1, 5)))) + f" {i}") for i in range(60)]
    got = sorted(tuple(r) for r in radix_dedup.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == window_brute(rows)


def test_hot_windows_are_runs(spark, monkeypatch):
    """A large group of near copies with a passage of one word repeated: one run a stretch, not one row a window."""
    monkeypatch.setattr(radix_dedup, "HOT", 2)
    monkeypatch.setattr(radix_dedup, "LOT_WINDOWS", 5000)
    common = " ".join(f"c{i}" for i in range(120))
    rows = [(i, f"{common} own {i} {'x' * (i % 7)}" + " same" * 100 + f" {i}") for i in range(60)]
    texts = spark.createDataFrame([(i, 0, i % 10 > 0, t) for i, t in rows], "k1 long, k2 long, lone boolean, text string")
    found = radix_dedup._repeated_anchors(texts, 3, 200).where("hot")
    spans = radix_dedup._hot_windows(radix_dedup._with_lists(texts, found), 5, 200).toPandas()
    assert set(spans.k1) == {i for i in range(60) if i % 10}
    assert len(spans) <= 4 * 60 and (spans.b - spans.a >= 200).all()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in radix_dedup.repeated_windows(docs).collect()) == window_brute(rows)


def test_anchors_do_not_depend_on_the_block():
    rng = np.random.default_rng(8)
    text = rng.integers(97, 123, 3000).astype(np.uint8)
    other = rng.integers(97, 123, 900_000).astype(np.uint8)
    small = radix_dedup.anchors(Block(0, text, np.array([0, 3000])))
    large = radix_dedup.anchors(Block(0, np.concatenate([text, other]), np.array([0, 3000, 903_000])))
    mine = large[0] == 0
    for x, y in zip(small, large, strict=True):
        assert (x == y[mine]).all()


def test_windows_null_ids_and_string_ids(spark):
    same = " ".join(f"n{i}" for i in range(90))
    rows = [(None, same + " end"), (None, same + " end"), (None, "begin " + same), ("a", same), ("b", "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(map(repr, (tuple(r) for r in radix_dedup.repeated_windows(docs).collect())))
    assert got == sorted(map(repr, ((rows[i][0], *w[1:]) for i, w in enumerate(window_brute(list(enumerate(t for _, t in rows)))))))


def test_windows_empty(nothing):
    assert radix_dedup.repeated_windows(nothing).count() == 0


def vector_brute(rows, threshold=0.93):
    fit = []
    for i, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fit.append((i, np.array(v, float) if ok else None, label))
    comp = {i: i for i, _, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = Counter()
    for k, (i, u, a) in enumerate(fit):
        for j, v, b in fit[k + 1 :]:
            if u is None or v is None or a != b or len(u) != len(v):
                continue
            if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return sorted((i, links[i], find(i), find(i) == i) for i, _, _ in rows)


@pytest.mark.parametrize("tile", [32, 1024])
def test_embeddings_equal_brute_force(spark, sf, tile):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = sorted(tuple(r) for r in embedding_dedup.embedding_classes(table, tile=tile).collect())
    assert got == vector_brute(rows)


def test_embeddings_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 8))
    rows = [(i, (base[i % 5] + rng.normal(size=8) * 0.15).tolist(), i % 2) for i in range(80)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [None] * 8, 1), (104, [1.0] * 8, None)]
    rows += [(105, [1.0, 2.0], 1), (106, [1.0, 2.0], 1), (107, [2.0, 4.0], 1), (108, [-0.0, 1.0], 1), (109, [0.0, 1.0], 1), (110, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("x", "kept")
    got = sorted(tuple(r) for r in embedding_dedup.embedding_classes(table, tile=16).collect())
    assert got == vector_brute(rows)
    assert embedding_dedup.embedding_classes(table.limit(0)).count() == 0
    far = [(1, [1e-170, 2e-170], 1), (2, [1e160, 2e160], 1), (3, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (5, [-1e-310, 0.0], 1), (6, [-3.0, 0.0], 1)]
    table = spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_classes(table).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), None: (3, 1), 5: (1, 5), 6: (1, 5)}


def test_embedding_links_beside_a_null_id(spark):
    """A null vec_id beside ids above 2**53: no id is rounded, and the null one links and bridges."""
    big = 2**53
    rows = [(big + 1, [1.0, 0.0], 1), (big + 2, [0.98, 0.2], 1), (big + 3, [0.0, 1.0], 2), (big + 5, [0.05, 1.0], 2), (None, [0.9, 0.44], 1), (big + 7, [0.8, 0.6], 1), (None, [-1.0, 0.0], 1), (None, None, 1)]
    got = embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    want = [(big + 1, 1, big + 1, True), (big + 2, 2, big + 1, False), (big + 3, 1, big + 3, True), (big + 5, 1, big + 3, False), (None, 2, big + 1, None), (big + 7, 1, big + 1, False), (None, 0, None, None), (None, 0, None, None)]
    assert got == sorted(want, key=repr)
