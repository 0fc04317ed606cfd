import hashlib
import math

import numpy as np
import pytest

from tallyglass.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, state int, error int"


def brute(rows):
    """Plain integer rounds over every entry."""
    kept = [(i, v, b) for i, v, b in rows if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[max(-(2**26), min(2**26, math.floor(1024 * x) if abs(x) < 1e300 else int(math.copysign(2**27, x)))) for x in v] for _, v, _ in kept]
    x = np.array(whole, np.int64).reshape(len(kept), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()
    nearest = lambda p: np.stack([((x[:, p] - e) ** 2).sum(1) for e in books[p]], 1)
    for _ in range(4):
        for p in range(4):
            own = nearest(p).argmin(1)
            for e in set(own.tolist()):
                books[p][e] = [int(s) // int((own == e).sum()) for s in x[own == e, p].sum(0)]
    squares = [nearest(p) for p in range(4)]
    codes = np.stack([s.argmin(1) for s in squares], 1)
    error = sum(s.min(1) for s in squares)
    by = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), e, by[label], digest) for (i, _, label), c, e in zip(kept, codes.astype(np.uint8), error.tolist(), strict=True)), key=str)


def report(docs):
    return sorted((tuple(r) for r in vector_codes.code_report(docs).collect()), key=str)


def test_the_given_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert report(e) == brute([(r.vec_id, r.embedding, r.label) for r in e.collect()])


@pytest.mark.parametrize("close", [24, 2])
def test_many_ties_and_clusters(spark, close, monkeypatch):
    """Coarse coordinates tie all the time; ids beyond 2**53 beside a null one; repeated rows."""
    monkeypatch.setattr(vector_codes, "FIRST_CLOSE", close)
    rng = np.random.default_rng(7)
    coarse = (rng.integers(-3, 4, (2500, 8)) / 2).tolist()
    fine = (rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 8)) / 20).tolist()
    rows = [(2**53 + 3 * i, v, [None, 1, 2][i % 3], "x", 1, 2) for i, v in enumerate(coarse + fine)]
    rows += [(None, [0.5] * 8, 1, "x", 1, 2)] + rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    assert report(df) == brute([r[:3] for r in rows])


def test_odd_vectors(spark):
    rows = [(5, [0.1, -0.1, 2.0, 1e-9], 1), (4, None, 1), (3, [], 1), (2, [1.0, None, 0.0, 0.0], 1), (1, [float("nan"), 0.0, 0.0, 0.0], None), (6, [float("inf"), 0.0, 0.0, 0.0], 2)]
    rows += [(7, [1e308, -1e308, 3e5, 0.0], None), (8, [0.0, -0.0, 0.0, 0.0], None), (9, [1.0, 2.0, 3.0], 1), (10, [1.0] * 8, 1), (5, [0.1, -0.1, 2.0, 1e-9], 1)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    want = brute(rows)
    assert report(df) == want and len(want) == 4
    assert report(df.where("vec_id < 5")) == []


def test_bounds_save_work_and_stay_right():
    """Two moves of a codebook: most parts keep their entry unseen, and all have the nearest."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (5000, 16))
    book = x[:256].astype(np.int64)
    state = np.zeros(len(x), vector_codes.state_type(24))
    vector_codes.from_scratch(x, book, state, 0, np.arange(len(x)))
    for close in (24, 40, 5):
        new = book + rng.integers(-60, 60, book.shape)
        state = vector_codes.carried_over(state, close)
        vector_codes.moved(x, new, ((new - book) ** 2).sum(1), state, 0)
        book = new
        assert (state["own"][:, 0] == vector_codes.all_squares(x, book).argmin(1)).all()
    assert (state["seen"][:, 0] == close + 1).mean() < 0.9


def test_number_of_close_entries_adapts():
    assert vector_codes.adapted(24, {0: 90, 25: 10}) == 48
    assert vector_codes.adapted(24, {0: 90, 7: 10}) == 7
    assert vector_codes.adapted(24, {0: 99, 25: 1}) == vector_codes.LEAST_CLOSE
    assert vector_codes.adapted(64, {65: 10}) == 64
