"""Vector code compression: one codebook for each of `PARTS` parts of the vectors, with adaptive distance bounds.

Components become integers, floor(`SCALE` * x). Each part position has a codebook of up to `ENTRIES` entries,
refined in `ROUNDS` rounds of nearest-entry assignment and componentwise floored means. What a part knows of
its codebook is kept from round to round, in a table written each time: its entry with an upper bound of the
distance, the `b` closest other entries with a lower bound each, and one outer lower bound for all the rest.
When entries have moved, bounds move by as much; taken in order, a bound holds for its entry and all after it.
A part whose upper bound lies below the first lower bound keeps its entry unseen. Otherwise the distance to its
own entry is computed, and as many of the close entries as its bound does not exclude are compared by whole
numbers; where even the outer bound excludes nothing, all are. So bounds only ever save work: ties go to the lower index
because every case that bounds leave open is settled in integers.

`b` adapts: it doubles where many parts had to compare all entries, and else falls to the deepest close entry
that was needed.

Codebooks and their sums have a fixed size and are all that reaches the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, as are vectors
whose length is no multiple of `PARTS` or is not that of the smallest kept vec_id; scaled components stop at
+-2**26 so that distances fit 64 bits; null vec_ids count as the largest, and rows of one vec_id follow their vectors;
with fewer rows than `ENTRIES` the codebooks have that many entries; repeated rows are coded each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 26
FIRST_CLOSE, LEAST_CLOSE, MOST_CLOSE = 24, 4, 64
MANY = 0.02
SLACK = 1e-6  # wider than the rounding of 32-bit bounds


def state_type(close: int) -> np.dtype:
    """What is kept of a vector's parts: entry, upper bound, close entries with lower bounds, outer bound, and how
    many close entries the last round looked at (close + 1: all entries)."""
    return np.dtype([("own", "u1", PARTS), ("upper", "f4", PARTS), ("ids", "u1", (PARTS, close)), ("lower", "f4", (PARTS, close)), ("outer", "f4", PARTS), ("seen", "u1", PARTS)])


def scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)


def up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def all_squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if most * most * 4 * x.shape[1] < 1 << 53:  # doubles are exact
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def from_scratch(x: np.ndarray, book: np.ndarray, out: np.ndarray, part: int, rows: np.ndarray) -> None:
    """State of the given rows from distances to all entries."""
    close = out.dtype["ids"].shape[1]
    for s in range(0, len(rows), 4096):
        at = rows[s : s + 4096]
        squares = all_squares(x[at], book)
        order = np.argsort(squares, axis=1, kind="stable")
        ranked = np.take_along_axis(squares, order, axis=1)
        have = min(close, len(book) - 1)
        out["own"][at, part] = order[:, 0]
        out["upper"][at, part] = up(ranked[:, 0])
        ids, lower = np.zeros((len(at), close), np.uint8), np.full((len(at), close), np.inf)
        ids[:, :have], lower[:, :have] = order[:, 1 : 1 + have], down(ranked[:, 1 : 1 + have])
        out["ids"][at, part], out["lower"][at, part] = ids, lower
        out["outer"][at, part] = down(ranked[:, have + 1]) if len(book) > have + 1 else np.inf
        out["seen"][at, part] = close + 1


def carried_over(old: np.ndarray, close: int) -> np.ndarray:
    """States with another number of close entries: surplus ones join the outer bound, new places are empty."""
    out = np.zeros(len(old), state_type(close))
    for name in ("own", "upper", "outer"):
        out[name] = old[name]
    have = min(close, old.dtype["ids"].shape[1])
    out["lower"] = np.inf
    out["ids"][..., :have], out["lower"][..., :have] = old["ids"][..., :have], old["lower"][..., :have]
    if have < old.dtype["ids"].shape[1]:
        out["outer"] = np.minimum(out["outer"], old["lower"][..., have:].min(axis=2))
    return out


def moved(x: np.ndarray, book: np.ndarray, moves: np.ndarray, out: np.ndarray, part: int) -> None:
    """Bring the states of one part position up to a moved codebook."""
    close = out.dtype["ids"].shape[1]
    step = up(moves)
    own = out["own"][:, part].astype(np.int64)
    upper = (out["upper"][:, part].astype(np.float64) + step[own]) * (1 + SLACK)
    shifted = lambda low, by: low - by - np.where(np.isfinite(low), np.abs(low), 0) * SLACK
    ids = out["ids"][:, part].astype(np.int64)
    lower = shifted(out["lower"][:, part].astype(np.float64), step[ids])
    outer = shifted(out["outer"][:, part].astype(np.float64), step.max())
    ordered = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    seen = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(upper >= ordered[:, 0])
    exact = ((x[open_] - book[own[open_]]) ** 2).sum(1)
    upper[open_] = up(exact)
    still = upper[open_] >= ordered[open_, 0]
    open_, exact = open_[still], exact[still]
    depth = (ordered[open_] <= upper[open_, None]).sum(1)  # of ordered bounds: how many are not above
    everything = open_[depth > close]
    some, depth, exact = open_[depth <= close], depth[depth <= close], exact[depth <= close]
    for z in np.unique(depth):
        rows = some[depth == z]
        near = np.concatenate([own[rows, None], ids[rows, :z]], axis=1)
        squares = np.empty(near.shape, np.int64)
        squares[:, 0] = exact[depth == z]
        for j in range(1, near.shape[1]):
            squares[:, j] = ((x[rows] - book[near[:, j]]) ** 2).sum(1)
        order = np.lexsort((near, squares), axis=1)
        near, squares = np.take_along_axis(near, order, 1), np.take_along_axis(squares, order, 1)
        own[rows], upper[rows] = near[:, 0], up(squares[:, 0])
        ids[rows, :z], lower[rows, :z] = near[:, 1:], down(squares[:, 1:])
        seen[rows] = z
    out["own"][:, part], out["upper"][:, part], out["ids"][:, part] = own, upper, ids
    out["lower"][:, part], out["outer"][:, part], out["seen"][:, part] = lower, outer, seen
    from_scratch(x, book, out, part, everything)


def adapted(close: int, seen: dict[int, int]) -> int:
    """The next number of close entries, from how many parts looked at how many of them."""
    total, everything = sum(seen.values()), seen.get(close + 1, 0)
    if everything > MANY * total:
        return min(2 * close, MOST_CLOSE)
    return max(LEAST_CLOSE, max((z for z in seen if z <= close), default=0))


def packed_vectors(vectors: DataFrame, fit: DataFrame) -> DataFrame:
    """vec_id, label and the scaled vector as 32-bit integers."""
    kinds = [vectors.schema["vec_id"], vectors.schema["label"], T.StructField("vector", T.BinaryType())]
    schema = T.StructType(kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e = batch.column("e")
            x = scaled(e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype("<i4").tobytes()
            width = len(x) // batch.num_rows
            cells = pa.array([x[i : i + width] for i in range(0, len(x), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), cells], names=schema.names)

    return fit.mapInArrow(pack, schema)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """vec_id, label, codes (binary, one byte a part) and error of every kept row; and the codebooks, an
    array by part, entry and position within the part. Without a kept row: None and no codebooks."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", e.alias("e"))
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.coalesce(~bad & (F.size("e") > 0) & (F.size("e") % PARTS == 0), F.lit(False)))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(1).select(F.size("e").alias("n")).first()
    if first is None:
        return None, np.zeros((PARTS, 0, 0), np.int64)
    dim = first.n
    fit = rows.where(F.size("e") == dim)
    begin = fit.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(ENTRIES).select("e").collect()
    books = scaled(np.array([r.e for r in begin])).reshape(len(begin), PARTS, -1).transpose(1, 0, 2)
    state = cut(packed_vectors(vectors, fit))
    close, moves = min(FIRST_CLOSE, ENTRIES - 1), None
    for turn in range(rounds + 1):
        assigned = assign(state, books, moves, close, dim)
        if turn == rounds:
            return assigned.select("vec_id", "label", "codes", "error"), books
        state = cut(assigned)
        totals, seen = sums(state, books.shape, close)
        counts = totals[..., -1:]
        new = np.where(counts > 0, totals[..., :-1] // np.maximum(counts, 1), books)
        moves, books = ((new - books) ** 2).sum(2), new
        close = adapted(close, seen)


def assign(state: DataFrame, books: np.ndarray, moves: np.ndarray | None, close: int, dim: int) -> DataFrame:
    """One assignment round over kept states (moves given) or over plain vectors: codes, error and new states."""
    names = ["vec_id", "label", "vector"]
    schema = T.StructType([state.schema[c] for c in names] + [T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("state", T.BinaryType())])
    shared = state.sparkSession.sparkContext.broadcast((books, moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").reshape(n, dim).astype(np.int64)
            if moves is None:
                out = np.zeros(n, state_type(close))
            else:
                raw = b"".join(batch.column("state").to_pylist())
                old = (len(raw) // n - state_type(0).itemsize) // (state_type(1).itemsize - state_type(0).itemsize)
                out = carried_over(np.frombuffer(raw, state_type(old)), close)
            error = np.zeros(n, np.int64)
            for p in range(PARTS):
                own = x[:, p * dim // PARTS : (p + 1) * dim // PARTS]
                if moves is None:
                    from_scratch(own, books[p], out, p, np.arange(n))
                else:
                    moved(own, books[p], moves[p], out, p)
                error += ((own - books[p][out["own"][:, p]]) ** 2).sum(1)
            codes = [r.tobytes() for r in out["own"]]
            arrays = [pa.array(codes, pa.binary()), pa.array(error), pa.array([r.tobytes() for r in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=schema.names)

    return state.mapInArrow(run, schema)


def sums(state: DataFrame, shape: tuple[int, int, int], close: int) -> tuple[np.ndarray, dict[int, int]]:
    """Sums of the vectors of every entry with their number last, and how many parts looked at how many entries.
    A task hands on one row for each part and entry."""
    parts, entries, width = shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros((parts, entries, width + 1), np.int64), np.zeros(close + 2, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").reshape(n, parts, width)
            s = np.frombuffer(b"".join(batch.column("state").to_pylist()), state_type(close))
            for p in range(parts):
                np.add.at(totals[p, :, :-1], s["own"][:, p], x[:, p])
                totals[p, :, -1] += np.bincount(s["own"][:, p], minlength=entries)
            seen += np.bincount(s["seen"].ravel(), minlength=close + 2)
        p, e = np.nonzero(totals[..., -1])
        z = np.flatnonzero(seen)
        lists = [*totals[p, e].tolist(), *([int(n)] + [0] * width for n in seen[z])]
        yield pa.RecordBatch.from_arrays([pa.array([*p.tolist(), *[-1] * len(z)], pa.int32()), pa.array([*e.tolist(), *z.tolist()], pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["part", "entry", "totals"])

    found = state.select("vector", "state").mapInArrow(part, "part int, entry int, totals array<bigint>")
    added = found.groupBy("part", "entry").agg(*[F.sum(F.col("totals")[i]).alias(f"s{i}") for i in range(width + 1)]).collect()
    totals, seen = np.zeros((parts, entries, width + 1), np.int64), {}
    for row in added:
        if row.part < 0:
            seen[row.entry] = row.s0
        else:
            totals[row.part, row.entry] = row[2:]
    return totals, seen


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    found, books = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if found is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    found = cut(found)
    labels = cut(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    met = found.join(labels.withColumnRenamed("label", "tg_label"), F.col("label").eqNullSafe(F.col("tg_label")))
    return met.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
