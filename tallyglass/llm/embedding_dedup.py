"""Near duplicates among embeddings: PCA-ordered tiled comparison with residual bounds.

Unit vectors are rotated onto the principal axes of all vectors (second moments summed over the whole
table), so leading coordinates hold most of a product. Within a (label, dimension) group, vectors are
dealt into blocks of about `TILE` along the first axis by a histogram with a running count, and only pairs
of blocks whose first coordinates can be near enough meet as tiles. A tile multiplies the leading
coordinates first; the rest of each product is bounded by the product of the suffix norms, and pairs that
cannot reach the threshold stop there. Survivors take further coordinates the same way and end with the
cosine of the original vectors in double precision.

Equal vectors of a label are compared once, as a class with a count. A tile returns link counts and a
spanning forest of its links, never all pairs. All pairs of blocks in reach are compared, so the work of
a label whose first coordinate separates nothing is quadratic in its different vectors; a vector is sent once
for each block in reach of its own, which is why blocks are large and tiles are read a few rows at a time.

Defined results: null label, null or zero vector, null or non-finite components: no links, own component
(other vectors link at any length, from subnormal to the largest);
vectors of different length are not compared; a null vec_id links like any other, and the component of vectors
without any id is null (other ids up to 2**62); repeated rows are separate vectors (a repeated vec_id is
one node of components); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut

THRESHOLD = 0.93
TILE = 4096
ROWS = 256
CELLS = 512
LEAD = 16


def _second_moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension, from sums of outer products combined in two levels."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in batches:
            for dim, rows in frame.groupby("dim"):
                u = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + u.T @ u
        yield pd.DataFrame([(d, hash(s.tobytes()) % 64, s.tobytes()) for d, s in sums.items()], columns=["dim", "salt", "sums"])

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in frame["sums"])
        return pd.DataFrame([(key[0], 0, total.tobytes())], columns=["dim", "salt", "sums"])

    schema = "dim int, salt int, sums binary"
    parts = vectors.select("dim", "unit").mapInPandas(part, schema)
    sums = parts.groupBy("dim", "salt").applyInPandas(add, schema).groupBy("dim").applyInPandas(add, schema)
    axes = {}
    for row in sums.collect():
        _, basis = np.linalg.eigh(np.frombuffer(row.sums, np.float64).reshape(row.dim, row.dim))
        axes[row.dim] = basis[:, ::-1].copy()
    return axes


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of the links among few nodes, as (node, root) pairs."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = where[: len(a)], where[len(a) :]
    while True:  # labels fall to the least neighbour, then jump
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[root[moved]]])


def scaled_rows(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (no rounding), so that squares of tiny and huge vectors stay in range."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def compare(frame: pd.DataFrame, dim: int, threshold: float, axes: np.ndarray) -> pd.DataFrame:
    """Links of one tile: rows (id, links, -1) with counts and (id, 0, root) for the forest."""
    left, right = frame[frame.side == 0], frame[frame.side == 1]
    same = not len(right)
    if same:
        right = left
    read = lambda f: scaled_rows(np.frombuffer(b"".join(f["vector"]), np.float64).reshape(-1, dim))
    x = read(left)
    y = x if same else read(right)
    nx, ny = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, y))
    p = (x / nx[:, None]) @ axes
    q = p if same else (y / ny[:, None]) @ axes
    suffix = lambda m: np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], 0))
    ps, qs = suffix(p), suffix(q)
    lead = min(LEAD, dim)
    out = []
    weight = [left["n"].to_numpy(), right["n"].to_numpy()]
    ids = [left["id"].to_numpy(), right["id"].to_numpy()]
    links = [np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)]
    for a, b, value in _leading(p, q, ps, qs, lead, threshold, same):
        for at in range(lead, dim, LEAD):
            to = min(dim, at + LEAD)
            value = value + np.einsum("ij,ij->i", p[a, at:to], q[b, at:to])
            rest = ps[a, to] * qs[b, to] if to < dim else 0.0
            on = value + rest >= threshold - 1e-9
            a, b, value = a[on], b[on], value[on]
        if len(a):
            on = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            a, b = a[on], b[on]
            np.add.at(links[0], a, weight[1][b])
            np.add.at(links[1], b, weight[0][a])
            if len(a):
                out.append(_forest(ids[0][a], ids[1][b]))
    if same:
        links = [links[0] + links[1]]
        ids = ids[:1]
    counted = [pd.DataFrame({"id": k[n > 0], "links": n[n > 0], "root": -1}) for k, n in zip(ids, links, strict=True)]
    edges = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pd.concat([*counted, pd.DataFrame({"id": edges[0], "links": 0, "root": edges[1]})], ignore_index=True)


def _leading(p: np.ndarray, q: np.ndarray, ps: np.ndarray, qs: np.ndarray, lead: int, threshold: float, same: bool) -> Iterator[tuple]:
    """Pairs whose leading coordinates leave the threshold in reach, with their products so far, a few rows at a time."""
    for s in range(0, len(p), ROWS):
        bound = p[s : s + ROWS, :lead] @ q[:, :lead].T
        reach = bound + np.outer(ps[s : s + ROWS, lead], qs[:, lead]) if lead < p.shape[1] else bound
        a, b = np.nonzero(reach >= threshold - 1e-9)
        if same:
            a, b = a[a + s < b], b[a + s < b]
        for k in range(0, len(a), 200_000):
            i, j = a[k : k + 200_000], b[k : k + 200_000]
            yield i + s, j, bound[i, j]


def embedding_classes(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", fit)
    top = rows.agg(F.max("vec_id")).first()[0]
    top = -1 if top is None else top
    # vectors that have no id at all are numbered behind all ids, once, in the table that is written next
    numbered = F.coalesce(F.col("id"), F.lit(top) + 1 + F.monotonically_increasing_id())
    classes = rows.where("ok").groupBy("label", "e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("id", numbered)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, scaled, dims = [], [], []
            for v in batch.column("e"):
                v = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # one zero
                raw.append(v.tobytes())
                v = scaled_rows(v[None, :])[0]
                scaled.append((v / np.sqrt((v * v).sum())).tobytes())
                dims.append(len(v))
            arrays = [pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(scaled, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), batch.column("n"), *arrays], names=["label", "id", "n", "dim", "vector", "unit"])

    label = classes.schema["label"].dataType.simpleString()
    base = cut(classes.mapInArrow(unit, f"label {label}, id long, n long, dim int, vector binary, unit binary"))
    axes = base.sparkSession.sparkContext.broadcast(_second_moments(base))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            cell = []
            for dim, u in zip(frame["dim"], frame["unit"], strict=True):
                t = np.frombuffer(u, np.float64) @ axes.value[dim][:, 0]
                cell.append(int(np.clip((t + 1) / 2 * CELLS, 0, CELLS - 1)))
            yield frame.drop(columns="unit").assign(cell=cell)

    turned = cut(base.mapInPandas(turn, f"label {label}, id long, n long, dim int, vector binary, cell int"))
    group = ["label", "dim"]
    counts = turned.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(*group).orderBy("cell")
    before = F.sum("size").over(order) - F.col("size")
    first = F.floor(before / tile)
    cells = counts.select(*group, "cell", first.alias("first"), F.greatest(F.lit(1), F.ceil(F.col("size") / tile)).alias("parts"))
    cells = cut(cells)
    spread = cells.select(*group, "cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "first")
    spread = spread.withColumn("block", F.concat_ws(".", F.col("first"), F.when(F.col("part") > 0, F.concat_ws("_", "cell", "part"))))
    ranges = spread.groupBy(*group, "block").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    reach = float(np.sqrt(2 - 2 * threshold)) * CELLS / 2 + 1
    l, r = ranges.alias("l"), ranges.alias("r")
    near = (F.col("l.block") <= F.col("r.block")) & (F.col("r.lo") - F.col("l.hi") <= reach) & (F.col("l.lo") - F.col("r.hi") <= reach)
    tiles = l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in group]).where(near)
    tiles = cut(tiles.select(*[F.col(f"l.{c}").alias(c) for c in group], F.col("l.block").alias("a"), F.col("r.block").alias("b"), F.monotonically_increasing_id().alias("tile")))
    part = F.pmod(F.xxhash64("id", "vector"), F.col("parts"))
    placed = turned.join(cells, [*group, "cell"]).withColumn("part", part)
    placed = placed.withColumn("block", F.concat_ws(".", F.col("first"), F.when(F.col("part") > 0, F.concat_ws("_", "cell", "part"))))
    slots = tiles.select(*group, F.col("a").alias("block"), F.lit(0).alias("side"), "tile").union(tiles.where("a <> b").select(*group, F.col("b").alias("block"), F.lit(1).alias("side"), "tile"))
    dealt = placed.join(slots, [*group, "block"]).select("tile", "side", "dim", "id", "n", "vector")

    def meet(key, frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iat[0])
        return compare(frame, dim, threshold, axes.value[dim])

    found = cut(dealt.groupBy("tile").applyInPandas(meet, "id long, links long, root long"))
    comp = components(found.where("root >= 0").select("id", "root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = base.select("id", "label", "vector", "n").join(links, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    known = cut(known.select("label", "vector", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0).tobytes() if ok else None for v, ok in zip(batch.column("e"), batch.column("ok").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])

    every = rows.mapInArrow(raw, f"vec_id long, label {label}, vector binary")
    out = every.join(known, ["label", "vector"], "left")
    component = F.when(F.coalesce(F.col("component") <= top, F.lit(True)), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
