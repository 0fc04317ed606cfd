"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Each text becomes a vector of transformed statistics. For every (lang, source) group the minimum
covariance determinant estimate is found by concentration steps from three starts: keep the `support` share
of the group's rows with the smallest distances, re-estimate mean and covariance from their sums, repeat;
of the three results the one of least determinant stays. A document is rejected when its Mahalanobis distance
is beyond `cutoff` or when the base rules fail. Every step is a grouped aggregate over all rows with map-side
combine, so a source holding a third of the corpus is one group of partial sums, never one task's rows.

Defined results: null or empty text has no words and fails the base rules; null lang or source form
groups of their own; repeated rows are judged alike; a group with fewer than `min_group` rows takes the
estimate of all rows together; an empty table gives no rows; other columns are carried untouched, whatever
their names; ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .words import SPACE, Block, binary_column, blocks, mix, ngram_hash, repeated, span_hash

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits"]
FEATURES = ["word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits"]
#: Least standard deviation of each feature: below it, differences don't count as unusual.
FLOORS = [0.15, 0.35, 0.50, 0.45, 0.30, 0.30, 0.70]
#: Bins of a unit of log distance.
BINS = 200
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?.,;:\"'()[]{}-_+=/\\@^~`")] = True


def block_counts(block: Block) -> dict[str, np.ndarray]:
    """The base counts of every document of a block."""
    data, n = block.data, block.n
    sums = block.prefix_hash()
    starts, ends, owner = block.words()
    solid = ~SPACE[data]
    out = {"n_words": np.bincount(owner, minlength=n)}
    out["word_chars"] = block.per_doc(solid & ((data & 0xC0) != 0x80))
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_marks", MARK), ("n_digits", DIGIT)):
        out[name] = block.per_doc(table[data])

    line_starts, line_ends = block.lines()
    solid_sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=solid_sums[1:])
    full = solid_sums[line_ends] > solid_sums[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = block.owner(line_starts)
    keys = span_hash(sums, line_starts, line_ends) + mix(line_owner.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=n)

    grams = ngram_hash(span_hash(sums, starts, ends), WINDOW)
    inside = owner[: len(grams)] == owner[WINDOW - 1 :][: len(grams)]
    keys = mix(grams + mix(owner[: len(grams)].astype(np.uint64)))
    at = np.flatnonzero(inside)
    at = at[repeated(keys[at])]
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + WINDOW, 1)
    covered = np.cumsum(steps[:-1]) > 0
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistic vectors, one row per document."""
    words = np.maximum(c["n_words"], 1).astype(float)
    chars = np.maximum(c["word_chars"], 1).astype(float)
    lines = np.sqrt(np.minimum(c["n_dup_lines"] * 12.0 / words, 1))
    logit = lambda part, scale: np.log1p(scale * part)
    return np.stack(
        [
            np.log(chars / words),
            logit(c["n_symbols"] / words, 20),
            lines,
            np.sqrt(c["n_repeat_words"] / words),
            logit(c["n_upper"] / chars, 10),
            logit(c["n_marks"] / words, 5),
            logit(c["n_digits"] / chars, 20),
        ],
        axis=1,
    )


def with_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Carried columns, the base counts and a feature array for every row of docs."""
    fields = [docs.schema[c] for c in carry]
    fields += [T.StructField(f"tg_{c}", T.LongType()) for c in COUNTS]
    schema = T.StructType([*fields, T.StructField("tg_z", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("tg_text")):
                counts = block_counts(block)
                z = features(counts)
                part = batch.slice(block.first, block.n)
                columns = [part.column(part.schema.names.index(c)) for c in carry]
                columns += [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
                flat = pa.array(z.ravel())
                ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                columns.append(pa.ListArray.from_arrays(ends, flat))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    taken = docs.select(*carry, F.col("text").cast("string").alias("tg_text"))
    return taken.mapInArrow(run, schema)


def chi_square(d: int, normal_quantile: float) -> float:
    """Wilson-Hilferty: chi-square quantile of d degrees at the given normal quantile."""
    return d * (1 - 2 / (9 * d) + normal_quantile * np.sqrt(2 / (9 * d))) ** 3


D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _distance() -> Column:
    diff = [F.col("tg_z")[i] - F.col("tg_mean")[i] for i in range(D)]
    terms = [diff[i] * diff[j] * F.col("tg_inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return reduce(lambda a, b: a + b, terms)


def _inverses(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sums of z and of products to mean, inverse covariance (floored on the diagonal) and determinant."""
    for batch in rows:
        frame = batch.to_pydict()
        means, inverses, sizes = [], [], []
        for n, s, p in zip(frame["n"], frame["sums"], frame["products"], strict=True):
            mean = np.array(s) / n
            cov = np.zeros((D, D))
            for value, (i, j) in zip(p, PAIRS, strict=True):
                cov[i, j] = cov[j, i] = value / n - mean[i] * mean[j]
            cov += np.diag(np.square(FLOORS))
            inverse = np.linalg.inv(cov)
            means.append(mean.tolist())
            inverses.append([float(inverse[i, j]) for i, j in PAIRS])
            sizes.append(float(np.linalg.slogdet(cov)[1]))
        kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        columns = [pa.array(c, k) for c, k in zip([means, inverses, sizes], kinds, strict=True)]
        keys = [batch.column(batch.schema.names.index(c)) for c in MODELS]
        yield pa.RecordBatch.from_arrays([*keys, *columns], names=[*MODELS, "tg_mean", "tg_inverse", "tg_logdet"])


#: tg_own: a group of (lang, source) with an estimate of its own; false: all rows together.
GROUP = ["tg_lang", "tg_source", "tg_own"]
MODELS = [*GROUP, "tg_start"]
MODEL = "tg_lang string, tg_source string, tg_own boolean, tg_start int, tg_mean array<double>, tg_inverse array<double>, tg_logdet double"


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Broadcast a table of groups when its counted size is small; else leave it to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def _joined(z: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    on = [z[c].eqNullSafe(model[c]) for c in keys]
    return z.join(small(model), on).drop(*[model[c] for c in keys])


def _quantile(near: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and tg_limit: the upper end of the bin of `d` in which the share is reached. Bins are fixed, so
    the limit is the same however rows are partitioned, and a group of any size is a few thousand counts."""
    bins = near.groupBy(*keys, F.floor(F.log(F.col("d") + 1e-9) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*keys)
    run = bins.withColumns({"below": F.sum("c").over(group.orderBy("bin")), "all": F.sum("c").over(group)})
    reached = run.where(F.col("below") >= F.ceil(F.col("all") * F.lit(share)))
    return reached.groupBy(*keys).agg(F.exp((F.min("bin") + 1) / F.lit(float(BINS))).alias("tg_limit"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("tg_z")[i]) for i in range(D)]).alias("sums"),
        F.array(*[F.sum(F.col("tg_z")[i] * F.col("tg_z")[j]) for i, j in PAIRS]).alias("products"),
    )


def _starts(z: DataFrame) -> DataFrame:
    """Three first estimates of every group: medians with quartile ranges, the plain mean and covariance of all
    rows, and medians with the covariance of the half of the rows next to them."""
    quartiles = z.groupBy(*GROUP).agg(*[F.percentile_approx(F.col("tg_z")[i], [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(D)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(D)]
    first = cut(
        quartiles.select(
            *GROUP,
            F.lit(0).alias("tg_start"),
            F.array(*[F.col(f"q{i}")[1] for i in range(D)]).alias("tg_mean"),
            F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("tg_inverse"),
            F.lit(0.0).alias("tg_logdet"),
        )
    )
    near = _joined(z, first, GROUP).withColumn("d", _distance())
    half = _joined(near, cut(_quantile(near, GROUP, 0.5)), GROUP).where("d <= tg_limit")
    sums = _moments(z, GROUP).withColumn("tg_start", F.lit(1)).unionByName(_moments(half, GROUP).withColumn("tg_start", F.lit(2)))
    return cut(first.unionByName(sums.mapInArrow(_inverses, MODEL)))


def fit(stats: DataFrame, steps: int = 3, support: float = 0.75, min_group: int = 60) -> tuple[DataFrame, DataFrame]:
    """The (lang, source) groups with an estimate of their own, and mean, inverse covariance and scale of every
    group and of all rows together: of the starts, the estimate of least determinant after its steps."""
    sizes = stats.groupBy(*GROUP[:2]).agg(F.count(F.lit(1)).alias("size"))
    big = cut(sizes.where(F.col("size") >= min_group).select(*GROUP[:2], F.lit(True).alias("tg_own")))
    every = stats.select(*[F.lit(None).cast("string").alias(c) for c in GROUP[:2]], F.lit(False).alias("tg_own"), "tg_z")
    z = cut(_joined(stats, big, GROUP[:2]).select(*GROUP, "tg_z").union(every))
    model = _starts(z)
    for _ in range(steps):
        near = _joined(z, model, GROUP).withColumn("d", _distance())
        core = _joined(near, cut(_quantile(near, MODELS, support)), MODELS).where("d <= tg_limit")
        model = cut(_moments(core, MODELS).mapInArrow(_inverses, MODEL))
    best = F.min_by(F.struct("tg_mean", "tg_inverse"), F.struct("tg_logdet", "tg_start")).alias("best")
    model = cut(model.groupBy(*GROUP).agg(best).select(*GROUP, "best.*"))
    near = _joined(z, model, GROUP).withColumn("d", _distance())
    scale = F.greatest(F.col("tg_limit") / chi_square(D, 0.0), F.lit(0.05)).alias("tg_scale")
    limits = cut(_quantile(near, GROUP, 0.5).select(*GROUP, scale))
    return big, cut(_joined(model, limits, GROUP))


def judge(counted: DataFrame, fitted: tuple[DataFrame, DataFrame], cutoff: float) -> DataFrame:
    """Adds tg_failed, tg_distance and tg_kept; rows of small groups are held against all rows together."""
    big, model = fitted
    failed = (F.col("tg_n_words") < MIN_WORDS) | (
        100 * F.col("tg_n_repeat_words") > REPEAT_PERCENT * F.col("tg_n_words")
    )
    side = small(big)
    met = counted.join(side, [counted[c].eqNullSafe(side[c]) for c in GROUP[:2]], "left").drop(*[side[c] for c in GROUP[:2]])
    own = F.coalesce("tg_own", F.lit(False))
    met = met.withColumns({"tg_own": own, **{f"{c}_key": F.when(own, F.col(c)) for c in GROUP[:2]}})
    keyed = model.withColumnsRenamed({c: f"{c}_key" for c in GROUP[:2]})
    met = _joined(met, keyed, [f"{c}_key" for c in GROUP[:2]] + ["tg_own"])
    met = met.withColumn("tg_failed", failed).withColumn("tg_distance", F.sqrt(_distance() / F.col("tg_scale")))
    return met.withColumn("tg_kept", ~F.col("tg_failed") & (F.col("tg_distance") <= cutoff))


CUTOFF = 8.0


def quality_outliers(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept for every document."""
    keyed = docs.select("doc_id", "text", *[F.col(c).cast("string").alias(f"tg_{c}") for c in ("lang", "source")])
    counted = cut(with_counts(keyed, ["doc_id", *GROUP[:2]]))
    judged = judge(counted, fit(counted.select(*GROUP[:2], "tg_z")), cutoff)
    return judged.select(
        "doc_id",
        *[F.col(f"tg_{c}").alias(c) for c in COUNTS[:5]],
        F.col("tg_failed").alias("base_failed"),
        F.col("tg_distance").alias("distance"),
        F.col("tg_kept").alias("kept"),
    )


def keep_quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that pass, with their columns; texts are read again instead of being stored."""
    groups = [F.col(c).cast("string").alias(f"tg_{c}") for c in ("lang", "source")]
    keyed = docs.select("text", F.struct(*docs.columns).alias("tg_row"), *groups)
    stats = cut(with_counts(keyed, GROUP[:2]).select(*GROUP[:2], "tg_z"))
    judged = judge(with_counts(keyed, ["tg_row", *GROUP[:2]]), fit(stats), cutoff)
    return judged.where("tg_kept").select("tg_row.*")
