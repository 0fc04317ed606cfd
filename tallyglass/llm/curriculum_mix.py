"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a target
stops at `CAP` times its source's size and the excess is shared again by weight (water filling, closed
form over sources ordered by cap / weight). Within a source, documents follow md5(doc_id); the stream of
target words runs over that order again and again, whole documents at a time, so a document is taken
floor(target / size) times and once more when its middle lies before the rest of the target.

Curriculum: a source's weight changes linearly in training time t, density 1 + a(2t - 1); its integral is
inverted so that the cumulative demand at a document's middle gives the training position of each take,
and documents are range-sorted by position.

Cumulative sizes use two levels: sums by (source, hash bucket), then a window inside a bucket of about
`BUCKET_ROWS` rows, so a source holding a third of all rows is never one task's window.

Defined results: null or empty text has size 0 and adds nothing; null source is a source of its own;
repeated rows count each; rows that tie in hash, id and size are interchangeable; an empty table gives no
rows; other columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = [5, 2, 1]
SLOPES = [0.5, 0.0, -0.5]
CAP = 3
BUCKET_ROWS = 4096
SOURCE_ROWS = 100_000
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, rows: int, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums over all rows before each in the given order: range partitions of about `SOURCE_ROWS`
    rows, sums of partitions, and a window inside each, so that no task sorts all sources."""
    parts = max(1, -(-rows // SOURCE_ROWS))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("tg_part", F.spark_partition_id()))
    total = placed.groupBy("tg_part").agg(*[F.sum(v).alias(f"tg_of_{k}") for k, v in sums.items()])
    earlier = Window.orderBy("tg_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("tg_part", *[F.coalesce(F.sum(f"tg_of_{k}").over(earlier), F.lit(0)).alias(f"tg_to_{k}") for k in sums])
    inside = Window.partitionBy("tg_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(F.broadcast(starts) if parts <= 100_000 else starts, "tg_part")
    met = met.withColumns({k: F.col(f"tg_to_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    return met.drop("tg_part", *[f"tg_to_{k}" for k in sums])


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (tg_source, tg_size) to source_size, target and slope; one row per source."""
    sizes = cut(sizes)
    known = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tg_size").cast("decimal(20,0)")).alias("total")).first()
    by_name = [F.col("tg_source").asc_nulls_last()]
    sizes = running(sizes, known.n, by_name, {"tg_place": F.lit(1)})
    place = F.col("tg_place")
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))
    wide = sizes.select(
        "tg_source",
        F.col("tg_size").cast("decimal(20,0)").alias("s"),
        cycle(WEIGHTS).cast("decimal(4,0)").alias("w"),
        cycle(SLOPES).alias("tg_slope"),
    )
    wide = running(wide, known.n, [F.col("s") / F.col("w"), *by_name], {"before": F.col("s") * CAP, "passed": F.col("w")})
    whole = wide.agg(F.sum("w").alias("w")).first().w
    wide = cut(wide.withColumn("rest", F.lit(whole) - F.col("passed")))
    total = F.lit(known.total)
    wide = wide.withColumn("capped", F.col("s") * CAP * F.col("rest") <= (total - F.col("before")) * F.col("w"))
    level = wide.where(~F.col("capped")).agg(F.min(F.struct("before", "rest")).alias("level")).first().level
    num = lambda c: F.col(c).cast("double")
    shared = num("w") * (total.cast("double") - float(level.before)) / float(level.rest) if level else F.lit(None).cast("double")
    return wide.select(
        "tg_source",
        F.col("s").cast("long").alias("tg_source_size"),
        F.when(F.col("capped"), num("s") * CAP).otherwise(shared).alias("tg_target"),
        "tg_slope",
    )


def position(demand: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's integrated weight schedule reaches the given demand."""
    u = F.least(demand / target, F.lit(1.0))
    curved = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, u).otherwise(curved)


def mixed(docs: DataFrame, carry: Column) -> DataFrame:
    """Each row of docs as tg_row (what `carry` keeps) with sizes, target and tg_copies, the times taken."""
    base = docs.select(
        carry.alias("tg_row"),
        F.col("doc_id").alias("tg_id"),
        F.col("source").cast("string").alias("tg_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tg_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("tg_hash"),
    )
    light = base.select("tg_source", "tg_size", "tg_hash")
    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    bucket = F.floor(F.conv(F.substring("tg_hash", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32))
    sums = cut(light.groupBy("tg_source", bucket.alias("tg_bucket")).agg(F.sum("tg_size").alias("tg_sum")))
    targets = source_targets(sums.groupBy("tg_source").agg(F.sum("tg_sum").alias("tg_size")))
    in_source = Window.partitionBy("tg_source").orderBy("tg_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("tg_start", F.coalesce(F.sum("tg_sum").over(in_source), F.lit(0)))
    targets = cut(targets)
    targets = F.broadcast(targets) if targets.count() <= FEW_SOURCES else targets
    plan = starts.join(targets, starts.tg_source.eqNullSafe(targets.tg_source)).drop(targets.tg_source)
    plan = cut(plan.drop("tg_sum"))
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan
    left = base.withColumn("tg_bucket", bucket)
    on = left.tg_source.eqNullSafe(plan.tg_source) & (left.tg_bucket == plan.tg_bucket)
    met = left.join(plan, on).drop(plan.tg_source, plan.tg_bucket)
    inside = Window.partitionBy("tg_source", "tg_bucket").orderBy("tg_hash", "tg_id", "tg_size")
    before = F.sum("tg_size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("tg_before", F.col("tg_start") + F.coalesce(before, F.lit(0)))
    passes = F.when(F.col("tg_source_size") > 0, F.floor(F.col("tg_target") / F.col("tg_source_size"))).otherwise(F.lit(0))
    met = met.withColumn("tg_passes", passes)
    rest = F.col("tg_target") - F.col("tg_passes") * F.col("tg_source_size")
    again = (2 * F.col("tg_before") + F.col("tg_size") <= 2 * rest) & (F.col("tg_passes") < CAP) & (rest > 0)
    return met.withColumn("tg_copies", (F.col("tg_passes") + F.when(again, 1).otherwise(0)).cast("long"))


def take_position(turn: Column) -> Column:
    demand = (turn * F.col("tg_source_size") + F.col("tg_before")).cast("double") + F.col("tg_size") / F.lit(2.0)
    return F.round(position(demand, F.col("tg_target"), F.col("tg_slope")), 9)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the position of the first take (null: not taken)."""
    met = mixed(docs, F.struct("doc_id"))
    taken = (F.col("tg_copies") * F.col("tg_size")).alias("taken")
    first = F.when(F.col("tg_copies") * F.col("tg_size") > 0, take_position(F.lit(0)))
    return met.select(
        "tg_row.doc_id",
        F.col("tg_size").alias("size"),
        F.col("tg_source_size").alias("source_size"),
        F.col("tg_target").alias("target"),
        taken,
        first.alias("position"),
    )


def training_order(docs: DataFrame) -> DataFrame:
    """The taken documents, each as often as it is taken, range-sorted by training position."""
    met = mixed(docs, F.struct(*docs.columns)).where("tg_copies > 0 and tg_size > 0")
    turns = met.withColumn("tg_turn", F.explode(F.sequence(F.lit(0), F.col("tg_copies") - 1)))
    placed = turns.withColumn("tg_position", take_position(F.col("tg_turn")))
    return placed.orderBy("tg_position", "tg_hash", "tg_turn").select("tg_row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
n AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS BIGINT) AS w,
             CAST([0.5, 0.0, -0.5][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS a FROM s),
o AS (SELECT *, CAST(sum(ss) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(3 * ss) OVER (ORDER BY ss / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
        CAST(sum(w) OVER (ORDER BY ss / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
      FROM n),
c AS (SELECT *, 3 * ss * rest <= (total - before) * w AS capped FROM o),
l AS (SELECT min(before) AS b, arg_min(rest, before) AS r FROM c WHERE NOT capped),
t AS (SELECT c.source, ss, a,
        CASE WHEN capped THEN CAST(ss AS DOUBLE) * 3 ELSE CAST(w AS DOUBLE) * (CAST(total AS DOUBLE) - CAST(l.b AS DOUBLE)) / CAST(l.r AS DOUBLE) END AS target
      FROM c LEFT JOIN l ON true),
x AS (SELECT d.doc_id, d.size, t.ss, t.target, t.a,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
        CASE WHEN t.ss > 0 THEN CAST(floor(t.target / t.ss) AS BIGINT) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, passes + CASE WHEN 2 * before + size <= 2 * (target - passes * ss) AND passes < 3 AND target - passes * ss > 0 THEN 1 ELSE 0 END AS copies,
        least((CAST(before AS DOUBLE) + size / 2.0) / target, 1.0) AS u FROM x)
SELECT doc_id, size, ss AS source_size, target, copies * size AS taken,
       CASE WHEN copies * size > 0 THEN round(CASE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END, 9) END AS position
FROM y
"""
