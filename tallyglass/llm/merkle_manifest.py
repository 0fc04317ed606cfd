"""Merkle manifest of a dataset: a content-addressed DAG and proofs by descent.

Every row is a leaf: SHA-256 over its fields with their lengths. Per source, leaves in order of doc_id are
joined `FANOUT` at a time, level by level, until one digest remains (the subroot); subroots in order of
source are joined the same way into the root. Each join is stored as a record digest -> children, equal
digests once, in one table a level.

Proofs descend. The requests' places, written in base `FANOUT`, are the way down: a level's wanted nodes
start as the root and meet the records of their digests; the child named by the next digit goes on, the
unselected children left and right of it are appended to the node's path. Requests with a common beginning
travel as one node, so the root is met once and not by every request. At the leaves each request has its
path from the root down, which reversed is its proof. Verification folds a leaf with that proof.

Ranks need no task that sees a whole source: rows are range-sorted, numbered within partitions, and
partition counts per source are added up.

Defined results: null fields are `-` in a leaf; a null source is a source of its own and comes first; rows of
a source that tie in doc_id follow their digest; equal rows are leaves each; a null doc_id comes first and is
never tampered with; a source of one row has its leaf as subroot, and a table of one source its subroot as
root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

FANOUT = 16
PART_ROWS = 50_000
SMALL = 100_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER = 5


def leaf_digest(values: list[Column]) -> Column:
    """H of the fields, each `-` if null, else its length in bytes, a colon and itself."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """tg_key (of the source), doc_id, leaf and tampered (the leaf after tampering), written once."""
    plain = [F.col(c) for c in FIELDS]
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # '' for null: first, and no null in joins
    leaf = leaf_digest(plain)
    return cut(docs.select(key.alias("tg_key"), "doc_id", leaf.alias("leaf"), F.when(chosen, leaf_digest([*plain[:-1], lower])).otherwise(leaf).alias("tampered")))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with tg_rank, the number of rows of the same tg_key before each in the given order, and tg_n of that key."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    rows = rows.withColumn("tg_tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(parts, "tg_key", *order, "tg_tie").sortWithinPartitions("tg_key", *order, "tg_tie")
    placed = cut(placed.drop("tg_tie").withColumn("tg_at", F.monotonically_increasing_id()))
    part = F.shiftright("tg_at", 33)
    counts = placed.groupBy("tg_key", part.alias("tg_part")).agg(F.min("tg_at").alias("tg_first"), F.count(F.lit(1)).alias("tg_rows"))
    whole = Window.partitionBy("tg_key")  # a source has as many rows here as partitions hold it
    before = F.sum("tg_rows").over(whole.orderBy("tg_part")) - F.col("tg_rows")
    starts = cut(counts.select("tg_key", "tg_part", (before - F.col("tg_first")).alias("tg_shift"), F.sum("tg_rows").over(whole).alias("tg_n")))
    starts = F.broadcast(starts) if starts.count() <= SMALL else starts
    met = placed.withColumn("tg_part", part).join(starts, ["tg_key", "tg_part"])
    return met.withColumn("tg_rank", F.col("tg_at") + F.col("tg_shift")).drop("tg_part", "tg_at", "tg_shift")


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tg_key, tg_rank, tg_n, digest) to one table of records (digest, children) for each level, lowest
    first, and the top of every key: (tg_key, digest, tg_height)."""
    records, tops = [], [nodes.where("tg_n = 1").select("tg_key", "digest", F.lit(0).alias("tg_height"))]
    most = nodes.agg(F.max("tg_n").alias("n")).first().n or 0
    level = nodes.where("tg_n > 1").select("tg_key", "tg_rank", "tg_n", "digest")
    while most > 1:
        parent = F.floor(F.col("tg_rank") / FANOUT).alias("tg_rank")
        joined = level.groupBy("tg_key", parent, F.ceil(F.col("tg_n") / FANOUT).alias("tg_n")).agg(F.sort_array(F.collect_list(F.struct("tg_rank", "digest"))).alias("c"))
        children = F.col("c.digest")
        level = cut(joined.select("tg_key", "tg_rank", "tg_n", F.sha2(F.concat_ws("", children), 256).alias("digest"), children.alias("children")))
        records.append(level.select("digest", "children").dropDuplicates(["digest"]))
        tops.append(level.where("tg_n = 1").select("tg_key", "digest", F.lit(len(records)).alias("tg_height")))
        level = level.where("tg_n > 1").select("tg_key", "tg_rank", "tg_n", "digest")
        most = -(-most // FANOUT)
    return records, reduce(DataFrame.union, tops)


def segment(children: Column, digit: Column) -> Column:
    """The unselected children of a record, left and right of the selected one."""
    left = F.concat_ws("", F.slice(children, 1, digit))
    right = F.concat_ws("", F.slice(children, digit + 2, FANOUT))
    return F.struct(left.alias("left"), right.alias("right"))


def descend(records: list[DataFrame], tops: DataFrame, requests: DataFrame, carry: list[str]) -> DataFrame:
    """From tops (tg_key, digest, tg_height, tg_path) down to requests (tg_key, tg_rank and others): each request
    with digest (its leaf), tg_path (segments from the root down) and what `carry` names of the tops."""
    here = tops.withColumn("tg_rank", F.lit(0).cast("long"))
    on = ["tg_key", "tg_rank"]
    for height in range(len(records), 1, -1):
        span = FANOUT ** (height - 1)
        wanted = requests.select("tg_key", F.floor(F.col("tg_rank") / span).alias("tg_rank")).distinct()
        met = here.where(F.col("tg_height") == height).join(records[height - 1], "digest")
        down = met.select("*", F.posexplode("children").alias("tg_digit", "tg_child"))
        path = F.array_append("tg_path", segment(F.col("children"), F.col("tg_digit")))
        rank = F.col("tg_rank") * FANOUT + F.col("tg_digit")
        down = down.select("tg_key", F.col("tg_child").alias("digest"), F.lit(height - 1).alias("tg_height"), path.alias("tg_path"), *carry, rank.alias("tg_rank"))
        # digests of the level above that no request passes through end here
        here = cut(here.where(F.col("tg_height") < height).unionByName(down.join(wanted, on, "left_semi")))
    ends = here.where("tg_height = 0").join(requests, on)
    ends = ends.select(*requests.columns, "digest", "tg_path", *carry)
    if not records:
        return ends
    last = here.where("tg_height = 1").join(records[0], "digest").withColumnRenamed("tg_rank", "tg_parent").drop("digest", "tg_height")
    asked = requests.withColumn("tg_parent", F.floor(F.col("tg_rank") / FANOUT))
    met = asked.join(last, ["tg_key", "tg_parent"])
    digit = (F.col("tg_rank") % FANOUT).cast("int")
    path = F.array_append("tg_path", segment(F.col("children"), digit))
    met = met.select(*requests.columns, F.element_at("children", digit + 1).alias("digest"), path.alias("tg_path"), *carry)
    return ends.unionByName(met)


def prove(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, leaf, tampered, subroot, root and proof (segments from leaf to root)."""
    leaves = cut(ranked(leaves_of(docs), ["doc_id", "leaf"]))
    records, subroots = grow(leaves.withColumnRenamed("leaf", "digest"))
    heads = ranked(cut(subroots).select(F.lit("").alias("tg_all"), "tg_key", "digest", "tg_height").withColumnsRenamed({"tg_key": "tg_source", "tg_all": "tg_key"}), ["tg_source"])
    heads = cut(heads)
    above, root = grow(heads)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = root.select("tg_key", "digest", "tg_height", nothing.alias("tg_path"), F.col("digest").alias("root"))
    heads = heads.withColumnsRenamed({"digest": "subroot", "tg_height": "tg_tall"})
    tops = cut(descend(above, root, heads, ["root"]))
    tops = tops.select(F.col("tg_source").alias("tg_key"), "digest", F.col("tg_tall").alias("tg_height"), "tg_path", "subroot", "root")
    found = descend(records, tops, leaves, ["subroot", "root"])
    return found.select("doc_id", "leaf", "tampered", "subroot", "root", F.reverse("tg_path").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, part: F.sha2(F.concat(part["left"], node, part["right"]), 256))


def proof_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row."""
    parts = F.transform("proof", lambda p: F.concat(p["left"], p["right"]))
    found = prove(docs).withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", parts), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql(levels: int = 7) -> str:
    """DuckDB SQL for proof_report, for sources (and numbers of sources) up to FANOUT ** levels: all levels written out."""
    field = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    text = "CAST(doc_id AS VARCHAR)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    sql = [
        f"d AS (SELECT *, {leaf('text')} AS leaf, {leaf(f'translate(text, {alphabet})')} AS lowered FROM documents)",
        f"a0 AS (SELECT doc_id, coalesce('=' || source, '') AS k, leaf, CASE WHEN {crc} % {TAMPER} = 0 THEN lowered ELSE leaf END AS tampered, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d)",
        "s0 AS (SELECT k, r, h, count(*) OVER (PARTITION BY k) AS n FROM a0)",
    ]

    def climb(name: str) -> str:
        """Tables name1.. of the nodes above name0 (k, r, h, n), with their children in order."""
        for i in range(1, levels + 1):
            sql.append(
                f"{name}{i} AS (SELECT k, r // {FANOUT} AS r, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h,"
                f" (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n = 1 THEN [] ELSE list(h ORDER BY r) END AS kids FROM {name}{i - 1} GROUP BY k, r // {FANOUT}, n)"
            )
        return f"{name}{levels}"

    sub = climb("s")
    sql.append(f"t0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS r, h, count(*) OVER () AS n, k AS source FROM {sub})")
    top = climb("t")

    def walk(name: str, base: str, folded: str) -> str:
        """Siblings of each row on its way up, and the folded digest."""
        sql.append(base)
        for i in range(1, levels + 1):
            place = f"(w.r // {FANOUT ** (i - 1)}) % {FANOUT}"
            left, right = f"array_to_string(list_slice(p.kids, 1, {place}), '')", f"array_to_string(list_slice(p.kids, {place} + 2, {FANOUT}), '')"
            sql.append(
                f"{name}w{i} AS (SELECT w.* EXCLUDE (sib, f), w.sib || {left} || {right} AS sib,"
                f" CASE WHEN len(p.kids) = 0 THEN f ELSE sha256({left} || f || {right}) END AS f FROM {name}w{i - 1} w JOIN {name}{i} p ON w.k = p.k AND w.r // {FANOUT**i} = p.r)"
            )
        return f"{name}w{levels}"

    up = walk("s", "sw0 AS (SELECT doc_id, k, r, leaf, '' AS sib, tampered AS f FROM a0)", "tampered")
    over = walk("t", f"tw0 AS (SELECT w.doc_id, w.leaf, t.h AS subroot, '' AS k, t.r, w.sib, w.f FROM {up} w JOIN t0 t ON t.source = w.k)", "f")
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, q.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = q.h AS verified FROM {over}, {top} q"
