"""Queries on model responses."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import rule_dim
from ..functions.text import clip, windows
from ..registry import query, shared_folder, table
from ..sources import responses as R


def _responses(spark, sf):
    """A response for each labelled document: raw, fenced (every third) or malformed (every tenth)."""
    d = F.col("doc_id")
    title = F.when(d % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), d.cast("string")))
    rule = F.when(d % 4 == 0, F.lit("V33-101")).when(d % 4 == 1, F.lit("AI-1")).otherwise(F.lit("X-9"))
    item = F.struct(title.alias("title"), F.lit("m").alias("message"), F.when(F.col("quality") == 1, "high").otherwise("odd").alias("severity"), rule.alias("rule_id"), (d % 5).cast("int").alias("page"), F.array(F.struct(F.lit(1).alias("page"), F.lit("e").alias("text"))).alias("evidence"))
    body = F.to_json(F.array(item))
    text = F.when(d % 10 == 0, F.lit("sorry, no list")).when(d % 3 == 0, F.concat(F.lit("here:\n```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return table(spark, sf, "labels").select("doc_id", text.alias("response"))


@query("s4_extract_json", "SELECT doc_id, doc_id % 10 <> 0 AS has_json FROM labels")
def s4(spark, sf):
    return _responses(spark, sf).select("doc_id", R.json_array("response").isNotNull().alias("has_json"))


@query("s5_response_items", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'no_json' WHEN doc_id % 7 = 0 THEN 'missing_title' ELSE 'good' END AS reason, CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id % 5 AS INTEGER) END AS page FROM labels")
def s5(spark, sf):
    return R.items(_responses(spark, sf)).select("doc_id", F.coalesce("reason", F.lit("good")).alias("reason"), "page")


@query("p12_accepted_items", "SELECT doc_id, doc_id % 4 IN (0, 1) AND quality = 1 AND doc_id % 5 > 0 AS accepted FROM labels WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0")
def p12(spark, sf):
    good = R.items(_responses(spark, sf)).where("reason is null")
    return R.accept(good, rule_dim(spark)).select("doc_id", "accepted")


@query("s6_response_pairs", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS budget_text, CASE WHEN doc_id % 3 <> 0 THEN 'r' END AS reason_text, 7 AS start FROM labels WHERE doc_id % 5 <> 0")
def s6(spark, sf):
    d = F.col("doc_id")
    two = lambda a, b: F.array(F.lit(a), F.lit(b))
    p = F.struct(
        d.cast("string").alias("budget_text"), F.when(d % 5 == 0, F.array(F.lit(1))).otherwise(two(1, 3)).alias("budget_span"), F.lit("2").alias("final_text"), two(4, 6).alias("final_span"),
        F.lit("s").alias("stmt_text"), two(7, 9).alias("stmt_span"), F.lit("r").alias("reason_text"), F.when(d % 3 == 0, F.array(F.lit(1))).otherwise(two(1, 2)).alias("reason_span"),
    )
    text = F.concat(F.lit("ok "), F.to_json(F.struct(F.array(p).alias("pairs"))), F.lit(" end"))
    return R.pairs(table(spark, sf, "labels").select("doc_id", text.alias("response"))).select("doc_id", "budget_text", "reason_text", "start")


@query("s7_located", "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id % 9 + 1 AS INTEGER) ELSE 99 END AS page, CASE WHEN doc_id % 10 <> 0 THEN 'AI_LOCATED' ELSE 'NO_ANCHOR' END AS why_not FROM labels")
def s7(spark, sf):
    d = F.col("doc_id")
    c = lambda page, score: F.struct(page.cast("int").alias("page"), F.lit("x").alias("text"), F.lit(score).alias("score"))
    body = F.to_json(F.array(c(F.lit(50), 0.2), c(d % 9 + 1, 0.9)))
    labels = table(spark, sf, "labels")
    answers = labels.select("doc_id", F.when(d % 10 == 0, F.lit("none")).otherwise(body).alias("response"))
    f = labels.select("doc_id", F.lit(99).alias("page"), F.lit("NO_ANCHOR").alias("why_not"))
    return R.located(f, answers).select("doc_id", "page", "why_not")


@query("s8_read_log", "SELECT event_id, event_type AS stage, value AS duration_ms FROM events WHERE event_id % 9 <> 0")
def s8(spark, sf):
    """Events written as JSON lines with every ninth line cut short, read back without the malformed ones."""
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("stage"), F.col("value").alias("duration_ms")))
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e.write.text(path)
    return spark.read.schema("event_id long, stage string, duration_ms double").option("mode", "DROPMALFORMED").json(path).select("event_id", "stage", "duration_ms")


WINDOW_SQL = "WITH w AS (SELECT doc_id, length(text) AS n, unnest([0, 1500, 3000]) AS start FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(greatest(least(n - start, 1700), 0) AS INTEGER) AS n_chars FROM w WHERE start <= greatest(n - 201, 0)"


@query("f22_windows", WINDOW_SQL)
def f22(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(windows("text")).alias("w"))
    return d.select("doc_id", "w.start", F.length("w.body").alias("n_chars"))


@query("f22_window_hits", "SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hits FROM (SELECT doc_id, unnest(range(0, 4700, 100)) AS p, length(text) AS n FROM documents WHERE text IS NOT NULL) WHERE p + 10 <= n AND ((p + 10 <= 1700) OR (n - 201 >= 1500 AND p >= 1500 AND p + 10 <= 3200) OR (n - 201 >= 3000 AND p >= 3000 AND p + 10 <= 4700)) GROUP BY 1")
def f22_hits(spark, sf):
    """Spans found in windows (every hundredth character of the text), shifted back and kept once."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(windows("text")).alias("w"))
    local = F.filter(F.sequence(F.lit(0), F.lit(1699)), lambda x: (x + F.col("w.start")) % 100 == 0)
    hits = d.select("doc_id", F.col("w.start").alias("s"), F.length("w.body").alias("n"), F.explode(local).alias("x")).where("x + 10 <= n")
    shifted = hits.select("doc_id", (F.col("s") + F.col("x")).alias("start"), (F.col("s") + F.col("x") + 10).alias("end"))
    once = F.row_number().over(Window.partitionBy("doc_id", "start", "end").orderBy("start"))
    return shifted.withColumn("r", once).where("r = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


@query("f21_clips", "SELECT doc_id, substr(t, CAST(greatest(doc_id % 50 - 10, 0) + 1 AS BIGINT), CAST(greatest(least(least(doc_id % 50 + 40 + 10, length(t)) - greatest(doc_id % 50 - 10, 0), 120), 0) AS BIGINT)) AS clip FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def f21(spark, sf):
    s = (F.col("doc_id") % 50).cast("int")
    return table(spark, sf, "documents").select("doc_id", clip("text", F.array(s, s + 20), F.array(s + 5, s + 40)).alias("clip"))
