"""Queries on page summaries and logs (A12-A14) and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, table


@query("a12_page_summary", """WITH p AS (SELECT o_custkey AS doc_id, o_orderkey % 4 = 0 AS ocr, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS q, o_orderkey % 10 AS tenths, length(o_orderpriority) AS chars FROM orders)
SELECT doc_id, count(*) AS n_pages, CAST(sum(chars) AS BIGINT) AS n_chars, CAST(sum(tenths) AS DOUBLE) / 10 / count(*) AS mean_quality, count(*) FILTER (ocr) AS n_ocr, CAST(count(*) FILTER (ocr) AS DOUBLE) / count(*) AS ocr_ratio, count(*) FILTER (q >= 0.8) AS good, count(*) FILTER (q >= 0.5 AND q < 0.8) AS fair, count(*) FILTER (q < 0.5) AS poor FROM p GROUP BY 1""")
def a12(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 4 == 0).alias("ocr"), ((F.col("o_orderkey") % 10) / 10).alias("q"), (F.col("o_orderkey") % 10).alias("tenths"), F.length("o_orderpriority").alias("chars"))
    n = F.count(F.lit(1))
    return p.groupBy("doc_id").agg(n.alias("n_pages"), F.sum("chars").alias("n_chars"), (F.sum("tenths").cast("double") / 10 / n).alias("mean_quality"), F.count_if("ocr").alias("n_ocr"), (F.count_if("ocr") / n).alias("ocr_ratio"), F.count_if(F.col("q") >= 0.8).alias("good"), F.count_if((F.col("q") >= 0.5) & (F.col("q") < 0.8)).alias("fair"), F.count_if(F.col("q") < 0.5).alias("poor"))


def job_stages(logs):
    """Count, total and mean of each job's stages, and of the whole job its time from first to last entry,
    entries, errors and largest value. One exchange by job: stages first, then windows over a job's few stages."""
    stages = _stages(logs)
    job = Window.partitionBy("job_id")
    seconds = (F.unix_micros(F.max("to").over(job).cast("timestamp")) - F.unix_micros(F.min("from").over(job).cast("timestamp"))) / 1_000_000
    whole = {"job_seconds": seconds, "job_entries": F.sum("n").over(job), "job_errors": F.sum(F.when(F.col("stage") == "error", F.col("n")).otherwise(0)).over(job), "job_most": F.max("most").over(job)}
    return stages.withColumns(whole).drop("from", "to", "most")


def _stages(logs):
    return logs.groupBy("job_id", "stage").agg(F.min("ts").alias("from"), F.max("ts").alias("to"), F.max("duration_ms").alias("most"), F.count(F.lit(1)).alias("n"), F.sum(F.col("duration_ms").cast("decimal(18,2)")).cast("double").alias("total_ms"), (F.sum(F.col("duration_ms").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean_ms"))


def logs_of(events):
    return events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), "ts")


@query("a13_job_profile", """WITH j AS (SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 AS job_seconds, count(*) AS job_entries, count(*) FILTER (event_type = 'error') AS job_errors, max(value) AS job_most FROM events GROUP BY 1)
SELECT user_id AS job_id, event_type AS stage, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_ms, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_ms, any_value(job_seconds) AS job_seconds, any_value(job_entries) AS job_entries, any_value(job_errors) AS job_errors, any_value(job_most) AS job_most FROM events JOIN j USING (user_id) GROUP BY ALL""")
def a13(spark, sf):
    return job_stages(logs_of(table(spark, sf, "events")))


@query("a14_system_overview", """WITH m AS (SELECT max(ts) AS t FROM events), e AS (SELECT * FROM events, m WHERE ts >= t - INTERVAL 72 HOUR), j AS (SELECT user_id, sum(CAST(value AS DECIMAL(18,2))) AS d, count(*) FILTER (event_type = 'error') AS errs FROM e GROUP BY 1)
SELECT count(*) AS jobs, count(*) FILTER (errs = 0) AS completed, count(*) FILTER (errs > 0) AS failed, CAST(count(*) FILTER (errs = 0) AS DOUBLE) / count(*) AS success_rate, CAST(sum(d) AS DOUBLE) / count(*) AS mean_ms FROM j""")
def a14(spark, sf):
    """Jobs of the last 72 hours: per job first, then over jobs; `now` is the log's last entry."""
    e = logs_of(table(spark, sf, "events"))
    last = e.agg(F.max("ts").alias("t"))
    recent = e.join(F.broadcast(last)).where(F.col("ts") >= F.col("t") - F.expr("interval 72 hours"))
    jobs = recent.groupBy("job_id").agg(F.sum(F.col("duration_ms").cast("decimal(18,2)")).alias("d"), F.count_if(F.col("stage") == "error").alias("errs"))
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("jobs"), F.count_if(F.col("errs") == 0).alias("completed"), F.count_if(F.col("errs") > 0).alias("failed"), (F.count_if(F.col("errs") == 0) / n).alias("success_rate"), (F.sum("d").cast("double") / n).alias("mean_ms"))


def _marked(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.year("o_orderdate") + 20).alias("y"))


@query("f1_normalize", "SELECT o_orderkey AS k, '收入支出' || o_orderkey || 'ab' AS flat FROM orders")
def f1(spark, sf):
    t = F.concat(F.lit("（收入）、支出：“"), F.col("k").cast("string"), F.lit("”—a·b　\n"))
    return _marked(spark, sf).select("k", X.normalize(t).alias("flat"))


@query("f2_squeeze", "SELECT o_orderkey AS k, '收入,' || o_orderkey AS flat FROM orders")
def f2(spark, sf):
    t = F.concat(F.lit("（收 入）,　["), F.col("k").cast("string"), F.lit("]\n"))
    return _marked(spark, sf).select("k", X.squeeze(t).alias("flat"))


@query("f13_years", "SELECT o_orderkey AS k, CAST(year(o_orderdate) + 20 AS INTEGER) AS year, 1 AS n FROM orders")
def f13(spark, sf):
    y = X.years(F.concat(F.lit("2013901 "), F.col("y").cast("string"), F.lit("年度 120240")))
    return _marked(spark, sf).select("k", F.get(y, F.lit(0)).alias("year"), F.size(y).alias("n"))


@query("f14_units", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '万元' WHEN 1 THEN '元' WHEN 2 THEN '亿元' END AS unit FROM orders")
def f14(spark, sf):
    k = F.col("k") % 4
    t = F.when(k == 0, "单位： 万元").when(k == 1, "单位:元").when(k == 2, "x 单位：亿元").otherwise("单位元")
    return _marked(spark, sf).select("k", X.money_unit(t).alias("unit"))


@query("f18_text_quality", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM orders")
def f18(spark, sf):
    k = F.col("k") % 3
    t = F.when(k == 0, "部门决算").when(k == 1, "部门1234"[:4]).otherwise("abcd")
    return _marked(spark, sf).select("k", X.quality(t).alias("quality"))


@query("f19_sentences", "SELECT o_orderkey AS k, '乙' || o_orderkey || '说明增加。' AS sentence FROM orders")
def f19(spark, sf):
    t = F.concat(F.lit("甲说。  乙"), F.col("k").cast("string"), F.lit("说明增加。丙说。"))
    return _marked(spark, sf).select("k", X.sentence(t, F.lit("说明")).alias("sentence"))


_MARKS = X.PUNCTUATION.replace("'", "''")


@query("f24_positions", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, substr(coalesce(text, ''), 21, 30) AS part, least(greatest(length(coalesce(text, '')), 20), 60) AS n FROM documents),
x AS (SELECT *, replace(trim(part, ' '), chr(10), '') AS flat, regexp_replace(text, '{_MARKS}', '', 'g') AS np, regexp_replace(part, '{_MARKS}', '', 'g') AS nn,
  CASE WHEN n = 60 THEN trim(substr(text, 21, 20), ' ') ELSE '' END AS s2, CASE WHEN n > 50 THEN trim(substr(text, 1 + 2 * (n // 3), n - 2 * (n // 3)), ' ') ELSE '' END AS s3 FROM d)
SELECT doc_id, CAST(CASE WHEN length(flat) >= 8 AND contains(text, flat) THEN instr(text, flat) - 1 WHEN length(part) >= 8 AND contains(np, nn) THEN floor(CAST(instr(np, nn) - 1 AS DOUBLE) / length(np) * length(text)) ELSE 1000000000 END AS INTEGER) AS pos,
CAST(CASE WHEN length(s2) > 0.3 * n AND length(s2) >= length(s3) THEN instr(text, s2) - 1 WHEN length(s3) > 0.3 * n THEN instr(text, s3) - 1 WHEN length(s2) > 0.3 * n THEN instr(text, s2) - 1 ELSE 1000000000 END AS INTEGER) AS part_pos FROM x""")
def f24(spark, sf):
    part = F.substring("text", 21, 30)
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    damaged = F.concat(F.lit("¤" * 20), F.substring("text", 21, 40))  # only its parts can be found
    return d.select("doc_id", X.guess_position("text", part).cast("int").alias("pos"), X.guess_position("text", damaged).cast("int").alias("part_pos"))


@query("f26_fingerprints", "SELECT md5(text) AS digest, sha256(text) AS sha, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def f26(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("digest"), F.sha2("text", 256).alias("sha"))
    return d.groupBy("digest", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
