"""Queries on findings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import page_is_front, page_is_table
from ..operators import findings as O
from ..registry import RuleBook, query, table, shared_folder
from ..sources.corpus import FINDINGS_SQL, MONEY, ORDERS_SQL, findings

W = f"WITH {FINDINGS_SQL} "
NOISY = "message LIKE '%表出现多次%' OR message LIKE '%页码异常%'"
RANK = "CASE severity WHEN 'error' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END"


@query("p1_noise_filter", W + f"SELECT doc_id, idx, message FROM f WHERE NOT ({NOISY})")
def p1(spark, sf):
    return O.without_noise(findings(spark, sf)).select("doc_id", "idx", "message")


def _document_pages(spark, sf):
    d = table(spark, sf, "documents")
    mark = F.when(F.col("doc_id") % 5 == 0, F.lit("目录")).when(F.col("doc_id") % 5 == 1, F.lit("单位：万元")).when(F.col("doc_id") % 5 == 2, F.lit("本表反映")).when(F.col("doc_id") % 5 == 3, F.lit("合计0123456789")).otherwise(F.lit(""))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), mark).alias("text"))


@query("p2_front_pages", "SELECT doc_id, doc_id % 5 = 0 AS front FROM documents")
def p2(spark, sf):
    return _document_pages(spark, sf).select("doc_id", page_is_front("text").alias("front"))


@query("p3_table_pages", "SELECT doc_id, doc_id % 5 IN (1, 2, 3) AS is_table FROM documents")
def p3(spark, sf):
    return _document_pages(spark, sf).select("doc_id", page_is_table("text").alias("is_table"))


@query("p4_search", W + "SELECT doc_id, idx FROM f WHERE (contains(title, '第3项') OR contains(lower(message), '第3项') OR lower(tag1) = '第3项') AND severity = 'warn' AND source = 'ai'")
def p4(spark, sf):
    return O.search(findings(spark, sf), "第3项", "warn", "ai").select("doc_id", "idx")


@query("p5_without_budget", W + "SELECT doc_id, idx FROM f WHERE section IS NULL")
def p5(spark, sf):
    f = findings(spark, sf).withColumn("content", F.when(F.col("section").isNotNull(), F.lit("预算说明")))
    return O.without_budget(f, ["content", "section"]).select("doc_id", "idx")


@query("p6_only_compare_rule", W + "SELECT doc_id, idx FROM f WHERE rule_id = 'V33-110' AND source = 'rule'")
def p6(spark, sf):
    return findings(spark, sf).where("rule_id = 'V33-110' and source = 'rule'").select("doc_id", "idx")


@query("p6b_compare_payload", W + "SELECT doc_id, CAST(0 AS BIGINT) AS n_ai, count(*) FILTER (rule_id = 'V33-110' AND source = 'rule') AS n_rule, count(*) FILTER (source = 'ai') AS n_ai_before FROM f GROUP BY 1")
def p6b(spark, sf):
    """Payloads reduced to one rule: its findings stay, the ai list is emptied, documents stay."""
    lists = findings(spark, sf).groupBy("doc_id").agg(*[F.collect_list(F.when(F.col("source") == s, F.struct("idx", "rule_id"))).alias(f"{s}_findings") for s in ("ai", "rule")])
    kept = O.only_rule(lists, "V33-110")
    before = lists.select("doc_id", F.size("ai_findings").cast("long").alias("n_ai_before"))
    return kept.select("doc_id", F.size("ai_findings").cast("long").alias("n_ai"), F.size("rule_findings").cast("long").alias("n_rule")).join(before, "doc_id")


@query("p7_active_rules", W + "SELECT doc_id, idx, rule_id FROM f WHERE rule_id IN ('V33-101', 'V33-105')")
def p7(spark, sf):
    chosen = spark.createDataFrame([("V33-101",), ("V33-105",)], "rule_id string")
    return findings(spark, sf).join(F.broadcast(chosen), "rule_id", "left_semi").select("doc_id", "idx", "rule_id")


@query("p10_profile", W + "SELECT doc_id, idx, CASE rule_id WHEN 'V33-102' THEN 'error' ELSE severity END AS severity FROM f WHERE rule_id <> 'V33-103'")
def p10(spark, sf):
    profile = spark.createDataFrame([("V33-102", True, "error"), ("V33-103", False, None)], "rule_id string, enabled boolean, override string")
    met = findings(spark, sf).join(F.broadcast(profile), "rule_id", "left").where("coalesce(enabled, true)")
    return met.select("doc_id", "idx", F.coalesce("override", "severity").alias("severity"))


@query("p11_valid_results", W + "SELECT doc_id, idx FROM f WHERE length(trim(section)) > 1 AND rule_id IS NOT NULL")
def p11(spark, sf):
    text = F.concat(F.lit("    "), F.col("section"))
    f = findings(spark, sf).withColumn("description", F.concat(text, text, text))
    return f.where("rule_id is not null and description is not null and length(trim(description)) > 5").select("doc_id", "idx")


@query("p13_wording", W + "SELECT doc_id, idx, '部门决算金额' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS message FROM f WHERE NOT (" + NOISY + ")")
def p13(spark, sf):
    f = O.deep_wording(O.without_noise(findings(spark, sf)), ["message"])
    return f.select("doc_id", "idx", F.substring_index("message", "。", 1).alias("message"))


@query("p14_coalesced_fields", W + "SELECT doc_id, idx, coalesce(section, table_name, '未知') AS place, split_part(message, '。', 1) AS title, coalesce(page, 0) AS page FROM f")
def p14(spark, sf):
    return findings(spark, sf).select("doc_id", "idx", F.coalesce("section", "table_name", F.lit("未知")).alias("place"), F.substring_index("message", "。", 1).alias("title"), F.coalesce("page", F.lit(0)).alias("page"))


@query("p15_severity_names", W + "SELECT doc_id, idx, CASE severity WHEN 'error' THEN 'high' WHEN 'warn' THEN 'medium' ELSE 'low' END AS norm, CASE severity WHEN 'error' THEN 4 WHEN 'warn' THEN 3 ELSE 2 END AS rank FROM f")
def p15(spark, sf):
    return O.with_severity(findings(spark, sf), "five").select("doc_id", "idx", "norm", "rank")


@query("p16_rule_codes", W + "SELECT doc_id, idx, rule_id AS code FROM f")
def p16(spark, sf):
    raw = F.when(F.col("idx") % 2 == 0, F.regexp_replace("rule_id", "^V33-", "R")).otherwise(F.col("rule_id"))
    return findings(spark, sf).select("doc_id", "idx", O.rule_code(raw).alias("code"))


@query("p17_score_levels", "SELECT event_id, CASE WHEN value / 50 >= 0.8 THEN 'HIGH' WHEN value / 50 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN value / 50 >= 0.8 THEN 3 WHEN value / 50 >= 0.6 THEN 2 ELSE 1 END AS confidence FROM events")
def p17(spark, sf):
    s = F.col("value") / 50
    return table(spark, sf, "events").select("event_id", O.score_severity(s).alias("severity"), O.score_confidence(s).alias("confidence"))


@query("p18_failure_reasons", "SELECT event_id, CASE event_type WHEN 'view' THEN 'NO_ANCHOR' WHEN 'click' THEN 'UNIT_MISMATCH' WHEN 'error' THEN 'DATA_FORMAT_ERROR' WHEN 'signup' THEN 'TOLERANCE_FAIL' ELSE 'UNKNOWN' END AS reason FROM events")
def p18(spark, sf):
    e = F.col("event_type")
    text = F.when(e == "view", "Anchor lost").when(e == "click", "unit differs").when(e == "error", "bad format").when(e == "signup", "容差 exceeded").otherwise("?")
    return table(spark, sf, "events").select("event_id", O.failure_reason(text).alias("reason"))


@query("p19_to_locate", W + "SELECT doc_id, idx FROM f WHERE page IS NULL")
def p19(spark, sf):
    why = F.when(F.col("page").isNull(), F.lit("NO_ANCHOR: page")).otherwise(F.lit("ok"))
    return findings(spark, sf).withColumn("why_not", why).where(F.col("why_not").rlike("NO_ANCHOR|MULTI_ANCHOR")).select("doc_id", "idx")


@query("p20_evidence_backfill", W + "SELECT f.doc_id, idx, coalesce(f.section, left(d.text, 200)) AS snippet FROM f LEFT JOIN documents d ON d.doc_id = f.doc_id")
def p20(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 200).alias("front"))
    return findings(spark, sf).join(pages, "doc_id", "left").select("doc_id", "idx", F.coalesce("section", "front").alias("snippet"))


PLACE = "coalesce(CAST(page AS VARCHAR), '0') || '_' || coalesce(section, '') || '_' || coalesce(table_name, '')"
ID = f"source || ':' || rule_id || ':' || left(md5(source || ':' || rule_id || ':' || {PLACE}), 8)"


@query("p21_finding_ids", W + f"SELECT doc_id, idx, {ID} AS finding_id FROM f")
def p21(spark, sf):
    f = findings(spark, sf)
    return f.select("doc_id", "idx", O.finding_id(f).alias("finding_id"))


@query("p22_better_text", "SELECT doc_id, doc_id % 2 = 0 AS replaced FROM documents")
def p22(spark, sf):
    from ..functions.text import quality

    d = table(spark, sf, "documents").withColumn("alt", F.when(F.col("doc_id") % 2 == 0, F.lit("部门决算说明")).otherwise(F.lit("abc")))
    q, q2 = quality("text"), quality("alt")
    return d.select("doc_id", ((q < 0.5) & (q2 > q)).alias("replaced"))


@query("w1_numbered", W + "SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 1000000000), coalesce(pos, 0), idx, amount) AS INTEGER) AS seq FROM f")
def w1(spark, sf):
    f = findings(spark, sf).withColumn("tie", F.struct("idx", "amount"))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(10**9)), F.coalesce("pos", F.lit(0)), "tie")
    return f.select("doc_id", "idx", F.row_number().over(order).alias("seq"))


@query("f12_ordinals", W + """, s AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN n <= 10 THEN substr('零一二三四五六七八九十', CAST(n AS INTEGER) + 1, 1) WHEN n < 100 THEN CASE WHEN n >= 20 THEN substr('零一二三四五六七八九十', CAST(n // 10 AS INTEGER) + 1, 1) ELSE '' END || '十' || CASE WHEN n % 10 > 0 THEN substr('零一二三四五六七八九十', CAST(n % 10 AS INTEGER) + 1, 1) ELSE '' END ELSE CAST(n AS VARCHAR) END AS ordinal FROM s""")
def f12(spark, sf):
    from ..functions.numbers import ordinal

    return findings(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", ordinal(F.col("n")).alias("ordinal"))


@query("w11_unique", W + "SELECT doc_id, rule_id, coalesce(section, '') AS section, min(idx) AS idx FROM f GROUP BY ALL")
def w11(spark, sf):
    f = findings(spark, sf).withColumn("section", F.coalesce("section", F.lit("")))
    return O.unique(f, F.concat_ws(":", "rule_id", "section")).select("doc_id", "rule_id", "section", "idx")


@query("k1_sorted", W + f"SELECT doc_id, {RANK} AS rank, count(*) AS n FROM f GROUP BY ALL ORDER BY rank DESC, doc_id")
def k1(spark, sf):
    f = O.with_severity(findings(spark, sf), "engine")
    return f.groupBy("doc_id", "rank").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("rank"), "doc_id")


#: Documents with hundreds of findings each.
BY_SUPPLIER = W.replace("l_orderkey AS doc_id", "l_suppkey AS doc_id")


@query("k2_capped", BY_SUPPLIER + f"SELECT doc_id, rank, confidence, count(*) AS n FROM (SELECT *, {RANK} AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK} DESC, confidence DESC, idx) AS r FROM f) WHERE r <= 50 GROUP BY ALL")
def k2(spark, sf):
    f = O.capped(O.with_severity(findings(spark, sf, "l_suppkey"), "engine"), 50)
    return f.groupBy("doc_id", "rank", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("k3_evidence_texts", BY_SUPPLIER + "SELECT doc_id, message FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY message) AS r FROM (SELECT DISTINCT doc_id, left(message, 100) AS message FROM f WHERE length(message) > 10)) WHERE r <= 20")
def k3(spark, sf):
    m = findings(spark, sf, "l_suppkey").where(F.length("message") > 10).select("doc_id", F.substring("message", 1, 100).alias("message")).distinct()
    return m.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("message"))).where("r <= 20").drop("r")


@query("k5_priority", W + f"SELECT doc_id, idx, CAST({RANK} AS DOUBLE) * confidence * (1 + 0.1 * coalesce(page, 0)) AS score FROM f")
def k5(spark, sf):
    f = O.with_severity(findings(spark, sf), "engine")
    return f.select("doc_id", "idx", O.priority(F.col("rank").cast("double"), F.col("confidence"), F.coalesce("page", F.lit(0))).alias("score"))


@query("u1_all_rules", W + "SELECT doc_id, rule_id, severity, idx FROM f WHERE rule_id IN ('V33-101', 'V33-102') UNION ALL SELECT NULL, 'V33-900', 'hint', NULL")
def u1(spark, sf):
    book = RuleBook(["doc_id", "rule_id", "severity", "idx"])
    book.rule("V33-101")(lambda t: t["findings"].where("rule_id = 'V33-101'"))
    book.rule("V33-102")(lambda t: t["findings"].where("rule_id = 'V33-102'"))
    book.rule("V33-900")(lambda t: t["absent"])
    return book.run(spark, {"findings": findings(spark, sf)})


@query("d1_rule_book", W + "SELECT doc_id, rule_id, count(*) AS n FROM f WHERE rule_id = 'V33-104' GROUP BY ALL")
def d1(spark, sf):
    book = RuleBook(["doc_id", "rule_id", "severity"])
    book.rule("V33-103")(lambda t: t["findings"].where("rule_id = 'V33-103'"))
    book.rule("V33-104")(lambda t: t["findings"].where("rule_id = 'V33-104'"))
    return book.run(spark, {"findings": findings(spark, sf)}, only=["V33-104"]).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("s11_severity_buckets", W + "SELECT doc_id, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info, count(*) AS n_all FROM f GROUP BY 1")
def s11(spark, sf):
    b = O.buckets(O.with_severity(findings(spark, sf), "engine"))
    return b.select("doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("error", "warn", "info", "all")])


@query("s12_report", W + f"SELECT doc_id, count(*) AS n, string_agg('[' || severity || '] ' || rule_id, chr(10) ORDER BY {RANK} DESC, idx, rule_id) AS report FROM f GROUP BY 1")
def s12(spark, sf):
    return O.report_lines(O.with_severity(findings(spark, sf), "engine"))


@query("s14_rule_catalogue", W + "SELECT rule_id, '文数' AS section, count(*) AS n FROM f GROUP BY 1")
def s14(spark, sf):
    f = O.with_catalogue(findings(spark, sf))
    return f.groupBy("rule_id", F.col("rule_section").alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("j19_catalogue_join", W + "SELECT doc_id, idx, '文数' AS rule_section, CASE WHEN rule_id IN ('V33-101', 'V33-110') THEN 10 ELSE 50 END AS priority FROM f")
def j19(spark, sf):
    return O.with_catalogue(findings(spark, sf)).select("doc_id", "idx", "rule_section", "priority")


SNAP = "SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS seq, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN [] ELSE [l_partkey] END AS value FROM lineitem"


@query("s13_snapshot_upsert", f"""WITH s AS ({SNAP}), n AS (SELECT *, coalesce(max(CASE WHEN value IS NULL THEN seq END) OVER (PARTITION BY doc_id), -1) AS z FROM s), a AS (SELECT * FROM n WHERE seq > z)
SELECT s.doc_id, (SELECT CAST(max_by(value[1], [seq, value[1]]) AS BIGINT) FROM a WHERE a.doc_id = s.doc_id AND len(value) > 0) AS value FROM s GROUP BY 1""")
def s13(spark, sf):
    part = F.col("l_partkey")
    value = F.when(part % 7 == 0, None).when(part % 3 == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(part))
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("merged").alias("key"), (F.col("l_linenumber") * 1000000 + part).alias("seq"), value.alias("value"))
    return O.upsert(s).select("doc_id", F.get("value", F.lit(0)).alias("value"))


def _written(df, kind: str):
    """Write to the session's shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    if kind == "json":
        df.write.partitionBy("severity").json(path)
        return spark.read.schema(df.schema).json(path)
    df.write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


@query("s9_export_json", W + "SELECT doc_id, idx, rule_id, severity, message FROM f")
def s9(spark, sf):
    return _written(findings(spark, sf).select("doc_id", "idx", "rule_id", "severity", "message"), "json").select("doc_id", "idx", "rule_id", "severity", "message")


@query("s10_export_csv", W + "SELECT doc_id, source, rule_id, severity, CASE source WHEN 'ai' THEN title ELSE left(message, 50) END AS title, coalesce(page, 0) AS page, amount FROM f")
def s10(spark, sf):
    f = findings(spark, sf).withColumn("page", F.coalesce("page", F.lit(0)))
    columns = ["doc_id", "source", "rule_id", "severity", "title", "page", "amount"]
    new = f.where("source = 'ai'").select(*columns)
    old = f.where("source = 'rule'").withColumn("title", F.substring("message", 1, 50)).select(*columns)
    return _written(new.unionByName(old), "csv")


@query("a7_severity_source_cube", W + "SELECT coalesce(severity, '*') AS severity, coalesce(source, '*') AS source, count(*) AS n FROM f GROUP BY CUBE (severity, source)")
def a7(spark, sf):
    c = findings(spark, sf).cube("severity", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("severity", F.lit("*")).alias("severity"), F.coalesce("source", F.lit("*")).alias("source"), "n")


RUNS_SQL = W + """, c AS (SELECT doc_id, rule_id, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT e.event_id, e.user_id AS doc_id, 'V33-' || CAST(101 + e.event_id % 10 AS VARCHAR) AS rule_id, e.event_type <> 'error' AS ok, e.ts, e.value FROM events e),
x AS (SELECT r.*, CASE WHEN ok THEN coalesce(c.n, 0) ELSE 0 END AS n FROM r LEFT JOIN c USING (doc_id, rule_id))
"""


def rule_runs(spark, sf):
    """The log read as rule runs (rule by entry number, document by user, failed where the entry is an error),
    each with the findings of its rule and document; those are counted before they meet the log."""
    found = findings(spark, sf).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    rule = F.concat(F.lit("V33-"), (F.col("event_id") % 10 + 101).cast("string"))
    runs = table(spark, sf, "events").select("event_id", F.col("user_id").alias("doc_id"), rule.alias("rule_id"), (F.col("event_type") != "error").alias("ok"), "ts", "value")
    return runs.join(found, ["doc_id", "rule_id"], "left").withColumn("n", F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(0))


@query("a8_rule_statistics", RUNS_SQL + "SELECT rule_id, count(*) AS runs, count(*) FILTER (n > 0) AS hits, count(*) FILTER (NOT ok) AS failures, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS elapsed_ms FROM x GROUP BY 1")
def a8(spark, sf):
    n = F.count(F.lit(1))
    elapsed = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return rule_runs(spark, sf).groupBy("rule_id").agg(n.alias("runs"), F.count_if(F.col("n") > 0).alias("hits"), F.count_if(~F.col("ok")).alias("failures"), F.sum("n").alias("findings"), elapsed.alias("elapsed_ms"))


@query("a9_rule_coverage", RUNS_SQL + """SELECT rule_id, count(*) AS runs, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (n > 0) AS hits, count(*) FILTER (ok AND n = 0) AS misses, CAST(count(*) FILTER (n > 0) AS DOUBLE) / count(*) AS hit_rate,
count(*) FILTER (NOT ok AND value >= 50) AS failed_slow, count(*) FILTER (NOT ok AND NOT value >= 50) AS failed_fast, epoch_us(max(ts)) AS last_run, CASE WHEN (array_agg(ok ORDER BY ts DESC, event_id DESC))[1] THEN 'success' ELSE 'failed' END AS last_status FROM x GROUP BY 1""")
def a9(spark, sf):
    """Runs, hits and misses of each rule, its failures by reason (a map of counts), its last run and how it ended."""
    runs = rule_runs(spark, sf).withColumn("reason", F.when(~F.col("ok"), F.when(F.col("value") >= 50, "slow").otherwise("fast")))
    parts = runs.groupBy("rule_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 0).alias("hits"), F.max_by(F.struct("ts", "ok"), F.struct("ts", "event_id")).alias("end"), F.max(F.struct("ts", "event_id")).alias("at")
    )
    reasons = F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("reasons")
    failed = F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("failed")
    whole = parts.groupBy("rule_id").agg(F.sum("n").alias("runs"), failed, F.sum("hits").alias("hits"), F.max_by("end", "at").alias("end"), reasons)
    named = lambda r: F.coalesce(F.try_element_at("reasons", F.lit(r)), F.lit(0)).cast("long").alias(f"failed_{r}")
    ok = F.col("runs") - F.col("failed")
    last = F.unix_micros(F.col("end.ts").cast("timestamp")).alias("last_run")
    status = F.when(F.col("end.ok"), "success").otherwise("failed").alias("last_status")
    return whole.select("rule_id", "runs", ok.alias("successful"), "failed", "hits", (ok - F.col("hits")).alias("misses"), (F.col("hits") / F.col("runs")).alias("hit_rate"), named("slow"), named("fast"), last, status)
