"""Operators on findings: filters, normalisers, ordering, identity, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import NOISE, rule_dim, severity_dim
from ..functions.numbers import ordinal
from ..functions.text import settled_wording


def without_noise(f: DataFrame) -> DataFrame:
    """Messages that report parse noise go."""
    return f.where(~F.col("message").rlike(NOISE))


def search(f: DataFrame, words: str, severity: str | None = None, source: str | None = None) -> DataFrame:
    """Substring of title, message or a tag, any case; optional severity and source."""
    q = words.lower()
    hit = F.lower("title").contains(q) | F.lower("message").contains(q) | F.exists("tags", lambda t: F.lower(t).contains(q))
    f = f.where(hit)
    f = f.where(F.col("severity") == severity) if severity else f
    return f.where(F.col("source") == source) if source else f


def only_rule(payloads: DataFrame, rule: str) -> DataFrame:
    """Payloads (doc_id, ai_findings, rule_findings) with one rule's findings left and no ai findings."""
    return payloads.withColumns({
        "rule_findings": F.filter("rule_findings", lambda x: x["rule_id"] == rule),
        "ai_findings": F.filter("ai_findings", lambda x: F.lit(False)),
    })


def without_budget(f: DataFrame, columns: list[str]) -> DataFrame:
    """P5: findings that mention budgets in any of the columns or tags go."""
    hit = F.exists("tags", lambda t: t.contains("预算"))
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains("预算"), F.lit(False))
    return f.where(~hit)


def with_severity(f: DataFrame, scheme: str) -> DataFrame:
    """Severity normalised by a scheme, with its rank; unknown names keep theirs with rank 0."""
    dim = F.broadcast(severity_dim(f.sparkSession, scheme))
    met = f.join(dim, F.lower("severity") == F.col("raw"), "left").drop("raw")
    return met.withColumns({"norm": F.coalesce("norm", "severity"), "rank": F.coalesce("rank", F.lit(0))})


def rule_code(c: Column) -> Column:
    """R005, r5, V33-5 and V33-005 are one code."""
    digits = F.regexp_extract(c, "(?i)^(?:R|V33-)0*(\\d{1,3})$", 1)
    return F.when(digits != "", F.format_string("V33-%03d", digits.cast("int"))).otherwise(c)


def score_severity(score: Column) -> Column:
    """P17"""
    return F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def score_confidence(score: Column) -> Column:
    """P17"""
    return F.when(score >= 0.8, 3).when(score >= 0.6, 2).otherwise(1)


def failure_reason(error: Column) -> Column:
    """Failure text to reason code, first match wins."""
    e = F.lower(error)
    # Reason codes and the words that tell them.
    table = [("NO_ANCHOR", "anchor|锚点|not found|未找到"), ("TABLE_PARSE_FAIL", "table|表格|parse"), ("UNIT_MISMATCH", "unit|单位"), ("TOLERANCE_FAIL", "tolerance|容差"), ("MISSING_DATA", "missing|缺失|none"), ("DATA_FORMAT_ERROR", "format|格式")]
    out = None
    for code, words in table:
        out = F.when(e.rlike(words), code) if out is None else out.when(e.rlike(words), code)
    return out.otherwise("UNKNOWN")


def finding_id(f: DataFrame) -> Column:
    """Source:rule:first eight of md5 over source, rule and place."""
    place = F.concat_ws("_", F.coalesce(F.col("page").cast("string"), F.lit("0")), F.coalesce("section", F.lit("")), F.coalesce("table_name", F.lit("")))
    digest = F.md5(F.concat_ws(":", "source", "rule_id", place).cast("binary"))
    return F.concat_ws(":", "source", "rule_id", F.substring(digest, 1, 8))


def numbered(f: DataFrame) -> DataFrame:
    """Findings of a document in page and position order, with the Chinese ordinal before the message."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(10**9)), F.coalesce("pos", F.lit(0)), "idx")
    f = f.withColumn("seq", F.row_number().over(order))
    return f.withColumn("message", F.concat(ordinal(F.col("seq")), F.lit("、"), F.col("message")))


def unique(f: DataFrame, key: Column) -> DataFrame:
    """The first of each document's findings with equal key."""
    rank = F.row_number().over(Window.partitionBy("doc_id", F.md5(key.cast("binary"))).orderBy("idx"))
    return f.withColumn("copy", rank).where("copy = 1").drop("copy")


def capped(f: DataFrame, most: int) -> DataFrame:
    """K2: at most `most` findings of a document, gravest and surest first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("rank"), F.desc("confidence"), "idx")
    return f.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def priority(weight: Column, confidence: Column, n_evidence: Column) -> Column:
    """K5"""
    return weight * confidence * (1 + 0.1 * n_evidence)


def with_catalogue(f: DataFrame) -> DataFrame:
    """Findings with their rule's section and tolerance; unknown rules are marked."""
    dim = F.broadcast(rule_dim(f.sparkSession).select("rule_id", "section", "priority").withColumnRenamed("section", "rule_section"))
    return f.join(dim, "rule_id", "left").withColumn("rule_section", F.coalesce("rule_section", F.lit("NO_RULE")))


def deep_wording(f: DataFrame, columns: list[str]) -> DataFrame:
    """P13 over several text columns and the tags."""
    return f.withColumns({c: settled_wording(F.col(c)) for c in columns}).withColumn("tags", F.transform("tags", settled_wording))


def buckets(f: DataFrame) -> DataFrame:
    """One row per document with findings in severity buckets."""
    item = F.struct("idx", "rule_id", "message")
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("norm") == s, item)))
    return f.groupBy("doc_id").agg(pick("error").alias("error"), pick("warn").alias("warn"), pick("info").alias("info"), F.array_sort(F.collect_list(item)).alias("all"))


def report_lines(f: DataFrame) -> DataFrame:
    """One text per document, findings in order of severity, unknown severities last."""
    line = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("rule_id"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "idx", line.alias("line"))))
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report"))


def upsert(snapshots: DataFrame) -> DataFrame:
    """Last value of each (doc, key): an empty list never replaces a full one, an explicit null does. Of snapshots
    with equal seq a null comes last, and the greater of two full lists stays."""
    last_null = F.max(F.when(F.col("value").isNull(), F.col("seq"))).over(Window.partitionBy("doc_id", "key"))
    s = snapshots.withColumn("null_at", last_null)
    after = s.where("null_at is null or seq >= null_at")
    full = F.col("value").isNotNull() & (F.size("value") > 0) & (F.col("null_at").isNull() | (F.col("seq") > F.col("null_at")))
    kept = F.coalesce(F.max_by(F.when(full, F.col("value")), F.when(full, F.struct("seq", "value"))), F.max_by("value", F.struct("seq", F.col("value").isNull())))
    return after.groupBy("doc_id", "key").agg(kept.alias("value"))
