"""Model responses as text: JSON found in them, typed rows, rejected rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "array<struct<title:string,message:string,severity:string,rule_id:string,page:int,evidence:array<struct<page:int,text:string>>>>"
PAIR = "struct<pairs:array<struct<budget_text:string,budget_span:array<int>,final_text:string,final_span:array<int>,stmt_text:string,stmt_span:array<int>,reason_text:string,reason_span:array<int>>>>"
PLACE = "array<struct<page:int,text:string,score:double>>"


def json_array(c) -> Column:
    """A raw array, else a fenced block, else the first bracketed stretch."""
    t = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    fence = F.regexp_extract(t, "(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```", 1)
    first = F.regexp_extract(t, "(?s)(\\[.*\\])", 1)
    found = F.when(t.rlike("(?s)^\\[.*\\]$"), t).when(fence != "", fence).when(first != "", first)
    return found


def items(responses: DataFrame) -> DataFrame:
    """One row per element; `reason` says what is wrong (null: good). Unreadable responses keep one row."""
    r = responses.withColumn("list", F.from_json(json_array("response"), ITEM))
    e = r.select("doc_id", F.explode_outer("list").alias("x"))
    needs = ["title", "message", "severity"]
    reason = F.when(F.col("x").isNull(), "no_json")
    for n in needs:
        reason = reason.when(F.coalesce(F.trim(F.col(f"x.{n}")), F.lit("")) == "", f"missing_{n}")
    return e.select("doc_id", "x.*", reason.alias("reason"))


def accept(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Known rule or AI- prefix, legal severity, positive page, first evidence with text."""
    known = F.broadcast(rules.select("rule_id", F.lit(True).alias("known")))
    met = rows.join(known, "rule_id", "left")
    first = F.get("evidence", F.lit(0))
    ok = (F.coalesce("known", F.lit(False)) | F.col("rule_id").startswith("AI-")) & F.lower("severity").isin("info", "low", "medium", "high", "critical") & (F.col("page") > 0) & (F.coalesce(F.trim(first["text"]), F.lit("")) != "")
    return met.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("known")


def pairs(responses: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The object between the first { and the last }; hits without their spans go, a bad reason is blanked."""
    body = F.regexp_extract(F.coalesce("response", F.lit("")), "(?s)(\\{.*\\})", 1)
    p = responses.select(*keys, F.explode(F.from_json(body, PAIR)["pairs"]).alias("p"))
    spans = ["budget_span", "final_span", "stmt_span"]
    good = F.lit(True)
    for s in spans:
        good = good & (F.coalesce(F.size(F.col(f"p.{s}")), F.lit(0)) == 2)
    whole = F.size("p.reason_span") == 2
    return p.where(good).select(*keys, "p.budget_text", "p.final_text", "p.stmt_text", F.when(whole, F.col("p.reason_text")).alias("reason_text"), F.col("p.stmt_span")[0].alias("start"))


def located(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """The best candidate place of each finding replaces its page and marks it as located."""
    c = responses.select("doc_id", F.explode(F.from_json(json_array("response"), PLACE)).alias("c")).where("c.page is not null and c.text is not null and c.score is not null")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c.score"), "c.page"))
    top = c.withColumn("r", best).where("r = 1").select("doc_id", F.col("c.page").alias("found_page"), F.col("c.text").alias("found_text"))
    met = findings.join(top, "doc_id", "left")
    return met.withColumns({"page": F.coalesce("found_page", "page"), "why_not": F.when(F.col("found_page").isNotNull(), F.lit("AI_LOCATED")).otherwise(F.col("why_not"))})
