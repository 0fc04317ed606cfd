"""Queries on prose (V110, V110b, F15, F16, F20, F23, W8, W14, J17, J18, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import near_number, near_percent, snippet, spans
from ..operators import prose as P
from ..registry import query, table, written
from ..sources import corpus as C
from ..sources import detailed as X
from ..sources import responses as R

D = lambda c: f"CAST({c} AS DOUBLE)"
PAIR_SQL = f"""WITH {C.ORDERS_SQL}, q AS (SELECT k AS doc_id, {D('budget')} AS b, {D('s')} AS a, CASE o_orderstatus WHEN 'F' THEN '大于' WHEN 'O' THEN '小于' ELSE '持平' END AS stated,
  o_orderstatus NOT IN ('F', 'O') AND k % 2 = 0 AS loose, left(o_orderpriority, 1) IN ('1', '2') AS has_reason FROM o),
t AS (SELECT *, greatest(a, b) AS top FROM q), u AS (SELECT *, CASE WHEN top < 100 THEN 1.0 WHEN top < 10000 THEN greatest(1.0, top * 0.005) ELSE greatest(1.0, top * 0.003) END AS tol FROM t),
w AS (SELECT *, CASE WHEN a > b + tol THEN '大于' WHEN a < b - tol THEN '小于' ELSE '持平' END AS computed FROM u)
"""


@query("v110_budget_vs_final", PAIR_SQL + """SELECT doc_id, stated, computed, 'mismatch' AS kind, 'error' AS severity FROM w WHERE stated <> computed
UNION ALL SELECT doc_id, stated, computed, 'wording', 'warn' FROM w WHERE loose UNION ALL SELECT doc_id, stated, computed, 'no_reason', 'error' FROM w WHERE stated IN ('大于', '小于') AND NOT has_reason""")
def v110(spark, sf):
    pairs = P.accepted_pairs(P.sections(C.comparisons(spark, sf)))
    return P.verdicts(pairs).select("doc_id", "stated", "computed", "kind", "severity")


@query("v110b_fallback_compare", PAIR_SQL + "SELECT doc_id, a AS spent, b AS planned, has_reason FROM w WHERE stated = computed AND NOT loose AND (stated = '持平' OR has_reason)")
def v110b(spark, sf):
    pages = C.comparisons(spark, sf)
    done = P.verdicts(P.accepted_pairs(P.sections(pages))).select("doc_id").distinct()
    loose = P.loose_pairs(pages).join(done, "doc_id", "left_anti")
    return loose.select("doc_id", F.col("spent").cast("double"), F.col("planned").cast("double"), (F.col("reason") != "").alias("has_reason"))


U2_SQL = PAIR_SQL + """SELECT k AS doc_id, CAST(2 + CASE WHEN k % 3 <> 2 AND k % 4 <> 1 THEN 1 ELSE 0 END + CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_found,
CAST(1 + CASE WHEN k % 3 <> 2 AND k % 4 <> 1 THEN 1 ELSE 0 END AS BIGINT) AS n_kept, CASE WHEN k % 3 <> 2 AND k % 4 <> 1 THEN CAST(odd AS DOUBLE) END AS model_planned FROM o"""


@query("u2_three_rounds", U2_SQL)
def u2(spark, sf):
    """Three rounds of rules and a fourth of pairs that a model gave for windows of the section; the model's pairs
    are shifted to the section and stay where no pair of the rules overlaps them."""
    pages, answers = X.model_pairs(spark, sf)
    read = P.matched(P.sections(pages)).select("doc_id", "from_page", F.size("items").alias("n_rules"), P.folded("items").alias("kept"))
    secs = written(read.select("doc_id", "from_page", F.lit(None).cast("string").alias("sec"), "n_rules", F.transform("kept", lambda p: F.struct(p["start"].alias("start"), p["found"].alias("found"))).alias("kept")))
    model = written(P.from_model(secs, R.pairs(answers, ("doc_id", "window_start"))).select("doc_id", "start", "found", "planned"))
    kept = secs.select("doc_id", F.explode("kept").alias("p")).select("doc_id", "p.*")
    beyond = P.beyond_rules(kept, model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_beyond"), F.max(F.col("planned").cast("double")).alias("model_planned"))
    found = model.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_model"))
    met = secs.select("doc_id", "n_rules", F.size("kept").alias("n_accepted")).join(found, "doc_id", "left").join(beyond, "doc_id", "left")
    n = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return met.select("doc_id", n("n_rules", "n_model").alias("n_found"), n("n_accepted", "n_beyond").alias("n_kept"), "model_planned").where("n_found > 0 and n_kept > 0")


def _twice(spark, sf):
    """Every section states its pair twice, the second time with a reason and, for every third, another amount."""
    s = lambda c: F.col(c).cast("string")
    other = F.when(F.col("k") % 3 == 0, (F.col("s") * 2).cast(C.MONEY)).otherwise(F.col("s"))
    one = lambda a: F.concat(F.lit("年初预算"), s("budget"), F.lit("，决算"), a.cast("string"), F.lit("，决算大于预算。"))
    text = F.concat(F.lit("三、一般公共预算财政拨款支出决算情况\n其中"), one(F.col("s")), one(other), F.lit("主要原因：补。"))
    return C.order_sums(spark, sf).select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text"))


@query("j18_pair_dedup", f"WITH {C.ORDERS_SQL} SELECT k AS doc_id, CAST(CASE WHEN k % 3 = 0 AND s > 0 THEN 2 ELSE 1 END AS BIGINT) AS n_pairs, CAST(CASE WHEN k % 3 = 0 AND s > 0 THEN 2 ELSE 1 END AS BIGINT) AS n_reasons FROM o")
def j18(spark, sf):
    kept = P.accepted(P.candidates(P.sections(_twice(spark, sf))).where("round = 0"))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("reason") != "").alias("n_reasons"))


@query("j17_near_starts", f"WITH {C.ORDERS_SQL} SELECT k AS doc_id, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS later_rounds FROM o")
def j17(spark, sf):
    """A pair in the usual order, then one the other way round: right behind it (dropped, as it starts too near), for
    every third after more text (kept), or none."""
    s = lambda c: F.col(c).cast("string")
    usual = F.concat(F.lit("年初预算"), s("n"), F.lit("，决算"), s("line"), F.lit("，决算大于预算。"))
    turned = F.concat(F.lit("决算"), s("k9"), F.lit("，年初预算"), s("n"), F.lit("，决算大于预算。"))
    filler = F.when(F.col("k") % 3 == 0, F.repeat(F.lit("各项工作按计划开展。"), 8)).otherwise("")
    d = C.order_sums(spark, sf).withColumns({"line": F.size("items"), "k9": F.col("k") % 9 + 2})
    text = F.concat(F.lit("三、一般公共预算财政拨款支出决算情况\n其中："), usual, filler, F.when(F.col("k") % 3 != 2, turned).otherwise(""))
    kept = P.accepted_pairs(P.sections(d.select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text"))))
    return kept.groupBy("doc_id").agg(F.count_if(F.col("round") > 0).alias("later_rounds"))


@query("w8_ordered_fold", PAIR_SQL + "SELECT doc_id, a AS spent, b AS planned, 'regex' AS found_by FROM w")
def w8(spark, sf):
    kept = P.accepted_pairs(P.sections(C.comparisons(spark, sf)))
    return kept.select("doc_id", F.col("spent").cast("double"), F.col("planned").cast("double"), "found_by")


@query("f15_near_values", f"WITH {C.ORDERS_SQL} SELECT k AS doc_id, {D('n1')} AS income, {D('n2')} AS fiscal_grant, CAST(CAST(pct AS DECIMAL(8,2)) AS DOUBLE) AS share FROM d")
def f15(spark, sf):
    p = C.disclosure_pages(C.disclosures(spark, sf)).where(F.col("text").contains("本年收入合计"))
    return p.select("doc_id", near_number("text", ["本年收入合计"]).alias("income"), near_number("text", ["财政拨款收入"]).alias("fiscal_grant"), near_percent("text", ["占比"]).alias("share"))


@query("f16_spans", f"WITH {C.ORDERS_SQL} SELECT k AS doc_id, CAST(length('（三）一般公共预算财政拨款支出决算具体情况') + length('其中：') + 2 + length('1、年初预算为') AS INTEGER) AS start, CAST(budget AS VARCHAR) AS found FROM o")
def f16(spark, sf):
    p = C.comparisons(spark, sf)
    return p.select("doc_id", F.explode(spans("text", "\\d+\\.\\d+")).alias("m")).groupBy("doc_id").agg(F.min("m.start").alias("start"), F.min_by("m.found", "m.start").alias("found"))


@query("f20_snippets", "SELECT doc_id, CASE WHEN length(t) > 64 THEN left(t, 32) || ' … ' || right(t, 32) ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(substr(text, 1, least(length(text), 72)), '[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)")
def f20(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", snippet("text", F.lit(30), F.lit(40)).alias("snippet"))


SECTION_SQL = f"""WITH {C.ORDERS_SQL} SELECT k AS doc_id, CAST(length('三、一般公共预算财政拨款支出决算情况') + 1 + length(CAST(s AS VARCHAR))
  + CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 + length(CAST(budget AS VARCHAR)) ELSE 8 + length(CAST(budget AS VARCHAR)) END AS INTEGER) AS n_chars FROM o WHERE k % 5 <> 0"""


@query("f23_sections", SECTION_SQL)
def f23(spark, sf):
    """Sections between their heading and the next one, or the end where none follows; no section without a heading."""
    k = F.col("k")
    s = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit("\n"), s("s"), F.when(k % 3 == 0, F.lit("\n四、其他\n")).when(k % 3 == 1, F.concat(F.lit("\n“（四）其他”\n"), s("budget"), F.lit("\n（六）尾"))).otherwise(F.concat(F.lit("\n在（四）其他\n"), s("budget"))))
    head = F.when(k % 5 == 0, F.lit("目录")).otherwise(F.lit("三、一般公共预算财政拨款支出决算情况"))
    pages = C.order_sums(spark, sf).select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.concat(head, body).alias("text"))
    return P.sections(pages).select("doc_id", F.length("sec").alias("n_chars"))


@query("w14_page_positions", f"""WITH {C.ORDERS_SQL}, t AS (SELECT k AS doc_id, length(CAST(year AS VARCHAR)) + length('年度部门决算') + 1 AS p2 FROM o)
SELECT doc_id, CAST(p AS BIGINT) AS position, CASE WHEN p >= p2 THEN 2 ELSE 1 END AS page_no, CAST(CASE WHEN p >= p2 THEN p - p2 ELSE p END AS BIGINT) AS pos FROM t, (VALUES (0), (5), (20)) x(p)""")
def w14(spark, sf):
    pages = C.disclosure_pages(C.disclosures(spark, sf))
    at = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 5, 20)])).alias("position"))
    return P.place(at, P.page_offsets(pages))
