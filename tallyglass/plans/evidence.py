"""Queries on evidence (W6, W7, A16, M007, J14, J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..registry import query, table

HITS_SQL = """WITH h AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INTEGER) AS page_no, l_linenumber * 100000 + l_partkey AS hit, CAST(l_partkey % 5 AS DOUBLE) AS x1, CAST(l_quantity * 10 AS DOUBLE) AS y1, CAST(l_partkey % 5 + 10 AS DOUBLE) AS x2, CAST(l_quantity * 10 + 4 AS DOUBLE) AS y2, 'w' || (l_partkey % 9) AS text FROM lineitem),
c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM h),
l AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM c WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y1, x1, hit)),
g AS (SELECT *, CAST(sum(CASE WHEN sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY y1, x1, hit ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM l),
s AS (SELECT doc_id, page_no, grp, string_agg(text, ' ... ' ORDER BY y1, x1, hit) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_hits FROM g GROUP BY ALL)
"""


def _hits(spark, sf):
    part = F.col("l_partkey")
    y = (F.col("l_quantity") * 10).cast("double")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).cast("int").alias("page_no"), (F.col("l_linenumber") * 100000 + part).alias("hit"),
        (part % 5).cast("double").alias("x1"), y.alias("y1"), (part % 5 + 10).cast("double").alias("x2"), (y + 4).alias("y2"), F.concat(F.lit("w"), (part % 9).cast("string")).alias("text"),
    )


@query("w6_nearby_groups", HITS_SQL + "SELECT doc_id, page_no, grp, count(*) AS n FROM g GROUP BY ALL")
def w6(spark, sf):
    return E.grouped(_hits(spark, sf)).groupBy("doc_id", "page_no", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("a16_group_summary", HITS_SQL + "SELECT * FROM s")
def a16(spark, sf):
    return E.summarised(E.grouped(_hits(spark, sf)))


@query("w7_pages_of_groups", HITS_SQL + "SELECT doc_id, page_no, grp, CAST(ceil(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, grp) / 2.0) AS INTEGER) AS screen, CAST(ceil(count(*) OVER (PARTITION BY doc_id) / 2.0) AS INTEGER) AS n_screens FROM s")
def w7(spark, sf):
    return E.paginated(E.summarised(E.grouped(_hits(spark, sf))), 2).select("doc_id", "page_no", "grp", "screen", "n_screens")


@query("m007_evidence_pages", HITS_SQL + "SELECT doc_id, CAST(ceil(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, grp) / 10.0) AS INTEGER) AS screen, text, n_hits FROM s")
def m007(spark, sf):
    return E.paginated(E.summarised(E.grouped(_hits(spark, sf)))).select("doc_id", "screen", "text", "n_hits")


@query("j14_spans_in_box", """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS ix, l_partkey AS p, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_quantity + 2 AS DOUBLE) AS x1 FROM lineitem)
SELECT doc_id, 1 AS page_no, box, string_agg('t' || p, ' ' ORDER BY ix, 't' || p) AS text FROM s, (VALUES (1, 0.0, 20.0), (2, 15.0, 60.0)) b(box, lo, hi) WHERE x0 >= lo AND x1 <= hi GROUP BY ALL""")
def j14(spark, sf):
    q = F.col("l_quantity").cast("double")
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("span_ix"), q.alias("x0"), F.lit(0.0).alias("y0"), (q + 2).alias("x1"), F.lit(1.0).alias("y1"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"))
    two = F.array(F.struct(F.lit(1).alias("box"), F.lit(0.0).alias("x0"), F.lit(20.0).alias("x1")), F.struct(F.lit(2).alias("box"), F.lit(15.0).alias("x0"), F.lit(60.0).alias("x1")))
    boxes = spans.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.explode(two).alias("b")).select("doc_id", "page_no", "b.box", "b.x0", F.lit(0.0).alias("y0"), "b.x1", F.lit(1.0).alias("y1"))
    return E.inside(spans, boxes)


@query("j15_text_in_spans", """SELECT l_orderkey AS doc_id, l_linenumber AS span_ix, 100.0::DOUBLE AS score FROM lineitem WHERE l_partkey % 5 = 0
UNION ALL SELECT l_orderkey, l_linenumber, 200.0::DOUBLE * 6 / 13 FROM lineitem WHERE l_partkey % 5 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = lineitem.l_orderkey AND m.l_partkey % 5 = 0)""")
def j15(spark, sf):
    k = F.col("l_partkey") % 5
    text = F.when(k == 0, "第三项预算差异").when(k == 1, "第三项差异数").otherwise("别的文字内容")
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("span_ix"), F.when(k == 1, F.lit("第三项算差异")).otherwise(text).alias("text"))
    wanted = spans.select("doc_id").distinct().withColumn("target", F.lit("第三项预算差异"))
    return E.find_text(spans, wanted).select("doc_id", "span_ix", "score")
