"""Queries on page tables and cells (S1-S3, V003-V005, A3, A4, W2-W5, J6, F7, F17)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import close, close_either, dynamic_tolerance
from ..operators import tables as T
from ..registry import query
from ..sources import corpus as C

STATEMENT_SQL = f"""WITH {C.ORDERS_SQL},
i AS (SELECT cust AS doc_id, row_number() OVER (PARTITION BY cust ORDER BY k) AS page_no, k, s, n FROM o),
l AS (SELECT i.doc_id, CAST(i.page_no AS INTEGER) AS page_no, i.k, i.s, i.n, CAST(row_number() OVER (PARTITION BY i.k ORDER BY l_linenumber, l_partkey, l_extendedprice) + 1 AS INTEGER) AS row_ix,
  lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS code, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM i JOIN lineitem ON l_orderkey = i.k),
g AS (SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, k, CAST(n AS INTEGER) AS n, s, CAST(round(s * (CASE WHEN k % 7 = 0 THEN 1.05 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS total FROM i)
"""

V005_SQL = STATEMENT_SQL + """, t AS (SELECT *, greatest(CAST(s AS DOUBLE), CAST(total AS DOUBLE)) AS top FROM g WHERE n >= 2),
bad AS (SELECT *, abs(CAST(s - total AS DOUBLE)) AS diff FROM t
  WHERE abs(CAST(s - total AS DOUBLE)) > CASE WHEN top < 100 THEN 1.0 WHEN top < 10000 THEN greatest(1.0, top * 0.005) ELSE greatest(1.0, top * 0.003) END)
SELECT doc_id, page_no, 2 AS col_ix, n + 2 AS total_row, CAST(total AS DOUBLE) AS total_value, CAST(s AS DOUBLE) AS sum_value,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS seq FROM bad"""


@query("v005_table_total", V005_SQL)
def v005(spark, sf):
    found = T.totals(C.cells(C.statement_tables(spark, sf)))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    return found.select("doc_id", "page_no", "col_ix", "total_row", F.col("total_value").cast("double"), F.col("sum_value").cast("double"), seq.alias("seq"))


@query("s2_cells", STATEMENT_SQL + """SELECT doc_id, page_no, row_ix, 1 AS col_ix, code AS text FROM l UNION ALL SELECT doc_id, page_no, row_ix, 2, CAST(price AS VARCHAR) FROM l
UNION ALL SELECT doc_id, page_no, 1, 1, '科目编码' FROM g UNION ALL SELECT doc_id, page_no, 1, 2, '金额' FROM g
UNION ALL SELECT doc_id, page_no, n + 2, 1, '合计' FROM g UNION ALL SELECT doc_id, page_no, n + 2, 2, CAST(total AS VARCHAR) FROM g""")
def s2(spark, sf):
    return C.cells(C.statement_tables(spark, sf)).select("doc_id", "page_no", "row_ix", "col_ix", "text")


@query("s3_regroup_tables", STATEMENT_SQL + "SELECT doc_id, page_no, 1 AS n_tables, n + 2 AS n_rows FROM g WHERE page_no <= 3")
def s3(spark, sf):
    tables = C.statement_tables(spark, sf).withColumn("n_pages", F.lit(3))
    back = C.regroup_tables(C.flat_tables(tables))
    return back.select("doc_id", "page_no", F.size("tables").alias("n_tables"), F.size(F.col("tables")[0]).alias("n_rows"))


@query("s1_corpus_view", f"""WITH {C.ORDERS_SQL} SELECT k AS doc_id, CAST(12 AS BIGINT) AS n_pages, CAST(9 - (SELECT count(*) FROM range(9) r(i) WHERE (k + i) % 17 = 0) AS BIGINT) AS unit_pages,
CASE WHEN k % 13 = 0 AND (k + 4) % 17 <> 0 THEN 2 ELSE 1 END AS n_units, year AS cover_year FROM o""")
def s1(spark, sf):
    v = C.corpus_view(C.disclosure_pages(C.disclosures(spark, sf)))
    return v.groupBy("doc_id").agg(F.max("n_pages").alias("n_pages"), F.count("unit").alias("unit_pages"), F.countDistinct("unit").cast("int").alias("n_units"), F.max(F.when(F.col("page_no") == 1, F.get("years", F.lit(0)))).alias("cover_year"))


@query("f7_parse_cells", STATEMENT_SQL + "SELECT doc_id, page_no, row_ix, CAST(price AS DOUBLE) AS value FROM l")
def f7(spark, sf):
    c = T.parsed(C.cells(C.statement_tables(spark, sf))).where("col_ix = 2 and value is not null")
    last = F.max("row_ix").over(Window.partitionBy("doc_id", "page_no"))
    return c.withColumn("last", last).where("row_ix < last").select("doc_id", "page_no", "row_ix", F.col("value").cast("double").alias("value"))


@query("v003_page_threshold", f"""WITH {C.ORDERS_SQL}, p AS (SELECT cust AS doc_id, count(*) AS pages FROM o GROUP BY 1)
SELECT doc_id, pages, 'error' AS severity FROM p WHERE pages < 8 UNION ALL SELECT doc_id, pages, 'warn' FROM p WHERE pages > 300""")
def v003(spark, sf):
    pages = C.statement_tables(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    severity = F.when(F.col("pages") < 8, "error").when(F.col("pages") > 300, "warn")
    return pages.withColumn("severity", severity).where("severity is not null")


@query("v004_cell_validity", """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS row_ix, CASE WHEN l_partkey % 4 = 0 THEN 'error' ELSE 'warn' END AS severity FROM lineitem
WHERE (l_partkey % 4 = 0 AND l_suppkey % 3 = 0) OR (l_partkey % 4 <> 0 AND l_suppkey % 5 = 0)""")
def v004(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rate = F.concat(F.when(supp % 3 == 0, F.lit("120")).otherwise(F.lit("20")), F.lit("%"))
    money = F.concat(F.when(supp % 5 == 0, F.lit("-")).otherwise(F.lit("")), F.col("l_extendedprice").cast(C.MONEY).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(part % 4 == 0, rate).otherwise(money).alias("cell"))))
    li = C.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(rows.alias("r"))
    nested = li.select("doc_id", F.lit(1).alias("page_no"), F.array(F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["cell"]))).alias("tables"), "r")
    found = T.validity(C.cells(nested))
    lines = nested.select("doc_id", F.posexplode("r").alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("row_ix"), F.col("x.l_linenumber").alias("line"))
    return found.join(lines, ["doc_id", "row_ix"]).select("doc_id", F.col("line").cast("int").alias("row_ix"), "severity")


@query("a3_column_sums", STATEMENT_SQL + "SELECT doc_id, page_no, CAST(sum(price) AS DOUBLE) AS total, count(*) AS n_parts FROM l GROUP BY ALL HAVING count(*) >= 2")
def a3(spark, sf):
    c = T.with_head(T.parsed(C.cells(C.statement_tables(spark, sf)))).where("col_ix = 2 and row_ix > 1 and value is not null and head <> '合计'")
    return c.groupBy("doc_id", "page_no").agg(F.sum("value").cast("double").alias("total"), F.count(F.lit(1)).alias("n_parts")).where("n_parts >= 2")


@query("a4_class_sums", STATEMENT_SQL + "SELECT doc_id, page_no, left(code, 3) AS code, CAST(sum(price) AS DOUBLE) AS value FROM l GROUP BY ALL")
def a4(spark, sf):
    return T.class_sums(C.cells(C.statement_tables(spark, sf))).select("doc_id", "page_no", "code", F.col("value").cast("double"))


def _two_tables(spark, sf):
    """Pages with two tables: items, and the items of small orders again with one row more."""
    t = C.statement_tables(spark, sf)
    more = F.concat(F.col("tables")[0], F.array(F.array(F.lit("备注"), F.lit(""), F.lit("x"))))
    return t.withColumn("tables", F.when(F.size(F.col("tables")[0]) % 2 == 0, F.array(F.col("tables")[0], more)).otherwise(F.array(F.col("tables")[0], F.col("tables")[0])))


@query("w2_largest_table", STATEMENT_SQL + "SELECT doc_id, page_no, CASE WHEN (n + 2) % 2 = 0 THEN 1 ELSE 0 END AS table_ix, CAST((n + 2) * 2 + CASE WHEN (n + 2) % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n_cells FROM g")
def w2(spark, sf):
    return T.largest_table(C.cells(_two_tables(spark, sf))).select("doc_id", "page_no", "table_ix", "n_cells")


@query("w3_first_label_row", STATEMENT_SQL + "SELECT doc_id, page_no, n + 2 AS row_ix FROM g")
def w3(spark, sf):
    return T.labelled_row(C.cells(C.statement_tables(spark, sf)), ["合计", "总计"]).select("doc_id", "page_no", "row_ix")


@query("w4_row_value", STATEMENT_SQL + "SELECT doc_id, page_no, CAST(total AS DOUBLE) AS value FROM g")
def w4(spark, sf):
    return T.row_value(C.cells(C.statement_tables(spark, sf)), ["合计"], ["金额"]).select("doc_id", "page_no", F.col("value").cast("double"))


@query("w5_total_row", STATEMENT_SQL + "SELECT doc_id, page_no, n + 2 AS total_row, CAST(n AS BIGINT) AS rows_above FROM g")
def w5(spark, sf):
    c = C.cells(C.statement_tables(spark, sf)).where("col_ix = 1")
    total = F.min(F.when(F.col("text").isin("合计", "总计"), F.col("row_ix"))).over(Window.partitionBy(*T.TABLE))
    return c.withColumn("total_row", total).where("row_ix > 1 and row_ix < total_row").groupBy("doc_id", "page_no", "total_row").agg(F.count(F.lit(1)).alias("rows_above"))


@query("f17_tolerances", f"""WITH {C.ORDERS_SQL}, x AS (SELECT k, CAST(s AS DOUBLE) AS a, CAST(budget AS DOUBLE) AS b, CAST(s AS DOUBLE) * (1 + (k % 9) / 1000.0) AS c FROM o)
SELECT k, abs(a - c) <= greatest(1.0, abs(a) * 0.001, abs(c) * 0.001) AS fixed,
abs(a - c) <= CASE WHEN greatest(a, c) < 100 THEN 1.0 WHEN greatest(a, c) < 10000 THEN greatest(1.0, greatest(a, c) * 0.005) ELSE greatest(1.0, greatest(a, c) * 0.003) END AS dynamic,
abs(a - c) <= 0.01 OR abs(a - c) <= greatest(a, c) * 0.005 AS either FROM x""")
def f17(spark, sf):
    x = C.order_sums(spark, sf).select("k", F.col("s").cast("double").alias("a"))
    x = x.withColumn("c", F.col("a") * (1 + (F.col("k") % 9) / F.lit(1000.0)))
    a, c = F.col("a"), F.col("c")
    return x.select("k", close(a, c).alias("fixed"), (F.abs(a - c) <= dynamic_tolerance(a, c)).alias("dynamic"), close_either(a, c).alias("either"))
