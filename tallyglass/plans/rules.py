"""Rule jobs V001, V002, V101-V109, C001-C006 and their joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import NINE_TABLES, TABLE_KEYWORDS
from ..functions.numbers import close
from ..functions.text import near_number, normalize
from ..operators import anchors as A
from ..operators import audit as U
from ..operators import tables as T
from ..registry import query, written
from ..sources import corpus as C

_NAMES = ", ".join(f"({i}, '{n}', '{a}')" for i, (n, al) in enumerate(NINE_TABLES) for a in dict.fromkeys([n, *al]))
# A page that begins with the fifth table's name is within 92% of the sixth's (its first 15 letters have 15 of 17), unless a letter is wrong.
_NORM = "replace(replace({}, '“', ''), '”', '')"
ANCHOR_SQL = f"""WITH {C.ORDERS_SQL}, dim(ord, table_name, alias) AS (VALUES {_NAMES}),
page AS (SELECT k, i, CASE WHEN k % 19 = 0 AND i IN (2, 3) THEN 8 - i ELSE 3 + i END AS page_no, (SELECT DISTINCT table_name FROM dim WHERE ord = i) AS title
  FROM o, range(9) r(i) WHERE (k + i) % 17 <> 0),
hit AS (SELECT DISTINCT i, ord, table_name FROM (SELECT DISTINCT ord AS i, table_name AS title FROM dim) t, dim WHERE contains({_NORM.format('t.title')}, {_NORM.format('dim.alias')})),
a AS (SELECT DISTINCT k AS doc_id, h.table_name, CAST(h.ord AS INTEGER) AS ord, CAST(page_no AS INTEGER) AS page_no FROM page p JOIN hit h USING (i)
  UNION SELECT k, (SELECT DISTINCT table_name FROM dim WHERE ord = 5), 5, CAST(page_no AS INTEGER) FROM page WHERE i = 4 AND (k + 4) % 23 <> 0)
"""


def _pages(spark, sf):
    return C.disclosure_pages(C.disclosures(spark, sf))


@query("j1_table_anchors", ANCHOR_SQL + "SELECT * FROM a")
def j1(spark, sf):
    return A.anchors(_pages(spark, sf)).select("doc_id", "table_name", "ord", "page_no")


MISSING = "m AS (SELECT k AS doc_id, n.table_name FROM o, (SELECT DISTINCT table_name FROM dim) n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = o.k AND a.table_name = n.table_name))"


@query("j5_missing_tables", ANCHOR_SQL + f", {MISSING} SELECT * FROM m")
def j5(spark, sf):
    pages = _pages(spark, sf)
    return A.missing_tables(pages.select("doc_id").distinct(), A.anchors(pages)).select("doc_id", "table_name")


FIRST = "fp AS (SELECT doc_id, table_name, ord, min(page_no) AS page_no, count(*) AS n FROM a GROUP BY ALL)"
BROKEN = "br AS (SELECT doc_id, count(*) AS n_tables FROM (SELECT *, lag(ord) OVER (PARTITION BY doc_id ORDER BY page_no, ord) AS b FROM fp) GROUP BY 1 HAVING count(*) >= 3 AND bool_or(ord < b))"


@query("w13_table_order", ANCHOR_SQL + f", {FIRST}, {BROKEN} SELECT * FROM br")
def w13(spark, sf):
    return A.out_of_order(A.anchors(_pages(spark, sf)))


V002_SQL = ANCHOR_SQL + f""", {MISSING}, {FIRST}, {BROKEN}
SELECT doc_id, '缺失表：' || table_name AS message, CASE WHEN count(*) OVER (PARTITION BY doc_id) <= 2 THEN 'warn' ELSE 'error' END AS severity FROM m
UNION ALL SELECT doc_id, '表出现多次：' || table_name, 'warn' FROM fp WHERE n > 1 UNION ALL SELECT doc_id, '顺序异常', 'warn' FROM br"""


@query("v002_nine_tables", V002_SQL)
def v002(spark, sf):
    """Anchors are searched once and written; all three findings start from them."""
    hits = written(A.page_tables(_pages(spark, sf)))
    docs = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return A.nine_tables(docs, A.named(hits).distinct())


@query("v001_cover_year_unit", f"""WITH {C.ORDERS_SQL}, u AS (SELECT k, (SELECT count(*) FROM range(9) r(i) WHERE (k + i) % 17 <> 0) AS n, (k % 13 = 0 AND (k + 4) % 17 <> 0) AS mixed FROM o)
SELECT k AS doc_id, '金额单位混用' AS message FROM u WHERE mixed AND n > 1""")
def v001(spark, sf):
    return U.cover_year_unit(_pages(spark, sf))


@query("a1_majority", """SELECT l_orderkey AS doc_id, l_returnflag AS value FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(l_linenumber), l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1""")
def a1(spark, sf):
    li = C.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first", "value"))
    return li.withColumn("rank", rank).where("rank = 1").select("doc_id", "value")


YEARS_SQL = """WITH y AS (SELECT o_custkey AS doc_id, CAST(year(o_orderdate) + 20 AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT doc_id, arg_max(y, n * 10000 - y) AS main FROM y GROUP BY 1) """


@query("a2_year_histogram", YEARS_SQL + "SELECT y.doc_id, y AS year, n, main FROM y JOIN m USING (doc_id)")
def a2(spark, sf):
    return _year_histogram(spark, sf)


def _year_histogram(spark, sf):
    from ..functions.text import years

    text = F.concat(F.lit("截至"), (F.year("o_orderdate") + 20).cast("string"), F.lit("年度报告"))
    pages = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), text.alias("text"))
    counted = pages.select("doc_id", F.explode(years("text")).alias("year")).groupBy("doc_id", "year").agg(F.count(F.lit(1)).alias("n"))
    main = F.first("year").over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "year"))
    return counted.withColumn("main", main)


@query("c003_year_consistency", YEARS_SQL + "SELECT doc_id, main, count(*) FILTER (abs(y - main) > 1) = 0 AS is_valid, count(*) FILTER (abs(y - main) > 1) AS problems FROM y JOIN m USING (doc_id) GROUP BY ALL")
def c003(spark, sf):
    h = _year_histogram(spark, sf).groupBy("doc_id", "main").agg(F.count_if(F.abs(F.col("year") - F.col("main")) > 1).alias("problems"))
    return h.select("doc_id", "main", (F.col("problems") == 0).alias("is_valid"), "problems")


_CATEGORIES = ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(TABLE_KEYWORDS))


@query("a5_completeness", ANCHOR_SQL + f""", c(ord, category) AS (VALUES {_CATEGORIES}), h AS (SELECT DISTINCT doc_id, ord FROM a),
w AS (SELECT o.k AS doc_id, category, h.ord IS NOT NULL AS found FROM o CROSS JOIN c LEFT JOIN h ON h.doc_id = o.k AND h.ord = c.ord)
SELECT doc_id, coalesce(category, '*') AS category, count(*) FILTER (found) AS n_found, count(*) AS n_tables, CAST(count(*) FILTER (found) AS DOUBLE) / count(*) >= 0.8 AS complete FROM w GROUP BY GROUPING SETS ((doc_id, category), (doc_id))""")
def a5(spark, sf):
    """Found tables of each category and, as category *, of the document; complete from 80% on."""
    pages = _pages(spark, sf)
    kinds = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category")) for i, (c, _) in enumerate(TABLE_KEYWORDS)])
    wanted = pages.select("doc_id").distinct().select("doc_id", F.explode(kinds).alias("t")).select("doc_id", "t.ord", "t.category")
    found = A.anchors(pages).select("doc_id", "ord", F.lit(True).alias("found")).distinct()
    w = wanted.join(found, ["doc_id", "ord"], "left")
    n = w.rollup("doc_id", "category").agg(F.count("found").alias("n_found"), F.count(F.lit(1)).alias("n_tables")).where("doc_id is not null")
    return n.select("doc_id", F.coalesce("category", F.lit("*")).alias("category"), "n_found", "n_tables", (F.col("n_found") / F.col("n_tables") >= 0.8).alias("complete"))


@query("c001_missing_or_pass", ANCHOR_SQL + f", {MISSING} SELECT k AS doc_id, CAST(count(m.table_name) AS BIGINT) AS n_missing, count(m.table_name) = 0 AS is_valid FROM o LEFT JOIN m ON m.doc_id = o.k GROUP BY ALL")
def c001(spark, sf):
    pages = _pages(spark, sf)
    docs = pages.select("doc_id").distinct()
    n = A.missing_tables(docs, A.anchors(pages)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = docs.join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_missing"))
    return out.withColumn("is_valid", F.col("n_missing") == 0)


@query("c004_contents_page", f"WITH {C.ORDERS_SQL} SELECT k AS doc_id, CASE WHEN k % 11 <> 0 THEN 2 END AS page_no, k % 11 <> 0 AS is_valid FROM o")
def c004(spark, sf):
    p = _pages(spark, sf).groupBy("doc_id").agg(F.min(F.when(F.col("text").contains("目录"), F.col("page_no"))).alias("page_no"))
    return p.withColumn("is_valid", F.col("page_no").isNotNull())


@query("c005_second_pack", ANCHOR_SQL + """, w(t) AS (VALUES ('收入决算表'), ('支出决算表'), ('财政拨款收入支出决算总表'))
SELECT k AS doc_id, t AS table_name FROM o, w WHERE NOT EXISTS (SELECT 1 FROM page p WHERE p.k = o.k AND contains(p.title, t))""")
def c005(spark, sf):
    """A table is found where its name is contained in a page; the rest is missing."""
    wanted = ["收入决算表", "支出决算表", "财政拨款收入支出决算总表"]
    g = _pages(spark, sf).groupBy("doc_id").agg(*[F.bool_or(normalize("text").contains(w)).alias(f"h{i}") for i, w in enumerate(wanted)])
    missing = F.array(*[F.when(~F.col(f"h{i}"), F.lit(w)) for i, w in enumerate(wanted)])
    return g.select("doc_id", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("table_name"))


@query("c006_keyword_pages", f"WITH {C.ORDERS_SQL} SELECT k AS doc_id, p AS page_no FROM o, (VALUES (1), (2)) t(p) UNION ALL SELECT k, 3 FROM o WHERE k % 17 <> 0")
def c006(spark, sf):
    return _pages(spark, sf).where("page_no <= 3").where(F.col("text").rlike("预算|执行|决算")).select("doc_id", "page_no")


def _book(spark, sf):
    """Pages and nested tables of the derived books."""
    d = C.disclosures(spark, sf)
    return C.disclosure_pages(d), C.disclosure_tables(d)


_OFF = "abs({a} - {b}) > greatest(1.0, abs({a}) * 0.001, abs({b}) * 0.001)"
_D = lambda c: f"CAST({c} AS DOUBLE)"
#: Page of a table's first anchor, as the oracle sees it; values follow that page's own table.
VALUES_SQL = ANCHOR_SQL.rstrip() + f", {FIRST}, fd AS (SELECT d.*, f.table_name, f.page_no, CASE WHEN d.k % 19 = 0 AND f.page_no IN (5, 6) THEN 8 - (f.page_no - 3) - 3 ELSE f.page_no - 3 END AS ix FROM d JOIN fp f ON f.doc_id = d.k)\n"


def off_sql(a: str, b: str) -> str:
    return f"{_D(b)} <> 0 AND " + _OFF.format(a=_D(a), b=_D(b))


@query("v101_sheet_identity", VALUES_SQL + f"SELECT k AS doc_id, {_D('sheet')} AS stated FROM fd WHERE table_name = '收入支出决算总表' AND ix = 0 AND " + _OFF.format(a=_D("sheet"), b=_D("s + alloc + carry")))
def v101(spark, sf):
    return U.sheet_identity(*_book(spark, sf))


@query("v102_sheet_vs_text", VALUES_SQL + f"SELECT k AS doc_id, {_D('t')} AS in_table, {_D('n0')} AS in_text FROM (SELECT *, CASE ix WHEN 0 THEN sheet ELSE s END AS t FROM fd WHERE table_name = '收入支出决算总表') WHERE " + _OFF.format(a=_D("t"), b=_D("n0")))
def v102(spark, sf):
    return U.sheet_vs_text(*_book(spark, sf))


@query("v103_income_vs_text", VALUES_SQL + f"""SELECT k AS doc_id, item FROM (SELECT *, unnest([CASE WHEN {off_sql('s', 'n1')} THEN '收入合计' END, CASE WHEN {off_sql('odd', 'n2')} THEN '财政拨款收入' END,
CASE WHEN abs(round({_D('odd')} / {_D('s')} * 100, 2) - CAST(CAST(pct AS DECIMAL(8,2)) AS DOUBLE)) > 1.0 THEN '占比' END]) AS item FROM fd WHERE table_name = '收入决算表' AND ix = 1) WHERE item IS NOT NULL""")
def v103(spark, sf):
    return U.income_vs_text(*_book(spark, sf))


@query("v104_expense_vs_text", VALUES_SQL + f"""SELECT k AS doc_id, item FROM (SELECT *, unnest([CASE WHEN {off_sql('s', 'n1')} THEN '本年支出合计' END, CASE WHEN {off_sql('odd', 'n4')} THEN '基本支出' END, CASE WHEN {off_sql('rest', 'n5')} THEN '项目支出' END,
CASE WHEN abs(round({_D('odd')} / {_D('s')} * 100, 2) - CAST(CAST(pct AS DECIMAL(8,2)) AS DOUBLE)) > 1.0 THEN '基本支出占比' END,
CASE WHEN abs(round({_D('rest')} / {_D('s')} * 100, 2) - CAST(CAST(pct AS DECIMAL(8,2)) AS DOUBLE)) > 1.0 THEN '项目支出占比' END]) AS item
FROM fd WHERE table_name = '支出决算表' AND ix = 2) WHERE item IS NOT NULL""")
def v104(spark, sf):
    return U.expense_vs_text(*_book(spark, sf))


@query("v105_grant_total_vs_text", VALUES_SQL + f"SELECT k AS doc_id, {_D('s')} AS in_table, {_D('n0')} AS in_text FROM fd WHERE table_name = '财政拨款收入支出决算总表' AND {off_sql('s', 'n0')}")
def v105(spark, sf):
    return U.grant_total_vs_text(*_book(spark, sf))


@query("v106_general_budget", VALUES_SQL + f"SELECT k AS doc_id, '合计' AS item FROM fd WHERE table_name = '一般公共预算财政拨款支出决算表' AND ix = 4 AND " + _OFF.format(a=_D("s"), b=_D("n0")) + f"""
UNION ALL SELECT k, '201' FROM fd WHERE table_name = '一般公共预算财政拨款支出决算表' AND ix = 4 AND abs({_D('odd')} / {_D('s')} * 100 - CAST(CAST(pct AS DECIMAL(8,2)) AS DOUBLE)) > 2.0 AND odd > 0""")
def v106(spark, sf):
    return U.general_budget(*_book(spark, sf))


@query("v107_basic_expense", VALUES_SQL + f"SELECT k AS doc_id FROM fd WHERE table_name = '一般公共预算财政拨款基本支出决算表' AND ix = 5 AND {off_sql('s', 'n1')}")
def v107(spark, sf):
    return U.basic_expense(*_book(spark, sf))


@query("v108_three_public", VALUES_SQL + f"""SELECT k AS doc_id, item FROM (SELECT *, unnest([CASE WHEN {off_sql('budget', 'b')} THEN '预算' END, CASE WHEN {off_sql('s', 'n0')} THEN '决算' END]) AS item
FROM fd WHERE table_name = '一般公共预算财政拨款“三公”经费支出决算表') WHERE item IS NOT NULL""")
def v108(spark, sf):
    return U.three_public(*_book(spark, sf))


@query("v109_empty_tables", VALUES_SQL + """SELECT k AS doc_id, table_name FROM fd WHERE k % 4 <> 0 AND (table_name = '政府性基金预算财政拨款收入支出决算表' OR (table_name = '国有资本经营预算财政拨款收入支出决算表' AND k % 2 = 0))""")
def v109(spark, sf):
    return U.empty_tables(*_book(spark, sf))


@query("audit_findings", VALUES_SQL + f", {MISSING}, {BROKEN}, e AS (SELECT k, table_name, ix, s, sheet, alloc, carry FROM fd)"
    + f"""SELECT k AS doc_id, 'V33-101' AS rule_id, 'error' AS severity FROM e WHERE table_name = '收入支出决算总表' AND ix = 0 AND """ + _OFF.format(a=_D("sheet"), b=_D("s + alloc + carry"))
    + """ UNION ALL SELECT doc_id, 'V33-002', CASE WHEN count(*) OVER (PARTITION BY doc_id) <= 2 THEN 'warn' ELSE 'error' END FROM m
UNION ALL SELECT doc_id, 'V33-002', 'warn' FROM br""")
def audit_findings(spark, sf):
    """The rule book over a whole corpus, here with two of its rules."""
    return U.audit(*_book(spark, sf), only=["V33-002", "V33-101"]).select("doc_id", "rule_id", "severity")


@query("j6_anchor_cells", VALUES_SQL + "SELECT k AS doc_id, table_name, page_no, CAST(2 * [5, 3, 4, 2, 4, 3, 3, 2, 2][CAST(ix AS INTEGER) + 1] AS BIGINT) AS n_cells FROM fd")
def j6(spark, sf):
    """A table's first anchor page, that page's largest table, its cells."""
    d = C.disclosures(spark, sf)
    first = A.first_anchors(C.disclosure_pages(d)).select("doc_id", "table_name", "page_no")
    n = C.cells(T.only_largest(C.disclosure_tables(d))).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_cells"))
    return first.join(n, ["doc_id", "page_no"]).select("doc_id", "table_name", "page_no", "n_cells")


@query("j7_table_vs_text", VALUES_SQL + f"""SELECT k AS doc_id, item, in_table, in_text FROM (SELECT k, unnest(['收入', '拨款']) AS item, unnest([{_D('s')}, {_D('odd')}]) AS in_table, unnest([{_D('n1')}, {_D('n2')}]) AS in_text
FROM fd WHERE table_name = '收入决算表' AND ix = 1) WHERE abs(in_table - in_text) > greatest(1.0, in_table * 0.001, in_text * 0.001)""")
def j7(spark, sf):
    """Table values beside prose values, by document and item, outside the tolerance."""
    x = U.compared(*_book(spark, sf), "收入决算表", ["本年收入合计", "财政拨款收入"])
    x = U.reading(x, n_income=near_number("prose", ["本年收入合计"]), n_grant=near_number("prose", ["财政拨款收入"]))
    item = lambda name, a, b: F.struct(F.lit(name).alias("item"), F.col(a).cast("double").alias("in_table"), F.col(b).alias("in_text"))
    met = x.select("doc_id", F.explode(F.array(item("收入", "income", "n_income"), item("拨款", "grant", "n_grant"))).alias("t")).select("doc_id", "t.*")
    met = met.where("in_table is not null and in_text is not null")
    return met.where(~close(F.col("in_table"), F.col("in_text")))
