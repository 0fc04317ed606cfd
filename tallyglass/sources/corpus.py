"""Corpora: page texts, nested page tables and long cells, and the ones derived from the sales tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import NINE_TABLES
from ..functions.text import money_unit, years
from ..registry import table

MONEY = "decimal(18,2)"


def cells(tables: DataFrame) -> DataFrame:
    """One row per cell of nested page tables; table_ix from 0, row_ix and col_ix from 1; null is empty."""
    t = tables.select("doc_id", "page_no", F.posexplode_outer("tables").alias("table_ix", "rows"))
    r = t.select("doc_id", "page_no", "table_ix", F.posexplode_outer("rows").alias("row_ix", "cols"))
    c = r.select("doc_id", "page_no", "table_ix", (F.col("row_ix") + 1).alias("row_ix"), F.posexplode_outer("cols").alias("col_ix", "text"))
    return c.select("doc_id", "page_no", "table_ix", "row_ix", (F.col("col_ix") + 1).alias("col_ix"), F.coalesce(F.trim("text"), F.lit("")).alias("text")).where("col_ix is not null")


def corpus_view(pages: DataFrame) -> DataFrame:
    """Pages with unit, years and the document's page count."""
    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return pages.select("doc_id", "page_no", "text", money_unit("text").alias("unit"), years("text").alias("years"), count.alias("n_pages"))


def flat_tables(tables: DataFrame) -> DataFrame:
    """S3: (doc, page, table) rows of pages that exist; empty tables go."""
    t = tables.select("doc_id", "page_no", "n_pages", F.posexplode("tables").alias("table_ix", "rows"))
    return t.where("page_no between 1 and n_pages and size(rows) > 0")


def regroup_tables(flat: DataFrame) -> DataFrame:
    """S3 back: tables of a page in their order."""
    kept = F.transform(F.array_sort(F.collect_list(F.struct("table_ix", "rows"))), lambda x: x["rows"])
    return flat.groupBy("doc_id", "page_no").agg(kept.alias("tables"))


def order_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lineitems: k, cust, year, s (sum), odd (sum of odd lines), n, items in line order."""
    price = F.col("l_extendedprice").cast(MONEY)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(price).cast(MONEY).alias("s"),
        F.coalesce(F.sum(F.when(F.col("l_linenumber") % 2 == 1, price)), F.lit(0)).cast(MONEY).alias("odd"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), price.alias("price")))).alias("items"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), (F.year("o_orderdate") + 20).alias("year"),
        F.col("o_totalprice").cast(MONEY).alias("budget"), "o_orderstatus", "o_orderpriority",
    )
    return orders.join(lines, "k")


def statement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are customers, pages orders: one table of items with a total that is 5% off for every seventh."""
    total = F.round(F.col("s") * F.when(F.col("k") % 7 == 0, F.lit(1.05).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)")), 2).cast(MONEY)
    row = lambda x: F.array(F.lpad(x["part"].cast("string"), 7, "0"), x["price"].cast("string"))
    rows = F.concat(F.array(F.array(F.lit("科目编码"), F.lit("金额"))), F.transform("items", row), F.array(F.array(F.lit("合计"), total.cast("string"))))
    page = F.row_number().over(Window.partitionBy("cust").orderBy("k"))
    return order_sums(spark, sf_dir).select(F.col("cust").alias("doc_id"), page.alias("page_no"), F.array(rows).alias("tables"))


def _off(column: str, modulus: int, rest: int) -> Column:
    """A column, two percent too high where k % modulus = rest."""
    return F.round(F.col(column) * F.when(F.col("k") % modulus == rest, F.lit(1.02).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)")), 2).cast(MONEY)


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as disclosures: the figures of each, with planted faults by key."""
    d = order_sums(spark, sf_dir).withColumns({
        "rest": (F.col("s") - F.col("odd")).cast(MONEY),
        "alloc": ((F.col("k") % 5) * 10).cast(MONEY),
        "carry": ((F.col("k") % 3) * 20).cast(MONEY),
    })
    sheet = (F.col("s") + F.col("alloc") + F.col("carry")) * F.when(F.col("k") % 7 == 0, F.lit(1.05).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)"))
    d = d.withColumn("sheet", F.round(sheet, 2).cast(MONEY))
    share = F.round(F.col("odd") / F.col("s") * 100, 2)
    return d.withColumns({
        "n0": _off("sheet", 10, 3), "n1": _off("s", 10, 4), "n2": _off("odd", 10, 5), "n4": _off("odd", 10, 6), "n5": _off("rest", 10, 7),
        "b": _off("budget", 10, 8), "pct": F.round(share + F.when(F.col("k") % 10 == 9, 5).otherwise(0), 2).cast("decimal(8,2)"),
    })


def table_page(i: int) -> Column:
    """Page number of the i-th standard table: tables 2 and 3 change places where k % 19 = 0."""
    other = {2: 3, 3: 2}.get(i, i)
    return F.when(F.col("k") % 19 == 0, F.lit(3 + other)).otherwise(F.lit(3 + i))


def _texts() -> list[tuple[Column, Column]]:
    """Number and text of a disclosure's twelve pages; the nine tables' stand third to eleventh."""
    s = lambda c: F.col(c).cast("string")
    prose = F.concat(
        F.when(F.col("k") % 11 != 0, F.lit("目录\n")).otherwise(F.lit("")),
        F.lit("总体情况说明：支出总计"), s("n0"), F.lit("万元。\n收入决算情况说明：本年收入合计"), s("n1"), F.lit("万元，财政拨款收入"), s("n2"),
        F.lit("万元，占比"), s("pct"), F.lit("%。\n支出决算情况说明：基本支出"), s("n4"), F.lit("万元，项目支出"), s("n5"),
        F.lit("万元。\n结构情况：201类占比"), s("pct"), F.lit("%。\n“三公”经费年初预算"), s("b"), F.lit("万元，"),
        F.when(F.col("k") % 4 == 0, F.lit("本表无数据。")).otherwise(F.lit("完毕。")),
    )
    pages = [(F.lit(1), F.concat(s("year"), F.lit("年度部门决算"))), (F.lit(2), prose)]
    for i, (name, _) in enumerate(NINE_TABLES):
        unit = F.when(F.lit(i == 4) & (F.col("k") % 13 == 0), F.lit("元")).otherwise(F.lit("万元"))
        damaged = F.when(F.lit(i >= 4) & ((F.col("k") + i) % 23 == 0), F.lit(name[:2] + "甲" + name[3:])).otherwise(F.lit(name))  # a letter misread
        body = F.when((F.col("k") + i) % 17 == 0, F.lit("附注")).otherwise(F.concat(damaged, F.lit("\n单位："), unit))
        pages.append((table_page(i), body))
    return [*pages, (F.lit(12), F.lit("完"))]


def disclosure_pages(d: DataFrame) -> DataFrame:
    """Twelve pages for each disclosure: cover, prose, nine tables (the title of some with one wrong letter), end."""
    pages = [F.struct(no.alias("page_no"), text.alias("text")) for no, text in _texts()]
    return d.select(F.col("k").alias("doc_id"), F.explode(F.array(*pages)).alias("p")).select("doc_id", "p.page_no", "p.text")


def _nested() -> list[Column]:
    """The nested cells of each of the nine tables' pages."""
    head = F.array(F.lit("项目"), F.lit("决算数"))
    row = lambda name, c: F.array(F.lit(name), (F.col(c) if isinstance(c, str) else c).cast("string"))
    bodies = [
        [row("支出合计", "sheet"), row("本年支出合计", "s"), row("结余分配", "alloc"), row("年末结转和结余", "carry")],
        [row("本年收入合计", "s"), row("财政拨款收入", "odd")],
        [row("本年支出合计", "s"), row("基本支出", "odd"), row("项目支出", "rest")],
        [row("支出合计", "s")],
        [row("2010101", "odd"), row("2080501", "rest"), row("合计", "s")],
        [row("人员经费合计", "odd"), row("公用经费合计", "rest")],
        [row("合计预算数", "budget"), row("合计决算数", "s")],
        [row("合计", F.lit("0.00"))],
        [row("合计", F.when(F.col("k") % 2 == 0, F.lit("0")).otherwise(F.lit("5.00")))],
    ]
    return [F.array(F.array(head, *rows)) for rows in bodies]


def disclosure_tables(d: DataFrame) -> DataFrame:
    """The nine tables' nested cells on their pages."""
    pages = [F.struct(table_page(i).alias("page_no"), tables.alias("tables")) for i, tables in enumerate(_nested())]
    return d.select(F.col("k").alias("doc_id"), F.explode(F.array(*pages)).alias("p")).select("doc_id", "p.page_no", "p.tables")


def disclosure_book(d: DataFrame) -> DataFrame:
    """Both at once: every page with its text and its nested tables (null on pages without)."""
    nested = [None, None, *_nested(), None]
    empty = F.lit(None).cast("array<array<array<string>>>")
    pages = [F.struct(no.alias("page_no"), text.alias("text"), (empty if t is None else t).alias("tables")) for (no, text), t in zip(_texts(), nested, strict=True)]
    return d.select(F.col("k").alias("doc_id"), F.explode(F.array(*pages)).alias("p")).select("doc_id", "p.*")


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-page documents that state budget, final amount and how they compare (V110's section)."""
    d = order_sums(spark, sf_dir)
    phrase = F.when(F.col("o_orderstatus") == "F", "大于").when(F.col("o_orderstatus") == "O", "小于").otherwise(F.when(F.col("k") % 2 == 0, "基本持平").otherwise("持平"))
    reason = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.lit("主要原因：按实际需求调整。")).otherwise(F.lit(""))
    text = F.concat(F.lit("（三）一般公共预算财政拨款支出决算具体情况\n其中：\n1、年初预算为"), F.col("budget").cast("string"), F.lit("万元，支出决算为"), F.col("s").cast("string"), F.lit("万元，决算数"), phrase, F.lit("预算数。"), reason)
    return d.select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text"))


def findings(spark: SparkSession, sf_dir: str, by: str = "l_orderkey") -> DataFrame:
    """Findings of two sources, one for each lineitem: document = order (or what `by` names), even lines from ai,
    odd from rule."""
    k, n, p, u = (F.col(c) for c in (by, "l_linenumber", "l_partkey", "l_suppkey"))
    noise = F.when(p % 23 == 0, F.lit("表出现多次：")).when(p % 29 == 0, F.lit("页码异常 ")).otherwise(F.lit(""))
    return table(spark, sf_dir, "lineitem").select(
        k.alias("doc_id"),
        n.cast("int").alias("idx"),
        F.when(n % 2 == 0, "ai").otherwise("rule").alias("source"),
        F.concat(F.lit("V33-"), F.lpad((101 + p % 10).cast("string"), 3, "0")).alias("rule_id"),
        F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "N", "warn").otherwise("info").alias("severity"),
        F.when(u % 10 > 0, 1 + u % 12).cast("int").alias("page"),
        F.when(p % 6 > 0, p % 1000).cast("int").alias("pos"),
        F.concat(F.lit("第"), (u % 7).cast("string"), F.lit("项预算差异")).alias("title"),
        F.concat(noise, F.lit("部门预算金额"), F.col("l_extendedprice").cast(MONEY).cast("string"), F.lit("。请核对")).alias("message"),
        F.when(p % 3 > 0, F.concat(F.lit("节"), (p % 4).cast("string"))).alias("section"),
        F.when(u % 3 > 0, F.concat(F.lit("表"), (u % 4).cast("string"))).alias("table_name"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_quantity") % 5 + 1).cast("int").alias("confidence"),
        F.array(F.col("l_linestatus"), F.col("l_returnflag")).alias("tags"),
        F.col("l_shipdate").alias("created_at"),
    )


def item_name(part) -> Column:
    """Two words of eight Chinese characters that belong to a part."""
    letters = F.decode(F.unhex(F.regexp_replace(F.md5(part.cast("string").cast("binary")), "(..)", "4E$1")), "UTF-16BE")
    return F.concat(F.substring(letters, 1, 8), F.lit(" "), F.substring(letters, 9, 8))


def named_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) of orders that name their parts, by line whole, with other blanks inside, with a wrong letter
    or with one missing; and the names (item_id, alias) of all parts."""

    def written(x):
        name, kind = item_name(x["part"]), x["place"] % 4
        head, tail = F.substring(name, 1, 3), F.substring(name, 5, 13)
        said = F.when(kind == 0, name).when(kind == 1, F.replace(name, F.lit(" "), F.lit("\t "))).when(kind == 2, F.concat(head, F.lit("?"), tail)).otherwise(F.concat(head, tail))
        return F.struct(x["place"].alias("place"), F.concat(F.lit("购置"), said, F.lit("一批")).alias("s"))

    # Part numbers cross the exchange; they become text behind it.
    line = F.struct(F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("part"))
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line.alias("l")).repartition("doc_id").groupBy("doc_id").agg(F.collect_list("l").alias("l"))
    said = F.array_join(F.transform(F.array_sort(F.transform("l", written)), lambda x: x["s"]), "；")
    texts = orders.select("doc_id", F.concat(said, F.lit("。")).alias("text"))
    return texts, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), item_name(F.col("p_partkey")).alias("alias"))


FINDINGS_SQL = """f AS (
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS idx,
  CASE WHEN l_linenumber % 2 = 0 THEN 'ai' ELSE 'rule' END AS source,
  'V33-' || lpad(CAST(101 + l_partkey % 10 AS VARCHAR), 3, '0') AS rule_id,
  CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warn' ELSE 'info' END AS severity,
  CASE WHEN l_suppkey % 10 > 0 THEN CAST(1 + l_suppkey % 12 AS INTEGER) END AS page,
  CASE WHEN l_partkey % 6 > 0 THEN CAST(l_partkey % 1000 AS INTEGER) END AS pos,
  '第' || (l_suppkey % 7) || '项预算差异' AS title,
  (CASE WHEN l_partkey % 23 = 0 THEN '表出现多次：' WHEN l_partkey % 29 = 0 THEN '页码异常 ' ELSE '' END)
    || '部门预算金额' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '。请核对' AS message,
  CASE WHEN l_partkey % 3 > 0 THEN '节' || (l_partkey % 4) END AS section,
  CASE WHEN l_suppkey % 3 > 0 THEN '表' || (l_suppkey % 4) END AS table_name,
  l_extendedprice AS amount, CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS INTEGER) AS confidence,
  l_linestatus AS tag1, l_returnflag AS tag2, l_shipdate AS created_at,
  l_partkey AS p, l_suppkey AS u
FROM lineitem)"""

ORDERS_SQL = """o AS (
SELECT o_orderkey AS k, o_custkey AS cust, CAST(year(o_orderdate) + 20 AS INTEGER) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS budget,
  o_orderstatus, o_orderpriority, s, odd, CAST(s - odd AS DECIMAL(18,2)) AS rest, n,
  CAST((o_orderkey % 5) * 10 AS DECIMAL(18,2)) AS alloc, CAST((o_orderkey % 3) * 20 AS DECIMAL(18,2)) AS carry
FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s,
    CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linenumber % 2 = 1), 0) AS DECIMAL(18,2)) AS odd,
    count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
v AS (SELECT *, CAST(round((s + alloc + carry) * (CASE WHEN k % 7 = 0 THEN 1.05 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS sheet FROM o),
d AS (SELECT *,
  CAST(round(sheet * (CASE WHEN k % 10 = 3 THEN 1.02 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS n0,
  CAST(round(s * (CASE WHEN k % 10 = 4 THEN 1.02 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS n1,
  CAST(round(odd * (CASE WHEN k % 10 = 5 THEN 1.02 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS n2,
  CAST(round(odd * (CASE WHEN k % 10 = 6 THEN 1.02 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS n4,
  CAST(round(rest * (CASE WHEN k % 10 = 7 THEN 1.02 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS n5,
  CAST(round(budget * (CASE WHEN k % 10 = 8 THEN 1.02 ELSE 1.00 END), 2) AS DECIMAL(18,2)) AS b,
  CAST(odd AS DOUBLE) / CAST(s AS DOUBLE) * 100 + (CASE WHEN k % 10 = 9 THEN 5 ELSE 0 END) AS pct
FROM v)"""
