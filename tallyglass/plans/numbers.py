"""Queries on amounts (F8-F11, C002, T27, T31)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import UNITS
from ..functions.numbers import all_numbers, amount_in_yuan, close_either, numeral, parse_robust
from ..registry import query, table
from ..sources.corpus import MONEY

PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


def _written(spark, sf):
    """Amounts as people write them, by line: plain, bracketed, percent, with a unit, with look-alikes, spaced, with a
    word of decrease."""
    price = F.col("l_extendedprice").cast(MONEY).cast("string")
    kind = F.col("l_partkey") % 8
    text = (
        F.when(kind == 0, price).when(kind == 1, F.concat(F.lit("("), price, F.lit(")"))).when(kind == 2, F.concat(price, F.lit("%")))
        .when(kind == 3, F.concat(price, F.lit("万元"))).when(kind == 4, F.concat(F.lit("约"), price, F.lit("左右"))).when(kind == 5, F.lit("—"))
        .when(kind == 6, F.concat(F.lit("下降"), price, F.lit("%"))).otherwise(F.lit("负三百二十"))
    )
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("part"), text.alias("text"))


ROBUST = f"CASE l_partkey % 8 WHEN 0 THEN CAST({PRICE} AS DOUBLE) WHEN 1 THEN -CAST({PRICE} AS DOUBLE) WHEN 2 THEN CAST({PRICE} AS DOUBLE) WHEN 3 THEN CAST({PRICE} * 10000 AS DOUBLE) WHEN 4 THEN CAST({PRICE} AS DOUBLE) WHEN 6 THEN -CAST({PRICE} AS DOUBLE) WHEN 7 THEN -320.0::DOUBLE END"


@query("f8_parse_robust", f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS line, l_partkey AS part, {ROBUST} AS value FROM lineitem")
def f8(spark, sf):
    return _written(spark, sf).select("doc_id", "line", "part", parse_robust("text").cast("double").alias("value"))


@query("t27_parse_quality", "SELECT l_orderkey AS doc_id, CAST(count(*) FILTER (l_partkey % 8 = 5) AS DOUBLE) / count(*) AS failure_rate FROM lineitem GROUP BY 1 HAVING CAST(count(*) FILTER (l_partkey % 8 = 5) AS DOUBLE) / count(*) > 0.1")
def t27(spark, sf):
    x = _written(spark, sf).withColumn("bad", parse_robust("text").isNull().cast("int"))
    return x.groupBy("doc_id").agg((F.sum("bad") / F.count(F.lit(1))).alias("failure_rate")).where("failure_rate > 0.1")


#: Numbers to be written out: small ones, and others up to the hundreds of 兆.
SPOKEN = "CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 10000 ELSE (p_partkey * 98765432101) % 100000000000000 END"


def spoken(n, formal):
    """n in Chinese: four digits a section, formal characters where asked for."""
    part = lambda v, unit: F.when(v > 0, F.concat(F.substring(F.lit("零一二三四五六七八九"), (v + 1).cast("int"), F.lit(1)), F.lit(unit))).otherwise(F.lit(""))
    section = lambda g: F.concat(part(F.floor(g / 1000), "千"), part(F.floor(g / 100) % 10, "百"), part(F.floor(g / 10) % 10, "十"), part(g % 10, ""))
    groups = [F.expr(f"({n} div {10**p}) % 10000") for p in (12, 8, 4, 0)]
    words = [F.when(g > 0, F.concat(F.when(g < 1000, F.lit("零")).otherwise(F.lit("")), section(g), F.lit(unit))).otherwise(F.lit("")) for g, unit in zip(groups, ["兆", "亿", "万", ""], strict=True)]
    said = F.regexp_replace(F.concat(*words), "^零", "")
    return F.when(formal, F.translate(said, "零一二三四五六七八九十百千万亿", "○壹贰叁肆伍陆柒捌玖拾佰仟萬億")).otherwise(said)


@query("f9_numerals", f"SELECT p_partkey AS part, CAST({SPOKEN} AS BIGINT) AS value FROM part WHERE {SPOKEN} > 0")
def f9(spark, sf):
    """Numbers written in common and (odd keys) in formal characters, read back."""
    p = table(spark, sf, "part").withColumn("n", F.expr(SPOKEN)).where("n > 0")
    return p.select(F.col("p_partkey").alias("part"), numeral(spoken("n", F.col("p_partkey") % 2 == 1)).alias("value"))


@query("f10_all_numbers", f"SELECT l_orderkey AS doc_id, l_linenumber, l_partkey AS part, unnest([1, 2, 3, 4]) AS place, unnest([CAST({PRICE} AS DOUBLE), -CAST(CAST(l_quantity AS INTEGER) AS DOUBLE), CAST(l_linenumber AS DOUBLE), 320.0::DOUBLE]) AS value FROM lineitem")
def f10(spark, sf):
    """One number of each form in every text; the unit after the first is none by itself."""
    text = F.concat(
        F.lit("合计"), F.col("l_extendedprice").cast(MONEY).cast("string"), F.lit("万元，调整（"), F.col("l_quantity").cast("int").cast("string"),
        F.lit("），占"), F.col("l_linenumber").cast("string"), F.lit("%，共三百二十项"),
    )
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("part"), text.alias("text"))
    m = li.select("doc_id", "l_linenumber", "part", F.posexplode(all_numbers("text")).alias("i", "m"))
    return m.select("doc_id", "l_linenumber", "part", (F.col("i") + 1).alias("place"), F.col("m.value").alias("value"))


@query("f11_amount_units", f"SELECT l_orderkey AS doc_id, l_linenumber, l_partkey AS part, CAST({PRICE} * CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10000 ELSE 100000000 END AS DOUBLE) AS yuan FROM lineitem")
def f11(spark, sf):
    unit = F.element_at(F.array(F.lit("元"), F.lit("万元"), F.lit("亿元")), (F.col("l_partkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("支出"), F.col("l_extendedprice").cast(MONEY).cast("string"), unit)
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("part"), amount_in_yuan(text).cast("double").alias("yuan"))


@query("t31_in_wan", f"SELECT l_orderkey AS doc_id, l_linenumber, l_partkey AS part, CAST({PRICE} AS DOUBLE) * CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10000 ELSE 100000000 END / 10000 AS wan FROM lineitem")
def t31(spark, sf):
    units = F.broadcast(spark.createDataFrame([u for u in UNITS if u[0] in ("元", "万元", "亿元")], "unit string, yuan long"))
    unit = F.element_at(F.array(F.lit("元"), F.lit("万元"), F.lit("亿元")), (F.col("l_partkey") % 3 + 1).cast("int"))
    li = table(spark, sf, "lineitem").withColumn("unit", unit).join(units, "unit")
    return li.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("part"), (F.col("l_extendedprice").cast(MONEY).cast("double") * F.col("yuan") / 10000).alias("wan"))


@query("c002_three_public", f"""WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, CAST({PRICE} AS DOUBLE) AS v FROM lineitem WHERE l_partkey % 2 = 0),
f AS (SELECT *, first_value(v) OVER (PARTITION BY doc_id ORDER BY line, part, v) AS first FROM x)
SELECT doc_id, count(*) FILTER (NOT (abs(v - first) <= 0.01 OR abs(v - first) <= greatest(v, first) * 0.005)) AS n_off FROM f GROUP BY 1""")
def c002(spark, sf):
    text = F.concat(F.when(F.col("l_partkey") % 2 == 0, F.lit("三公经费支出")).otherwise(F.lit("其他支出")), F.col("l_extendedprice").cast(MONEY).cast("string"), F.lit("万元"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", text.alias("text"))
    amount = F.regexp_extract("text", "(?:三公|公务接待|因公出国|公务用车)[^0-9]{0,20}(\\d+(?:\\.\\d+)?)", 1)
    x = li.withColumn("v", F.when(amount != "", amount.cast("double"))).where("v is not null")
    first = F.first("v").over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "v"))
    return x.withColumn("first", first).groupBy("doc_id").agg(F.count_if(~close_either(F.col("v"), F.col("first"))).alias("n_off"))
