"""The rules over books, as jobs on pages (doc_id, page_no, text) and nested tables (doc_id, page_no, tables): single
rules with their own columns, and `audit`, which runs a book of rules into one table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import close
from ..functions.text import near_number, near_percent
from ..registry import RuleBook
from ..sources.corpus import cells, corpus_view
from . import anchors as A
from . import prose as P
from . import tables as T
from .findings import without_noise

# Labels of the rows whose values the rules compare.
WANTED = {
    "total": ["支出合计", "支出总计", "合计"], "year_total": ["本年支出合计", "本年支出", "本年合计"], "alloc": ["结余分配"], "carry": ["年末结转"],
    "income": ["本年收入合计", "本年合计", "合计"], "grant": ["财政拨款收入"], "basic": ["基本支出"], "project": ["项目支出"],
    "staff": ["人员经费合计"], "public": ["公用经费合计"], "planned": ["合计预算数", "预算合计", "预算数"], "spent": ["合计决算数", "决算合计", "决算数"],
}
EMPTY_WORDS = "空表|无相关收支|不存在|无此项|本表无数据|无数据"


def values(pages: DataFrame, tables: DataFrame, names: list[str], labels: list[str] | None = None) -> DataFrame:
    """For each of the named tables a document has, the labelled values (all, or those asked for) of the
    largest table on its first page, where it has any. Tables are read where they stand; only values are joined."""
    first = A.first_anchors(pages, names).select("doc_id", "table_name", "page_no")
    return first.join(T.nested_row_values(T.only_largest(tables), {n: WANTED[n] for n in labels or WANTED}), ["doc_id", "page_no"])


def prose(pages: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, prose): the pages that hold one of the words, each with the page after it (a number may stand there),
    joined in order; a document's other pages stay where they are."""
    hit = reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in words])
    marked = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text")).withColumn("hit", hit)
    near = marked.withColumn("before", F.lag("hit", 1, False).over(Window.partitionBy("doc_id").orderBy("page_no"))).where("hit or before")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    return near.groupBy("doc_id").agg(text.alias("prose"))


def compared(pages: DataFrame, tables: DataFrame, name: str, words: list[str], labels: list[str] | None = None) -> DataFrame:
    """A table's values beside the prose around the words."""
    return values(pages, tables, [name], labels).join(prose(pages, words), "doc_id")


def reading(x: DataFrame, **columns: Column) -> DataFrame:
    """x with columns read from text once each: exploded, so that no condition on them reads the text again."""
    read = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_read")
    return x.select("*", read).select(*x.columns, "_read.*")


def differs(a: Column, b: Column) -> Column:
    return (F.coalesce(b, F.lit(0.0)) != 0) & ~close(a, b)


def _items(x: DataFrame, *items: Column) -> DataFrame:
    return x.select("doc_id", F.explode(F.array_compact(F.array(*items))).alias("item"))


def cover_year_unit(pages: DataFrame) -> DataFrame:
    """V001: (doc_id, message) where no year stands in front, no unit anywhere, or units are mixed."""
    d = corpus_view(pages).groupBy("doc_id").agg(F.countDistinct("unit").alias("n_units"), F.max(F.when(F.col("page_no") <= 3, F.size("years"))).alias("n_years"))
    rows = F.array(F.when(F.col("n_years") == 0, F.lit("未能识别年度")), F.when(F.col("n_units") == 0, F.lit("未识别到金额单位")), F.when(F.col("n_units") > 1, F.lit("金额单位混用")))
    return d.select("doc_id", F.explode(F.array_compact(rows)).alias("message"))


def sheet_identity(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V101: total expenditure against the year's, allocation and carry-over."""
    x = values(pages, tables, ["收入支出决算总表"], ["total", "year_total", "alloc", "carry"]).where("total is not null and year_total is not null and alloc is not null and carry is not null")
    parts = F.col("year_total") + F.col("alloc") + F.col("carry")
    return x.where(~close(F.col("total"), parts)).select("doc_id", F.col("total").cast("double").alias("stated"))


def sheet_vs_text(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V102: the sheet's total against the first number near the general explanation."""
    x = compared(pages, tables, "收入支出决算总表", ["总体情况"], ["total"])
    near = F.substring("prose", F.call_function("locate", F.lit("总体情况"), F.col("prose")), F.lit(100))
    number = F.regexp_extract(near, "(\\d+(?:,\\d{3})*(?:\\.\\d+)?)", 1)
    x = reading(x, n=F.regexp_replace(number, ",", "").try_cast("double"))
    return x.where(F.col("total").isNotNull() & F.col("n").isNotNull()).where(~close(F.col("total"), F.col("n"))).select("doc_id", F.col("total").cast("double").alias("in_table"), F.col("n").alias("in_text"))


def income_vs_text(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V103: income total, grant and the grant's share."""
    keys = [["收入决算情况说明", "本年收入合计", "合计"], ["财政拨款收入"], ["财政拨款收入", "占比", "比重"]]
    x = compared(pages, tables, "收入决算表", sum(keys, []), ["income", "grant"]).where("income is not null and grant is not null")
    x = reading(x, n_income=near_number("prose", keys[0]), n_grant=near_number("prose", keys[1]), pct=near_percent("prose", keys[2]))
    off = F.abs(F.round(F.col("grant") / F.col("income") * 100, 2).cast("double") - F.col("pct")) > 1.0
    return _items(x, F.when(differs(F.col("income"), F.col("n_income")), F.lit("收入合计")), F.when(differs(F.col("grant"), F.col("n_grant")), F.lit("财政拨款收入")), F.when(off, F.lit("占比")))


def expense_vs_text(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V104: expenditure total, basic and project expenditure, and both shares."""
    said = [("本年支出合计", "year_total", ["支出决算情况说明", "本年支出合计", "合计"]), ("基本支出", "basic", ["基本支出"]), ("项目支出", "project", ["项目支出"])]
    x = compared(pages, tables, "支出决算表", [w for _, _, keys in said for w in keys] + ["占比", "比重"], [c for _, c, _ in said]).where("year_total is not null and basic is not null and project is not null")
    x = reading(x, **{f"n_{c}": near_number("prose", keys) for _, c, keys in said}, **{f"pct_{c}": near_percent("prose", [name, "占比", "比重"]) for name, c, _ in said[1:]})
    sums = [F.when(differs(F.col(c), F.col(f"n_{c}")), F.lit(name)) for name, c, _ in said]
    share = lambda c: F.round(F.col(c) / F.col("year_total") * 100, 2).cast("double")
    off = [F.when(F.abs(share(c) - F.col(f"pct_{c}")) > 1.0, F.lit(name + "占比")) for name, c, _ in said[1:]]
    return _items(x, *sums, *off)


def grant_total_vs_text(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V105: the grant sheet's total."""
    keys = ["财政拨款收入支出决算总体情况说明", "总计", "合计"]
    x = reading(compared(pages, tables, "财政拨款收入支出决算总表", keys, ["total"]), n=near_number("prose", keys))
    return x.where(differs(F.col("total"), F.col("n"))).select("doc_id", F.col("total").cast("double").alias("in_table"), F.col("n").alias("in_text"))


def general_budget(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V106: the general budget's total, and each class's share against what prose says of its code."""
    x = compared(pages, tables, "一般公共预算财政拨款支出决算表", ["总体情况说明", "总体情况", "结构情况", "%"], ["total"])
    a = reading(x, n=near_number("prose", ["总体情况说明", "总体情况"])).where(F.col("n").isNotNull() & ~close(F.col("total"), F.col("n"))).select("doc_id", F.lit("合计").alias("item"))
    here = A.first_anchors(pages, ["一般公共预算财政拨款支出决算表"]).select("doc_id", "page_no")
    sums = T.nested_class_sums(tables.join(here, ["doc_id", "page_no"], "left_semi")).select("doc_id", "page_no", "code", F.col("value").alias("part"))
    y = x.join(sums, ["doc_id", "page_no"]).where("part > 0")
    pattern = F.concat(F.lit("(?s)(?:"), F.col("code"), F.lit("|结构情况)[^0-9]*?(-?\\d+(?:\\.\\d+)?)\\s*%"))
    y = reading(y, said=F.get(F.regexp_extract_all(F.col("prose"), pattern, F.lit(1)), F.lit(0)).cast("double"))
    said = F.col("said")
    share = F.col("part").cast("double") / F.col("total").cast("double") * 100
    return a.unionByName(y.where(said.isNotNull() & (F.abs(share - said) > 2.0)).select("doc_id", F.col("code").alias("item")))


def basic_expense(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V107: personnel and public expenses against basic expenditure in prose."""
    keys = ["一般公共预算财政拨款基本支出决算情况说明", "基本支出", "合计"]
    x = compared(pages, tables, "一般公共预算财政拨款基本支出决算表", keys, ["staff", "public"]).where("staff is not null and public is not null")
    return reading(x, n=near_number("prose", keys)).where(differs(F.col("staff") + F.col("public"), F.col("n"))).select("doc_id")


def three_public(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V108: budget and final amount of the three public expenses."""
    before, after = ["三公", "年初预算", "预算"], ["三公", "支出决算", "决算"]
    x = compared(pages, tables, "一般公共预算财政拨款“三公”经费支出决算表", before + after, ["planned", "spent"])
    x = reading(x, n_planned=near_number("prose", before), n_spent=near_number("prose", after))
    return _items(x, F.when(differs(F.col("planned"), F.col("n_planned")), F.lit("预算")), F.when(differs(F.col("spent"), F.col("n_spent")), F.lit("决算")))


def empty_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """V109: fund tables without amounts of which no page says that there are none."""
    names = ["政府性基金预算财政拨款收入支出决算表", "国有资本经营预算财政拨款收入支出决算表"]
    first = A.first_anchors(pages, names).select("doc_id", "table_name", "page_no")
    nested = tables.join(first.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    peak = T.parsed(cells(nested)).where("col_ix > 1").groupBy("doc_id", "page_no").agg(F.max(F.abs("value")).alias("peak"))
    said = pages.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(EMPTY_WORDS)).alias("said"))
    x = first.join(peak, ["doc_id", "page_no"]).join(said, "doc_id")
    return x.where("coalesce(peak, 0) < 1e-9 and not said").select("doc_id", "table_name")


def rule_book() -> RuleBook:
    """The executed rules by code; each gets {pages, tables} and returns doc_id, severity and message."""
    book = RuleBook(["doc_id", "rule_id", "severity", "message"])

    def add(code: str, severity: str, message: Column, rule) -> None:
        book.rule(code)(lambda t: rule(t).select("doc_id", F.lit(severity).alias("severity"), message.alias("message")))

    item = lambda words: F.concat(F.lit(words + "："), F.col("item"))
    both = lambda rule: lambda t: rule(t["pages"], t["tables"])
    add("V33-001", "warn", F.col("message"), lambda t: cover_year_unit(t["pages"]))

    @book.rule("V33-002")
    def nine(t):
        docs = t["pages"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
        return A.nine_tables(docs, A.anchors(t["pages"]))

    numbers = F.format_string("表内 %s，文中 %s", F.col("in_table").cast("string"), F.col("in_text").cast("string"))
    add("V33-101", "error", F.concat(F.lit("支出合计与各部分之和不符："), F.col("stated").cast("string")), both(sheet_identity))
    add("V33-102", "warn", numbers, both(sheet_vs_text))
    add("V33-103", "warn", item("收入决算表与文字不符"), both(income_vs_text))
    add("V33-104", "warn", item("支出决算表与文字不符"), both(expense_vs_text))
    add("V33-105", "warn", numbers, both(grant_total_vs_text))
    add("V33-106", "warn", item("一般公共预算与文字不符"), both(general_budget))
    add("V33-107", "warn", F.lit("人员与公用经费之和与文字不符"), both(basic_expense))
    add("V33-108", "warn", item("三公经费与文字不符"), both(three_public))
    add("V33-109", "warn", F.concat(F.lit("空表未作说明："), F.col("table_name")), both(empty_tables))

    @book.rule("V33-110")
    def prose_pairs(t):
        found = P.verdicts(P.accepted_pairs(P.sections(t["pages"])))
        return found.select("doc_id", "severity", F.concat_ws(" ", "kind", "planned", "spent", "stated").alias("message"))

    return book


def audit(pages: DataFrame, tables: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Findings (doc_id, rule_id, severity, message) of all rules, or of those asked for, over a corpus of books,
    without those that report parse noise (P1)."""
    return without_noise(rule_book().run(pages.sparkSession, {"pages": pages, "tables": tables}, only))
