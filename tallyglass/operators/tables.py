"""Operators on cells: value look-up, totals, largest table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dynamic_tolerance, is_negative, is_percent, parse_cell

TABLE = ["doc_id", "page_no", "table_ix"]
MONEY_HEADS = "金额|合计|本年收入|本年支出|决算数|预算数"
SKIPPED_HEADS = ["其中", "小计", "分项", "人员经费合计", "公用经费合计"]


def parsed(cells: DataFrame) -> DataFrame:
    """Cells with value and sign; parsed once for every rule that reads them."""
    return cells.withColumns({"value": parse_cell("text"), "is_percent": is_percent("text"), "is_negative": is_negative("text")})


def with_head(cells: DataFrame) -> DataFrame:
    """Adds the row's first cell and the column's header; both windows use the table's partitioning."""
    row = Window.partitionBy(*TABLE, "row_ix").orderBy("col_ix")
    col = Window.partitionBy(*TABLE, "col_ix").orderBy("row_ix")
    first = lambda c, w, cond: F.first(F.when(cond, F.col(c)), ignorenulls=True).over(w)
    return cells.withColumns({"head": first("text", row, F.col("col_ix") == 1), "header": first("text", col, F.col("row_ix") == 1)})


def totals(cells: DataFrame) -> DataFrame:
    """V005: total cells that differ from the sum of their leaf rows beyond the dynamic tolerance. Cells are dealt by
    table once; the windows by row, column and table and the sums all find them there."""
    whole = Window.partitionBy(*TABLE)
    c = with_head(parsed(cells.repartition(*TABLE))).withColumn("head", F.coalesce("head", F.lit("")))
    is_total = F.trim("head").isin("合计", "总计")
    c = c.withColumns({
        "total_row": F.min(F.when((F.col("col_ix") == 1) & is_total, F.col("row_ix"))).over(whole),
        "two_sided": F.max((F.col("row_ix") == 1) & F.col("text").contains("收入")).over(whole) & F.max((F.col("row_ix") == 1) & F.col("text").contains("支出")).over(whole),
        "by_header": (F.col("col_ix") > 1) & F.coalesce(F.col("header"), F.lit("")).rlike(MONEY_HEADS),
        "code": F.regexp_extract("head", "(?U)^\\s*(\\d{3,7})", 1),
        "number": F.col("value").isNotNull() & ~F.col("is_percent"),
    }).where("total_row >= 3 and not two_sided")
    any_header = F.max("by_header").over(whole)
    above = F.col("row_ix") < F.col("total_row")
    column = Window.partitionBy(*TABLE, "col_ix")
    counted = F.sum(F.when(above & F.col("number"), 1).otherwise(0)).over(column)
    c = c.withColumn("money", F.when(any_header, F.col("by_header")).otherwise((F.col("col_ix") > 1) & (counted >= 3)))
    leaf = F.max(F.when(above & (F.col("row_ix") > 1) & (F.col("code") != ""), F.length("code"))).over(whole)
    c = c.withColumn("leaf", leaf)
    part = above & (F.col("row_ix") > 1) & ~F.col("head").isin(*SKIPPED_HEADS) & ~is_total & (F.col("leaf").isNull() | ((F.col("code") != "") & (F.length("code") == F.col("leaf"))))
    sums = c.where("money and number").groupBy(*TABLE, "col_ix").agg(
        F.max("total_row").alias("total_row"),
        F.max(F.when(F.col("row_ix") == F.col("total_row"), F.col("value"))).alias("total_value"),
        F.sum(F.when(part, F.col("value"))).alias("sum_value"),
        F.count(F.when(part, 1)).alias("n_parts"),
    )
    off = F.abs(F.col("sum_value") - F.col("total_value")).cast("double") > dynamic_tolerance(F.col("sum_value"), F.col("total_value"))
    return sums.where("n_parts >= 2 and total_value is not null").where(off)


def validity(cells: DataFrame) -> DataFrame:
    """V004: percentages outside 0 to 100 (error) and negative numbers (warn), with coordinates."""
    c = parsed(cells).where("value is not null")
    out_of_range = F.col("is_percent") & ~F.col("value").between(0, 100)
    severity = F.when(out_of_range, "error").when(~F.col("is_percent") & F.col("is_negative"), "warn")
    return c.withColumn("severity", severity).where("severity is not null").select("doc_id", "page_no", "table_ix", "row_ix", "col_ix", "severity", "text")


def largest_table(cells: DataFrame) -> DataFrame:
    """The table with most cells of each page; the first wins ties."""
    sizes = cells.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n_cells"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.desc("n_cells"), "table_ix"))
    return sizes.withColumn("rank", rank).where("rank = 1").drop("rank")


def only_largest(nested: DataFrame) -> DataFrame:
    """W2 on nested tables (doc_id, page_no, tables), a row a page: all but the table with most cells are emptied, where
    they stand; the first wins ties."""
    cells_of = lambda rows: F.aggregate(F.coalesce(rows, F.array()), F.lit(0), lambda n, cols: n + F.coalesce(F.greatest(F.size(cols), F.lit(0)), F.lit(0)))
    size = F.transform("tables", cells_of)
    left = F.transform("tables", lambda rows, i: F.when(i == F.array_position(size, F.array_max(size)) - 1, rows))
    return nested.select("doc_id", "page_no", F.when(F.size("tables") == 1, F.col("tables")).otherwise(left).alias("tables"))


def labelled_row(cells: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each table whose label holds any key."""
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.col("text").contains(k)
    return cells.where("col_ix = 1").where(hit).groupBy(*TABLE).agg(F.min("row_ix").alias("row_ix"))


def row_value(cells: DataFrame, keys: list[str], prefer: list[str] | None = None) -> DataFrame:
    """Value of the first row with such a label: preferred header columns, else the rightmost number."""
    c = with_head(parsed(cells)) if prefer else parsed(cells)
    met = c.join(labelled_row(cells, keys), [*TABLE, "row_ix"]).where("value is not null and not is_percent")
    liked = F.lit(False)
    for p in prefer or []:
        liked = liked | F.col("header").contains(p)
    return met.groupBy(*TABLE).agg(
        F.coalesce(F.min_by(F.when(liked, F.col("value")), F.when(liked, F.col("col_ix"))), F.max_by("value", "col_ix")).alias("value")
    )


def row_values(cells: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """W4 for several labels at once: one pass over the cells, a column for each name."""
    c = parsed(cells.repartition(*TABLE)).withColumn("head", F.first(F.when(F.col("col_ix") == 1, F.col("text")), ignorenulls=True).over(Window.partitionBy(*TABLE, "row_ix").orderBy("col_ix")))
    whole = Window.partitionBy(*TABLE)
    rows = {}
    for name, keys in wanted.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.col("head").contains(k)
        rows[name] = F.min(F.when(hit, F.col("row_ix"))).over(whole)
    c = c.withColumns({f"row_{n}": e for n, e in rows.items()}).where("value is not null and not is_percent")
    at = lambda n: F.col("row_ix") == F.col(f"row_{n}")
    return c.groupBy(*TABLE).agg(*[F.max_by(F.when(at(n), F.col("value")), F.when(at(n), F.col("col_ix"))).alias(n) for n in wanted])


def nested_row_values(tables: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """W4 on nested tables (doc_id, page_no, tables): the same values, each row read where it stands; only rows with a
    wanted label are parsed, and nothing is dealt or sorted. Tables without any of the values stay out."""
    t = tables.select("doc_id", "page_no", F.posexplode("tables").alias("table_ix", "rows"))
    r = t.select(*TABLE, F.posexplode("rows").alias("row_ix", "cols")).withColumn("head", F.coalesce(F.get("cols", F.lit(0)), F.lit("")))
    hit = lambda keys: reduce(lambda a, b: a | b, [F.col("head").contains(k) for k in dict.fromkeys(keys)])
    r = r.where(hit([k for keys in wanted.values() for k in keys]))
    numbers = F.filter(F.transform("cols", lambda c: F.when(~is_percent(c), parse_cell(c))), lambda v: v.isNotNull())
    r = r.withColumn("value", F.try_element_at(numbers, F.lit(-1)))
    first = [F.min_by("value", F.when(hit(keys), F.col("row_ix"))).alias(n) for n, keys in wanted.items()]
    return r.groupBy(*TABLE).agg(*first).where(F.coalesce(*wanted).isNotNull())


def class_sums(cells: DataFrame, digits: int = 3) -> DataFrame:
    """A4: sums by functional class (code prefix), from each row's last plain number; the header is skipped."""
    c = with_head(parsed(cells)).where("row_ix > 1")
    c = c.withColumn("code", F.substring(F.regexp_extract(F.trim("head"), "(?U)^(\\d{3,7})", 1), 1, digits)).where("code <> ''")
    rows = c.where("col_ix > 1 and value is not null and not is_percent").groupBy(*TABLE, "row_ix", "code").agg(F.max_by("value", "col_ix").alias("value"))
    return rows.groupBy(*TABLE, "code").agg(F.sum("value").alias("value"))


def nested_class_sums(tables: DataFrame, digits: int = 3) -> DataFrame:
    """A4 on nested tables (doc_id, page_no, tables): the same sums, each row read where it stands; only rows with a code
    are parsed, and nothing is sorted."""
    t = tables.select("doc_id", "page_no", F.posexplode("tables").alias("table_ix", "rows"))
    r = t.select("doc_id", "page_no", "table_ix", F.posexplode("rows").alias("row_ix", "cols")).where("row_ix > 0 and size(cols) > 1")
    head = F.trim(F.coalesce(F.get("cols", F.lit(0)), F.lit("")))
    r = r.withColumn("code", F.substring(F.regexp_extract(head, "(?U)^(\\d{3,7})", 1), 1, digits)).where("code <> ''")
    numbers = F.filter(F.transform(F.slice("cols", 2, 10**9), lambda c: F.when(~is_percent(F.trim(c)), parse_cell(F.trim(c)))), lambda v: v.isNotNull())
    rows = r.select("doc_id", "page_no", "table_ix", "code", F.try_element_at(numbers, F.lit(-1)).alias("value")).where("value is not null")
    return rows.groupBy(*TABLE, "code").agg(F.sum("value").alias("value"))


def first_cells(tables: str, pattern: str) -> Column:
    """Of one page's nested tables the different texts of rows' first cells that match a pattern."""
    every = lambda c: F.filter(c, lambda x: x.isNotNull())
    firsts = F.transform(every(F.flatten(every(F.col(tables)))), lambda cols: F.trim(F.coalesce(F.get(cols, F.lit(0)), F.lit(""))))
    return F.array_distinct(F.filter(firsts, lambda c: c.rlike(pattern)))


def class_rows(tables: str, digits: int = 3) -> Column:
    """Of one page's nested tables the array of (code, value) of every row with a code and a number, as in
    `nested_class_sums`, for plans that keep a page's row as it is."""
    every = lambda c: F.filter(c, lambda x: x.isNotNull())
    coded = lambda cols: F.regexp_extract(F.trim(F.coalesce(F.get(cols, F.lit(0)), F.lit(""))), "(?U)^(\\d{3,7})", 1)
    rows = F.flatten(F.transform(every(F.col(tables)), lambda t: F.slice(t, 2, 10**9)))
    rows = F.filter(every(rows), lambda cols: (F.size(cols) > 1) & (coded(cols) != ""))
    number = lambda c: F.when(~is_percent(F.trim(c)), parse_cell(F.trim(c)))
    last = lambda cols: F.try_element_at(every(F.transform(F.slice(cols, 2, 10**9), number)), F.lit(-1))
    found = F.transform(rows, lambda cols: F.struct(F.substring(coded(cols), 1, digits).alias("code"), last(cols).alias("value")))
    return F.filter(found, lambda x: x["value"].isNotNull())
