"""Declared check types as parameterised DataFrame operators: check(tables, parameters) -> findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import close, let, parse_cell


def identity(values: DataFrame, left: list[tuple[str, int]], right: str, absolute: float = 1.0, relative: float = 0.005) -> DataFrame:
    """A signed sum of labelled values against one of them; T18 downgrades differences of 0.01 or less."""
    total = reduce(lambda a, b: a + b, [F.col(c) * sign for c, sign in left])
    diff = F.abs((total - F.col(right)).cast("double"))
    out = values.withColumns({"expected": total, "diff": diff}).where("expected is not null").where(F.col(right).isNotNull())
    severity = F.when(F.col("diff") <= 0.01, "info").when(close(F.col("expected"), F.col(right), absolute, relative), None).otherwise("error")
    return out.withColumn("severity", F.when(F.col("diff") > 0, severity)).where("severity is not null")


def value_pairs(values: DataFrame, items: list[tuple[str, str, str]], absolute: float = 1.0, relative: float = 0.001) -> DataFrame:
    """Table value against prose value for a list of (item, table column, text column)."""
    rows = F.array(*[F.struct(F.lit(i).alias("item"), F.col(a).cast("double").alias("in_table"), F.col(b).cast("double").alias("in_text")) for i, a, b in items])
    x = values.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
    return x.where(F.col("in_table").isNotNull() & F.col("in_text").isNotNull() & ~close(F.col("in_table"), F.col("in_text"), absolute, relative))


def shares(values: DataFrame, part: str, whole: str, stated: str, points: float = 0.1) -> DataFrame:
    """Computed share against stated share."""
    share = F.col(part).cast("double") / F.col(whole).cast("double") * 100
    return values.withColumn("share", share).where(F.abs(F.col("share") - F.col(stated)) > points)


def class_shares(pages: DataFrame, points: float = 2.0) -> DataFrame:
    """(doc_id, code) for each share that some page (doc_id, rows of (code, value), text) states and that is not the
    class's part of its document."""
    pattern = F.lit("(\\d{3})类占比(\\d+(?:[.]\\d+)?)%")
    said = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("code"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("pct"))
    said = F.when(F.col("text").contains("类占比"), said)  # most pages state none
    number = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    entry = lambda code, value, pct: F.struct(code.alias("code"), number(value, "decimal(28,4)").alias("value"), number(pct, "double").alias("pct"))
    parts = F.coalesce(F.transform("rows", lambda x: entry(x["code"], x["value"], None)), F.array())
    stated = F.coalesce(F.transform(said, lambda x: entry(x["code"], None, x["pct"])), F.array())
    x = pages.select("doc_id", F.explode(F.concat(parts, stated)).alias("x")).select("doc_id", "x.*")
    sums = x.groupBy("doc_id", "code").agg(F.sum("value").alias("part"), F.collect_list("pct").alias("pct"))
    sums = sums.withColumn("whole", F.sum("part").over(Window.partitionBy("doc_id"))).where("part > 0")
    stated = sums.select("doc_id", "code", "part", "whole", F.explode("pct").alias("pct"))
    return shares(stated, "part", "whole", "pct", points).select("doc_id", "code")


def needs_reason(texts: DataFrame, trigger: str, reason: str) -> DataFrame:
    """A trigger phrase without a reason."""
    return texts.where(F.col("text").rlike(trigger) & ~F.col("text").rlike(reason))


def undescribed(items: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a mention."""
    return items.join(mentions, keys, "left_anti")


def undescribed_codes(codes: DataFrame, mentions: DataFrame, levels: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """Codes (doc_id, code) of a table that prose leaves out. A code is described where it is named, and one of a
    higher level also where all codes below it are; levels go from items up."""
    keyed = codes.distinct().join(mentions.distinct().withColumn("named", F.lit(True)), ["doc_id", "code"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    out, below = [], None
    for n in reversed(levels):
        here = keyed.where(F.length("code") == n)
        if below is not None:
            children = below.groupBy("doc_id", F.left("code", F.lit(n)).alias("code")).agg(F.bool_and("named").alias("all_below"))
            here = here.join(children, ["doc_id", "code"], "left").withColumn("named", F.col("named") | F.coalesce("all_below", F.lit(False))).drop("all_below")
        out.append(here)
        below = here
    return reduce(DataFrame.unionByName, out).where("not named").select("doc_id", "code")


def undescribed_in_rows(books: DataFrame, levels: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """T06 where a document's codes and mentions are arrays of one row (doc_id, codes, mentions): nothing is dealt."""
    of = lambda n: F.filter("codes", lambda c: F.length(c) == n)
    left = []
    for at, n in reversed(list(enumerate(levels))):
        here = F.array_except(of(n), F.col("mentions"))
        if left:
            above = lambda c, n=n: F.transform(c, lambda x: F.left(x, F.lit(n)))
            here = F.array_except(here, F.array_except(above(of(levels[at + 1])), above(left[-1])))
        left.append(here)
    return books.select("doc_id", F.explode(F.concat(*left)).alias("code"))


def contents_entries(pages: DataFrame) -> DataFrame:
    """(doc_id, line, title, toc_page) of the tables that contents pages list: a title, dots or blanks, a page."""
    listed = pages.where(F.col("text").rlike("(?m)^\\s*目\\s*录\\s*$")).select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("at", "entry"))
    form = "(?U)^\\s*(.{2,50}?表)[\\s.…·]*(\\d+)\\s*$"
    found = listed.where(F.col("entry").rlike(form))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "at"))
    return found.select("doc_id", place.alias("line"), F.regexp_extract("entry", form, 1).alias("title"), F.regexp_extract("entry", form, 2).cast("int").alias("toc_page"))


def body_titles(pages: DataFrame) -> DataFrame:
    """(doc_id, title, page_no) of pages whose first line is a table's title; of equal ones the first page."""
    head = F.trim(F.substring_index("text", "\n", 1))
    found = pages.select("doc_id", "page_no", head.alias("title")).where(F.col("title").rlike("^.{2,50}表$"))
    return found.groupBy("doc_id", "title").agg(F.min("page_no").alias("page_no"))


def longest_rise(values: Column) -> Column:
    """Of an array of different numbers, the places (from 0) of a longest rising subsequence, the earliest one.
    First the longest rise from each place on, from the right; then places are taken from the left."""
    at = F.arrays_zip(values.alias("v"), F.sequence(F.lit(0), F.size(values) - 1).alias("i"))
    state = "array<struct<v:int,i:int,n:int>>"

    def longer(acc, x):
        n = F.coalesce(F.array_max(F.transform(F.filter(acc, lambda y: y["v"] > x["v"]), lambda y: y["n"])), F.lit(0)) + 1
        return F.concat(F.array(F.struct(x["v"].cast("int").alias("v"), x["i"].cast("int").alias("i"), n.cast("int").alias("n"))), acc)

    sized = F.aggregate(F.reverse(at), F.expr(f"cast(array() as {state})"), longer)
    start = lambda runs: F.struct(F.array_max(F.transform(runs, lambda y: y["n"])).alias("left"), F.lit(-(2**31)).alias("v"), F.expr("cast(array() as array<int>)").alias("kept"))

    def take(acc, y):
        on = (y["n"] == acc["left"]) & (y["v"] > acc["v"])
        return F.when(on, F.struct((acc["left"] - 1).alias("left"), y["v"].alias("v"), F.concat(acc["kept"], F.array(y["i"])).alias("kept"))).otherwise(acc)

    return let(sized, lambda runs: F.aggregate(runs, start(runs), take, lambda acc: acc["kept"]))


def contents_alignment(entries: DataFrame, titles: DataFrame, reach: int = 3) -> DataFrame:
    """Titles of only one side, titles whose page is off by more than `reach`, and titles out of the order of
    the contents: those outside the longest rising run of pages. Both sides of a document are short arrays that meet in
    one grouping: nothing is joined, so nothing is broadcast, whatever their sizes are taken for."""
    listed = F.struct("line", "title", "toc_page")
    there = F.struct("title", "page_no")
    both = entries.select("doc_id", listed.alias("e"), F.lit(None).cast(titles.select(there.alias("t")).schema["t"].dataType).alias("t"))
    both = both.unionByName(titles.select("doc_id", F.lit(None).cast(both.schema["e"].dataType).alias("e"), there.alias("t")))
    books = both.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("listed"), F.array_sort(F.collect_list("t")).alias("there"))

    def row(line, title, toc_page, page_no):
        return F.struct(line.cast("int").alias("line"), page_no.cast("int").alias("page_no"), title.alias("title"), toc_page.cast("int").alias("toc_page"))

    def with_page(e):
        same = F.filter("there", lambda t: t["title"] == e["title"])
        return F.when(F.size(same) > 0, F.transform(same, lambda t: row(e["line"], e["title"], e["toc_page"], t["page_no"]))).otherwise(F.array(row(e["line"], e["title"], e["toc_page"], F.lit(None))))

    alone = F.filter("there", lambda t: ~F.exists("listed", lambda e: e["title"] == t["title"]))
    met = F.concat(F.flatten(F.transform("listed", with_page)), F.transform(alone, lambda t: row(F.lit(None), t["title"], F.lit(None), t["page_no"])))
    problem = lambda x: F.when(x["page_no"].isNull(), "not_in_body").when(x["toc_page"].isNull(), "not_in_contents").when(F.abs(x["page_no"] - x["toc_page"]) > reach, "wrong_page")
    single = lambda c: F.filter(F.transform(c, lambda x: F.struct(x["title"].alias("title"), problem(x).alias("problem"))), lambda x: x["problem"].isNotNull())
    aligned = lambda c: F.array_sort(F.filter(c, lambda x: x["page_no"].isNotNull() & x["toc_page"].isNotNull()))

    def moved(c):
        pages = F.transform(c, lambda x: x["page_no"])
        return let(longest_rise(pages), lambda kept: F.transform(F.filter(c, lambda x, i: ~F.array_contains(kept, i)), lambda x: F.struct(x["title"].alias("title"), F.lit("out_of_order").alias("problem"))))

    every = let(met, lambda c: F.concat(single(c), let(aligned(c), lambda a: F.when(F.size(a) > 1, moved(a)).otherwise(F.slice(single(c), 1, 0)))))
    return books.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.title", "x.problem")


def layouts(tables: DataFrame, covers: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Each table's header signature (sorted cells without blanks, hashed), its document's region as the cover
    names it, and whether a whitelisted layout (region, columns) of that region is part of the header."""
    clean = F.transform(F.filter(F.transform(F.col("tables")[0][0], lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s", "")), lambda c: c != ""), lambda c: c)
    heads = tables.select("doc_id", "page_no", F.array_sort(F.array_distinct(clean)).alias("header"))
    listed = F.broadcast(whitelist.withColumnRenamed("region", "listed_region"))
    named = covers.join(F.broadcast(whitelist.select("region").distinct()), F.expr("contains(text, region)"), "left").groupBy("doc_id").agg(F.min("region").alias("region"))
    met = heads.join(named, "doc_id", "left").join(listed, F.col("region") == F.col("listed_region"), "left")
    fits = F.coalesce(F.size(F.array_except("columns", "header")) == 0, F.lit(False))
    out = met.groupBy("doc_id", "page_no", "region", "header").agg(F.bool_or(fits).alias("whitelisted"))
    return out.select("doc_id", "page_no", "region", F.md5(F.array_join("header", "|").cast("binary")).alias("signature"), "whitelisted")


def unit_coverage(units: DataFrame, disclosed: DataFrame, exempt: DataFrame) -> DataFrame:
    """Every unit of the map as covered, exempt or uncovered."""
    met = units.join(disclosed.withColumn("c", F.lit(True)), "unit", "left").join(exempt.withColumn("x", F.lit(True)), "unit", "left")
    return met.select("unit", F.when(F.col("c"), "covered").when(F.col("x"), "exempt").otherwise("uncovered").alias("status"))


def near_section(anchors: DataFrame, titles: DataFrame, reach: int = 3) -> DataFrame:
    """Tables without an explanation title within so many pages."""
    met = anchors.join(titles.withColumnRenamed("page_no", "title_page"), ["doc_id", "table_name"], "left")
    near = F.bool_or(F.coalesce(F.abs(F.col("title_page") - F.col("page_no")) <= reach, F.lit(False)))
    return met.groupBy("doc_id", "table_name", "page_no").agg(near.alias("near")).where("not near").drop("near")


def code_names(items: DataFrame, book: DataFrame) -> DataFrame:
    """Items whose name the code book knows under another code."""
    return items.join(book.withColumnRenamed("code", "right_code"), "name").where("code <> right_code")


def near_keywords(sentences: DataFrame, first: str, second: str) -> DataFrame:
    """Sentences with the first keyword and the second in it or a neighbour."""
    w = Window.partitionBy("doc_id").orderBy("ix")
    around = F.concat_ws(" ", F.lag("text").over(w), F.col("text"), F.lead("text").over(w))
    return sentences.withColumn("around", around).where(F.col("text").contains(first) & F.col("around").contains(second)).drop("around")


def inconsistent_names(names: DataFrame) -> DataFrame:
    """Documents that use more than one entity name."""
    return names.groupBy("doc_id").agg(F.collect_set("name").alias("names")).where(F.size("names") > 1)


def one_to_one(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, item, side) of items that only the table or only the prose of a document has."""
    a, b = items.distinct().withColumn("in_table", F.lit(True)), mentions.distinct().withColumn("in_text", F.lit(True))
    met = a.join(b, ["doc_id", "item"], "full_outer").where("in_table is null or in_text is null")
    return met.select("doc_id", "item", F.when(F.col("in_text").isNull(), "table_only").otherwise("text_only").alias("side"))


def mentioned(texts: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, item): which of the names a text holds."""
    found = F.array_compact(F.array(*[F.when(F.col("text").contains(n), F.lit(n)) for n in names]))
    return texts.select("doc_id", F.explode(found).alias("item"))


def part_sums(cells: DataFrame, texts: DataFrame, parts: list[str], change: str) -> DataFrame:
    """(doc_id, problem) of tables (project, last year, this year): a part without a row, a total that is not the
    sum of its parts (where all are there), a total that changed while the prose says nothing of it."""
    labels = cells.where("col_ix = 1").select("doc_id", "page_no", "table_ix", "row_ix", F.col("text").alias("label"))
    value = lambda i: F.max(F.when(F.col("col_ix") == i, parse_cell("text")))
    rows = cells.groupBy("doc_id", "page_no", "table_ix", "row_ix").agg(value(2).alias("before"), value(3).alias("now")).join(labels, ["doc_id", "page_no", "table_ix", "row_ix"])
    of = lambda n, c: F.max(F.when(F.col("label") == n, F.col(c)))
    wide = rows.groupBy("doc_id").agg(*[of(p, "now").alias(f"p{i}") for i, p in enumerate(parts)], of("合计", "now").alias("total"), of("合计", "before").alias("total_before"))
    silent = texts.select("doc_id", (~F.col("text").rlike(change)).alias("silent"))
    every = [F.col(f"p{i}") for i in range(len(parts))]
    off = ~close(reduce(lambda a, b: a + b, every), F.col("total"))
    problems = [F.when(c.isNull(), F.lit(f"缺少{p}")) for c, p in zip(every, parts, strict=True)]
    problems += [F.when(off, F.lit("分项之和不等于合计")), F.when(~close(F.col("total"), F.col("total_before")) & F.col("silent"), F.lit("变动未说明"))]
    found = wide.join(silent, "doc_id").select("doc_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    return found


def stated_figures(pages: DataFrame, figures: dict[str, str]) -> DataFrame:
    """(doc_id, item, value): every amount that stands behind one of a figure's words."""
    parts = [pages.select("doc_id", F.lit(name).alias("item"), F.explode(F.regexp_extract_all("text", F.lit(f"(?:{words})\\s*[：:]?\\s*(\\d[\\d,]*(?:[.]\\d+)?)"), F.lit(1))).alias("v")) for name, words in figures.items()]
    return reduce(DataFrame.unionByName, parts).select("doc_id", "item", F.regexp_replace("v", ",", "").cast("double").alias("value"))


def carried(values: DataFrame, texts: DataFrame, words: str) -> DataFrame:
    """Documents whose expenditure exceeds the grant by what carry-overs fell, with a sentence that says so and
    whether the prose has one already. values: doc_id, spent, grant, opening, closing."""
    gap, moved = F.col("spent") - F.col("grant"), F.col("opening") - F.col("closing")
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    said = F.concat(F.lit("支出决算合计与财政拨款支出合计相差"), money(gap), F.lit("万元，即年初结转"), money(F.col("opening")), F.lit("万元与年末结转"), money(F.col("closing")), F.lit("万元之差。"))
    met = values.where(close(gap, moved)).join(texts.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(words)).alias("explained")), "doc_id")
    return met.select("doc_id", said.alias("explanation"), "explained")


def spread(values: DataFrame, points: float) -> DataFrame:
    """A figure given by several sources that differ."""
    g = values.groupBy("doc_id", "item").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= 2).where(F.col("hi") - F.col("lo") > points)


def order_breaks(toc: DataFrame, body: DataFrame, reach: int = 3) -> DataFrame:
    """Titles whose page is off by more than `reach`, or that come before their predecessor's page."""
    met = toc.join(body, ["doc_id", "title"])
    before = F.lag("page_no").over(Window.partitionBy("doc_id").orderBy("line"))
    met = met.withColumn("back", F.coalesce(F.col("page_no") < before, F.lit(False)))
    return met.where((F.abs(F.col("page_no") - F.col("toc_page")) > reach) | F.col("back"))


def repeated_titles(titles: DataFrame, reach: int = 4) -> DataFrame:
    """The same title again within so many pages."""
    before = F.lag("page_no").over(Window.partitionBy("doc_id", "title").orderBy("page_no"))
    return titles.withColumn("before", before).where(F.col("page_no") - F.col("before") <= reach)


def dominant_style(samples: DataFrame, least: int = 3) -> DataFrame:
    """Share of each document's most used style, with enough samples."""
    n = samples.groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("doc_id").agg(F.sum("n").alias("samples"), F.max_by("style", F.struct("n", "style")).alias("style"), F.max("n").alias("most"))
    return g.where(F.col("samples") >= least).withColumn("share", F.col("most") / F.col("samples"))


def late(docs: DataFrame, days: int = 20) -> DataFrame:
    """Published more than so many days after approval."""
    return docs.withColumn("days", F.date_diff("published", "approved")).where(F.col("days") > days)


def graded(findings: DataFrame, weights: dict[str, int], start: int = 100) -> DataFrame:
    """Score from weighted findings, and its band."""
    weight = reduce(lambda acc, kv: acc.when(F.col("severity") == kv[0], kv[1]), list(weights.items())[1:], F.when(F.col("severity") == next(iter(weights)), next(iter(weights.values()))))
    g = findings.groupBy("doc_id").agg(F.sum(F.coalesce(weight, F.lit(0))).alias("penalty"))
    score = F.greatest(F.lit(start) - F.col("penalty"), F.lit(0)).cast("long")
    return g.select("doc_id", score.alias("score")).withColumn("grade", band(F.col("score")))


def band(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")
