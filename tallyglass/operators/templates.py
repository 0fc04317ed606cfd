"""Templates of whole books: detection by scores, alignment with what a template requires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import Template

# Weights of the seven terms, how far a cover reaches, the confidence formula and its limits.
ANCHOR, NAME, COVER, ATTACHMENT, CONFLICT, WEAK, FEW_ANCHORS = 2, 1, 8, 3, -3, 1, -1
COVER_CHARS = 4000
LEAST_CONFIDENCE, LEAST_MARGIN = 0.6, 3


def scores(books: DataFrame, templates: list[Template]) -> DataFrame:
    """(doc_id, ord, key, score) of every book (doc_id, text) and template. Templates are a fixed handful, so
    their conditions are columns of the book's row and nothing is joined."""
    flat = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
    b = books.select("doc_id", flat("text").alias("text"), flat(F.substring("text", 1, COVER_CHARS)).alias("cover"))
    marks = {"final": "决算", "dept": "部门", "unit": "单位", "a22": "附件2-2", "a2": "附件2："}
    b = b.select("doc_id", "text", *[F.col("cover").contains(v).alias(k) for k, v in marks.items()])

    def score(t: Template) -> Column:
        hits = lambda names: reduce(lambda x, y: x + y, [F.col("text").contains(n).cast("int") for n in names], F.lit(0))
        points = lambda condition, n: F.when(condition, n).otherwise(0)
        anchors = hits([a for a in t.anchors if a])
        boost = points(F.lit("部门" in t.name) & F.col("dept") & F.col("final"), COVER) + points(F.lit("单位" in t.name) & F.col("unit") & F.col("final"), COVER)
        boost = boost + points(F.lit("附件2-2" in t.name) & F.col("a22"), ATTACHMENT)
        boost = boost + points(F.lit("附件2" in t.name.replace("附件2-2", "")) & F.col("a2") & ~F.col("a22"), ATTACHMENT)
        conflict = points(F.col("dept") & F.col("unit") & F.col("final"), CONFLICT)
        weak = points(~F.col("dept") & ~F.col("unit") & F.col("final"), WEAK)
        return anchors * ANCHOR + hits([t.name, *t.aliases]) * NAME + boost + conflict + weak + points((boost == 0) & (anchors == 1), FEW_ANCHORS)

    every = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t.key).alias("key"), score(t).alias("score")) for i, t in enumerate(templates)])
    return b.select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.*")


def ranked(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord")
    return scored.withColumns({"place": F.row_number().over(w), "next": F.lead("score").over(w)})


def detected(scored: DataFrame) -> DataFrame:
    """M005 and W12: the best template with its margin, confidence, and whether someone must look."""
    top = ranked(scored).where("place = 1").withColumn("margin", F.col("score") - F.col("next"))
    raw = 0.5 + 0.1 * F.col("margin") + 0.02 * F.col("score")
    top = top.withColumn("confidence", F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(0.99)), 6))
    return top.withColumn("manual", (F.col("confidence") < LEAST_CONFIDENCE) | (F.col("margin") < LEAST_MARGIN))


def alignment(books: DataFrame, required: list[tuple[bool, str, list[str]]]) -> DataFrame:
    """How many of the tables and titles that the book's template requires its text holds; the template is the
    department's where the file name says so, else the unit's."""
    dept = F.col("file_name").contains("部门")
    hit = lambda names: reduce(lambda x, y: x | y, [F.col("text").contains(n) for n in names])

    def count(kind: str, hits: bool) -> Column:
        return reduce(lambda x, y: x + y, [F.when((dept == d) & (hit(names) if hits else F.lit(True)), 1).otherwise(0) for d, k, names in required if k == kind]).cast("long")

    return books.select("doc_id", count("table", False).alias("n_tables"), count("table", True).alias("tables_hit"), count("title", False).alias("n_titles"), count("title", True).alias("titles_hit"))


def card() -> Column:
    """M006: an alignment as the lines of a report."""
    share = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
    return F.concat(F.lit("# 模板对齐报告\n表: "), share("tables_hit", "n_tables"), F.lit("\n章节: "), share("titles_hit", "n_titles"))
