"""Locating standard tables on pages."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import NINE_TABLES
from ..functions.similarity import mention
from ..functions.text import PUNCTUATION, page_is_front, page_is_table
from ..registry import written

# Least partial ratio of a page with a table's name and with an alias.
NAME_RATIO, ALIAS_RATIO = 92.0, 95.0
#: Per table: its name and other aliases as pages are compared with them.
FLAT_NAMES = [list(dict.fromkeys(re.sub(PUNCTUATION, "", x) for x in [name, *aliases])) for name, aliases in NINE_TABLES]


MARKS = re.compile(PUNCTUATION)


@lru_cache(maxsize=10_000)
def tables_like(flat: str) -> list[int]:
    """Tables of which a page holds the name or an alias, to the letter or nearly."""
    found = []
    for i, names in enumerate(FLAT_NAMES if flat else []):
        if any(n in flat for n in names) or any(mention(flat, n, ALIAS_RATIO if j else NAME_RATIO) for j, n in enumerate(names)):
            found.append(i)
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _near_tables(text: pd.Series) -> pd.Series:
    codes, texts = pd.factorize(text)
    found = [tables_like(MARKS.sub("", t)) for t in texts]
    return pd.Series([found[c] for c in codes.tolist()], dtype=object)


#: Called nondeterministic so that no filter on the result has every page compared a second time.
near_tables = _near_tables.asNondeterministic()


def page_tables(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, ords): the tables whose name or alias a table page's text holds without its punctuation, or nearly does. The
    fixed nine tables are compared inside the page's task, without a join; works on streams too."""
    on = ~page_is_front("text") & page_is_table("text")
    return pages.select("doc_id", "page_no", near_tables(F.when(on, F.col("text")).otherwise("")).alias("ords"))


def named(hits: DataFrame) -> DataFrame:
    """(doc_id, table_name, ord, page_no) of hits (doc_id, page_no, ords)."""
    return with_names(hits.select("doc_id", "page_no", F.explode("ords").alias("ord")))


def anchors(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(doc_id, table_name, ord, page_no) for table pages that hold a table's name or alias (or those of one of the
    tables named), or nearly do."""
    return with_names(_hits(pages, names).distinct())


def _hits(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(doc_id, page_no, ord) of table pages, of all tables or of those named; repeated pages repeated."""
    wanted = [i for i, (n, _) in enumerate(NINE_TABLES) if names is None or n in names]
    on = pages.where(~page_is_front("text") & page_is_table("text"))
    ords = on.select("doc_id", "page_no", near_tables("text").alias("ords"))
    hits = ords.select("doc_id", "page_no", F.explode("ords").alias("ord"))
    return hits if names is None else hits.where(F.col("ord").isin(wanted))


def with_names(hits: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in NINE_TABLES])
    return hits.select("doc_id", names[F.col("ord")].alias("table_name"), "ord", "page_no")


def first_anchors(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(doc_id, table_name, ord, page_no): the first page of each table (or of those named) of a document, by one
    grouping."""
    return with_names(_hits(pages, names).groupBy("doc_id", "ord").agg(F.min("page_no").alias("page_no")))


#: Rows of a range in which texts follow one another.
RANGE_ROWS = 50_000


def with_next_head(texts: DataFrame, group: str, order: str, lines: int = 3) -> DataFrame:
    """Texts with `searched`, the text and the first lines of the next one of its group. Only heads are ordered:
    ranges of rows, a window inside each, and the first head of a group's next range for its last row, so that no
    group is one task. `order` tells the texts of the table apart."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n")
    slim = texts.select(group, order, head.alias("head"))
    parts = max(1, -(-slim.count() // RANGE_ROWS))
    placed = written(slim.repartitionByRange(parts, group, order).withColumn("part", F.spark_partition_id()))
    near = F.lead("head").over(Window.partitionBy("part", group).orderBy(order))
    first = placed.groupBy(group, "part").agg(F.min_by("head", order).alias("first"))
    later = first.select(F.col(group).alias("g"), F.col("part").alias("p"), F.lead("first").over(Window.partitionBy(group).orderBy("part")).alias("follows"))
    met = placed.withColumn("near", near).join(later, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    heads = met.select(F.col(order).alias("o"), F.coalesce("near", "follows").alias("next_head"))
    joined = texts.join(heads, F.col(order) == F.col("o")).drop("o")
    return joined.withColumn("searched", F.concat(F.col("text"), F.coalesce(F.concat(F.lit("\n"), F.col("next_head")), F.lit("")))).drop("next_head")


def first_pages(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "table_name", "ord").agg(F.min("page_no").alias("page_no"), F.count(F.lit(1)).alias("n_pages"))


def missing_tables(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Standard tables without an anchor, for every document (nine candidates each)."""
    names = F.array(*[F.struct(F.lit(n).alias("table_name"), F.lit(i).alias("ord")) for i, (n, _) in enumerate(NINE_TABLES)])
    wanted = docs.select("doc_id", F.explode(names).alias("t")).select("doc_id", "t.table_name", "t.ord")
    return wanted.join(found.select("doc_id", "table_name").distinct(), ["doc_id", "table_name"], "left_anti")


def nine_tables(docs: DataFrame, found: DataFrame) -> DataFrame:
    """V002: (doc_id, message, severity) for documents (doc_id, n_pages) with anchors found: missing, repeated and
    displaced tables."""
    missing = missing_tables(docs, found).join(docs, "doc_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    severity = F.when(F.col("n_pages") < 8, "info").when(F.col("n") <= 2, "warn").otherwise("error")
    a = missing.select("doc_id", F.concat(F.lit("缺失表："), "table_name").alias("message"), severity.alias("severity"))
    b = first_pages(found).where("n_pages > 1").select("doc_id", F.concat(F.lit("表出现多次："), "table_name").alias("message"), F.lit("warn").alias("severity"))
    c = out_of_order(found).select("doc_id", F.lit("顺序异常").alias("message"), F.lit("warn").alias("severity"))
    return a.unionByName(b).unionByName(c)


def out_of_order(found: DataFrame) -> DataFrame:
    """Documents with three tables or more whose first pages break the expected order."""
    by_page = Window.partitionBy("doc_id").orderBy("page_no", "ord")
    f = first_pages(found).withColumn("before", F.lag("ord").over(by_page))
    g = f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tables"), F.bool_or(F.coalesce(F.col("ord") < F.col("before"), F.lit(False))).alias("broken"))
    return g.where("n_tables >= 3 and broken").select("doc_id", "n_tables")
