"""Evidence: grouping of nearby hits, pagination, spans inside rectangles, text search in spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy

PAGE = ["doc_id", "page_no"]


def grouped(hits: DataFrame, distance: float = 100.0) -> DataFrame:
    """Hits of a page in reading order; a gap beyond the distance opens a new group."""
    w = Window.partitionBy(*PAGE).orderBy("y1", "x1", "hit")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    h = hits.withColumns({"cx": cx, "cy": cy})
    dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
    opens = F.when(F.coalesce(F.sqrt(dx * dx + dy * dy) <= distance, F.lit(False)), 0).otherwise(1)
    return h.withColumn("opens", opens).withColumn("grp", F.sum("opens").over(w)).drop("opens", "cx", "cy")


def summarised(g: DataFrame) -> DataFrame:
    """Text, bounding box and size of each group."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "hit", "text"))), lambda x: x["text"]), " ... ")
    return g.groupBy(*PAGE, "grp").agg(texts.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_hits"))


def paginated(groups: DataFrame, size: int = 10) -> DataFrame:
    """Groups of a document, so many to a screen."""
    w = Window.partitionBy("doc_id")
    place = F.row_number().over(w.orderBy("page_no", "grp"))
    return groups.withColumns({"screen": F.ceil(place / size).cast("int"), "n_screens": F.ceil(F.count(F.lit(1)).over(w) / size).cast("int")})


def inside(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text of the spans fully inside each rectangle, in order."""
    b = boxes.select(*PAGE, "box", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    met = spans.join(b, PAGE).where("x0 >= bx0 and y0 >= by0 and x1 <= bx1 and y1 <= by1")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ix", "text"))), lambda x: x["text"]), " ")
    return met.groupBy(*PAGE, "box").agg(texts.alias("text"))


def find_text(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """Spans that contain a text; where a text has none, spans longer than 3 with ratio over 80."""
    p = spans.join(wanted, "doc_id")
    direct = p.where(F.expr("contains(text, target)")).select("doc_id", "target", "span_ix", F.lit(100.0).alias("score"))
    rest = p.join(direct.select("doc_id", "target").distinct(), ["doc_id", "target"], "left_anti").where(F.length("text") > 3)
    near = rest.withColumn("score", fuzzy("text", "target")["ratio"]).where("score > 80").select("doc_id", "target", "span_ix", "score")
    return direct.unionByName(near)
