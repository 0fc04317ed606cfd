"""Rules on pages as they arrive. Row rules run on every page once; document rules run again for every document
that has got pages, and what they said of it before no longer holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_percent, parse_cell
from ..operators.anchors import named, nine_tables, page_tables
from ..sources.corpus import cells


def cell_faults(pages: DataFrame) -> DataFrame:
    """V004 on arriving nested tables: percentages outside 0 to 100 and negative numbers, cell by cell."""
    c = cells(pages).withColumn("value", parse_cell("text"))
    off = F.when(is_percent("text") & ~F.col("value").between(0, 100), "百分比越界").when(~is_percent("text") & (F.col("value") < 0), "负数")
    return c.withColumn("message", off).where("message is not null").select("doc_id", "page_no", "row_ix", "col_ix", "message")


def document_state(pages: DataFrame) -> DataFrame:
    """The streaming aggregate that keeps, for every document, its pages and the tables on them. Run in update mode,
    a batch gives the whole state of the documents it touched, and of no other."""
    return page_tables(pages).groupBy("doc_id").agg(F.collect_set(F.struct("page_no", "ords")).alias("facts"))


def judge(batch: DataFrame, epoch: int, at: str) -> None:
    """V002 for the documents of a batch of states. Findings are kept by epoch, with one row for each judged document
    (message null), so that the last epoch of a document says all that holds for it."""
    batch.write.mode("overwrite").parquet(f"{at}/states/epoch={epoch}")
    states = batch.sparkSession.read.schema(batch.schema).parquet(f"{at}/states/epoch={epoch}")
    facts = states.select("doc_id", F.explode("facts").alias("f")).select("doc_id", "f.page_no", "f.ords")
    docs = facts.groupBy("doc_id").agg(F.countDistinct("page_no").alias("n_pages"))
    found = nine_tables(docs, named(facts).distinct())
    judged = states.select("doc_id", F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("severity"))
    found.unionByName(judged).write.mode("overwrite").parquet(f"{at}/findings/epoch={epoch}")


def run(stream: DataFrame, at: str) -> None:
    """One run of both queries over what has arrived; checkpoints and results stay in the folder for the next run."""
    docs = document_state(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{at}/docs-checkpoint")
    rows = cell_faults(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{at}/rows-checkpoint")
    queries = [
        docs.foreachBatch(lambda batch, epoch: judge(batch, epoch, at)).start(),
        rows.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}")).start(),
    ]
    for q in queries:
        q.awaitTermination()


def held(spark, at: str) -> DataFrame:
    """(doc_id, message, state): findings that hold (open), and earlier ones that a later judgement of the document no
    longer makes (withdrawn)."""
    every = spark.read.schema("doc_id long, message string, severity string, epoch long").parquet(f"{at}/findings")
    last = F.max("epoch").over(Window.partitionBy("doc_id"))
    kept = every.withColumn("last", last).where("message is not null").groupBy("doc_id", "message").agg(F.max(F.col("epoch") == F.col("last")).alias("open"))
    return kept.select("doc_id", "message", F.when(F.col("open"), "open").otherwise("withdrawn").alias("state"))


def row_findings(spark, at: str) -> DataFrame:
    return spark.read.schema("doc_id long, page_no int, row_ix int, col_ix int, message string, epoch long").parquet(f"{at}/rows").drop("epoch")
