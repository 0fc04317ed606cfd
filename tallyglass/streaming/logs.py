"""Structured Streaming: windowed log overview and row-level rules on arriving pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import shared_folder


def overview(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and total duration of each stage and event-time window, with a watermark for late entries."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage")
    sums = w.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"))
    return sums.select(F.col("w.start").alias("start"), "stage", "n", "total_ms")


def repeated_words(pages: DataFrame) -> DataFrame:
    """A row-level rule on arriving pages: immediately repeated words of two Chinese characters or more."""
    found = F.regexp_extract_all("text", F.lit("([一-龥]{2,})\\1"), F.lit(0))
    return pages.select("doc_id", "page_no", F.explode(found).alias("found"))


def drained(out: DataFrame, mode: str) -> DataFrame:
    """Run a stream over everything that is there and return what its sink holds, as a table in the shared folder."""
    spark: SparkSession = out.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    writer = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(out.schema.add("epoch", "long")).parquet(f"{at}/out")
