"""Streaming queries (X1, X2): tables read as file streams and drained."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..registry import query, shared_folder
from ..sources import corpus as C
from ..streaming.arrivals import held, row_findings, run
from ..streaming.logs import drained, overview
from .rules import V002_SQL


def _stream(spark, sf, name):
    """A table as a file stream. The path is a glob, which Spark's source takes for files and folders alike."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


@query("x1_log_windows", """WITH d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS stage, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_ms FROM events GROUP BY ALL)
SELECT * FROM d WHERE start + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events)""")
def x1(spark, sf):
    """Append mode: a window comes out once, when the watermark (an hour behind the last entry) has passed it,
    and its state goes; windows still open wait for the next run."""
    logs = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(18,2)").alias("duration_ms"))
    return drained(overview(logs), "append").select("start", "stage", "n", F.col("total_ms").cast("double").alias("total_ms"))


LATE = "(k + 2 * i) % 41 = 0"
EARLY_SQL = V002_SQL.replace("WHERE (k + i) % 17 <> 0)", f"WHERE (k + i) % 17 <> 0 AND NOT ({LATE}))")
X2_SQL = f"""WITH final AS ({V002_SQL}), early AS ({EARLY_SQL})
SELECT doc_id, message, 'open' AS state FROM final
UNION ALL SELECT doc_id, message, 'withdrawn' FROM early e WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.doc_id = e.doc_id AND f.message = e.message)
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN '负数' ELSE '百分比越界' END, 'row' FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND (o_orderkey % 31 = 0 OR o_orderkey % 37 = 0)"""


@query("x2_arriving_pages", X2_SQL)
def x2(spark, sf):
    """Pages arrive in two runs, some tables' pages only in the second: row rules once for every page, the nine tables
    judged again for documents that get pages, which withdraws what they no longer lack."""
    d = C.disclosures(spark, sf)
    k = F.col("doc_id")
    odd = F.when(k % 31 == 0, "-5.00").when(k % 37 == 0, "120%").otherwise("7.00")
    tables = F.when(F.col("page_no") == 1, F.array(F.array(F.array(F.lit("项目"), F.lit("金额")), F.array(F.lit("合计"), odd))))
    late = reduce(lambda a, b: a | b, [(F.col("page_no") == F.when(k % 19 == 0, 3 + {2: 3, 3: 2}.get(i, i)).otherwise(3 + i)) & ((k + 2 * i) % 41 == 0) for i in range(9)])
    pages = C.disclosure_pages(d).withColumns({"tables": tables, "late": late})
    at = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    for turn in (False, True):
        pages.where(F.col("late") == turn).drop("late").write.mode("append").parquet(f"{at}/in")
        run(spark.readStream.schema(pages.drop("late").schema).parquet(f"{at}/in"), at)
    rows = row_findings(spark, at).select("doc_id", "message", F.lit("row").alias("state"))
    return held(spark, at).unionByName(rows)
