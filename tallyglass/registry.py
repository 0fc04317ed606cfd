"""All registered queries with their oracle SQL, and the rule registry of user extensions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name of the operator inventory."""

    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; only on one machine is there another one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (folder or "file:///tmp/spark-exports").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: what follows starts from a table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyglass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class RuleBook:
    """Named rules f(tables) -> findings. A rule that cannot be planned, or whose columns differ,
    becomes one finding of severity hint and leaves the others alone. Schemas are checked on the plan."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.rules: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}

    def rule(self, code: str):
        def keep(f):
            self.rules[code] = f
            return f

        return keep

    def run(self, spark: SparkSession, tables: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
        from functools import reduce

        from pyspark.errors import PySparkException

        parts, failed = [], []
        for code, f in self.rules.items():
            if only is not None and code not in only:
                continue
            try:
                found = f(tables)
                if missing := set(self.columns) - set(found.columns) - {"rule_id"}:
                    raise ValueError(f"missing columns {sorted(missing)}")
                from pyspark.sql import functions as F

                parts.append(found.withColumn("rule_id", F.lit(code)).select(*self.columns))
            except (PySparkException, ValueError, KeyError) as e:
                failed.append((code, type(e).__name__))
        if failed:
            rows = spark.createDataFrame(failed, "rule_id string, message string")
            from pyspark.sql import functions as F

            known = {"rule_id": F.col("rule_id"), "severity": F.lit("hint"), "message": F.col("message")}
            like = parts[0].schema if parts else None
            cols = [known.get(c, F.lit(None)).cast(like[c].dataType if like else "string").alias(c) for c in self.columns]
            parts.append(rows.select(*cols))
        return reduce(lambda a, b: a.unionByName(b), parts)
