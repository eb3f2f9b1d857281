"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path in that of spark.checkpoint.dir. Only where that is unset and Spark is local a temporary folder serves."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/rowloom-step-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir and read back, so that lost executors cost one step."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Rows appended step by step to n buckets by keys, in the folder of spark.checkpoint.dir; joins on the keys read them without a shuffle.

    What is appended should be dealt by repartition(n, *keys), which gives each bucket one file a step.
    """

    def __init__(self, spark: SparkSession, n: int, keys: list[str], step: str | None = None):
        self.spark, self.n, self.keys, self.step = spark, n, keys, step
        self.path = folder(spark)
        self.name = f"rowloom_{self.path.rsplit('-', 1)[1]}"
        self.schema = None

    def append(self, df: DataFrame) -> None:
        self.schema = df.schema
        writer = df.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.n, *self.keys)
        (writer.partitionBy(self.step) if self.step else writer).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        """All rows, read by path: the table's name is given up."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)
