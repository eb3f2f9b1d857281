"""Shared pieces: where intermediate tables go, and how inputs are narrowed to the columns an operator needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast. Every broadcast below checks its count against this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a temporary one only if that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/rowloom-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame) -> DataFrame:
    """Id and text only: other columns, whatever their names, are left behind."""
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, whose rows must be of a fixed size, with a broadcast hint if a count shows that it has at most so many; otherwise df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
