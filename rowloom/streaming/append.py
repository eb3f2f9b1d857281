"""Incremental, idempotent appends: a batch skips what is stored, and a stream does the same micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import offer_id
from ..operators.relational import first_by
from ..sources.records import OFFER_SCHEMA


def finished(stored: DataFrame) -> DataFrame:
    """Ids of stored rows; refused ones, which carry no id, by their URL."""
    key = F.coalesce(F.nullif(F.col("job_id"), F.lit("")), offer_id(F.col("url")))
    return stored.select(key.alias("job_id")).where(F.col("job_id").isNotNull()).distinct()


def unseen(raw: DataFrame, stored: DataFrame | None, order: list) -> DataFrame:
    """Rows of raw whose id is not stored, the first of each id; rows without an id always stay."""
    named = first_by(raw.where("job_id is not null and job_id <> ''"), ["job_id"], *order)
    if stored is not None:
        named = named.join(finished(stored), "job_id", "left_anti")
    return named.select(*raw.columns).unionByName(raw.where("job_id is null or job_id = ''"))


def append(raw: DataFrame, path: str, normalise, order: list) -> int:
    """Normalise and append what path lacks. A second run appends nothing."""
    spark = raw.sparkSession
    try:
        stored = spark.read.schema("job_id string, url string").json(path)
    except Exception as problem:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        stored = None
    fresh = normalise(unseen(raw, stored, order)).cache()
    added = fresh.count()
    if added:
        fresh.write.mode("append").option("ignoreNullFields", True).json(path)
    fresh.unpersist()
    return added


def stream(spark: SparkSession, folder: str, out: str, checkpoint: str, normalise):
    """Files of raw records that arrive in folder, normalised and appended once by id."""
    raw = spark.readStream.schema(OFFER_SCHEMA).json(folder)
    writer = raw.writeStream.foreachBatch(lambda batch, _n: append(batch, out, normalise, [F.col("url")]))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: sessions of users over a stream or a table of events (user_id, ts, event_type)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", late) if events.isStreaming else stamped
    grouped = stamped.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("session_start"), F.col("session.end").cast("timestamp_ntz").alias("session_end"), "n_events")
