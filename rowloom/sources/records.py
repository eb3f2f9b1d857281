"""Readers and writers of record files: JSON lines, CSV, registries of files, snapshots of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a raw offer, all text, all nullable.
OFFER_FIELDS = ["job_id", "url", "title", "company", "company_logo", "country", "date_posted", "deadline", "education", "teleworking", "contract", "experience", "description"]
OFFER_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in OFFER_FIELDS])


def offers(spark: SparkSession, path: str) -> DataFrame:
    """Raw offers, one JSON object a line, blank lines skipped; the schema is given, never inferred."""
    return spark.read.schema(OFFER_SCHEMA).json(path)


def records(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False) -> DataFrame:
    """JSON lines, or with whole one JSON array or object a file."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all text; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(name.lstrip("﻿").strip() for name in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def file_registry(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and SHA-256 of each file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def canonical(df: DataFrame) -> DataFrame:
    """Each row as JSON of its columns in the order of their names."""
    return df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("row"))


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and a hash of a table that does not depend on the order of its rows; repeated rows count."""
    hashed = canonical(df).select(F.xxhash64("row").alias("h"), F.crc32("row").alias("c"))
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("row_xor"), F.coalesce(F.sum("c"), F.lit(0)).alias("row_sum"))


def export_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """All tables as gzipped JSON lines (table, row), and the fingerprint of each."""
    parts = [canonical(df).select(F.lit(name).alias("table"), "row") for name, df in tables.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole.write.mode("overwrite").option("compression", "gzip").partitionBy("table").json(path)
    prints = [fingerprint(df).select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    out = prints[0]
    for part in prints[1:]:
        out = out.unionByName(part)
    return out


def rebuild_snapshot(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Tables of a snapshot by name; the partition folders mean that each reads its own rows only."""
    stored = spark.read.schema("row string, table string").json(path)
    return {name: stored.where(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*") for name, schema in schemas.items()}
