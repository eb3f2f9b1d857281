"""One query per operator: its whole table, its production parameters, the digest columns of its results."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, language, line_rules, minhash, mixing, oracles, passages, pii, quality, repeats, runs, token_files, vectors
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {"op1_vectors": oracles.OP1, "op5_minhash": oracles.OP5, "op7_line_rules": oracles.OP7, "op11_passages": oracles.OP11}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.joined_spans(F.col("base")), 256).alias("base_sha256"),
        pii.joined_spans(F.col("all_spans")).alias("spans"),
    )


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"))


@_query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_files.read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of one document in ten made periodic from some place on, by its id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[: a + p] + words[a : a + p] * ((n - a) // p))[:n]


@_query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(table(spark, sf_dir, "documents"), _planted)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.col("longest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(top[c].alias(c) for c in ("start", "length", "period")),
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")
