"""Retrieval by vectors: cosine in JVM expressions, top k, scores of owners, fusion of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def similarities(queries: DataFrame, catalogue: DataFrame, rows: int = 100_000) -> DataFrame:
    """Every query (query_id, q) with every item of a catalogue (v) of bounded size, whose count is checked before it is broadcast."""
    n = catalogue.limit(rows + 1).count()
    if n > rows:
        raise ValueError(f"a catalogue of over {rows} vectors needs an index, not a scan")
    return queries.crossJoin(F.broadcast(catalogue)).withColumn("score", cosine(F.col("q"), F.col("v"))).drop("q", "v")


def nearest(scored: DataFrame, keys: list, k: int, item: str) -> DataFrame:
    return top_k(scored, keys, k, F.col("score").desc(), F.col(item))


def owner_scores(scored: DataFrame, query: str, owner: str, item: str) -> DataFrame:
    """Per query and owner: the best item, floored at 0, and the mean over items of their best windows."""
    best = scored.groupBy(query, owner, item).agg(F.max("score").alias("best"))
    return best.groupBy(query, owner).agg(F.greatest(F.max("best"), F.lit(0.0)).alias("title"), F.avg("best").alias("tasks"))


def mixed_score(title: Column, technology: Column, definition: Column, tasks: Column) -> Column:
    """0.70 title, 0.15 technology, 0.15 the mean of definition and tasks."""
    return 0.70 * title + 0.15 * technology + 0.15 * (definition + tasks) / 2


def soft_maximum(scored: DataFrame, keys: list, bonus: float = 0.10, temperature: float = 0.05) -> DataFrame:
    """Best score a key plus a bonus for others near it: max + bonus * ln(sum(exp((s - max) / temperature)))."""
    top = scored.groupBy(*keys).agg(F.max("score").alias("most"))
    spread = scored.join(top, keys).groupBy(*keys, "most").agg(F.sum(F.exp((F.col("score") - F.col("most")) / temperature)).alias("s"))
    return spread.select(*keys, (F.col("most") + bonus * F.log("s")).alias("score"))
