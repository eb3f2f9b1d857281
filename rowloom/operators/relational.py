"""Relational building blocks: resolution walks, precedence unions, keyed dedupe, upserts, checks, interval unions, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list, *order: Column) -> DataFrame:
    """One row a key: the first in an order that must be total."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("first_by__", n).where("first_by__ = 1").drop("first_by__")


def top_k(df: DataFrame, keys: list, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows a key with their rank. Catalyst turns the filter into a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_with_ties(df: DataFrame, keys: list, priority: str) -> DataFrame:
    """All rows of the highest priority of their key."""
    return df.withColumn("best__", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(priority).desc()))).where("best__ = 1").drop("best__")


def unambiguous(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Sources with exactly one edge, and its target."""
    return edges.groupBy(source).agg(F.count(F.lit(1)).alias("n__"), F.min(target).alias(target)).where("n__ = 1").drop("n__")


def resolve(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str, depth: int = 8) -> DataFrame:
    """Where each node's unambiguous edges end, after at most `depth` steps: node, resolved. Members of a cycle have no row.

    Each step doubles the length of the paths that stand for one edge, so depth 8 takes three joins.
    """
    step = unambiguous(edges, source, target).select(F.col(source).alias("from__"), F.col(target).alias("to__"))
    walk = nodes.select(F.col(node), F.col(node).alias("resolved")).join(step, F.col(node) == F.col("from__"), "left")
    walk = walk.select(node, F.coalesce("to__", "resolved").alias("resolved"))
    length = 1
    while length < depth:
        onward = walk.select(F.col(node).alias("from__"), F.col("resolved").alias("to__"))
        walk = walk.join(onward, F.col("resolved") == F.col("from__"), "left").select(node, F.coalesce("to__", "resolved").alias("resolved"))
        length *= 2
    return walk.join(step.select(F.col("from__").alias("resolved")), "resolved", "left_anti").select(node, "resolved")


def prefer(first: DataFrame, second: DataFrame, keys: list) -> DataFrame:
    """Rows of first, and of second where first has none of their key."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list) -> DataFrame:
    """new replaces old by key."""
    return prefer(new, old, keys)


def append_new(old: DataFrame, new: DataFrame, keys: list) -> DataFrame:
    """old, and rows of new whose key it lacks."""
    return prefer(old, new, keys)


def broken_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose reference is not null and points to no row."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def repeated_keys(df: DataFrame, keys: list) -> DataFrame:
    """Keys of more than one row, or with a null in them, and their number of rows."""
    null = F.lit(False)
    for key in keys:
        null = null | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | null)


def islands(df: DataFrame, keys: list, start: str, end: str, adjacent: int = 0) -> DataFrame:
    """Union of intervals: keys, start and end of each island. Intervals that are `adjacent` apart or nearer are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + adjacent), 1).otherwise(0)
    marked = df.withColumn("opens__", opens).withColumn("island__", F.sum("opens__").over(order))
    return marked.groupBy(*keys, "island__").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island__")


def margin_choice(df: DataFrame, keys: list, name: str, score: str, threshold: float, margin: float) -> DataFrame:
    """The best row a key if its score reaches the threshold and leads the second by the margin; ties by name."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(name))
    ranked = df.withColumn("rank__", F.row_number().over(order)).withColumn("lead__", F.col(score) - F.coalesce(F.lead(score).over(order), F.lit(0.0)))
    return ranked.where((F.col("rank__") == 1) & (F.col(score) >= threshold) & (F.col("lead__") >= margin)).drop("rank__").withColumnRenamed("lead__", "margin")


def idf(n: Column, df: Column) -> Column:
    return 1 + F.log((1 + n) / (1 + df))


def clamp(score: Column) -> Column:
    """To [0, 1]; not a number: 0."""
    number = score.try_cast("double") if hasattr(score, "try_cast") else score.cast("double")
    return F.when(F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))))
