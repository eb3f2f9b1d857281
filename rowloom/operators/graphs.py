"""Closures of graphs in which a node may have many parents, cycles included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import Buckets, kept

#: Edges whose pairs share a bucket of a closure.
EDGES = 50_000


def _steps(edges: DataFrame, child: str, parent: str) -> DataFrame:
    rows = edges.select(F.col(child).alias("low"), F.col(parent).alias("high"))
    return kept(rows.where("low is not null and high is not null").distinct())


def reachable(edges: DataFrame, child: str, parent: str, seeds: DataFrame, node: str) -> DataFrame:
    """Distinct nodes that edges lead to from the seeds, in any number of steps, seeds included: column node, and steps, the least number.

    Semi-naive: a round joins only the nodes that the last one found. Null nodes and edges with a null end are left out; cycles end,
    as no node is found twice; no seeds give no rows. There are as many rounds as the longest of the shortest paths.
    """
    step = _steps(edges, child, parent)
    known = kept(seeds.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("steps", F.lit(0)))
    last = known
    while last.limit(1).count():
        onward = last.join(step, F.col("node") == F.col("low")).select(F.col("high").alias("node"), F.col("steps") + 1).toDF("node", "steps").distinct()
        last = kept(onward.join(known, "node", "left_anti"))
        known = kept(known.unionByName(last)) if last.limit(1).count() else known
    return known.select(F.col("node").alias(node), "steps")


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """child, parent, steps: every node with each of its ancestors and the least number of steps to it; a node of a cycle is its own ancestor.

    Semi-naive by pairs: a round extends only the pairs that the last one found. A round's pairs are written once, in buckets, and
    pairs found anew are dealt to the same buckets, so that what earlier rounds found is neither shuffled nor written again. Edges
    that repeat count once, those with a null end not at all; an empty table gives no rows. The result has a row for each pair,
    which is what is asked for.
    """
    step = _steps(edges, child, parent)
    spark = step.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-step.count() // EDGES))
    known, above = Buckets(spark, n, ["low", "high"], "steps"), Buckets(spark, n, ["low"])
    above.append(step.repartition(n, "low"))
    known.append(step.repartition(n, "low", "high").withColumn("steps", F.lit(1)))
    steps = 1
    while known.rows().where(F.col("steps") == steps).limit(1).count():
        last = known.rows().where(F.col("steps") == steps).select("low", F.col("high").alias("via")).repartition(n, "via")
        onward = last.join(above.rows().withColumnRenamed("low", "via"), "via").select("low", "high").repartition(n, "low", "high").distinct()
        steps += 1
        known.append(onward.join(known.rows(), ["low", "high"], "left_anti").withColumn("steps", F.lit(steps)))
    above.closed()
    return known.closed().select(F.col("low").alias(child), F.col("high").alias(parent), "steps")
