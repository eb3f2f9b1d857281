"""Occupation paths: candidates of several sources checked against a hierarchy, merged by leaf, pruned of what a more specific leaf covers, and cut to a few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top_k

# The leaf that wins and those that it covers.
COVERS = {
    "FULLSTACK_DEVELOPER": ["FRONTEND_DEVELOPER", "BACKEND_DEVELOPER"], "DEVSECOPS_ENGINEER": ["DEVOPS_ENGINEER"], "SITE_RELIABILITY_ENGINEER": ["DEVOPS_ENGINEER"],
    "SAP_DEVELOPER": ["SOFTWARE_ENGINEER", "SOFTWARE_DEVELOPER"], "SAP_FUNCTIONAL_CONSULTANT": ["FUNCTIONAL_CONSULTANT"], "NETWORK_SECURITY_ENGINEER": ["NETWORK_ENGINEER"],
    "DATABASE_ADMINISTRATOR": ["DATABASE_ENGINEER"],
}
#: Paths of one posting at most.
MOST = 5


def covers(spark) -> DataFrame:
    """winner, loser."""
    return spark.createDataFrame([(w, x) for w, losers in COVERS.items() for x in losers], "winner string, loser string")


def on_hierarchy(candidates: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """candidates (key, source, leaf, family, parent, score, forced) whose leaf is in hierarchy (leaf, family, parent) and contradicts none of it.

    A null or empty family or parent contradicts nothing and is filled in. A candidate without a score counts only if it is forced.
    """
    own = hierarchy.select(F.col("leaf").alias("own leaf"), F.col("family").alias("own family"), F.col("parent").alias("own parent")).dropDuplicates(["own leaf"])
    fits = lambda c: (F.coalesce(F.col(c), F.lit("")) == "") | (F.col(c) == F.col(f"own {c}"))
    scored = (F.coalesce(F.col("score"), F.lit(0.0)) != 0) | F.coalesce(F.col("forced"), F.lit(False))
    found = candidates.join(own, F.col("leaf") == F.col("own leaf")).where(fits("family") & fits("parent") & scored)
    return found.withColumn("family", F.col("own family")).withColumn("parent", F.col("own parent")).drop("own leaf", "own family", "own parent")


def merged(candidates: DataFrame) -> DataFrame:
    """One row a key and leaf: family, parent, the best score, the sources in order of their names, and whether any was forced."""
    return candidates.groupBy("key", "leaf", "family", "parent").agg(
        F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"), F.max(F.coalesce("forced", F.lit(False))).alias("forced")
    )


def without_covered(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths without the leaves that another leaf of the same key covers. rules (winner, loser) may be any number; a loser may be a winner, too."""
    lost = paths.select("key", "leaf").join(rules, F.col("leaf") == F.col("winner")).select(F.col("key").alias("own key"), F.col("loser")).distinct()
    return paths.join(lost, F.col("key").eqNullSafe(F.col("own key")) & (F.col("leaf") == F.col("loser")), "left_anti")


def selected(candidates: DataFrame, hierarchy: DataFrame, rules: DataFrame, most: int = MOST) -> DataFrame:
    """key, leaf, family, parent, score, sources, forced and rank (1: the primary path) of the best `most` paths of each key.

    Forced paths come first, then higher scores, then more sources, then the leaf's name. Null keys are one key.
    """
    paths = without_covered(merged(on_hierarchy(candidates, hierarchy)), rules)
    return top_k(paths, ["key"], most, F.desc("forced"), F.desc("score"), F.desc(F.size("sources")), F.col("leaf"))
