"""Occupation candidates and job recommendations: pattern rules, tiers, fusion, paths, a ranker built from its description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_by, top_k


def pattern_candidates(titles: DataFrame, patterns: DataFrame, most: int = 10_000) -> DataFrame:
    """titles (title_id, title) with every pattern (pattern_id, pattern, leaf, parent, priority, position) that they match.

    A theta join on a regular expression: the patterns, whose number is checked, go to every task; the titles stay where they are.
    """
    n = patterns.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} patterns")
    joined = titles.join(F.broadcast(patterns), F.expr("title rlike pattern"))
    return joined.withColumn("matched", F.expr("regexp_extract(title, concat('(', pattern, ')'), 1)"))


def resolved(candidates: DataFrame, key: str, least: int = 70) -> DataFrame:
    """The best candidate a key by priority, length of the match and catalogue position; weak short matches abstain."""
    best = first_by(candidates.where("leaf is not null"), [key], F.col("priority").desc(), F.length("matched").desc(), F.col("position"))
    return best.where((F.col("priority") >= least) | (F.length("matched") >= 4))


def first_tier(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each key's answer from the first tier that has one, with the tier's name; UNKNOWN where none has.

    A tier gets only the keys that those before it left open, so a costly tier runs on few rows. tiers: name and answers (key, answer).
    """
    left, out = rows.select(key), None
    for name, answers in tiers:
        found = left.join(answers, key).select(key, "answer", F.lit(name).alias("method"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(key), key, "left_anti")
    rest = left.select(key, F.lit("UNKNOWN").alias("answer"), F.lit("NONE").alias("method"))
    return rest if out is None else out.unionByName(rest)


def requirement_weight(requirement: Column) -> Column:
    return F.when(requirement == "REQUIRED", 1.0).when(requirement == "PREFERRED", 0.4).otherwise(0.7)


def proficiency_factor(level: Column) -> Column:
    return F.when(level == "BEGINNER", 0.5).when(level == "INTERMEDIATE", 0.75).otherwise(1.0)


def semantic_credit(cosine: Column) -> Column:
    """Credit of a best cosine: up to 0.90 from 0.85, up to 0.70 from 0.75, else none."""
    return F.when(cosine >= 0.85, F.least(cosine, F.lit(0.90))).when(cosine >= 0.75, F.least(cosine, F.lit(0.70))).otherwise(0.0)


# Fixed value: the type of summed credits; a cosine's further digits are rounded.
CREDIT = "decimal(12,10)"


def recommend(jobs: DataFrame, held: DataFrame, k: int = 20) -> DataFrame:
    """The best k jobs of each candidate.

    jobs: job_id, skill_id, kind (TECHNOLOGY or PROFESSIONAL), requirement. held: candidate_id, skill_id, credit (1 for an exact
    professional skill, a semantic credit, or a proficiency factor). A category's score is the weighted mean of credits; the mix is
    0.55 professional and 0.45 technology, renormalised where one is missing; required skills scale it by 0.5 + 0.5 * coverage.
    An equi-join on skills pairs only jobs and candidates that share one.
    """
    # sums are of decimals, so that no order of rows changes a score
    needs = jobs.withColumn("w", requirement_weight(F.col("requirement")).cast("decimal(2,1)"))
    held = held.withColumn("credit", F.col("credit").cast(CREDIT))
    professional = F.col("kind") == "PROFESSIONAL"
    totals = needs.groupBy("job_id").agg(
        F.sum(F.when(professional, F.col("w"))).alias("wp"), F.sum(F.when(~professional, F.col("w"))).alias("wt"), F.count_if(F.col("requirement") == "REQUIRED").alias("required")
    )
    hits = needs.join(held, "skill_id").groupBy("candidate_id", "job_id").agg(
        F.sum(F.when(professional, F.col("w") * F.col("credit"))).alias("sp"),
        F.sum(F.when(~professional, F.col("w") * F.col("credit"))).alias("st"),
        F.count_if((F.col("requirement") == "REQUIRED") & ((F.col("credit") >= 0.85) | ~professional)).alias("covered"),
    )
    part = lambda share, s, w: F.when(F.col(w).isNotNull(), share * F.coalesce(F.col(s).cast("double"), F.lit(0.0)) / F.col(w).cast("double")).otherwise(0.0)
    both = part(0.55, "sp", "wp") + part(0.45, "st", "wt")
    weight = F.when(F.col("wp").isNotNull(), 0.55).otherwise(0.0) + F.when(F.col("wt").isNotNull(), 0.45).otherwise(0.0)
    coverage = F.when(F.col("required") > 0, 0.5 + 0.5 * F.col("covered") / F.col("required")).otherwise(1.0)
    scored = hits.join(totals, "job_id").select("candidate_id", "job_id", (F.round(both / weight * coverage * 1e6) / 1e6).alias("score"))
    return top_k(scored, ["candidate_id"], k, F.col("score").desc(), F.col("job_id"))
