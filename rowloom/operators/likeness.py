"""Joins of short strings by insert-delete likeness, without pairing all with all or all that share a word.

Two strings whose likeness is at least r percent differ in at most d = (100 - r) % of their joint length, and each insert or
delete touches two pairs of neighbouring characters at most. So the rarest 2 * d + 1 pairs of either, in one order for all, have
one in common: the join is on these few, counted pairs, with the lengths that r allows, and candidates are measured exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_column
from .steps import kept


def _pairs(text: Column) -> Column:
    """Neighbouring characters of a text between marks of its ends; an equal pair's second place makes another pair."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    found = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(found, lambda p, i: F.concat(p, F.size(F.filter(F.slice(found, 1, i), lambda q: q == p)).cast("string")))


def alike(left: DataFrame, left_text: str, right: DataFrame, right_text: str, percent: float) -> DataFrame:
    """Pairs (a, b, ratio) of distinct texts of both sides whose insert-delete likeness is at least percent (over 50).

    Null texts are like nothing; an empty one is like an empty one. Equal texts have ratio 100. Texts are names or headings: each
    is short, their number may be any. A pair of characters that very many texts share is seldom among the rarest of a text, and
    its rows are split by their lengths, too.
    """
    share = (100.0 - percent) / 100.0
    one = kept(left.select(F.col(left_text).alias("text")).where("text is not null").distinct())
    other = kept(right.select(F.col(right_text).alias("text")).where("text is not null").distinct())
    weigh = one.unionByName(other).select(F.explode(F.array_distinct(_pairs(F.col("text")))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("times"))
    weigh = kept(weigh)
    # the longest partner has (1 + share) / (1 - share) times the length
    most = F.floor(F.length("text") * (share * (1 + (1 + share) / (1 - share))) + 1e-9)

    def rarest(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select("text", F.explode(_pairs(F.col("text"))).alias("pair")).join(weigh, "pair")
        own = each.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("times", "pair"))).alias("pairs"))
        short = own.select(F.col("text").alias(name), F.explode(F.slice("pairs", F.lit(1), (2 * most + 1).cast("int"))).alias("p"))
        return short.select(name, F.col("p.pair").alias("pair"), F.length(name).alias(f"length {name}"))

    a, b = rarest(one, "a"), rarest(other, "b")
    longest = (1 + share) / (1 - share)
    # lengths in classes: a partner's class is the same or the next
    size = lambda c: F.floor(F.log(F.col(c) + 1.0) / F.log(F.lit(longest + 1e-9)) + 1e-12)
    a = a.withColumn("size", size("length a"))
    b = b.withColumn("size", F.explode(F.array(size("length b") - 1, size("length b"), size("length b") + 1)))
    met = a.join(b, ["pair", "size"]).where((F.col("length a") <= F.col("length b") * longest + 1e-9) & (F.col("length b") <= F.col("length a") * longest + 1e-9))
    return met.select("a", "b").distinct().withColumn("ratio", ratio_column("a", "b")).where(F.col("ratio") >= percent)
