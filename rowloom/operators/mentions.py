"""Literal mentions of many names in many texts.

Names meet texts by a join on their first word, never by trying each name on each text. Only words and keys are joined; each
text is then read once, for the names that it can hold.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by which names and texts meet (for Spark), and the characters that may not stand before and after a mention.
WORDS, EDGES = r"(?U)\w+", (r"\w+#.", r"\w+#")
PLACES = "array<struct<name:int,surface:string,start:int,end:int>>"


@lru_cache(maxsize=10_000)
def _form(name: str, before: str, after: str) -> re.Pattern:
    return re.compile(f"(?<![{before}]){re.escape(name)}(?![{after}])", re.IGNORECASE)


def row_key(key: Column, text: Column) -> Column:
    """Tells rows apart but for those that agree in key and text, which hold the same mentions."""
    return F.struct(key.alias("key"), F.xxhash64(text).alias("hash"), F.length(text).alias("length"))


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, words: str = WORDS, edges: tuple = EDGES) -> DataFrame:
    """Every place where a name stands in a text, in any case and not within a longer word: key, all columns of names, surface, start, end.

    start and end count characters from 0, end exclusive. A name is found by its first run of `words`, so it has to hold one; the
    places of one name do not overlap, those of different names may. `edges` are the characters that may not stand before and after.
    Null texts, null names and names without a word give nothing. Repeated rows are answered once each. A word that many texts
    hold is no more than a key of many narrow rows: the join is broadcast, or splits its partitions, as Spark sees fit.
    """

    @F.pandas_udf(PLACES)
    def places(text: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for own, forms in zip(text, names, strict=True):
            found = [(i, m.group(), m.start(), m.end()) for i, n in enumerate(forms) for m in _form(n, *edges).finditer(own)]
            out.append([dict(zip(("name", "surface", "start", "end"), f, strict=True)) for f in found])
        return pd.Series(out)

    named = names.where(F.col(name).isNotNull()).withColumn("first word", F.regexp_extract(F.lower(name), words, 0)).where("`first word` <> ''")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key of text"), F.col(text).alias("own text"))
    rows = rows.withColumn("row of text", row_key(F.col("key of text"), F.col("own text")))
    held = rows.select("row of text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("own text"), F.lit(words), 0))).alias("first word")).distinct()
    met = held.join(named, "first word").groupBy(F.col("row of text").alias("met row")).agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in names.columns))).alias("names met"))
    found = rows.join(met, F.col("row of text") == F.col("met row"))
    found = found.select("key of text", "names met", F.explode(places("own text", F.transform("names met", lambda n: n[name]))).alias("place"))
    return found.select(F.col("key of text").alias(key), F.expr("`names met`[place.name]").alias("one"), "place").select(key, "one.*", "place.surface", "place.start", "place.end")
