"""Zones of a description by its headings, with their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Expressions that begin a heading of each kind, in the order in which they are tried; a heading is shorter than this.
KINDS = {
    "REQUIREMENTS": r"requirements|what you.?ll need|what we.?re looking for|must have",
    "QUALIFICATIONS": r"qualifications|profile|who you are",
    "EDUCATION": r"education|academic|diplomas?",
    "EXPERIENCE": r"experience|professional experience",
    "LANGUAGES": r"languages?|language requirements",
    "EMPLOYMENT_TERMS": r"contract|employment|offer|working conditions|compensation",
    "LOCATION": r"location|where you.?ll work|workplace",
    "RESPONSIBILITIES": r"responsibilities|your role|what you.?ll do|duties|missions?",
    "BENEFITS": r"benefits|perks|we offer",
    "COMPANY": r"about us|about the company|who we are|the company",
}
SHORTER = 80
#: Where lines end, the mark kept with the line.
_ENDS = r"(?<=[\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029])|(?<=\r)(?!\n)"


def zones(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, end of the zones of each text, from heading to heading; before the first, and without any, OTHER.

    Places count characters from 0, end exclusive. Keys must be distinct. Blank and null texts have no zones. A text's lines are
    summed up within its key; no text meets another.
    """
    rows = docs.select(F.col(key), F.col(text).alias("text")).where(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") != "")
    lines = rows.select(key, F.length("text").alias("size"), F.posexplode(F.split("text", _ENDS)).alias("nth", "line"))
    order = Window.partitionBy(key).orderBy("nth")
    start = F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bare = F.col("line")
    for edge in (r"\s", ":", r"\s"):
        bare = F.regexp_replace(bare, rf"(?U)^{edge}+|{edge}+$", "")
    kind = F.when(F.length(bare) >= SHORTER, None)
    for name, form in KINDS.items():
        kind = kind.when(bare.rlike(rf"(?iU)^(?:{form})\b"), name)
    heads = lines.withColumn("start", start.cast("int")).withColumn("kind", kind).where((F.col("kind").isNotNull()) | (F.col("nth") == 0))
    heads = heads.withColumn("kind", F.coalesce("kind", F.lit("OTHER")))
    end = F.coalesce(F.lead("start").over(order), F.col("size"))
    return heads.select(key, "kind", "start", end.cast("int").alias("end")).where("end > start")


def zone_at(places: DataFrame, zones: DataFrame, key: str, place: str) -> DataFrame:
    """places with the column zone: the kind of the zone that holds the place, else OTHER."""
    own = zones.select(F.col(key).alias("own key"), F.col("kind").alias("own kind"), F.col("start").alias("own start"), F.col("end").alias("own end"))
    met = places.join(own, (F.col(key) == F.col("own key")) & (F.col("own start") <= F.col(place)) & (F.col(place) < F.col("own end")), "left")
    return met.select(*(F.col(f"`{c}`") for c in places.columns), F.coalesce("own kind", F.lit("OTHER")).alias("zone"))
