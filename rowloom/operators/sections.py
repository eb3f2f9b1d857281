"""Sections of a document's lines: headings by name, likeness and content, and boundaries that depend on what came before."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .likeness import alike
from .steps import kept

# Sections in whose records a heading-like line is mostly a record's title; headings within records.
FOLDING = ["PROFESSIONAL_EXPERIENCE", "INTERNSHIP", "ALTERNANCE", "PROJECTS", "CERTIFICATIONS", "EDUCATION"]
WITHIN_RECORDS = [
    "responsibilities", "roles and responsibilities", "roles & responsibilities", "key responsibilities", "job responsibilities", "duties", "job profile",
    "key result areas", "kra", "role", "roles", "highlights", "project details", "responsibility", "job description", "description",
    "achievements", "achievement", "strengths", "strength", "references", "reference", "declaration",
]
# The least likeness and most words of a heading; most words of a filled field's label and value; longer headers are looked at.
LIKENESS, MOST_WORDS, LABEL_WORDS, VALUE_WORDS, HEADER_LINES = 90, 6, 3, 4, 6
# Expressions of a section's content.
YEAR, LEVEL = r"(?U)\b(19|20)\d{2}\b", r"(?iU)\b[ABC][12]\b"
PROFICIENCY = r"(?iU)\b(native|fluent|advanced|intermediate|basic|beginner|natif|natale|courant|avancé|intermédiaire|débutant|notions)\b"
LANGUAGES = r"(?iU)\b(english|french|arabic|spanish|german|italian|portuguese|chinese|anglais|français|arabe|espagnol|allemand|italien|portugais|chinois)\b"
CERTIFIED = r"(?iU)\b(certified|certificate|certification|certifi[ée]|attestation)\b"
SEPARATOR, SENTENCE_END = r"[,•|;/·]", r"(?U)[.!?]\s"


@F.pandas_udf(T.StringType())
def heading_key(text: pd.Series) -> pd.Series:
    """A heading with compatible letters alike, without colons behind it, whatever its case; null stays null."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t).strip().rstrip(":：").strip().casefold() for t in text], dtype=object)


def classify_headings(headings: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """Distinct texts of headings with section_type, method and score: by an equal alias, else by the likest of at least 90 percent.

    aliases: alias, section_type, place (their order; of equal aliases the last counts, of equally like ones the first). Headings of
    over six words are taken by an equal alias alone. Null headings are left out; what matches nothing is UNKNOWN without a score.
    Both sides and the likest names are written, so that no plan holds the inputs' plans many times over.
    """
    keyed = headings.select(F.col(text).alias("heading")).where("heading is not null").distinct().withColumn("key", heading_key(F.col("heading")))
    keyed = kept(keyed)
    known = aliases.select(heading_key(F.col("alias")).alias("alias"), "section_type", "place").groupBy("alias").agg(F.max_by("section_type", "place").alias("section_type"), F.min("place").alias("place"))
    known = kept(known)
    words = F.size(F.filter(F.split("key", r"(?U)\s+"), lambda w: w != ""))
    exact = keyed.join(known, F.col("key") == F.col("alias")).select("heading", "section_type", F.lit("ALIAS_EXACT").alias("method"), F.lit(100.0).alias("score"))
    rest = keyed.join(known, F.col("key") == F.col("alias"), "left_anti")
    near = alike(rest.where(words <= MOST_WORDS), "key", known, "alias", LIKENESS).join(known, F.col("b") == F.col("alias"))
    best = near.groupBy(F.col("a").alias("best key")).agg(F.max_by(F.struct("section_type", "ratio"), F.struct("ratio", (-F.col("place")).alias("first"))).alias("best"))
    best = kept(best)
    other = rest.join(best, F.col("key") == F.col("best key"), "left").select(
        "heading",
        F.coalesce("best.section_type", F.lit("UNKNOWN")).alias("section_type"),
        F.when(F.col("best").isNotNull(), "FUZZY_HEADING").otherwise("UNKNOWN").alias("method"),
        F.col("best.ratio").alias("score"),
    )
    return exact.unionByName(other)


def _scores(text: Column) -> list[tuple[str, Column]]:
    """Points of each kind of content, the first of equals first."""
    blank = lambda t: F.regexp_replace(t, r"(?U)\s+", "") == ""
    count = lambda t: F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    if_ = lambda test, points: F.when(test, points).otherwise(0.0)
    all_lines = F.split(text, "\n", -1)
    lines = F.filter(all_lines, lambda x: ~blank(x))
    tokens = F.filter(F.split(text, SEPARATOR, -1), lambda t: ~blank(t))
    words = F.aggregate(tokens, F.lit(0), lambda n, t: n + count(t)) / F.greatest(F.size(tokens), F.lit(1))
    ends = F.regexp_count(text, F.lit(SENTENCE_END)) / F.size(all_lines)
    skills = if_(F.size(tokens) >= 4, if_(words <= 3.0, 2.0) + if_(ends < 0.1, 1.0) + if_(F.size(tokens) >= 8, 1.0))
    dated = F.size(F.filter(lines, lambda x: x.rlike(YEAR)))
    long = F.exists(lines, lambda x: count(x) >= 8)
    experience = F.when((dated >= 2) & long, 2.0).when(dated >= 2, 0.75).when(dated == 1, 0.5).otherwise(0.0) + if_(long, 0.5)
    short = F.size(F.filter(lines, lambda x: count(x) <= 4))
    languages = if_(text.rlike(LEVEL), 2.0) + if_(text.rlike(PROFICIENCY), 1.0) + if_(text.rlike(LANGUAGES), 1.0) + if_((F.size(lines) > 0) & (short / F.greatest(F.size(lines), F.lit(1)) > 0.6), 0.5)
    certificates = if_(text.rlike(CERTIFIED), 2.0) + if_(text.rlike(YEAR), 0.5)
    return [("SKILLS", skills), ("PROFESSIONAL_EXPERIENCE", experience), ("LANGUAGES", languages), ("CERTIFICATIONS", certificates)]


def by_content(text: Column) -> Column:
    """section_type and score of a section by what its text looks like; null if none has 2 points and 0.75 more than the next."""
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("first"), F.lit(kind).alias("section_type")) for i, (kind, s) in enumerate(_scores(text))))
    order = F.reverse(F.array_sort(ranked))
    fine = (order[0]["score"] >= 2.0) & (order[0]["score"] - order[1]["score"] >= 0.75) & (F.regexp_replace(text, r"(?U)\s+", "") != "")
    return F.when(fine, F.struct(order[0]["section_type"].alias("section_type"), order[0]["score"].alias("score")))


def filled_field(text: Column) -> Column:
    """A short label, a colon and a short value: no heading, however it is printed."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    form = r"(?U)^([^:：]{1,60}?)\s*[:：]\s*(\S.*)$"
    count = lambda i: F.size(F.filter(F.split(F.regexp_extract(trimmed, form, i), r"(?U)\s+"), lambda w: w != ""))
    return trimmed.rlike(form) & count(1).between(1, LABEL_WORDS) & count(2).between(1, VALUE_WORDS)


def boundaries(lines: DataFrame, doc: str) -> DataFrame:
    """lines with the column opens: whether a section begins there.

    lines: doc, line (their order), text, is_heading, section_type, method, style (a heading's look, comparable). Blank lines open
    nothing and must have been left out. A heading with a name opens a section, but for those of records within a section that
    folds; one without a name does once a named one has opened one, and within a section that folds only if it looks like one that
    has opened a section by its name and is none of records. Null flags are false; documents with a null key are one document.

    What counts of the past is whether the section folds, whether a named heading opened one, and in which looks. Given the looks,
    a line either sets whether the section folds or leaves it as it is; such steps compose to the last one that sets it, so the
    state at each line is a window's last value and no line waits for a loop over those before it. Looks are found in rounds: a
    round can only change what follows the first change of the round before, and ends the work of a document that has none.
    """
    order = Window.partitionBy(doc).orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = F.col("is_heading") & F.col("method").isin("ALIAS_EXACT", "FUZZY_HEADING")
    inner = F.col("is_heading") & heading_key(F.col("text")).isin(WITHIN_RECORDS)
    rows = lines.select(
        doc, "line", "style", F.coalesce(named, F.lit(False)).alias("named"), F.coalesce(inner, F.lit(False)).alias("inner"),
        F.coalesce(F.col("is_heading") & (F.col("method") == "UNKNOWN") & ~filled_field(F.col("text")), F.lit(False)).alias("open"),
        F.coalesce(F.col("section_type").isin(FOLDING), F.lit(False)).alias("folds"),
    )
    rows = kept(rows.where("named or open").withColumn("opens", F.col("named") & ~F.col("inner")))
    same_look = Window.partitionBy(doc, "style").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        by_name = F.col("named") & F.col("opens")
        seen = rows.withColumn("seen", F.coalesce(F.max(by_name).over(before), F.lit(False))).withColumn("look", F.coalesce(F.max(by_name).over(same_look), F.lit(False)))
        # an unnamed heading of a known look always opens a section, which doesn't fold; one of another look only where none folds anyway
        unnamed, look = F.col("open") & F.col("seen"), F.col("look") & ~F.col("inner")
        sets = F.when(F.col("named") & (~F.col("inner") | F.col("folds")), F.col("folds")).when(unnamed & look, F.lit(False))
        state = seen.withColumn("in fold", F.coalesce(F.last(sets, ignorenulls=True).over(before), F.lit(False)))
        opens = F.when(F.col("named"), ~F.col("inner") | ~F.col("in fold")).otherwise(unnamed & (~F.col("in fold") | look))
        following = kept(state.withColumn("next", opens).drop("seen", "look", "in fold"))
        changed = following.where("named and next <> opens").limit(1).count()
        rows = following.drop("opens").withColumnRenamed("next", "opens")
        if not changed:
            break
    found = rows.where("opens").select(F.col(doc).alias("own doc"), F.col("line").alias("own line"), F.lit(True).alias("opens"))
    on = F.col(doc).eqNullSafe(F.col("own doc")) & F.col("line").eqNullSafe(F.col("own line"))
    return lines.join(found, on, "left").select(*(F.col(f"`{c}`") for c in lines.columns), F.coalesce("opens", F.lit(False)).alias("opens"))


def sections(lines: DataFrame, doc: str) -> DataFrame:
    """doc, section (from 0), section_type, method, heading, score, first_line, last_line, text of each section of lines.

    lines: doc, line, text, is_heading, section_type, method, score, style. Lines before the first boundary are the HEADER. A section
    without a name, or a header of over six lines, is named by its content where that is clear. Blank lines are left out.
    """
    rows = kept(lines.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") != ""))
    opened = boundaries(rows, doc)
    order = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("opens") | (F.row_number().over(Window.partitionBy(doc).orderBy("line")) == 1)
    numbered = opened.withColumn("first", first).withColumn("section", F.sum(F.col("first").cast("int")).over(order) - 1)
    head = F.min_by(F.struct("opens", "section_type", "method", "text", "score"), "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    grouped = numbered.groupBy(doc, "section").agg(head.alias("head"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), text.alias("text"))
    named = F.col("head.opens")
    grouped = grouped.select(
        doc, "section", F.when(named, F.col("head.section_type")).otherwise("HEADER").alias("section_type"), F.when(named, F.col("head.method")).otherwise("HEADER").alias("method"),
        F.when(named, F.col("head.text")).alias("heading"), F.when(named, F.col("head.score")).alias("score"), "first_line", "last_line", "n_lines", "text",
    )
    guessed = F.when((F.col("method") == "UNKNOWN") | ((F.col("method") == "HEADER") & (F.col("n_lines") > HEADER_LINES)), by_content(F.col("text")))
    guessed = grouped.withColumn("guess", guessed)
    return guessed.withColumn("section_type", F.coalesce("guess.section_type", "section_type")).withColumn("method", F.when(F.col("guess").isNotNull(), "STRUCTURAL_SIGNATURE").otherwise(F.col("method"))).drop("guess", "n_lines")
