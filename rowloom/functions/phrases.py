"""Rules as tables of phrases. A text becomes clauses of plain words; a rule asks which phrases of a list a clause holds.

Clauses are strings of folded words, one space between any two and one at each end, so that a phrase is found as a whole by the
space before and behind it. All of it is Spark's own expressions; no row goes to Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and the letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ’‘“”"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy''\"\""
#: Words that deny what follows them closely.
NEGATORS = ["no", "not", "never", "without", "neither", "nor", "pas", "pas de", "non", "sans"]
#: Words between a denial and what it denies.
REACH = 3


def fold(text: Column) -> Column:
    """Lower case, without the accents of Latin letters; null: empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, FOLDED)


def spoken(text: Column) -> Column:
    """The folded words of a text, a space at each side of each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), r"[^a-z0-9+#%]+", " ")), F.lit(" "))


def sentences(text: Column) -> Column:
    """Stretches between line ends, semicolons and the marks that end sentences; a point within a figure or word ends none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[;\n!?]+|\.(?!\w)"), lambda part: F.trim(part) != "")


def clauses(text: Column) -> Column:
    return F.transform(sentences(text), spoken)


def listed(phrases: list[str]) -> str:
    """An expression for any of the phrases, the longest first."""
    return "(?:" + "|".join(re.sub(r"([+*.?()])", r"\\\1", p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + ")"


def says(clause: Column, phrases: list[str]) -> Column:
    return clause.rlike(f" {listed(phrases)} ")


def follows(clause: Column, cues: list[str], phrases: list[str], within: int | None = REACH) -> Column:
    """Whether one of phrases comes behind one of cues, with at most so many words between (None: any number)."""
    between = r"(?: \S+)*" if within is None else rf"(?: \S+){{0,{within}}}"
    return clause.rlike(f" {listed(cues)}{between} {listed(phrases)} ")


def asserts(clause: Column, phrases: list[str]) -> Column:
    """Says one of phrases and denies none of them."""
    return says(clause, phrases) & ~follows(clause, NEGATORS, phrases)


def without(clause: Column, phrases: list[str]) -> Column:
    """The clause with each of phrases made a mark, so that nothing is found in it."""
    return F.regexp_replace(clause, f" {listed(phrases)}(?= )", " *")


def behind(clause: Column, labels: list[str]) -> Column:
    """What stands behind a label that begins the clause, as a clause; null if none does."""
    rest = F.regexp_extract(clause, f"^ {listed(labels)}( .*)$", 1)
    return F.nullif(rest, F.lit(""))


def bound(value: Column, make) -> Column:
    """make(value) with the value computed once, however often make() uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def first(values: Column) -> Column:
    """The first of an array that is not null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def names(table: dict[str, list[str]], says_one) -> Column:
    """The keys of a table of phrases for which says_one(key, phrases) holds, in the table's order."""
    return F.filter(F.array(*(F.when(says_one(key, phrases), key) for key, phrases in table.items())), lambda k: k.isNotNull())
