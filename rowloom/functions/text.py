"""Column expressions on text: keys, lists, words, titles, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(text: Column) -> Column:
    """White space runs as one space; nothing left: null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def name_key(text: Column) -> Column:
    """Identity of a name: hyphens as spaces, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.replace(text, F.lit("-"), F.lit(" ")), r"\s+", " ")))


def parts(text: Column, by: str = ";") -> Column:
    return F.filter(F.transform(F.split(text, by), lambda p: F.trim(p)), lambda p: p != "")


def meaningful_words(text: Column) -> Column:
    """Number of white-space tokens that hold a letter."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\p{L}]*\p{L}\S*")), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def offer_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"-(\d+)\.html(?:\?|$)", 1), F.lit(""))


def english_url(url: Column) -> Column:
    """The page under /en/: kept if it is, in place of /fr/, else before the path."""
    base = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    rest = F.substring(url, F.length(base) + 1, F.length(url))
    path = F.when(rest == "", "/").when(F.substring(rest, 1, 1) != "/", F.concat(F.lit("/"), rest)).otherwise(rest)
    return (
        F.when(path.startswith("/en/"), url)
        .when(path.startswith("/fr/"), F.concat(base, F.lit("/en/"), F.substring(path, 5, F.length(path))))
        .otherwise(F.concat(base, F.lit("/en"), path))
    )


def content_key(prefix: str, *columns: Column) -> Column:
    """Surrogate key: prefix and 24 hex digits of the SHA-256 of the parts; a null part counts as the word None."""
    joined = F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("None")) for c in columns))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def bracket(months: Column) -> Column:
    """Months of experience as a bracket; null: UNKNOWN."""
    return (
        F.when(months.isNull(), "UNKNOWN")
        .when(months < 12, "0_YEARS")
        .when(months < 36, "1_2_YEARS")
        .when(months < 60, "3_5_YEARS")
        .when(months < 96, "5_7_YEARS")
        .otherwise("8_PLUS_YEARS")
    )


def month_index(year: Column, month: Column, end_of_period: bool = False) -> Column:
    return year * 12 + F.coalesce(month, F.lit(12 if end_of_period else 1)) - 1


def csv_bool(text: Column, default: bool = False) -> Column:
    value = F.nullif(F.lower(F.trim(text)), F.lit(""))
    return F.coalesce(value.isin("1", "true", "yes", "y"), F.lit(default))


def distinct_ignoring_case(values: Column) -> Column:
    """The first of values that differ in case only, in order."""
    lowered = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
