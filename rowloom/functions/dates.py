"""Dates and ranges of dates in text: the first range, else the first date, as precise as it is written."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months in English and French, and what stands for an open end.
MONTHS = [
    ["jan", "january", "janv", "janvier"], ["feb", "february", "fevr", "févr", "fevrier", "février"], ["mar", "march", "mars"], ["apr", "april", "avr", "avril"],
    ["may", "mai"], ["jun", "june", "juin"], ["jul", "july", "juil", "juillet"], ["aug", "august", "aout", "août"], ["sep", "sept", "september", "septembre"],
    ["oct", "october", "octobre"], ["nov", "november", "novembre"], ["dec", "december", "dec.", "décembre", "decembre", "déc"],
]
OPEN = ["present", "current", "now", "ongoing", "to date", "to present", "actuellement", "à ce jour", "en cours", "aujourd'hui", "à présent", "a present"]

_NAME = "|".join(n.replace(".", r"\.") for n in sorted(chain.from_iterable(MONTHS), key=len, reverse=True))
_OPEN, _YEAR, _DIGITS = "|".join(OPEN), r"(?:19|20)[0-9]{2}", r"0?[1-9]|1[0-2]"
_DATE = rf"(?:(?:{_DIGITS})[/.\-]{_YEAR})|(?:(?:{_NAME})\.?\s+{_YEAR})|(?:{_YEAR})"
_RANGE = rf"(?iU)({_DATE}|(?:{_NAME})\.?)\s*(?:-|–|—|to|au|à)\s*({_DATE}|{_OPEN})"
_SINGLE = f"(?iU)(?:{_DATE})"


def _month(name: Column) -> Column:
    """Number of a month by its name in any case, or null."""
    known = F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, names in enumerate(MONTHS, 1) for n in names))
    return F.try_element_at(known, F.lower(name))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _date(text: Column) -> Column:
    numbers, names = rf"^({_DIGITS})[/.\-]({_YEAR})$", rf"(?iU)^({_NAME})\.?\s+({_YEAR})$"
    part = lambda form, i: F.regexp_extract(text, form, i)
    made = lambda year, month, precision: F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), F.lit(precision).alias("precision"))
    return (
        F.when(text.rlike(numbers), made(part(numbers, 2), part(numbers, 1), "MONTH"))
        .when(text.rlike(f"^{_YEAR}$"), made(text, F.lit(None), "YEAR"))
        .when(text.rlike(names), made(part(names, 2), _month(part(names, 1)), "MONTH"))
    )


def date_of(token: Column) -> Column:
    """year, month, precision (MONTH or YEAR) of a text that is a date and no more; else null."""
    return _once(F.regexp_replace(F.lower(F.trim(token)), r"\.+$", ""), _date)


def date_range(text: Column) -> Column:
    """start, end (as of date_of), is_current and raw of the first range in a text, else of its first date; null if it has neither.

    A start that is a month alone borrows the year of the end; with an open end it is no start. A first range without a start is
    passed over for the first date. Null and empty texts have no date.
    """
    made = lambda s, e, c, raw: F.struct(s.alias("start"), e.alias("end"), c.alias("is_current"), raw.alias("raw"))
    none = F.lit(None).cast("struct<year:int,month:int,precision:string>")

    def ranged(raw: Column) -> Column:
        current = F.trim(raw["end"]).rlike(f"(?iU)^(?:{_OPEN})$")
        dated = F.struct(date_of(raw["start"]).alias("own"), F.when(~current, date_of(raw["end"])).alias("end"), current.alias("current"))

        def started(d: Column) -> Column:
            borrowed = _month(F.regexp_replace(F.trim(raw["start"]), r"\.+$", ""))
            start = F.coalesce(d["own"], F.when(d["end"]["year"].isNotNull() & borrowed.isNotNull(), F.struct(d["end"]["year"].alias("year"), borrowed.alias("month"), F.lit("MONTH").alias("precision"))))
            return F.when(start.isNotNull(), made(start, d["end"], d["current"], raw["whole"]))

        return _once(dated, started)

    first = F.when(text.rlike(_RANGE), _once(F.struct(*(F.regexp_extract(text, _RANGE, i).alias(c) for i, c in enumerate(("whole", "start", "end")))), ranged))
    single = _once(F.regexp_extract(text, _SINGLE, 0), lambda raw: F.when(raw != "", made(date_of(raw), none, F.lit(False), raw)))
    return F.coalesce(first, single)


def month_number(date: Column, last: bool = False) -> Column:
    """Months since January of year 0; of a bare year its first month or, with last, its last."""
    return date["year"] * 12 + F.coalesce(date["month"], F.lit(12 if last else 1)) - 1
