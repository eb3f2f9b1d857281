"""Positioned words to lines, blocks, columns, reading order and sections."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_by

LINE = "doc_id long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, font double"


def distinct_words(words: DataFrame, grid: float = 1.0) -> DataFrame:
    """Words of one text whose boxes round to the same grid are one, the first by place."""
    cells = [F.bround(F.col(c) / grid).alias(f"{c}__") for c in ("x0", "y0", "x1", "y1")]
    rows = words.select("*", *cells)
    return first_by(rows, ["doc_id", "page", "text", "x0__", "y0__", "x1__", "y1__"], F.col("y0"), F.col("x0")).drop("x0__", "y0__", "x1__", "y1__")


def _line(key: tuple, number: int, words: list[tuple]) -> tuple:
    """The line of words (text, x0, y0, x1, y1, font), which are put in order from the left."""
    words.sort(key=lambda w: (_missing(w[1]), w[1]))
    text, *places = zip(*words, strict=True)
    x0, y0, x1, y1, font = ([v for v in values if not _missing(v)] for values in places)
    return (*key, number, " ".join(text), min(x0, default=None), min(y0, default=None), max(x1, default=None), max(y1, default=None), median(font) if font else None)


def _missing(value: float | None) -> bool:
    return value is None or value != value


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word joins the line above it if its centre is within half a height of the line's running mean. Words come by page and centre; one line is held."""
    fields = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string())] + [(c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "font")])
    nan = float("nan")
    at, number, mean, high, n, own = None, -1, 0.0, 0.0, 0, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=fields)

    for batch in batches:
        out = []
        for doc_id, page, text, x0, y0, x1, y1, font in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            known = y0 is not None and y1 is not None
            mid, height = ((y0 + y1) / 2, (y1 - y0) or 1.0) if known else (nan, nan)
            same = at == (doc_id, page)
            if same and abs(mid - mean) <= max(height, high) / 2:
                n += 1
                mean += (mid - mean) / n
                high = max(high, height)
            else:
                if own:
                    out.append(_line(at, number, own))
                number, mean, high, n, own = number + 1 if same else 0, mid, height, 1, []
                at = (doc_id, page)
            own.append((text, x0, y0, x1, y1, font))
        yield batch_of(out)
    if own:
        yield batch_of([_line(at, number, own)])


def lines(words: DataFrame) -> DataFrame:
    """Lines of each page, found in one pass over sorted words."""
    rows = words.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text", *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "font")))
    order = [F.col("doc_id"), F.col("page"), ((F.col("y0") + F.col("y1")) / 2).asc_nulls_last(), F.col("x0").asc_nulls_last(), F.col("text")]
    return rows.repartition("doc_id", "page").sortWithinPartitions(*order).mapInArrow(_lines, LINE)


def blocks(rows: DataFrame, gap: float = 0.9) -> DataFrame:
    """Lines with the number of their block: a gap over 0.9 of the height above opens one."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    height = F.coalesce(F.lag("font").over(order), F.lag(F.col("y1") - F.col("y0")).over(order))
    opens = F.when(F.col("y0") - F.lag("y1").over(order) > gap * height, 1).otherwise(0)
    return rows.withColumn("opens", opens).withColumn("block", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def _groups(df: DataFrame, keys: list[str], low: str, high: str, gap: float, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(low, high, "block")
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("o__", F.when(F.col(low) - reach > gap, 1).otherwise(0)).withColumn(name, F.sum("o__").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("o__")


def reading_order(rows: DataFrame, *also: Column, band_gap: float = 12.0, column_gap: float = 24.0) -> DataFrame:
    """Blocks by band from the top, within it by column from the left, within that from the top: place, band and column.

    also: named aggregates of a block's lines, as further columns.
    """
    boxes = rows.groupBy("doc_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *also)
    more = boxes.columns[7:]
    banded = _groups(boxes, ["doc_id", "page"], "y0", "y1", band_gap, "band")
    columned = _groups(banded, ["doc_id", "page", "band"], "x0", "x1", column_gap, "column")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("band", "column", "y0", "block"))
    return columned.select("doc_id", "page", "block", "band", "column", place.alias("place"), *more)


# Headings of a profile's sections.
SECTIONS = {
    "EXPERIENCE": ["experience", "work experience", "professional experience", "expérience professionnelle", "expériences"],
    "EDUCATION": ["education", "formation", "studies", "academic background"],
    "SKILLS": ["skills", "technical skills", "compétences", "competences"],
    "LANGUAGES": ["languages", "langues"],
    "CERTIFICATIONS": ["certifications", "certificates"],
    "SUMMARY": ["summary", "profile", "profil", "about me"],
}


def sections(rows: DataFrame) -> DataFrame:
    """Lines with the section of the last heading at or before them; HEADER before the first."""
    heads = F.create_map(*(F.lit(x) for kind, names in SECTIONS.items() for name in names for x in (name, kind)))
    kind = F.element_at(heads, F.lower(F.regexp_replace(F.trim("text"), r"\s*[::]\s*$", "")))
    order = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", kind).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("HEADER")))


def page_state(words: DataFrame) -> DataFrame:
    """Text quality of each page: under 40 characters, over 2 % of odd characters or over half of words of one character is poor."""
    joined = words.groupBy("doc_id", "page").agg(
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.length(F.regexp_replace("text", r"(?U)[\w\p{P}\p{S}\s]", ""))).alias("odd"),
        F.avg((F.length("text") == 1).cast("double")).alias("single"),
    )
    poor = (F.col("chars") < 40) | (F.col("odd") > 0.02 * F.col("chars")) | (F.col("single") > 0.5)
    return joined.select("doc_id", "page", F.when(poor, "POOR").otherwise("GOOD").alias("state"))
