"""Boxes as columns, and joins of intervals and boxes that overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A level's bins are so many times as wide as those of the level below.
_FACTOR = 4


def _box(box: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{box}.{c}" if box else c) for c in ("x0", "y0", "x1", "y1"))


def normalised(box: str, width: Column, height: Column) -> Column:
    """A box in parts of its page; all zeros if the page has no extent."""
    x0, y0, x1, y1 = _box(box)
    fine = (width > 0) & (height > 0)
    part = lambda v, whole: F.when(fine, v / whole).otherwise(0.0)
    return F.struct(part(x0, width).alias("x0"), part(y0, height).alias("y0"), part(x1, width).alias("x1"), part(y1, height).alias("y1"))


def union_of(box: str) -> Column:
    """An aggregate: the least box around a group's boxes."""
    x0, y0, x1, y1 = _box(box)
    return F.struct(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length between two intervals, 0 if they touch or overlap."""
    return F.when(a1 <= b0, b0 - a1).when(b1 <= a0, a0 - b1).otherwise(0.0)


def shared_area(a: str, b: str) -> Column:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _box(a), _box(b)
    return overlap(ax0, ax1, bx0, bx1) * overlap(ay0, ay1, by0, by1)


def shared_ratio(a: str, b: str) -> Column:
    """Shared area as a part of the smaller box's area; 0 if that has none."""
    area = lambda x0, y0, x1, y1: F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)
    smaller = F.least(area(*_box(a)), area(*_box(b)))
    return F.when(smaller > 0, shared_area(a, b) / smaller).otherwise(0.0)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal keys whose spans share more than a point: struct columns l and r.

    Each span goes to the level whose bins are about as long as it and to all levels above, two bins or fewer in each, so that its
    length doesn't matter; a pair meets in the level of the longer span, in the first bin that both have. Spans with a null end, or
    that end where they start or before, overlap nothing. `width`, the lowest level's, decides only on speed.
    """

    def spread(rows: DataFrame, span: tuple[str, str], name: str, top: int) -> DataFrame:
        start, end = F.col(span[0]).cast("double"), F.col(span[1]).cast("double")
        rows = rows.where(end > start)
        own = level(start, end)
        each = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(name), start.alias("start"), end.alias("end"), own.alias("own"))
        each = each.withColumn("level", F.explode(F.sequence("own", F.lit(top))))
        size = F.lit(float(width)) * F.pow(F.lit(float(_FACTOR)), F.col("level"))
        return each.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size)))).withColumn("low", F.floor(F.col("start") / size))

    def level(start: Column, end: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log((end - start) / F.lit(float(width))) / math.log(_FACTOR))).cast("int")

    def longest(rows: DataFrame, span: tuple[str, str]) -> int:
        start, end = F.col(span[0]).cast("double"), F.col(span[1]).cast("double")
        return rows.where(end > start).agg(F.max(level(start, end))).first()[0] or 0  # one number

    top = max(longest(left, left_span), longest(right, right_span))
    a, b = spread(left, left_span, "l", top).alias("a"), spread(right, right_span, "r", top).alias("b")
    same = (F.col("a.level") == F.col("b.level")) & (F.col("a.bin") == F.col("b.bin"))
    for key in keys:
        same = same & (F.col(f"a.l.{key}") == F.col(f"b.r.{key}"))
    met = a.join(b, same).where((F.col("a.level") == F.greatest("a.own", "b.own")) & (F.col("a.bin") == F.greatest("a.low", "b.low")))
    return met.where((F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))).select("a.l", "b.r")


def style_of_words(words: DataFrame, spans: DataFrame, keys: list[str], place: str, width: float = 16.0) -> DataFrame:
    """words with the struct column style: the span of the same keys that shares most area with the word, the first by `place` of equals, or null.

    words and spans have x0, y0, x1, y1. Pairs are those that overlap in height; a word of no area, or null edges, has no style.
    """
    rows = words.withColumn("own word", F.struct(*(F.col(f"`{c}`") for c in words.columns)))
    pairs = overlap_join(words.distinct(), spans, keys, ("y0", "y1"), ("y0", "y1"), width)
    pairs = pairs.withColumn("area", shared_area("l", "r")).where("area > 0")
    best = pairs.groupBy(F.col("l").alias("styled")).agg(F.max_by("r", F.struct("area", (-F.col(f"r.{place}")).alias("first"))).alias("style"))
    return rows.join(best, F.col("own word") == F.col("styled"), "left").select(*(F.col(f"`{c}`") for c in words.columns), "style")


def reading_order(blocks: DataFrame, keys: list[str], band_gap: Column, column_gap: Column) -> DataFrame:
    """Blocks by horizontal bands and, in these, columns: all columns of blocks with band, column_number and reading_order.

    Bands are unions of blocks' heights that lie no farther apart than band_gap, columns unions of a band's blocks' widths within
    column_gap. A block belongs to each band and column that it overlaps by more than an edge; one of no height or width may belong
    to none. A page (keys) is a group: as large as a sheet of paper, whatever the table's size.
    """

    def merged(rows: DataFrame, by: list[str], low: str, high: str, gap: str, number: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(low, high)
        upto = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(upto.isNull() | (F.col(low) - upto > F.col(gap)), 1).otherwise(0)
        numbered = rows.withColumn("opens", opens).withColumn(number, F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        return numbered.groupBy(*by, number).agg(F.min(low).alias("from"), F.max(high).alias("upto"))

    rows = blocks.withColumn("band gap", band_gap).withColumn("column gap", column_gap)
    bands = merged(rows, keys, "y0", "y1", "band gap", "band")
    in_band = rows.join(bands, keys).where((F.col("y0") < F.col("upto")) & (F.col("y1") > F.col("from"))).drop("from", "upto")
    columns = merged(in_band, [*keys, "band"], "x0", "x1", "column gap", "column_number")
    placed = in_band.join(columns, [*keys, "band"]).where((F.col("x0") < F.col("upto")) & (F.col("x1") > F.col("from"))).drop("from", "upto", "band gap", "column gap")
    order = Window.partitionBy(*keys).orderBy("band", "column_number", "y0", *(c for c in blocks.columns if c not in ("y0", *keys)))
    return placed.withColumn("reading_order", F.row_number().over(order) - 1)
