"""Similarity of short strings: insert-delete ratio and token sets, from their published definitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; bit-parallel, one step a character of b."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - inserts and deletes / total length)."""
    total = len(a) + len(b)
    return 100.0 * 2 * common_length(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared tokens and the shared tokens with either side's rest; 100 if one side's tokens are all shared."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = sorted(left & right)
    if shared and (left <= right or right <= left):
        return 100.0
    base = " ".join(shared)
    one, two = (" ".join([*shared, *sorted(x)]) for x in (left - right, right - left))
    scores = [ratio(one, two)]
    if shared:
        scores += [ratio(base, one), ratio(base, two)]
    return max(scores)


@F.pandas_udf(T.DoubleType())
def ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def blocked(left: Column) -> Column:
    """Distinct tokens of a text: a join on them keeps a similarity join from pairing all with all."""
    return F.array_distinct(F.filter(F.split(F.lower(left), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
