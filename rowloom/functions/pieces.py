"""Functions of one row's values over Arrow batches, of which few rows at a time are Python objects."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are Python objects at once.
ROWS = 64


def by_pieces(one: Callable, kind: T.DataType, arrow: pa.DataType) -> Callable:
    """A column function that gives one(value, ...) of every row; the batch stays in Arrow's buffers but for pieces of ROWS rows."""

    def run(*columns: pa.Array) -> pa.Array:
        made = [pa.array([one(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True)], arrow) for at in range(0, len(columns[0]), ROWS)]
        return pa.concat_arrays(made) if made else pa.array([], arrow)

    return F.arrow_udf(run, kind)
