"""Centroid clustering on integers: rounds of assignment by a tournament of bisectors, and of exact means.

Between two centroids a < b lies a bisector with the integer normal 2 * (b - a) and the threshold |b|^2 - |a|^2: a vector is
nearer to b if its product with the normal exceeds the threshold, and a wins at zero, having the smaller number. A vector's
nearest centroid is what is left of k after k - 1 such sign tests: the winner so far meets the next number. Only the winner's
distance is computed, exactly.

Each round reads the vectors' column once. A task sends one row a centroid: how many vectors it has and the sums of their
components; the driver gets k rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the query runs with.
WIDTH, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Below this size of components, products and squares of WIDTH of them stay within 64 bits; others are Python's integers.
_NARROW = 1 << 26
#: A vector with a component of this size or more isn't kept: no squared distance to it could be a long.
_LIMIT = float(1 << 62)
_SLICE = 1 << 14


def integers(column: pa.Array, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are kept, and floor(scale * x) of their components, as long or, if large, as Python's integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = column.filter(pa.array(sizes == width)).flatten()
    found = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width) * float(scale)
    fine = (np.abs(found) < _LIMIT).all(axis=1)  # false for nulls, too, which are NaN here
    found = np.floor(found[fine])
    narrow = not len(found) or np.abs(found).max() < _NARROW
    return rows[fine], found.astype("i8") if narrow else np.vectorize(int, otypes=[object])(found)


class Tournament:
    """Nearest of k centroids (rows of Python's integers) by k - 1 sign tests a vector."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        k = len(centroids)
        squares = (self.centroids**2).sum(axis=1)
        self.normals = np.array([[2 * (self.centroids[b] - self.centroids[a]) for b in range(k)] for a in range(k)], dtype=object)
        self.thresholds = np.array([[squares[b] - squares[a] for b in range(k)] for a in range(k)], dtype=object).reshape(k, k)
        self.narrow = all(abs(x) < _NARROW for row in centroids for x in row)
        if self.narrow:
            self._as_long = tuple(x.astype("i8") for x in (self.centroids, self.normals, self.thresholds))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of x, the smaller of equals, and the squared distance to it."""
        long = self.narrow and x.dtype != object
        centroids, normals, thresholds = self._as_long if long else (self.centroids, self.normals, self.thresholds)
        x = x if long else x.astype(object)
        winner = np.zeros(len(x), "i4")
        for rival in range(1, len(centroids)):
            side = (x * normals[winner, rival]).sum(axis=1) - thresholds[winner, rival]
            winner[np.asarray(side > 0, bool)] = rival
        return winner, ((x - centroids[winner]) ** 2).sum(axis=1)


def _slices(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            yield part, *integers(part.column("embedding"), width, scale)


_SUMS = "cluster int, n long, high decimal(38,0), low decimal(38,0), sums array<decimal(38,0)>"
#: Sums of distances are sent as low + high * _HALF, as one decimal may not hold them.
_HALF = 1 << 60


def _totals(vectors: DataFrame, centroids: list[list[int]], width: int, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid that has vectors: their number, the sum of their distances and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament, k = Tournament(centroids), len(centroids)
        counts, distances, sums = [0] * k, [0] * k, [[0] * width for _ in range(k)]
        for _, _, x in _slices(batches, width, scale):
            winner, distance = tournament.assign(x)
            for c in set(winner.tolist()):
                own = winner == c
                counts[c] += int(own.sum())
                distances[c] += sum(distance[own].tolist())
                sums[c] = [a + b for a, b in zip(sums[c], x[own].sum(axis=0).tolist(), strict=True)]
        some = [c for c in range(k) if counts[c]]
        wide = pa.decimal128(38, 0)
        columns = [
            pa.array(some, pa.int32()),
            pa.array([counts[c] for c in some], pa.int64()),
            pa.array([Decimal(distances[c] // _HALF) for c in some], wide),
            pa.array([Decimal(distances[c] % _HALF) for c in some], wide),
            pa.array([[Decimal(v) for v in sums[c]] for c in some], pa.list_(wide)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "high", "low", "sums"])

    parts = vectors.select("embedding").mapInArrow(run, _SUMS)
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), *each).collect()  # k rows at most
    return {r["cluster"]: (int(r["n"]), int(r["high"]) * _HALF + int(r["low"]), [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def _kept(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and embedding of the rows that integers() keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, _ in _slices(batches, width, scale):
            yield part.take(pa.array(rows, pa.int64()))

    return vectors.mapInArrow(run, vectors.schema)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its components) of every kept row of vectors (vec_id, embedding).

    Kept are rows with exactly `width` components, none null, non-finite or of a scaled size of 2 ** 62 or more; other rows give
    none. The k first centroids are the kept rows with the smallest sha256 of `seed:vec_id`; among equal ids the smaller vector
    comes first, rows with a null id come last. Fewer kept rows than k give as many centroids, none an empty result. Centroids that
    coincide leave all their vectors to the smallest number. Repeated rows count as often as they occur; a null id is returned as
    null; other columns are left behind. Distances and their sums that no long holds are null.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = _kept(rows, width, scale).orderBy(draw.asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    centroids: list[list[int]] = [x.tolist() for x in integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width, scale)[1]]
    for _ in range(rounds if centroids else 0):
        for c, (n, _, sums) in _totals(rows, centroids, width, scale).items():
            centroids[c] = [s // n for s in sums]
    totals = _totals(rows, centroids, width, scale) if centroids else {}
    return rows.mapInArrow(_assigner(centroids, {c: t[1] for c, t in totals.items()}, width, scale), _RESULT)


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<decimal(38,0)>, centroid_sha256 string"


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def _assigner(centroids: list[list[int]], inertias: dict[int, int], width: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, total = len(centroids), _long(sum(inertias.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not k:
            return
        tournament = Tournament(centroids)
        inertia = pa.array([_long(inertias.get(c, 0)) for c in range(k)], pa.int64())
        components = pa.array([[Decimal(x) for x in row] for row in centroids], pa.list_(pa.decimal128(38, 0)))
        digests = pa.array([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids])
        for part, rows, x in _slices(batches, width, scale):
            winner, distance = tournament.assign(x)
            own = pa.array(winner, pa.int32())
            columns = [
                part.column("vec_id").take(pa.array(rows, pa.int64())),
                own,
                pa.array([_long(d) for d in distance.tolist()], pa.int64()),
                inertia.take(own),
                pa.array([total] * len(rows), pa.int64()),
                components.take(own),
                digests.take(own),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"])

    return run
