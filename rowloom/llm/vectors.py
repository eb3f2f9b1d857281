"""Near-duplicate vectors by robust-pruned flat graphs.

Each vector is at home with its nearest centre and a guest of the next nearest ones. A shard is what is at home with a centre; its
task builds a graph of it: each vector's nearest candidates, pruned so that no kept neighbour is much nearer to another kept one
than to the vector. Home vectors and guests search that graph: greedily until a beam is exhausted, and on through everything near
enough to the range. Two vectors meet where either is a guest of the other's shard; if both are, one of the two tasks counts.

A vector moves once, home. Its guests are codes of a byte a component with the bound of their error, which settles what lies well
within or beyond the range; a guest with a link that it leaves in doubt is sent once more as it is. Links are verified in double
precision. Recall is audited for a bounded set of queries against all vectors; if it falls short, all is dealt again with more guests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, small
from .components import components

COSINE = 0.9
#: Vectors at home in a shard (larger ones are parted by a hash), guests that a task holds beside them, centres that are found at once.
SHARD, BLOCK, CENTRES = 2048, 16_384, 64
#: Rows that CENTRES centres are found from; of more centres, rows for each. Chosen by a hash.
FIT_ROWS, FIT_EACH = 16_384, 64
#: A vector goes to the nearest so many centres, of those whose cosine with it lacks at most MARGIN of the nearest one's; the
#: margin is wider where vectors have fewer parts than SPREAD, as a step in the range then changes each cosine more. ...
OVERLAP, MARGIN, SPREAD = 16, 0.07, 64
#: ... Beside these it goes to every centre as near as this, twice the range's angle: what lies within the range of such a centre may be linked.
CLOSE = 2 * COSINE * COSINE - 1
CANDIDATES, DEGREE, ALPHA = 40, 20, 1.2
BEAM, SLACK, MEDOIDS = 24, 0.15, 8
#: Queries that are audited against all vectors, the recall below which all is dealt again, with OVERLAP four and MARGIN two times as large, and how often.
AUDITED, RECALL, ATTEMPTS = 1024, 0.99, 3
_BLOCK = 256
#: Rows that a query opens at a step while its beam is not full, and the best rows that it remembers.
_STEP, _POOL = 8, 64
#: A query with more than so many rows near the range is settled against all rows of its task: opening each costs more than that.
_WIDE = 16
#: Bound of what single precision may err in a cosine.
_ROUGH = 1e-4


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of k clusters of unit vectors, from evenly spaced starts; fewer if clusters empty."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 4096] @ c.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return c


def neighbours(x: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours of each row among the rows of x, -1 where there are fewer.

    Slots that pruning leaves are filled with the nearest of what it drops: in a group that is almost one point it would drop all.
    """
    x = x.astype("f4")
    n, width = len(x), min(CANDIDATES, len(x) - 1)
    out = np.full((n, DEGREE), -1, "i4")
    if width < 1:
        return out
    for at in range(0, n, _BLOCK):
        block = np.arange(at, min(at + _BLOCK, n))
        sims = x[block] @ x.T
        sims[np.arange(len(block)), block] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        away = 2 - 2 * np.take_along_axis(sims, near, 1)
        between = 2 - 2 * (x[near] @ x[near].transpose(0, 2, 1))
        open_, left = np.ones(near.shape, bool), np.ones(near.shape, bool)
        rows = np.arange(len(block))
        for slot in range(min(DEGREE, width)):
            some = open_.any(1)
            pick = np.where(some, open_.argmax(1), left.argmax(1))
            out[block, slot] = near[rows, pick]
            open_ &= ~(ALPHA * ALPHA * between[rows, pick] <= away)
            open_[rows, pick] = left[rows, pick] = False
    return out


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """Rows nearest to the centres of k clusters."""
    return np.unique((centres(x[:: max(1, len(x) // 2048)], min(k, len(x))) @ x.T).argmax(1))


def search(rough: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, err: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of queries: query, row of rough and cosine (all in single precision) of each pair found that may reach COSINE, if the query errs by err.

    A query starts from the rows of start and from its own place, as a group of near copies may be an island of the graph: that is
    its own row (own) or, if it is none of the graph, the rows nearest to it, which it would be put beside. Where the nearest row of
    all is out of range, every row is, and the query ends at once. All others of a block step together. Each opens its best few
    unopened rows until it has opened a beam of them, and every row that is within the range and some slack, and looks at their
    neighbours; it ends when nothing is left to open, or when so much of the graph lies in range that all of it is looked at.
    """
    n = len(rough)
    for at in range(0, len(queries), _BLOCK):
        x, least = queries[at : at + _BLOCK], COSINE - _ROUGH - err[at : at + _BLOCK]
        if own is None:
            every = x @ rough.T
            nearest = every.max(1)
        else:
            first = graph[own[at : at + _BLOCK], 0]  # a row's nearest one
            nearest = np.where(first < 0, -np.inf, np.einsum("ij,ij->i", x, rough[first]))
        going = np.flatnonzero(nearest >= least)
        if not len(going):
            continue
        x, least = x[going], least[going]
        if own is None:
            place = np.argpartition(-every[going], min(_STEP, n) - 1, axis=1)[:, :_STEP]
            near = np.take_along_axis(every[going], place, 1)
        else:
            place, near = own[at + going, None], np.ones((len(x), 1), "f4")
        rows = np.arange(len(x))[:, None]
        others = np.where((start[None, :, None] == place[:, None, :]).any(2), -1, start)
        ids = np.concatenate([place, others], axis=1)
        sims = np.concatenate([near, np.where(others < 0, -np.inf, x @ rough[start].T)], axis=1)
        seen = np.zeros((len(x), n), bool)
        seen[np.repeat(rows.ravel(), ids.shape[1])[ids.ravel() >= 0], ids[ids >= 0]] = True
        opened, count, whole = ids < 0, np.zeros(len(x), int), np.zeros(len(x), bool)
        while True:
            whole |= (sims >= COSINE - SLACK).sum(1) > _WIDE
            waiting = np.where(opened | whole[:, None], -np.inf, sims)
            best = np.argpartition(-waiting, min(_STEP, waiting.shape[1]) - 1, axis=1)[:, :_STEP]
            value = waiting[rows, best]
            q, slot = np.nonzero((value > -np.inf) & ((count < BEAM)[:, None] | (value >= COSINE - SLACK)))
            if not len(q):
                break
            opened[q, best[q, slot]] = True
            count += np.bincount(q, minlength=len(x))
            near = graph[ids[q, best[q, slot]]]
            new = np.zeros((len(x), n), bool)
            new[np.repeat(q, near.shape[1])[near.ravel() >= 0], near[near >= 0]] = True
            new &= ~seen
            seen |= new
            q, m = np.nonzero(new)
            found = np.einsum("ij,ij->i", x[q], rough[m])
            held = np.bincount(q, minlength=len(x))
            place = np.arange(len(q)) - np.repeat(np.cumsum(held) - held, held)
            more, value = np.full((len(x), held.max(initial=0)), -1), np.full((len(x), held.max(initial=0)), -np.inf, "f4")
            more[q, place], value[q, place] = m, found
            ids, sims, opened = np.concatenate([ids, more], 1), np.concatenate([sims, value], 1), np.concatenate([opened, more < 0], 1)
            if sims.shape[1] > _POOL:
                keep = np.argpartition(-sims, _POOL - 1, axis=1)[:, :_POOL]
                ids, sims, opened = ids[rows, keep], sims[rows, keep], opened[rows, keep]
        q, slot = np.nonzero((sims >= least[:, None]) & ~whole[:, None])
        m, value = ids[q, slot], sims[q, slot]
        some = np.flatnonzero(whole)
        every = x[some] @ rough.T
        a, b = np.nonzero(every >= least[some][:, None])
        q, m, value = np.concatenate([q, some[a]]), np.concatenate([m, b]), np.concatenate([value, every[a, b]])
        q = at + going[q]
        if own is not None:
            other = m != own[q]
            q, m, value = q[other], m[other], value[other]
        yield q, m, value


def both_ways(x: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The graph with each edge turned round too, the nearest DEGREE of them a row, so that what points somewhere can be reached."""
    row, slot = np.nonzero(graph >= 0)
    a, b = graph[row, slot], row
    order = np.lexsort((b, -np.einsum("ij,ij->i", x[a], x[b]), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < DEGREE
    back = np.full((len(x), DEGREE), -1, "i4")
    back[a[keep], place[keep]] = b[keep]
    return np.concatenate([graph, back], axis=1)


def lowered(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a row of its own group) after the groups of each a and b are joined; the least row of a group is its label."""
    while True:
        lowest = label.copy()
        np.minimum.at(lowest, a, label[b])
        np.minimum.at(lowest, b, label[a])
        hook = np.arange(len(label))
        np.minimum.at(hook, label, lowest)
        lowest = hook[lowest]
        if np.array_equal(lowest, label):
            return label
        label = lowest


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of v at length 1; scaled by the largest part first, so that no square is too large or small."""
    v = v.astype("f8")
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each part of unit vectors, and for each vector (f4) the step of its codes and a bound of the distance between it and them."""
    step = (np.abs(x).max(1) / 127).astype("f4")
    code = np.rint(x / step[:, None].astype("f8")).clip(-128, 127).astype("i1")
    err = np.linalg.norm(x - code * step[:, None].astype("f8"), axis=1).astype("f4")
    return code, np.stack([step, np.nextafter(err, np.float32(2))], axis=1)


def _parts(embedding: Column) -> Column:
    """In double precision; minus zero is zero."""
    return F.transform(embedding.cast("array<double>"), lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))


def _keys(v: Column) -> tuple[Column, Column]:
    return F.xxhash64(v).alias("k1"), F.xxhash64(F.lit("second"), v).alias("k2")


def usable(vectors: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """id, rep, copies, two keys and v, one row a distinct vector, of those that are not null, zero, or of null or non-finite parts; how many there are of each length.

    id is the least id of its rows; rep is too, unless another vector has the same one: then it is a hash of the vector. Copies are
    found by their keys alone, and a vector that has none is not shuffled.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v")).dropna()
    parts = _parts(F.col("v"))
    good = F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(parts, lambda c: c != 0)
    rows = rows.where((F.size("v") > 0) & F.coalesce(good, F.lit(False))).select(F.col("vec_id").alias("id"), *_keys(parts), "v")
    one = rows.select("id", "k1", "k2", F.size("v").alias("width"))
    keyed = saved(one.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("width").alias("width")), "keyed")
    widths = {r["width"]: r["n"] for r in keyed.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    several = keyed.where("copies > 1").select("k1", "k2")
    grouped = rows if (n := several.limit(BROADCAST_ROWS + 1).count()) > BROADCAST_ROWS else rows.join(F.broadcast(several), ["k1", "k2"], "left_semi")
    distinct = grouped.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    if n <= BROADCAST_ROWS:
        single = (rows.join(F.broadcast(several), ["k1", "k2"], "left_anti") if n else rows).withColumn("copies", F.lit(1).cast("long"))
        distinct = single.unionByName(distinct) if n else single
    shared = saved(keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("shared")), "shared")
    marked = distinct.join(small(shared), "id", "left")
    return marked.select("id", F.when(F.col("shared"), F.col("k1")).otherwise(F.col("id")).alias("rep"), "copies", "k1", "k2", "v"), widths


@dataclass
class Leaves:
    """Centres of each length of vectors, with the number of the first; a length that fills no shard is one leaf without centres."""

    first: dict[int, int]
    centres: dict[int, np.ndarray]
    n: int


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length in a column of lists, and their vectors."""
    size, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), pc.list_flatten(column).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        yield rows, flat[first[rows][:, None] + np.arange(width)]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors, all of one length, of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fitted(distinct: DataFrame, widths: dict[int, int]) -> Leaves:
    """Centres for vectors of each length that fill a shard, from samples: of few centres at once, of more first of cells, then of each cell's own."""
    wanted = {w: math.ceil(n * 1.5 / SHARD) for w, n in widths.items() if n > SHARD}
    draw = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)

    def share(of: dict) -> Column:
        return F.element_at(F.create_map(*(F.lit(v) for k, f in of.items() for v in (k, float(f)))), F.size("v"))

    def find(counts: dict):
        def run(batch: pa.Table) -> pa.Table:
            batch = batch.sort_by("rep")
            width, cell = batch["width"][0].as_py(), batch["cell"][0].as_py()
            x = unit(_matrix(batch["v"]))
            c = centres(x, min(counts[width, cell], len(x)))
            return pa.table({"width": pa.array([width], pa.int32()), "cell": pa.array([cell], pa.int32()), "centres": pa.array([c.astype("f4").tobytes()], pa.binary())})

        return run

    found: dict[int, list] = {w: [] for w in wanted}
    if wanted:
        k = {(w, 0): n if n <= CENTRES else math.ceil(math.sqrt(n)) for w, n in wanted.items()}
        chosen = distinct.where(F.size("v").isin(list(wanted))).where(draw < share({w: FIT_ROWS / widths[w] for w in wanted}))
        chosen = chosen.select("rep", "v", F.size("v").alias("width"), F.lit(0).alias("cell"))
        for r in chosen.groupBy("width", "cell").applyInArrow(find(k), "width int, cell int, centres binary").collect():
            found[r["width"]] = [np.frombuffer(r["centres"], "f4").reshape(-1, r["width"])]
    many = {w: n for w, n in wanted.items() if n > CENTRES}
    if many:
        cells = {w: found[w][0] for w in many}

        def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.zeros(len(batch), "i4")
                for rows, v in _vectors(batch.column("v")):
                    cell[rows] = (unit(v).astype("f4") @ cells[v.shape[1]].T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        chosen = distinct.where(F.size("v").isin(list(many))).where(draw < share({w: FIT_EACH * n / widths[w] for w, n in many.items()}))
        chosen = chosen.select("rep", "v", F.size("v").alias("width"))
        kind = chosen.schema["v"].dataType.simpleString()
        chosen = saved(chosen.mapInArrow(parted, f"rep long, v {kind}, width int, cell int"), "sample")
        held = {(r["width"], r["cell"]): r["n"] for r in chosen.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        k = {key: math.ceil(n / FIT_EACH) for key, n in held.items()}
        full = F.element_at(F.create_map(*(F.lit(v) for (w, c), n in held.items() for v in (f"{w} {c}", FIT_ROWS / n))), F.concat_ws(" ", "width", "cell"))
        chosen = chosen.where(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 20)) / float(1 << 20) < full)
        for w in many:
            found[w] = []
        for r in sorted(chosen.groupBy("width", "cell").applyInArrow(find(k), "width int, cell int, centres binary").collect(), key=lambda r: r["cell"]):
            found[r["width"]].append(np.frombuffer(r["centres"], "f4").reshape(-1, r["width"]))
    first, n, joined = {}, 0, {w: np.concatenate(c) for w, c in found.items() if c}
    for w in sorted(widths):
        first[w] = n
        n += len(joined.get(w, [0]))
    return Leaves(first, joined, n)


def places(x: np.ndarray, c: np.ndarray, overlap: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centre of each row; row and centre of all that it goes to."""
    own, rows, goes = [], [], []
    margin *= math.sqrt(max(1.0, SPREAD / x.shape[1]))
    for at in range(0, len(x), _BLOCK):
        sims = x[at : at + _BLOCK] @ c.T
        most = min(overlap, len(c))
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(sims, near, 1)
        to = sims >= CLOSE
        row, slot = np.nonzero(value >= value.max(1)[:, None] - margin)
        to[row, near[row, slot]] = True
        row, centre = np.nonzero(to)
        own.append(near[np.arange(len(near)), value.argmax(1)])
        rows.append(at + row)
        goes.append(centre)
    return np.concatenate(own), np.concatenate(rows), np.concatenate(goes)


def with_places(distinct: DataFrame, leaves: Leaves, overlap: int, margin: float) -> DataFrame:
    """distinct with its leaf and all leaves that it visits, its own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, each, visits = np.zeros(len(batch), "i4"), [np.empty(0, "i8")], [np.empty(0, "i8")]
            for rows, v in _vectors(batch.column("v")):
                first, c = leaves.first[v.shape[1]], leaves.centres.get(v.shape[1])
                own, row, goes = (0, np.arange(len(v)), np.zeros(len(v), int)) if c is None else places(unit(v).astype("f4"), c, overlap, margin)
                leaf[rows] = first + own
                each.append(rows[row])
                visits.append(first + goes)
            each, visits = np.concatenate(each), np.concatenate(visits)
            ends = np.r_[0, np.cumsum(np.bincount(each, minlength=len(batch)))]
            visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(visits[np.argsort(each, kind="stable")], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), visits], [*batch.schema.names, "leaf", "visits"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.mapInArrow(run, f"id long, rep long, copies long, k1 long, k2 long, v {kind}, leaf int, visits array<int>")


@dataclass
class Deal:
    """How leaves are parted: parts of a leaf's home rows, blocks of its guests; the first shard of each leaf, and each shard's leaf."""

    parts: np.ndarray
    blocks: np.ndarray

    def __post_init__(self):
        shards = self.parts * self.blocks
        self.first = np.cumsum(shards) - shards
        self.leaf = np.repeat(np.arange(len(shards)), shards)

    def part(self, rep: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return (_mixed(rep, 0x9E3779B97F4A7C15) % self.parts[leaf]).astype("i4")

    def where(self, shard: int) -> tuple[int, int, int]:
        """Leaf, part and block of a shard."""
        leaf = int(self.leaf[shard])
        return (leaf, *divmod(shard - int(self.first[leaf]), int(self.blocks[leaf])))


def _mixed(rep: np.ndarray, by: int) -> np.ndarray:
    return (rep.astype("u8") * np.uint64(by) >> np.uint64(33)).astype("i8")


def _sent(at: np.ndarray, batch: pa.RecordBatch, rows: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Rows as they are shuffled: data (bytes, a row each) beside at, which is twice the shard, and one more for a guest."""
    ends = np.arange(len(rows) + 1, dtype="i8") * data.shape[1]
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([pa.array(at.astype("i8")), *(batch.column(c).take(pa.array(rows)) for c in ("rep", "copies")), packed.cast(pa.binary())], ["at", "rep", "copies", "data"])


def _bytes(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(c).view("u1").reshape(len(c), -1) for c in columns], axis=1)


_SENT = "at long, rep long, copies long, data binary"
#: Visits that a home row brings along for a guest from elsewhere to see whether it is itself one there; -1 where there are fewer.
_NONE = -1


def _homes(batch: pa.RecordBatch, rows: np.ndarray, v: np.ndarray, rep: np.ndarray, leaf: np.ndarray, deal: Deal, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Home rows by shard, once for each block of guests: the vector and its visits."""
    size = pc.list_value_length(batch.column("visits")).to_numpy(zero_copy_only=False)[rows]
    part = deal.part(rep[rows], leaf[rows])
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        visits = _matrix(batch.column("visits").take(pa.array(rows[some])))
        blocks = deal.blocks[leaf[rows[some]]]
        nth = np.repeat(np.arange(len(some)), blocks)
        shard = deal.first[leaf[rows[some]]][nth] + part[some][nth] * blocks[nth] + np.arange(len(nth)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        keep = np.ones(len(shard), bool) if only is None else only[shard]
        yield _sent(2 * shard[keep], batch, rows[some][nth[keep]], _bytes(v[some], visits.astype("i4"))[nth[keep]])


def dealt(placed: DataFrame, deal: Deal) -> DataFrame:
    """Rows by shard: home rows, and guests as codes with the bound of their error and where they are at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, leaf = batch.column("rep").to_numpy(), batch.column("leaf").to_numpy()
            size, visits = pc.list_value_length(batch.column("visits")).to_numpy(zero_copy_only=False), pc.list_flatten(batch.column("visits")).to_numpy()
            first = np.cumsum(size) - size
            for rows, v in _vectors(batch.column("v")):
                yield from _homes(batch, rows, v, rep, leaf, deal, None)
                own = deal.part(rep[rows], leaf[rows])
                data = _bytes(*coded(unit(v)), leaf[rows].astype("i4"), own)
                nth = np.repeat(np.arange(len(rows)), size[rows])
                to = visits[np.repeat(first[rows], size[rows]) + np.arange(len(nth)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])]
                parts = deal.parts[to]
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                nth, to = np.repeat(nth, parts), np.repeat(to, parts)
                guest = (to != leaf[rows][nth]) | (part != own[nth])
                nth, to, part = nth[guest], to[guest], part[guest]
                block = _mixed(rep[rows][nth], 0xC2B2AE3D27D4EB4F) % deal.blocks[to]
                yield _sent(2 * (deal.first[to] + part * deal.blocks[to] + block) + 1, batch, rows[nth], data[nth])

    return placed.select("rep", "copies", "v", "leaf", "visits").mapInArrow(run, _SENT)


def dealt_again(placed: DataFrame, called: DataFrame, deal: Deal) -> DataFrame:
    """Guests (rep, shard) that are called, as whole vectors, and the home rows of their shards."""
    shards = np.array([r["shard"] for r in called.select("shard").distinct().collect()], "i8")
    only = np.zeros(len(deal.leaf), bool)
    only[shards] = True

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, leaf = batch.column("rep").to_numpy(), batch.column("leaf").to_numpy()
            for rows, v in _vectors(batch.column("v")):
                yield from _homes(batch, rows, v, rep, leaf, deal, only)

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, leaf, shard = (batch.column(c).to_numpy() for c in ("rep", "leaf", "shard"))
            for rows, v in _vectors(batch.column("v")):
                yield _sent(2 * shard[rows] + 1, batch, rows, _bytes(v, leaf[rows].astype("i4"), deal.part(rep[rows], leaf[rows])))

    again = placed.select("rep", "copies", "v", "leaf").join(small(called), "rep").mapInArrow(guests, _SENT)
    return placed.select("rep", "copies", "v", "leaf", "visits").mapInArrow(homes, _SENT).unionByName(again)


class Task:
    """A shard's graph, and the links that are found in it."""

    def __init__(self, shard: int, deal: Deal, width: int, kind: str, exact: bool):
        self.shard, self.width, self.kind, self.exact = shard, width, np.dtype(kind), exact
        self.leaf, self.part, self.block = deal.where(shard)
        self.held: list = []
        self.x: np.ndarray | None = None

    def add(self, rep: np.ndarray, copies: np.ndarray, data: pa.Array) -> None:
        self.held.append((rep, copies, data))

    def build(self) -> None:
        rep, copies = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        raw = [row for h in self.held for row in h[2].to_pylist()]
        order, size = np.argsort(rep), self.width * self.kind.itemsize
        self.rep, self.copies = rep[order], copies[order]
        self.x = unit(np.stack([np.frombuffer(raw[i], self.kind, self.width) for i in order]))
        self.visits = np.full((len(raw), max((len(r) - size) // 4 for r in raw)), _NONE, "i4")
        for at, i in enumerate(order):
            self.visits[at, : (len(raw[i]) - size) // 4] = np.frombuffer(raw[i], "i4", offset=size)
        self.rough, self.graph = self.x.astype("f4"), both_ways(self.x, neighbours(self.x))
        self.start = medoids(self.x)
        self.links, self.label, self.held = np.zeros(len(raw), "i8"), np.arange(len(raw)), []

    def sure(self, x: np.ndarray, q: np.ndarray, m: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Which pairs of a unit vector and a row reach the range."""
        linked = value >= COSINE + _ROUGH
        near = np.flatnonzero(~linked)
        for part in range(0, len(near), 1 << 16):
            some = near[part : part + (1 << 16)]
            linked[some] = np.einsum("ij,ij->i", x[q[some]], self.x[m[some]]) >= COSINE
        return linked

    def at_home(self) -> None:
        """Links between home rows."""
        n = len(self.rep)
        for q, m, value in search(self.rough, self.graph, self.start, self.rough, np.zeros(n), np.arange(n)):
            linked = self.sure(self.x, q, m, value)
            q, m = q[linked], m[linked]
            self.links += np.bincount(q, self.copies[m], n).astype("i8")
            self.label = lowered(self.label, q, m)

    def guests(self, rep: np.ndarray, copies: np.ndarray, data: pa.Array) -> Iterator[pa.RecordBatch]:
        """Links of guests with home rows, but for those that the other's shard counts."""
        n = len(self.rep)
        raw = np.frombuffer(b"".join(data.to_pylist()), "u1").reshape(len(rep), -1)
        home = np.ascontiguousarray(raw[:, -8:]).view("i4")
        if self.exact:
            x = unit(np.ascontiguousarray(raw[:, :-8]).view(self.kind))
            rough, err = x.astype("f4"), np.zeros(len(rep))
        else:
            step = np.ascontiguousarray(raw[:, -16:-8]).view("f4")
            rough, err = raw[:, :-16].view("i1") * step[:, :1], step[:, 1].astype("f8")
        for q, m, value in search(self.rough, self.graph, self.start, rough, err):
            if self.exact:
                linked = self.sure(x, q, m, value)
            else:
                linked = value >= COSINE + _ROUGH + err[q]
                doubt = np.unique(q[~linked])
                yield _found(rep[doubt], shard=np.full(len(doubt), self.shard))
                linked &= ~np.isin(q, doubt)
            q, m = q[linked], m[linked]
            first, nth = np.unique(q, return_index=True)
            head = np.empty(len(rep), int)
            head[first] = m[nth]
            self.label = lowered(self.label, head[q], m)
            # where the home row is a guest of the guest's shard too, the lesser of both counts
            from_, part = home[q, 0], home[q, 1]
            later = (from_ < self.leaf) | ((from_ == self.leaf) & (part < self.part))
            counted = ~(later & (self.visits[m] == from_[:, None]).any(1))
            own = np.bincount(q[counted], self.copies[m[counted]], len(rep)).astype("i8")
            self.links += np.bincount(m[counted], copies[q[counted]], n).astype("i8")
            yield _found(rep[first], own[first], self.rep[head[first]])

    def finish(self) -> pa.RecordBatch:
        some = (self.links > 0) | (self.label != np.arange(len(self.label)))
        return _found(self.rep[some], self.links[some], self.rep[self.label[some]])


_FOUND = "rep long, links long, label long, shard long"


def _found(rep: np.ndarray, links: np.ndarray | None = None, label: np.ndarray | None = None, shard: np.ndarray | None = None) -> pa.RecordBatch:
    """What leaves a task: a row's links and a row that it is joined with, or that it is called to a shard."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(rep), pa.int64()) if c is None else pa.array(c.astype("i8")) for c in (rep, links, label, shard)], ["rep", "links", "label", "shard"])


def _searched(rows: DataFrame, deal: Deal, leaves: Leaves, kind: str, exact: bool) -> DataFrame:
    """_FOUND of all shards. A shard's home rows come before its guests, so that no task holds more of these than a batch."""
    width = np.zeros(leaves.n, int)
    for w, first in leaves.first.items():
        width[first : first + len(leaves.centres.get(w, [0]))] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: Task | None = None

        def ready() -> None:
            if task is not None and task.x is None and task.held:
                task.build()
                # home rows are in each block of their shard; their links with each other count in the first
                if task.block == 0 and not exact:
                    task.at_home()

        for batch in batches:
            at, rep, copies = (batch.column(c).to_numpy() for c in ("at", "rep", "copies"))
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                shard, guest = divmod(int(at[a]), 2)
                if task is None or task.shard != shard:
                    ready()
                    if task is not None and task.x is not None:
                        yield task.finish()
                    task = Task(shard, deal, int(width[deal.leaf[shard]]), kind, exact)
                data = batch.column("data").slice(a, b - a)
                if not guest:
                    task.add(rep[a:b], copies[a:b], data)
                    continue
                ready()
                if task.x is not None:
                    yield from task.guests(rep[a:b], copies[a:b], data)
        ready()
        if task is not None and task.x is not None:
            yield task.finish()

    return rows.repartition(F.shiftright("at", 1)).sortWithinPartitions("at").mapInArrow(run, _FOUND)


def audited(distinct: DataFrame, links: DataFrame) -> float:
    """Share of the links of AUDITED queries, chosen by a hash, that links (rep, links) has of those that all vectors give."""
    chosen = distinct.orderBy(F.xxhash64("rep", F.lit("audit")), "rep").limit(AUDITED).select("rep", "v").toArrow()
    ids = chosen["rep"].to_numpy()
    by_width = {v.shape[1]: (ids[rows], unit(v)) for rows, v in (_vectors(chosen["v"].combine_chunks()) if len(chosen) else ())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            for rows, v in _vectors(batch.column("v")):
                if v.shape[1] in by_width:
                    own, queries = by_width[v.shape[1]]
                    x = unit(v)
                    sims = queries.astype("f4") @ x.astype("f4").T
                    q, m = np.nonzero(sims >= COSINE - _ROUGH)
                    near = (sims[q, m] >= COSINE + _ROUGH) | (np.einsum("ij,ij->i", queries[q], x[m]) >= COSINE)
                    near &= own[q] != rep[rows[m]]
                    truth = np.bincount(q[near], copies[rows[m[near]]], len(own)).astype("i8")
                    yield pa.RecordBatch.from_arrays([pa.array(own[truth > 0]), pa.array(truth[truth > 0])], ["rep", "truth"])

    truth = distinct.select("rep", "copies", "v").mapInArrow(run, "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth"))
    row = truth.join(links, "rep", "left").agg(F.sum("truth").alias("truth"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return row["found"] / row["truth"] if row["truth"] else 1.0


def _linked(placed: DataFrame, leaves: Leaves) -> tuple[DataFrame, DataFrame]:
    """rep and links of each distinct vector that has any; pairs (a, b) that join the linked ones."""
    kind = "f4" if placed.schema["v"].dataType.simpleString() == "array<float>" else "f8"
    each = placed.select("leaf", F.explode("visits").alias("to"))
    counted = each.groupBy("to").agg(F.count(F.when(F.col("to") == F.col("leaf"), 1)).alias("home"), F.count(F.lit(1)).alias("n")).collect()
    parts, blocks = np.ones(leaves.n, "i8"), np.ones(leaves.n, "i8")
    for r in counted:
        parts[r["to"]] = max(1, math.ceil(r["home"] / SHARD))
        # home rows that are guests of the leaf's other parts, and those from elsewhere
        blocks[r["to"]] = max(1, math.ceil((r["n"] - r["home"] / parts[r["to"]]) / BLOCK))
    deal = Deal(parts, blocks)
    found = saved(_searched(dealt(placed, deal), deal, leaves, kind, False), "found")
    called = found.where("shard is not null").select("rep", "shard")
    if called.limit(1).count():
        again = saved(_searched(dealt_again(placed, called, deal), deal, leaves, kind, True), "found again")
        found = found.where("shard is null").unionByName(again)
    links = saved(found.groupBy("rep").agg(F.sum("links").alias("links")), "links")
    return links, found.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b"))


def link(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding); beside them the audited recall.

    Vectors are linked if their cosine in double precision is 0.9 or more. n_links counts the other rows linked directly, copies
    included; component_id is the smallest id that links reach. Null, zero and non-finite vectors link with nothing; vectors of
    different lengths neither. Equal vectors are one node, which the least of their ids stands for. A null id links with nothing
    and has a null component. Rows that repeat an id count as rows of their own, each with its vector's links, and are
    of one component. Equal cosines need no order: every pair at the threshold is linked. No rows in, no rows out. Only links that the
    graph search finds count; what leaves a task is one count and one label a row, never a shard's pairs.
    """
    distinct, widths = usable(vectors)
    leaves = fitted(distinct, widths)
    for attempt in range(ATTEMPTS):
        placed = saved(with_places(distinct, leaves, OVERLAP << 2 * attempt, MARGIN * 2**attempt), "placed")
        counts, edges = _linked(placed, leaves)
        recall = audited(placed, counts)
        if recall >= RECALL:
            break
    distinct = placed.select("id", "rep", "copies", "k1", "k2")
    same_id = distinct.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    labels = components(edges.unionByName(same_id)).withColumnRenamed("id", "rep")
    nodes = distinct.join(counts, "rep", "left").join(labels, "rep", "left")
    least = nodes.where("component is not null").groupBy("component").agg(F.min("id").alias("first"))
    nodes = nodes.join(least, "component", "left").select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "id").alias("component"))
    rows = vectors.select(F.col("vec_id").cast("long"), *_keys(_parts(F.col("embedding"))))
    joined = rows.join(nodes, ["k1", "k2"], "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.when(known, F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.lit(float(recall)).alias("audited_recall"),
    )
