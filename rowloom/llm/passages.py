"""Removal of passages that documents with smaller ids hold too, by fixed blocks of words and rolling windows.

Every document is a reference: its words 0 to 24, 25 to 49 and so on are blocks that are indexed by their hash. Any 50 words in a
row hold a whole block, so a passage of 50 words that another document shares is met when all of that document's 25-word windows
are looked up in the index. Index and windows meet in buckets of hashes; tasks send them packed, 4 bytes a window and the
differences of the documents' ids, mostly a byte, not a row each. A bucket's task holds its part of the index, with the smallest id of each
block, and streams the windows past it.

Hits are then extended in the documents that have any. All 50-word windows that hold a hit make its context, up to 75 words, which
is hashed from all of them (in two independent ways, 128 bits) and counted by hash, never by pairs. In documents that are not the
smallest of their context all of its windows go. Of blocks with several contexts, one document a context, the smallest, tells by
hashes of its single windows which of them start in a still smaller document. What goes, united, are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .minhash import mixed
from .suffixes import powers, prefix_sums, span_hashes

WINDOW = 50
#: The longest blocks of which any window holds a whole one.
BLOCK = WINDOW // 2
#: Bytes of text whose blocks make one bucket of the index, and the least number of buckets for each of Spark's cores.
BUCKET_BYTES, BUCKETS_A_CORE = 64 << 20, 4
#: Windows that a task packs at once, and bytes of text that it hashes at once.
_CHUNK, _TEXTS = 1 << 20, 1 << 20
#: Rows that a task gives at once.
_ROWS = 1 << 16
#: Rows whose texts a task holds as Python objects at once.
_SLICE = 256
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _edges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in bytes."""
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = ~_SPACE[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where it starts."""
    a = np.frombuffer(raw, "u1")
    starts, ends = _edges(a)
    return mixed(span_hashes(prefix_sums(a), starts, ends) + (ends - starts).astype("u8")), starts


def _rolling(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each `width` words in a row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, "u8")
    up, down = powers(len(words) + 1)
    each = mixed(words + _U(salt)) if salt else words
    sums = np.zeros(len(words) + 1, "u8")
    np.cumsum(each * up[: len(words)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[:n] + _U(salt))


def _block_hashes(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of texts: the hash of each 25-word window, the number of its text, and whether it is one of its text's blocks."""
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= _TEXTS):
            size += len(raws[end]) + 1
            end += 1
        words, starts = _words(b" ".join(raws[at:end]))
        offsets = np.cumsum([0] + [len(r) + 1 for r in raws[at:end]])
        bounds = np.searchsorted(starts, offsets)
        text = np.repeat(np.arange(end - at), np.diff(bounds))
        place = np.arange(len(words)) - bounds[text]
        hashes = _rolling(words, BLOCK)
        n = len(hashes)
        whole = text[:n] == text[BLOCK - 1 :] if n else np.zeros(0, bool)
        yield hashes[whole], text[:n][whole] + at, (place[:n] % BLOCK == 0)[whole]
        at = end


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in order, as differences of as many bytes as the largest needs, and that number; the first in full."""
    steps = np.diff(values)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) < 1 << (8 * w))
    return bytes([width]) + values[:1].tobytes() + steps.astype(f"u{width}").tobytes()


def _widened(raw: pa.Buffer) -> np.ndarray:
    width = raw[0]
    out = np.empty((raw.size - 9) // width + 1, "i8")
    out[0] = np.frombuffer(raw, "i8", 1, 1)[0]
    out[1:] = np.frombuffer(raw, f"u{width}", -1, 9)
    return np.cumsum(out, out=out)


_PACK = "bucket int, probes boolean, hashes binary, ids binary"


def _packs(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks (probes: false) and all windows (true) of texts (doc_id, raw), by bucket: the low 4 bytes of their hashes, and ids."""

    def packed(hashes: np.ndarray, ids: np.ndarray, probes: bool) -> pa.RecordBatch:
        # by bucket and, within it, by id, so that differences of ids are small
        order = np.argsort(ids, kind="stable")
        bucket = ((hashes >> _U(32)) % _U(buckets)).astype("u2" if buckets <= 1 << 16 else "u4")[order]
        by = np.argsort(bucket, kind="stable")
        order = order[by]
        low, ids = (hashes & _U(0xFFFFFFFF)).astype("u4")[order], ids[order]
        held, first = np.unique(bucket[by], return_index=True)
        parts = list(zip(first.tolist(), [*first[1:].tolist(), len(low)], strict=True))
        columns = [pa.array(held.astype("i4")), pa.array([probes] * len(held)), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([_narrow(ids[a:b]) for a, b in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "probes", "hashes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, ids, block = (np.concatenate(c) for c in zip(*held, strict=True))
            yield packed(hashes, ids, True)
            yield packed(hashes[block], ids[block], False)

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                own = part.column("doc_id").to_numpy(zero_copy_only=False)
                for hashes, text, block in _block_hashes(part.column("raw").to_pylist()):
                    held.append((hashes, own[text], block))
                    size += len(hashes)
                    if size >= _CHUNK:
                        yield from flush()
                        held, size = [], 0
        if size:
            yield from flush()

    return texts.mapInArrow(run, _PACK)


def _hits(packs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, block (bucket and low bytes of its hash): windows that are blocks of smaller documents, and those blocks in the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, index = None, [], None

        def batched(own: int, ids: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + _ROWS], pa.int64()), pa.array(low[at : at + _ROWS].astype("i8") | (own << 32), pa.int64())], ["doc_id", "block"])

        for batch in batches:
            for own, probes, hashes, ids in zip(*(batch.column(c) for c in ("bucket", "probes", "hashes", "ids")), strict=True):
                own, probes, hashes, ids = own.as_py(), probes.as_py(), hashes.as_buffer(), ids.as_buffer()
                if own != bucket:
                    if index is not None:
                        yield from batched(bucket, index[1][index[2]], index[0][index[2]])
                    bucket, parts, index = own, [], None
                low, docs = np.frombuffer(hashes, "u4"), _widened(ids)
                if not probes:
                    parts.append((low, docs))
                    if len(parts) > 64:
                        parts = [_least(parts)]
                    continue
                if index is None:
                    keys, least = _least(parts) if parts else (np.zeros(0, "u4"), np.zeros(0, "i8"))
                    parts, index = [], (keys, least, np.zeros(len(keys), bool))
                    near = np.zeros(1 << 22, bool)
                    near[keys >> 10] = True
                keys, least, met = index
                some = np.flatnonzero(near[low >> 10])
                if not len(keys) or not len(some):
                    continue
                low, docs = low[some], docs[some]
                place = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
                later = (keys[place] == low) & (least[place] < docs)
                met[place[later]] = True
                yield from batched(own, docs[later], low[later])
        if index is not None:
            yield from batched(bucket, index[1][index[2]], index[0][index[2]])

    return packs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "probes").mapInArrow(run, "doc_id long, block long")


def _least(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, each with its smallest id."""
    low, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, low))
    low, ids = low[order], ids[order]
    first = np.ones(len(low), bool)
    first[1:] = low[1:] != low[:-1]
    return low[first], ids[first]


class _Text:
    """Hashes of stretches of one text's words, in two independent ways."""

    def __init__(self, raw: bytes):
        self.words = _words(raw)[0]
        up, self.down = powers(len(self.words) + 1)
        self.sums = []
        for salt in (0, 0x5851F42D4C957F2D):
            each = mixed(self.words + _U(salt)) if salt else self.words
            self.sums.append(np.concatenate([np.zeros(1, "u8"), np.cumsum(each * up[: len(each)])]))

    def blocks(self, buckets: int) -> np.ndarray:
        """The bucket and the low bytes of the hash of each 25-word window."""
        hashes = _rolling(self.words, BLOCK)
        return ((((hashes >> _U(32)) % _U(buckets)) << _U(32)) | (hashes & _U(0xFFFFFFFF))).view("i8")

    def hashes(self, first: np.ndarray, last: np.ndarray, inner: np.ndarray | int = 0) -> list[np.ndarray]:
        """Of stretches of words; inner tells apart what agrees in its words."""
        salt = np.asarray(inner, "u8") * _U(0x9E3779B97F4A7C15)
        return [mixed((s[last] - s[first]) * self.down[first] + salt).view("i8") for s in self.sums]

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of all windows that hold the block at each place."""
        return np.maximum(at - (WINDOW - BLOCK), 0), np.minimum(at + WINDOW, len(self.words))

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Where the windows start that hold one of the blocks at these places."""
        n = max(len(self.words) - WINDOW + 1, 0)
        depth = np.zeros(n + 1, "i4")
        if n:
            np.add.at(depth, np.maximum(at - (WINDOW - BLOCK), 0), 1)
            np.add.at(depth, np.minimum(at, n - 1) + 1, -1)
        return np.flatnonzero(np.cumsum(depth)[:n])


def _mapped(rows: DataFrame, schema: str, columns: list[str], one) -> DataFrame:
    """one(*values of a row) gives a dict of arrays of equal lengths; all of them as rows."""
    kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                for values in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                    found = one(*values)
                    for begin in range(0, len(next(iter(found.values()))), _ROWS):
                        arrays = [pa.array(found[c][begin : begin + _ROWS], arrow[kinds[c]]) for c in kinds]
                        held.append(pa.RecordBatch.from_arrays(arrays, list(kinds)))
                        size += held[-1].num_rows
                if size >= _ROWS or held and len(held) >= _SLICE:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
        if held and size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows.select(*columns).mapInArrow(run, schema)


def _hit_places(rows: DataFrame, buckets: int) -> DataFrame:
    """doc_id, raw, at: of rows (doc_id, raw, blocks) the places of their hits, in texts of at least a window; else null."""

    def one(doc_id: int | None, raw: bytes | None, blocks: list[int] | None) -> dict:
        at = None
        if blocks:
            text = _Text(raw)
            if len(text.words) >= WINDOW:
                at = np.flatnonzero(np.isin(text.blocks(buckets), np.array(blocks, "i8"))).tolist() or None
        return {"doc_id": [doc_id], "raw": [raw], "at": [at]}

    return _mapped(rows, "doc_id long, raw binary, at array<int>", ["doc_id", "raw", "blocks"], one)


def _contexts(live: DataFrame, buckets: int) -> DataFrame:
    """block, c1, c2, doc_id of each hit: what a context agrees in, its windows agree in."""

    def one(doc_id: int, raw: bytes, at: list[int]) -> dict:
        text, at = _Text(raw), np.array(at)
        first, last = text.contexts(at)
        c1, c2 = text.hashes(first, last, at - first + 1)
        return {"block": text.blocks(buckets)[at], "c1": c1, "c2": c2, "doc_id": np.full(len(at), doc_id)}

    return _mapped(live, "block long, c1 long, c2 long, doc_id long", ["doc_id", "raw", "at"], one)


def _candidates(rows: DataFrame) -> DataFrame:
    """h1, h2, doc_id of the windows of rows (doc_id, raw, at, open) that hold a hit whose context is open."""

    def one(doc_id: int, raw: bytes, at: list[int], open_: list[int]) -> dict:
        text, at = _Text(raw), np.array(at)
        first, last = text.contexts(at)
        mine = np.isin(text.hashes(first, last, at - first + 1)[0], np.array(open_, "i8"))
        starts = text.windows(at[mine])
        h1, h2 = text.hashes(starts, starts + WINDOW)
        return {"h1": h1, "h2": h2, "doc_id": np.full(len(starts), doc_id)}

    return _mapped(rows, "h1 long, h2 long, doc_id long", ["doc_id", "raw", "at", "open"], one)


def _removed(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, raw, at, whole, gone): the words that no gone window, and no context that goes as a whole, covers."""

    def one(doc_id: int | None, raw: bytes | None, at: list[int] | None, whole: list[int] | None, gone: list[int] | None) -> dict:
        parts = (raw or b"").split()
        left = parts
        if whole or gone:
            text, at = _Text(raw), np.array(at)
            first, last = text.contexts(at)
            mine = np.isin(text.hashes(first, last, at - first + 1)[0], np.array(whole or [], "i8"))
            starts = text.windows(at)
            starts = starts[np.isin(text.hashes(starts, starts + WINDOW)[0], np.array(gone or [], "i8"))]
            depth = np.zeros(len(parts) + 1, "i4")
            for begin, end in ((first[mine], last[mine]), (starts, starts + WINDOW)):
                np.add.at(depth, begin, 1)
                np.add.at(depth, end, -1)
            left = [w for w, d in zip(parts, np.cumsum(depth).tolist(), strict=False) if not d]
        return {"doc_id": [doc_id], "n_words": [len(parts)], "n_removed": [len(parts) - len(left)], "kept": [b" ".join(left)]}

    return _mapped(rows, "doc_id long, n_words long, n_removed long, kept binary", ["doc_id", "raw", "at", "whole", "gone"], one)


def without_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by one space, as bytes) of every row of docs (doc_id, text).

    A word goes if 50 words in a row that cover it also start in a row with a smaller id; windows are judged on the input. Words
    are runs of anything but six white-space characters of ASCII, unchanged. Null and empty texts have no words. Rows that repeat
    an id are no smaller than each other, but each counts for larger ids; a null id is neither smaller nor larger than another,
    and its row stays whole. An empty table gives no rows; other columns are left behind. Long texts are read whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("raw"))
    able = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("raw") >= 2 * WINDOW - 1))
    size = able.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), spark.sparkContext.defaultParallelism * BUCKETS_A_CORE)
    hits = saved(_hits(_packs(able, buckets), buckets), "hits")
    blocks = hits.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("block").alias("blocks"))
    # texts have any length, so no side is broadcast
    met = texts.join(blocks.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "raw", "blocks")
    placed = saved(_hit_places(met, buckets), "places")
    live = placed.where("at is not null")
    contexts = saved(_contexts(live, buckets), "contexts")
    # one row a context, whatever number of documents holds it; what is joined below is written first, so that hot keys can be split
    classes = saved(contexts.groupBy("block", "c1", "c2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "classes")
    later = contexts.join(classes.where("least < most").select("c1", "c2", "least").hint("merge"), ["c1", "c2"]).where("doc_id > least")
    whole = later.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("c1").alias("whole"))
    several = saved(classes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"), "several")
    opened = classes.join(several.hint("merge"), "block").groupBy(F.col("least").alias("id")).agg(F.collect_set("c1").alias("open"))
    windows = saved(_candidates(live.join(opened.hint("merge"), F.col("doc_id") == F.col("id"))), "windows")
    least = saved(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "least")
    gone = windows.join(least.hint("merge"), ["h1", "h2"]).where("doc_id > least").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("h1").alias("gone"))
    cuts = whole.join(gone, "id", "full")
    none = F.lit(None).cast("array<long>")
    untouched = _removed(placed.where("at is null").select("doc_id", "raw", "at", none.alias("whole"), none.alias("gone")))
    return untouched.unionByName(_removed(live.join(cuts.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "raw", "at", "whole", "gone")))
