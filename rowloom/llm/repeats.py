"""Removal of every byte that lies in a string of 400 bytes found twice or more, by suffix arrays of shards.

Each 400-byte window of a text has an anchor, the least-hashed 64-byte stretch within it; windows with one anchor are neighbours
and make a context. Equal windows have equal anchors in equal places, and so agree in the 232 bytes or more around the anchor
that lie within them: those are the key by which contexts meet. Contexts that are equal as a whole are counted; different
contexts under one key are put into one shard, whose suffix array and common prefixes tell which of their windows recur. Where a
key has more different contexts than a shard takes, each is halved by where its windows lie around the key's bytes: either half
agrees in more of them, which makes longer keys, until few contexts share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .minhash import mixed
from .suffixes import common_prefixes, prefix_sums, span_hashes, suffix_array

LENGTH, ANCHOR = 400, 64
_REACH = LENGTH - ANCHOR + 1  # anchors in a window
_LEFT = _REACH // 2
#: Bytes of contexts that one suffix array takes; a key's contexts stay together.
SHARD = 1 << 20
#: Bytes of different contexts under one key beyond which they are halved.
HOT = 4 << 20
_U = np.uint64
_SEPARATOR = 0xFF  # no byte of UTF-8
#: Texts are read in stretches of so many window starts, which bounds memory.
_STRETCH = 1 << 20
_INDEX = 21


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by running minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo("u8").max, "u8")
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def contexts(raw: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, hash of the whole context, first and last window start, and core, of each context of a text; by stretches.

    core: the key's first byte behind the first window's start, twice, and one more if the key has LEFT_KEY bytes, not RIGHT_KEY.
    """
    whole, out = np.frombuffer(raw, "u1"), []
    for base in range(0, max(len(whole) - LENGTH + 1, 0), _STRETCH):
        a = whole[base : base + _STRETCH + LENGTH - 1]
        sums = prefix_sums(a)
        place = np.arange(len(a) - ANCHOR + 1)
        hashes = mixed(span_hashes(sums, place, place + ANCHOR))
        # the low bits say where, so that the least is also the first of equals
        least = _sliding_least((hashes >> _U(_INDEX) << _U(_INDEX)) | place.astype("u8"), _REACH)
        anchor = (least & _U((1 << _INDEX) - 1)).astype("i8")
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(anchor) - 1]])
        at = anchor[first]
        # windows that reach far to the left of the anchor, and the others, which reach far to its right
        for left in (True, False):
            low = first if left else np.maximum(first, at - _LEFT + 1)
            high = np.minimum(last, at - _LEFT) if left else last
            some = low <= high
            low, high, mid = low[some], high[some], at[some]
            begin, end = (mid - _LEFT, mid + ANCHOR) if left else (mid, mid + LENGTH - _LEFT + 1)
            key = mixed(span_hashes(sums, begin, end) + _U(1 + left))
            context = mixed(span_hashes(sums, low, high + LENGTH) + (high - low).astype("u8") * _U(0x9E3779B97F4A7C15))
            out.append((key.view("i8"), context.view("i8"), low + base, high + base, (begin - low) * 2 + left))
    return out


def _occurrences(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                rows, columns = [], []
                for i, text in enumerate(part["text"]):
                    for found in contexts(text.encode("utf-8", "surrogatepass")) if text else ():
                        rows.append(np.full(len(found[0]), i))
                        columns.append(found)
                if columns:
                    row = np.concatenate(rows)
                    key, context, low, high, core = (np.concatenate(c) for c in zip(*columns, strict=True))
                    own = {"doc_id": part["doc_id"].array[row], "text_key": part["text_key"].to_numpy()[row]}
                    yield pd.DataFrame(own | {"key": key, "context": context, "low": low, "high": high, "core": core.astype("i2")})

    return texts.mapInPandas(run, "doc_id long, text_key long, key long, context long, low long, high long, core short")


def repeated_windows(pieces: list[bytes]) -> list[list[tuple[int, int]]]:
    """Of each piece, the ranges of starts of windows that recur in another place of these pieces."""
    joined = np.frombuffer(bytes([_SEPARATOR]).join(pieces) + bytes([_SEPARATOR]), "u1")
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    valid = np.zeros(len(joined) + 1, "i4")
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + sizes - LENGTH + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    sums = prefix_sums(joined)
    sa = suffix_array(joined, sums)
    shared = common_prefixes(joined, sa, sums, 4 * LENGTH + 2 * int(sizes.max(initial=0)))[sa]
    group = np.cumsum(shared < LENGTH)
    counts = np.bincount(group[valid[sa]], minlength=int(group[-1]) + 1)
    recurs = np.zeros(len(joined) + 1, "i1")
    recurs[sa] = valid[sa] & (counts[group] >= 2)
    edges = np.diff(np.concatenate([[0], recurs]))
    up, down = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) - 1
    owner = np.searchsorted(begin, up, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for i, a, b in zip(owner.tolist(), (up - begin[owner]).tolist(), (down - begin[owner]).tolist(), strict=True):
        out[i].append((a, b))
    return out


_OWN = "owner_key long, owner_context long, shift long, n long"
_MARKS = "key long, context long, firsts array<long>, lasts array<long>"


def _contested(pieces: DataFrame) -> DataFrame:
    """Marks of contexts that occur once: the ranges of their windows that recur in others. A key's rows must share a partition in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[tuple, bytes]] = []
        size, last = 0, None

        def flush() -> pd.DataFrame:
            found = repeated_windows([raw for _, raw in held])
            rows = [(k, c, [a + shift for a, _ in f], [b + shift for _, b in f]) for ((k, c, shift, n), _), f in zip(held, found, strict=True) if f and n == 1]
            return pd.DataFrame(rows, columns=["key", "context", "firsts", "lasts"])

        for batch in batches:
            for key, raw, *own in zip(batch["key"], batch["raw"], *(batch[c] for c in ("owner_key", "owner_context", "shift", "n")), strict=True):
                if size >= SHARD and key != last:
                    yield flush()
                    held, size = [], 0
                held.append((tuple(own), bytes(raw)))
                size, last = size + len(raw), key
        if held:
            yield flush()

    return pieces.repartition("key").sortWithinPartitions("key").mapInPandas(run, _MARKS)


def _halved(pieces: DataFrame) -> DataFrame:
    """Each context's windows in two halves: those that reach farther to the left of the key's bytes, and the others, under longer keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "text_key", "owner_key", "owner_context", "n"]
        for batch in batches:
            rows = []
            for raw, low, begin, end, shift, *own in zip(*(batch[c] for c in ("raw", "low", "begin", "end", "shift", *columns)), strict=True):
                sums, high = prefix_sums(np.frombuffer(raw, "u1")), len(raw) - LENGTH
                middle = (LENGTH - end + begin) // 2
                # windows whose start lies more than `middle` before the key, and the others
                for left, first, last, b, e in ((1, 0, min(high, begin - middle - 1), begin - middle - 1, end), (0, max(0, begin - middle), high, begin, begin + LENGTH - middle)):
                    if first <= last:
                        key, context = (int(x) for x in mixed(span_hashes(sums, np.array([b, first]), np.array([e, last + LENGTH])) + np.array([3 + left, last - first], "u8")).view("i8"))
                        rows.append((key, context, low + first, low + last, b - first, e - first, shift + first, *own))
            yield pd.DataFrame(rows, columns=["key", "context", "low", "high", "begin", "end", "shift", *columns])

    return pieces.mapInPandas(run, f"key long, context long, low long, high long, begin int, end int, doc_id long, text_key long, {_OWN}")


def _pieces(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the bytes of their windows, raw. Rows of texts that share id and text hold the same bytes; one of each will do."""
    wanted = rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in ("doc_id", "text_key")))).alias("parts"))
    wanted = wanted.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "own")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("own")))
    found = found.select("doc_id", "text_key", F.col("text").cast("binary").alias("bytes"), F.explode("parts").alias("part"))
    assert LENGTH == 400
    raw = F.expr("substring(bytes, cast(part.low + 1 as int), cast(part.high - part.low as int) + 400)").alias("raw")
    return found.select("doc_id", "text_key", "part.*", raw).dropDuplicates(["key", "context", "owner_key", "owner_context"])


def _partial_marks(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Marks of contexts that occur once but some of whose windows recur. rows: distinct contexts with what _OWN and _halved() name."""
    marks = rows.sparkSession.createDataFrame([], _MARKS)
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("high") - F.col("low") + LENGTH).alias("bytes")).where("c > 1")
        live = saved(rows.join(sizes.select("key", (F.col("bytes") > HOT).alias("hot")), "key"), "live")
        marks = marks.unionByName(saved(_contested(_pieces(texts, live.where("not hot").drop("hot"))), "partly"))
        hot = live.where("hot").drop("hot")
        if hot.limit(1).count() == 0:
            return marks
        halves = saved(_halved(_pieces(texts, hot)), "halves")
        columns = [c for c in halves.columns if c not in ("key", "context", "n")]
        counts = halves.groupBy("key", "context").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("n"), F.min(F.struct(*columns)).alias("one"))
        again = halves.where("n = 1").join(counts.where("times > 1").select("key", "context"), ["key", "context"])
        again = again.select(F.col("owner_key").alias("key"), F.col("owner_context").alias("context"), F.array("shift").alias("firsts"), F.array(F.col("shift") + F.col("high") - F.col("low")).alias("lasts"))
        marks = marks.unionByName(saved(again, "again"))
        rows = counts.select("key", "context", F.greatest("times", "n").alias("n"), "one.*")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, firsts, lasts: of each text with any, the ranges of starts of windows that recur anywhere."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    found = _occurrences(texts.where(F.octet_length("text") >= LENGTH))
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = saved(found.join(saved(twice, "keys"), "key"), "met")
    distinct = met.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "low", "high", "core")).alias("one"))
    distinct = saved(distinct.select("key", "context", "n", "one.*"), "contexts")
    whole = distinct.where("n > 1").select("key", "context", F.array(F.lit(0).cast("long")).alias("firsts"), F.array(F.col("high") - F.col("low")).alias("lasts"))
    begin = F.shiftright("core", 1)
    end = begin + F.when(F.col("core") % 2 == 1, _LEFT + ANCHOR).otherwise(LENGTH - _LEFT + 1)
    own = [F.col("key").alias("owner_key"), F.col("context").alias("owner_context"), F.lit(0).cast("long").alias("shift")]
    marks = whole.unionByName(_partial_marks(texts, distinct.select("key", "context", "n", "doc_id", "text_key", "low", "high", begin.alias("begin"), end.alias("end"), *own)))
    placed = met.join(marks, ["key", "context"]).select(
        "doc_id", "text_key", F.transform("firsts", lambda x: x + F.col("low")).alias("firsts"), F.transform("lasts", lambda x: x + F.col("low")).alias("lasts")
    )
    return placed.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and text (these as characters, torn ones left out) of every row of docs (doc_id, text).

    A byte goes if a 400-byte string that covers it also starts anywhere else, in its own text too; strings are judged on the
    input and never cross texts. Null text is empty. Rows that repeat an id and text are copies of each other and lose all bytes
    if they have 400. Empty tables give no rows. A task sorts the suffixes of a bounded number of bytes.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    # rows of any length, so no broadcast at any size: texts are shuffled to them
    marks = removals(docs).withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "own")
    joined = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("own")), "left").select("doc_id", "text", "firsts", "lasts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                part = batch.iloc[at : at + 500]
                for text, firsts, lasts in zip(part["text"], part["firsts"], part["lasts"], strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    if firsts is None:
                        rows.append((len(raw), 0, 0, raw, text or ""))
                        continue
                    depth = np.zeros(len(raw) + 1, "i4")
                    np.add.at(depth, np.asarray(firsts, "i8"), 1)
                    np.add.at(depth, np.asarray(lasts, "i8") + LENGTH, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype("i1")])) > 0))
                    left = np.frombuffer(raw, "u1")[~gone].tobytes()
                    rows.append((len(raw), int(gone.sum()), spans, left, left.decode("utf-8", "ignore")))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "text"])
                out.insert(0, "doc_id", part["doc_id"].array)
                yield out

    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string")
