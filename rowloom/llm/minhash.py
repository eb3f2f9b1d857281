"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and stars of candidates.

A document's shingles are hashed once. The top bits of a hash choose one of 256 bins, each of which keeps its least hash; an
empty bin borrows from the filled bin that comes first in the bin's own random order of all bins. Five bins make a band; equal
bands put documents in a bucket. In each bucket one hub, the document that shares most buckets, is compared with all others:
n - 1 pairs, not n * (n - 1) / 2. Links are confirmed on the full sets. A bucket that still holds several components is split by
further bins, several ways; in each part a member of its smallest component is the hub of a second star, against the members of
other components. That is repeated until a round confirms no link, which leaves few components. Then every pair of different
components that a bucket still holds is tested, but for those that sizes or bins prove to be no link. These pairs can be many
times the documents in them, so no text is sent out for a pair: documents are dealt to blocks, and a task tests all pairs of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved, small
from .components import components

SHINGLE = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 75
BINS, BANDS, ROWS = 256, 40, 5
#: Members compared with one hub by one task; a hub with more is spread over several.
STAR = 256
#: Ways in which a bucket of several components is split, and the further bins that split it.
WAYS, FURTHER = 2, 2
#: Members of a bucket that a task compares with as many others at once.
TILE = 2048
#: Shingles, about, of the documents of a block; a document counts as so many at least, which bounds the pairs of two blocks.
BLOCK, LEAST = 1 << 18, 256

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mixed(np.arange(1, 257, dtype="u8") * _U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD6E8FEB86659FD93
_ODD = mixed(np.arange(1, 65, dtype="u8")) | _U(1)
_ORDER = np.random.default_rng(5).permuted(np.tile(np.arange(BINS, dtype="u2"), (BINS, 1)), axis=1)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, 2 ** bits of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(1 << bits, base, "u8")
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of an ASCII-lower-cased text, in order."""
    a = np.frombuffer(raw, "u1")
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = ~_SPACE[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(max(17, int(len(a)).bit_length()))
    sums = np.zeros(len(a) + 1, "u8")
    np.cumsum(_BYTES[a] * powers[: len(a)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype("u8"))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if it is shorter; none without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if not n:
        return words
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, width, "u8")
    for k in range(width):
        total += words[k : n - width + 1 + k] * _ODD[k]
    return np.unique(mixed(total))


def filled_bins(found: np.ndarray) -> np.ndarray:
    """Which bins have a hash of their own."""
    filled = np.zeros(BINS, bool)
    filled[found >> _U(56)] = True
    return filled


def bins(found: np.ndarray) -> np.ndarray:
    """The densified bins of a non-empty sorted set of hashes."""
    first = np.searchsorted(found, np.arange(BINS, dtype="u8") << _U(56))
    filled = filled_bins(found)
    values = found[np.minimum(first, len(found) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        full = np.flatnonzero(filled)
        values[empty] = values[full[_ORDER[np.ix_(empty, full)].argmin(1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """Keys of the bands of bins."""
    grouped = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = (grouped * _ODD[8 : 8 + ROWS]).sum(1, dtype="u8") + np.arange(1, BANDS + 1, dtype="u8") * _U(0x9E3779B97F4A7C15)
    return mixed(keys).view("i8")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two keys of the set, the band keys, a byte of each bin and a bit of each that is filled (null for an empty set) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, rows = batch.iloc[at : at + 1000], []
                for text in part["text"]:
                    found = shingles(text)
                    keys = (int(found.sum(dtype="u8").astype("i8")), int(mixed(found).sum(dtype="u8").astype("i8")))
                    values = bins(found) if len(found) else None
                    rows.append((len(found), *keys, *((None, None, None) if values is None else (bands(values), values.astype("u1").tobytes(), np.packbits(filled_bins(found)).tobytes()))))
                out = pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "bands", "sketch", "filled"])
                out.insert(0, "doc_id", part["doc_id"].array)
                yield out

    return documents(docs).mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary, filled binary")


def _shared(rows: DataFrame) -> DataFrame:
    """Those of rows (bucket, ...) whose bucket has another row; they are shuffled once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, wanted = None, False  # the last row, which the next batch may share a bucket with
        for batch in batches:
            if not len(batch):
                continue
            every = batch if last is None else pd.concat([last, batch])
            bucket = every["bucket"].to_numpy()
            keep = np.zeros(len(every), bool)
            keep[0] = wanted
            same = bucket[1:] == bucket[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            last, wanted = every.iloc[-1:], bool(keep[-1])
            yield every.iloc[:-1][keep[:-1]]
        if wanted:
            yield last

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, rows.schema)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (hub, member), those whose full sets are similar enough.

    A hub's members are dealt to tasks by hub and, for a hub with many, by member; each task reads the hub's text first and
    holds one set at a time beside it.
    """
    degree = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("shares"))
    hubs = degree.select("hub", F.col("hub").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    members = pairs.join(degree, "hub").select("hub", F.col("member").alias("doc_id"), F.pmod(F.xxhash64("member"), F.col("shares")).cast("int").alias("share"))
    wanted = hubs.withColumn("role", F.lit(0)).unionByName(members.withColumn("role", F.lit(1)))
    texts = documents(docs).dropna(subset=["doc_id"])
    # few rows without texts: sent to the texts where their count allows, so that only wanted texts are shuffled
    rows = texts.join(small(saved(wanted, "wanted")), "doc_id").repartition("hub", "share").sortWithinPartitions("hub", "share", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, []
        for batch in batches:
            out = []
            for hub, share, role, doc_id, text in zip(batch["hub"].array, batch["share"].array, batch["role"].array, batch["doc_id"].array, batch["text"], strict=True):
                found = shingles(text)
                if role == 0:
                    own = [*own, found] if at == (hub, share) else [found]  # rows that share the hub's id
                    at = (hub, share)
                    continue
                for other in own:
                    both = len(np.intersect1d(found, other, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(found) + len(other) - both):
                        out.append((hub, doc_id))
                        break
            yield pd.DataFrame(out, columns=["hub", "member"])

    return rows.select("hub", "share", "role", "doc_id", "text").mapInPandas(run, "hub long, member long")


def _second_stars(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (hub, member) of rows (bucket, doc_id, n_shingles, component) of buckets that hold several components."""
    way = F.explode(F.array(*(F.lit(w) for w in range(WAYS))))
    at = F.pmod(F.xxhash64("bucket", "way"), F.lit(BINS - FURTHER)).cast("int") + 1
    split = rows.join(sketches.dropDuplicates(["doc_id"]), "doc_id").withColumn("way", way).withColumn("part", F.xxhash64("bucket", "way", F.substring("sketch", at, F.lit(FURTHER))))
    split = split.select("part", "doc_id", "n_shingles", "component")
    sizes = split.groupBy("part", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "n_shingles")).alias("one"))
    hubs = sizes.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("size", "component", "one")).alias("hub")).where("c > 1")
    hubs = hubs.select("part", F.col("hub.component").alias("hub_component"), F.col("hub.one.doc_id").alias("hub"), F.col("hub.one.n_shingles").alias("hub_n"))
    alike = 100 * F.least("n_shingles", "hub_n") >= PERCENT * F.greatest("n_shingles", "hub_n")
    return split.join(hubs, "part").where((F.col("component") != F.col("hub_component")) & alike).select("hub", F.col("doc_id").alias("member")).distinct()


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bins (bytes, filled) that prove a shingle to be in one set alone, of one set and each of others.

    If the least hashes of a bin differ, the lower of them is in one set only; so is any of a bin that the other leaves empty.
    """
    return ((a[1] ^ b[1]) | (a[1] & b[1] & (a[0] != b[0]))).sum(1)


def _blocks(rows: DataFrame) -> DataFrame:
    """doc_id and block of every document of rows (bucket, doc_id, n_shingles, component).

    Documents of one block mostly share buckets: their buckets have the same smallest component. What a block holds decides only
    how often a text is moved.
    """
    lows = rows.groupBy("bucket").agg(F.min("component").alias("low"))
    family = rows.join(lows, "bucket").groupBy("doc_id").agg(F.min("low").alias("family"), F.greatest(F.max("n_shingles"), F.lit(LEAST)).alias("n"))
    sizes = family.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    return family.join(sizes, "family").select("doc_id", F.xxhash64("family", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("block"))


def _untested(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (hub, member) of different components that share a bucket, but for those that sizes or bins rule out, and their blocks (low, high).

    rows (bucket, doc_id, n_shingles, component, block) are of buckets of several components; signed has the documents' bins. The
    largest component's members are never paired with each other. Both they and the rest are dealt to tiles, and pairs of tiles to
    tasks. A pair comes more than once only if rows share an id.
    """
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("all"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.select("bucket", F.col("most.component").alias("major"), tiles(F.col("most.size")).alias("n_major"), tiles(F.col("all") - F.col("most.size")).alias("n_minor"))
    # tiles of the largest component have numbers below zero
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    is_major = F.col("component") == F.col("major")
    dealt = rows.join(sizes, "bucket").withColumn("tile", F.when(is_major, -1 - place(F.col("n_major"))).otherwise(place(F.col("n_minor"))))
    others = F.sequence(F.when(is_major, 0).otherwise(-F.col("n_major")), F.col("n_minor") - 1)
    dealt = dealt.select("bucket", "tile", "doc_id", "n_shingles", "component", "block", F.explode(others).alias("other"))
    dealt = dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")
    # bins are wide: they come last, and are shuffled to the tiles once
    dealt = dealt.join(signed.select("doc_id", "n_shingles", "bands", "sketch", "filled"), ["doc_id", "n_shingles"]).where(F.array_contains("bands", F.col("bucket")))
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "tile")

    def pairs(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, component = (group[c].to_numpy() for c in ("n_shingles", "component"))
        keys = np.stack(group["bands"].to_list())
        sketch = np.frombuffer(b"".join(group["sketch"]), "u1").reshape(-1, BINS)
        filled = np.unpackbits(np.frombuffer(b"".join(group["filled"]), "u1")).reshape(-1, BINS).astype(bool)
        bucket, low, high = (group[c].iloc[0] for c in ("bucket", "low", "high"))
        first = len(group) if low == high else int(np.searchsorted(group["tile"].to_numpy(), high))
        for i in range(first):
            j = np.arange(i + 1 if low == high else first, len(group))
            j = j[(component[j] != component[i]) & (100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i]))]
            j = j[(100 + PERCENT) * differing((sketch[i], filled[i]), (sketch[j], filled[j])) <= (100 - PERCENT) * (n[i] + n[j])]
            # a pair of several buckets belongs to the first of them
            j = j[keys[j, (keys[j] == keys[i]).argmax(1)] == bucket]
            if len(j):
                yield np.full(len(j), i), j

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            ids, block = group["doc_id"].to_numpy(), group["block"].to_numpy()
            held, size = [], 0

            def out() -> pd.DataFrame:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                return pd.DataFrame({"low": np.minimum(block[a], block[b]), "high": np.maximum(block[a], block[b]), "hub": ids[a], "member": ids[b]})

            for some in pairs(group):
                held.append(some)
                size += len(some[0])
                if size >= 100_000:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

        yield from _by_group(batches, ["bucket", "low", "high"], found)

    return dealt.mapInPandas(run, "low long, high long, hub long, member long")


def _by_group(batches: Iterator[pd.DataFrame], columns: list[str], found: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """What found gives for each run of rows that agree in columns."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = batch[columns].to_numpy()
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), len(batch)]
        if held and (held[0][columns].to_numpy()[0] != at[0]).any():
            yield from found(pd.concat(held))
            held = []
        for start, end in zip(starts, starts[1:], strict=False):
            held.append(batch.iloc[start:end])
            if end < len(batch):
                yield from found(pd.concat(held))
                held = []
    if held:
        yield from found(pd.concat(held))


class _Sets:
    """Sets of shingles by document, and which pairs of documents are similar enough."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = np.argsort(np.array(ids, "i8"), kind="stable")
        self.ids = np.array(ids, "i8")[order]
        self.sizes = np.array([len(s) for s in sets], "i8")[order]
        self.ends = np.cumsum(self.sizes)
        self.cells = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].astype("i4")
        self.mark = np.zeros(len(self.cells) + 1, bool)

    def _of(self, row: int) -> np.ndarray:
        return self.cells[self.ends[row] - self.sizes[row] : self.ends[row]]

    def links(self, hub: int, members: np.ndarray) -> np.ndarray:
        """Whether any set of each member is linked with any of the hub's; an id has several if rows share it."""
        first, last = np.searchsorted(self.ids, members, "left"), np.searchsorted(self.ids, members, "right")
        owner = np.repeat(np.arange(len(members)), last - first)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(last - first) - last, last - first)
        linked = np.zeros(len(members), bool)
        if not len(rows):
            return linked
        cells = np.concatenate([self._of(r) for r in rows])
        starts = np.cumsum(self.sizes[rows]) - self.sizes[rows]
        for at in range(*np.searchsorted(self.ids, [hub, hub + 1])):
            self.mark[self._of(at)] = True
            both = np.add.reduceat(self.mark[cells], starts, dtype="i8")
            self.mark[self._of(at)] = False
            linked[owner[(both > 0) & (100 * both >= PERCENT * (self.sizes[rows] + self.sizes[at] - both))]] = True
        return linked


def _verified_blocks(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (low, high, hub, member), those whose full sets are similar enough.

    low and high are the blocks of the two documents. A text is sent to each pair of blocks that has a pair of it, not to each
    pair; a task holds the sets of two blocks.
    """
    ends = pairs.select("low", "high", F.col("hub").alias("doc_id")).unionByName(pairs.select("low", "high", F.col("member").alias("doc_id")))
    texts = documents(docs).dropna(subset=["doc_id"])
    rows = texts.join(small(saved(ends.distinct(), "wanted")), "doc_id").select("low", "high", F.lit(0).alias("role"), "doc_id", F.lit(None).cast("long").alias("member"), "text")
    rows = rows.unionByName(pairs.select("low", "high", F.lit(1).alias("role"), F.col("hub").alias("doc_id"), "member", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("low", "high").sortWithinPartitions("low", "high", "role", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, sets, both = None, [], [], None
        for batch in batches:
            out = []
            blocks, roles = batch[["low", "high"]].to_numpy(), batch["role"].to_numpy()
            hubs, members, texts = batch["doc_id"].to_numpy(), batch["member"].to_numpy(), batch["text"].array
            starts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]).any(1) | (roles[1:] != roles[:-1]) | (hubs[1:] != hubs[:-1])])[: len(batch)])
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                if at != tuple(blocks[start]):
                    at, ids, sets, both = tuple(blocks[start]), [], [], None
                if roles[start] == 0:
                    for text in texts[start:end]:
                        found = shingles(text)
                        if len(found):
                            ids.append(hubs[start])
                            sets.append(found)
                    continue
                both = both or _Sets(ids, sets)
                some = members[start:end].astype("i8")
                out += [(hubs[start], m) for m in some[both.links(hubs[start], some)]]
            yield pd.DataFrame(out, columns=["hub", "member"])

    return rows.mapInPandas(run, "hub long, member long")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents are linked if their sets of five-word shingles agree by three quarters; component_id is the smallest id that links
    reach. Sets that are equal are one node, whatever the number of copies. Texts that are null or without words have no shingle
    and no link. Rows with one id are one node with the links of all of them. A null id links with nothing: its component is null
    and it is kept. A pair at exactly the threshold shares no band, and so may be missed, with a probability of 2e-5; a pair
    that shares one is linked by other documents, tested, or proven to be no link.
    """
    signed = saved(signatures(docs), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = saved(usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    # one row a distinct set, with its bands; fewer rows are copies than not
    copies = usable.join(classes.where("copies > 1"), ["k1", "k2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "k1", "k2").distinct()
    reps = usable.join(small(saved(copies, "copies")), ["doc_id", "k1", "k2"], "left_anti")
    rows = saved(_shared(reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))), "rows")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    members = saved(rows.join(shared.select("bucket", "size"), "bucket"), "members")
    weights = saved(members.groupBy("doc_id").agg(F.sum("size").alias("weight")), "weights")
    members = saved(members.drop("size").join(weights, "doc_id"), "weighted")

    hub = F.max(F.struct("weight", (-F.col("doc_id")).alias("low"), "n_shingles")).alias("hub")
    hubs = members.groupBy("bucket").agg(hub).select("bucket", (-F.col("hub.low")).alias("hub"), F.col("hub.n_shingles").alias("hub_n"))
    alike = (100 * F.least("n_shingles", "hub_n") >= PERCENT * F.greatest("n_shingles", "hub_n")) & (F.col("doc_id") != F.col("hub"))
    pairs = members.join(hubs, "bucket").where(alike).select("hub", F.col("doc_id").alias("member")).distinct()
    tested = saved(pairs, "tested")
    links = saved(verified(tested, docs), "links")
    # an id whose rows have different sets joins the classes of all of them
    several = usable.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("doc_id")
    own = usable.join(several, "doc_id").join(classes, ["k1", "k2", "n_shingles"]).select(F.col("doc_id").alias("hub"), F.col("rep").alias("member")).where("hub <> member")
    links = links.unionByName(own)
    found = components(links.select(F.col("hub").alias("a"), F.col("member").alias("b")))
    # the wide bins of documents that share a bucket, written once
    reps = saved(reps.join(small(weights.select("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "bands", "sketch", "filled"), "bins")
    sketches = reps.select("doc_id", "sketch")

    def open_members() -> DataFrame:
        """Members of buckets that hold several components."""
        label = F.coalesce(F.col("component"), F.col("doc_id")).alias("component")
        every = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n_shingles", label)
        open_ = every.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        return every.join(open_, "bucket")

    while True:
        fresh = saved(_second_stars(open_members(), sketches).join(tested, ["hub", "member"], "left_anti"), "fresh")
        if fresh.limit(1).count() == 0:
            break
        confirmed = saved(verified(fresh, docs), "links")
        tested = tested.unionByName(fresh)
        if confirmed.limit(1).count() == 0:
            break
        links = links.unionByName(confirmed)
        found = components(links.select(F.col("hub").alias("a"), F.col("member").alias("b")))
    # what the stars have left, without a further round: whatever these pairs link, none is left untested
    left = saved(open_members().distinct(), "open")
    rest = saved(_untested(left.join(_blocks(left), "doc_id"), reps), "rest")
    confirmed = saved(_verified_blocks(rest, docs), "links")
    if confirmed.limit(1).count():
        found = components(links.unionByName(confirmed).select(F.col("hub").alias("a"), F.col("member").alias("b")))

    copied = classes.where("copies > 1").select("k1", "k2", "n_shingles", "rep")
    whole = signed.drop("bands", "sketch", "filled").join(copied, ["k1", "k2", "n_shingles"], "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")))
    labelled = whole.join(found.withColumnRenamed("id", "node"), "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of docs, columns unchanged, of which one id of each component is left, the smallest.

    Repeated rows of that id stay; so do null ids, and null and empty texts, which are linked with nothing. Long texts are compared
    whole; no rows in, no rows out.
    """
    gone = small(saved(link(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone"))
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").cast("long") == F.col("g.gone_id"), "left_anti")
