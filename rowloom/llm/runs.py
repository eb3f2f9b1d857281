"""Periodic runs of words, by longest common extensions from suffix trees.

A run is a maximal stretch of words that repeats its first `period` words three times or more. Every run holds, as one of its
periods, a Lyndon word that is the longest one at its place in one of two orders of words, the second of which is the first
turned round. So each place gives two candidates: the longest Lyndon word there tells the period, and how far the stretch goes on
to both sides with that period tells the run. The longest Lyndon words come from the order of suffixes, and the extensions, in
constant time each, from the lowest common ancestors in the suffix trees of the words and of the words turned round, which are
the least depths between two leaves at which the trees' Euler tours turn.

Trees are built, by Ukkonen's steps, for the stretches of a document that can hold a run: in a run of at least 24 words and
three periods every 8 words in a row occur again, one period on or before, and so no farther than a third of the run's length.
Words around which that is not so, in a stretch no shorter than the run, are in no run. Proof: let a run be [s, e) with period q.
The 8 words at j equal those at j + q if j + q + 8 <= e, else those at j - q, as j > e - 8 - q >= s + q - 1 because
e - s >= max(24, 3 * q) >= 2 * q + 7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run, and periods of a run at least. The proof above rests on these and GRAM.
LEAST, TIMES, GRAM = 24, 3, 8
#: Rows whose texts a task holds as Python objects at once.
_SLICE = 256
_ODD = np.random.default_rng(12).integers(1, 1 << 63, GRAM, dtype="u8") | np.uint64(1)


class SuffixTree:
    """Suffix tree of a sequence of numbers over 0, which gets 0 as its end; longest common prefixes of its suffixes.

    A node's edge is labelled s[first:last]; leaves are open to the end. Leaves come in the order of their suffixes' starts.
    """

    def __init__(self, sequence: list[int]):
        self.s = [*sequence, 0]
        self.width = max(self.s) + 1
        self._grow()
        # children by parent and first word, 0 before all
        keys = np.fromiter(self.to.keys(), "i8", len(self.to))
        child = np.fromiter(self.to.values(), "i8", len(self.to))
        self.parent, self.symbol, self.child = keys // self.width, keys % self.width, child
        del self.to
        order, turns = self._tour(self.symbol)
        self.rank = np.empty(len(self.s), "i8")
        self.rank[order] = np.arange(len(self.s))
        self.levels = [np.array(turns, "i4")]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(turns):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def _grow(self) -> None:
        s, width, n = self.s, self.width, len(self.s)
        first, last, link, to = [0], [0], [0], {}
        node = edge = length = rest = 0
        self.leaves = leaves = []
        for i, c in enumerate(s):
            rest += 1
            pending = 0
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = to.get(key)
                if below is None:
                    to[key] = len(first)
                    leaves.append(len(first))
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    begin = first[below]
                    span = last[below] - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    inner = len(first)
                    first += (begin, i)
                    last += (begin + length, n)
                    link += (0, 0)
                    to[key] = inner
                    to[inner * width + c] = inner + 1
                    leaves.append(inner + 1)
                    first[below] = begin = begin + length
                    to[inner * width + s[begin]] = below
                    if pending:
                        link[pending] = inner
                    pending = inner
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.first, self.last, self.to = first, last, to

    def _tour(self, symbol: np.ndarray) -> tuple[list[int], list[int]]:
        """Starts of the suffixes in the order of the tour that takes children by symbol, and the depth at which it turns before each."""
        by = np.lexsort((symbol, self.parent))
        n = len(self.first)
        bounds = np.searchsorted(self.parent[by], np.arange(n + 1)).tolist()
        children = self.child[by].tolist()
        start = np.full(n, -1, "i8")
        start[self.leaves] = np.arange(len(self.leaves))
        span = (np.array(self.last) - np.array(self.first)).tolist()
        start = start.tolist()
        order, turns = [], []
        stack, turn, depth = [(0, 0, 0)], 0, 0
        while stack:
            # a node, its depth, and the depth of its parent if the tour turns there
            node, depth, turned = stack.pop()
            if turned >= 0:
                turn = turned
            if start[node] >= 0:
                order.append(start[node])
                turns.append(turn)
                continue
            a, b = bounds[node], bounds[node + 1]
            for child in reversed(children[a + 1 : b]):
                stack.append((child, depth + span[child], depth))
            child = children[a]
            stack.append((child, depth + span[child], -1))
        return order, turns

    def turned_rank(self) -> np.ndarray:
        """Ranks of the suffixes if the order of words is turned round, the end still before all."""
        order, _ = self._tour(np.where(self.symbol == 0, 0, self.width - self.symbol))
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes that start at a and at b, which differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype("f8"))[1] - 1
        out = np.empty(len(low), "i8")
        for k in np.unique(level):
            own = level == k
            table = self.levels[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << int(k))])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place but the last, whose rank is least, the next one with a smaller rank."""
    values, out, stack = rank.tolist(), [0] * len(rank), []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out[:-1], "i8")


def runs_of(sequence: list[int]) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers over 0, by start and period."""
    n = len(sequence)
    tree, back = SuffixTree(sequence), SuffixTree(sequence[::-1])
    at = np.arange(n)
    found = []
    for rank in (tree.rank, tree.turned_rank()):
        following = _next_smaller(rank)
        period = following - at
        right = following + tree.common(at, following)
        left = at - back.common(n - at, n - following)
        length = right - left
        some = length >= np.maximum(LEAST, TIMES * period)
        found.append(np.stack([left, length, period], 1)[some])
    return np.unique(np.concatenate(found), axis=0)


def _stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """The stretches of words that can hold a run: where every GRAM words in a row occur again within a third of the stretch's length. Equal hashes only add to them."""
    n = len(words) - GRAM + 1
    if len(words) < LEAST:
        return []
    each = np.fromiter(map(hash, words), "i8", len(words)).view("u8")
    grams = np.zeros(n, "u8")
    for k in range(GRAM):
        grams += each[k : n + k] * _ODD[k]
    order = np.argsort(grams, kind="stable")
    same = np.diff(grams[order]) == 0
    if not same.any():
        return []
    one, other = order[:-1][same], order[1:][same]
    nearest = np.full(n, len(words) * TIMES)
    nearest[one] = other - one
    nearest[other] = np.minimum(nearest[other], other - one)
    marks = np.zeros(n + 2, bool)
    marks[1:-1] = nearest < len(words)
    while True:
        edges = np.flatnonzero(marks[1:] != marks[:-1])
        first, last = edges[::2], edges[1::2]
        lengths = last - first + GRAM - 1
        held = np.repeat(lengths, last - first)  # one for each mark
        place = np.flatnonzero(marks) - 1
        gone = place[(nearest[place] * TIMES > held) | (held < LEAST)]
        if not len(gone):
            return list(zip(first.tolist(), (last + GRAM - 1).tolist(), strict=True))
        marks[gone + 1] = False


def periodic_runs(words: list[bytes]) -> np.ndarray:
    """Rows (start, length, period) of the runs of a list of words, by start and period."""
    found = []
    for a, b in _stretches(words):
        names: dict[bytes, int] = {}
        number = count(1)
        own = runs_of([names[w] if w in names else names.setdefault(w, next(number)) for w in words[a:b]])
        own[:, 0] += a
        found.append(own)
    return np.concatenate(found) if found else np.zeros((0, 3), "i8")


def most_repeated(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equals that with the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that lie in no run beyond its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, "i8")
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, longest struct<start: long, length: long, period: long>, collapsed string"


def find(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), longest (the run with the greatest exponent, or null) and collapsed of every row of docs (doc_id, text).

    rewrite(doc_id, words), if given, changes a document's words first. A null or empty text, and one of under 24 words, has no run;
    collapsed is then its words joined by one space. A null id is an id without a number. Of runs with equal exponents the first is
    the longest. Each row is judged alone: repeated rows give equal results, an empty table none, and other columns are left behind.
    A text is read whole by one task; memory grows with the longest stretch of it that can hold a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                sizes, found, best, texts = [], [], [], []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    words = (raw or b"").split()  # bytes are split at the six white-space characters of ASCII
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    runs = periodic_runs(words)
                    sizes.append(len(words))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()])
                    top = most_repeated(runs)
                    best.append(None if top is None else dict(zip(("start", "length", "period"), top, strict=True)))
                    texts.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "longest", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, _RESULT)
