"""Byte-level BPE encoding and decoding by published merge ranks.

A piece's pairs stand in a segment tree over byte positions, 64 children to a node. Its top gives the leftmost pair of the lowest
rank; a merge empties one leaf and rewrites at most two, those of its live neighbours, each in logarithmic time. So one piece
of a million bytes costs n log n and not n squared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents

_NONE = 1 << 62
#: Children of a node of the tree are 1 << _FAN neighbours, so that the least of them is one call.
_FAN = 6


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    leaves = [_NONE] * (n - 1)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank << 32 | i
    tree = [leaves]
    while len(tree[-1]) > 1 << _FAN:
        below = tree[-1]
        tree.append([min(below[at : at + (1 << _FAN)]) for at in range(0, len(below), 1 << _FAN)])
    top, upper = tree[-1], tree[1:]
    after = list(range(1, n + 2))  # start of the live token that follows the one at i
    before = list(range(-1, n + 1))

    def lift(i: int) -> None:
        below = leaves
        for level in upper:
            i >>= _FAN
            least = min(below[i << _FAN : (i + 1) << _FAN])
            if level[i] == least:
                return
            level[i] = least
            below = level

    while top and (least := min(top)) != _NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        if j < n - 1:
            leaves[j] = _NONE
            lift(j)
        rank = get(piece[i : after[k]]) if k < n else None
        leaves[i] = _NONE if rank is None else rank << 32 | i
        lift(i)
        if i:
            h = before[i]
            rank = get(piece[h:k])
            leaves[h] = _NONE if rank is None else rank << 32 | h
            lift(h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token, and tokens by rank, from a file of base64 tokens and ranks."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


def lists(ids: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    """ids cut into lists of these sizes."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype="i8")])), pa.array(ids, pa.uint32()))


class Recent:
    """The lists of keys seen lately, as Arrow arrays: at most `most`, and twice as many for a moment; then the longest unseen go."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.keys, self.lists, self.seen = pa.array([], pa.string()), lists(np.empty(0, "u4"), np.empty(0, "i8")), np.empty(0, "i8")

    def find(self, keys: pa.StringArray) -> np.ndarray:
        """Where each of keys is held; -1 for those that are not."""
        at = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype("i8")
        self.seen[at[at >= 0]] = self.turn
        return at

    def add(self, keys: pa.StringArray, found: pa.LargeListArray) -> np.ndarray:
        """Where the keys, none of which is held, are put."""
        self.keys, self.lists = pa.concat_arrays([self.keys, keys]), pa.concat_arrays([self.lists, found])
        self.seen = np.concatenate([self.seen, np.full(len(keys), self.turn)])
        return np.arange(len(self.keys) - len(keys), len(self.keys))

    def settle(self) -> None:
        """After each batch; keys of over 64 bytes are not worth their room."""
        self.turn += 1
        if len(self.keys) > 2 * self.most:
            keep = np.sort(np.argsort(-self.seen, kind="stable")[: self.most])
            keep = keep[pc.binary_length(self.keys).to_numpy()[keep] <= 64]
            self.keys, self.lists, self.seen = self.keys.take(keep), self.lists.take(keep), self.seen[keep]


#: Bytes behind a space at which a text is not cut: white space, and the first bytes of any that is not ASCII.
_UNCUT = np.zeros(256, bool)
_UNCUT[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Bytes of text that are encoded at once; a longer text is alone.
_SLICE = 4 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of so many bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="i8")
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _SLICE, "right")))
        yield start, stop
        start = stop


class Chunks:
    """Encodes texts by their chunks and a chunk by its pieces, each looked up if it has been seen lately.

    A text is cut before each space that a non-space follows. PATTERN never lets a piece cross such a place, so a text's ids are
    those of its chunks in a row; for another pattern that need not hold, and texts are cut by the pattern alone. encode_pieces
    gives all ids of distinct pieces in a row, and each piece's number of them. Each distinct chunk of a batch is handled once.
    """

    def __init__(self, pattern: str, encode_pieces, most: int = 120_000):
        import public_tokenizers
        import regex

        self.find, self.encode_pieces, self.plain = regex.compile(pattern).findall, encode_pieces, pattern == public_tokenizers.PATTERN
        self.recent = Recent(most)

    def cut(self, chunk: str) -> list[str]:
        """The pattern's pieces. A space and letters, with at most one mark behind them, need no search."""
        if self.plain and chunk[:1] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def split(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The chunks of all texts in a row, and where each text's begin, and the end."""
        texts = texts.cast(pa.string())  # offsets of 4 bytes, whatever type Spark sends
        ends = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
        raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[ends[0] : ends[-1]]
        ends = ends - ends[0]
        begins = np.zeros(len(raw) + 1, bool)
        if self.plain and len(raw):
            begins[: len(raw) - 1] = (raw[:-1] == 32) & ~_UNCUT[raw[1:]]
            begins[np.maximum(ends[1:] - 1, 0)] = False  # what follows a text's last byte is another text
        begins[ends] = True
        at = np.flatnonzero(begins)
        chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype("i4")), pa.py_buffer(np.ascontiguousarray(raw)))
        return chunks, np.searchsorted(at, ends)

    def encode(self, chunks: list[str]) -> np.ndarray:
        """Where distinct chunks that are not held are put. A chunk of one piece is held as that piece."""
        recent = self.recent
        parted = [self.cut(chunk) for chunk in chunks]
        sizes = np.fromiter(map(len, parted), "i8", len(parted))
        coded = pa.array(list(chain.from_iterable(parted)), pa.string()).dictionary_encode()
        pieces = recent.find(coded.dictionary)
        new = coded.dictionary.take(pa.array(np.flatnonzero(pieces < 0)))
        pieces[pieces < 0] = recent.add(new, lists(*self.encode_pieces(new.to_pylist())))
        at = pieces[coded.indices.to_numpy()]
        first = np.cumsum(sizes) - sizes
        out = at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else np.zeros(len(chunks), "i8")
        several = sizes != 1
        found = recent.lists.take(pa.array(at[np.repeat(several, sizes)]))
        before = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())])
        ends = before[np.cumsum(sizes[several])]
        keys = pa.array([chunk for chunk, yes in zip(chunks, several, strict=True) if yes], pa.string())
        out[several] = recent.add(keys, lists(found.flatten().to_numpy(), np.diff(ends, prepend=0)))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, and the end. Null texts are as if empty."""
        chunks, starts = self.split(pc.fill_null(texts, ""))
        coded = chunks.dictionary_encode()
        at = self.recent.find(coded.dictionary)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = self.encode(coded.dictionary.take(pa.array(missing)).to_pylist())
        taken = self.recent.lists.take(pa.array(at).take(coded.indices))
        before = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy())])
        self.recent.settle()
        return taken.flatten().to_numpy(), before[starts]


def _pieces(path: str):
    ranks, _ = vocabulary(path)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [merge(piece.encode("utf-8", "surrogatepass"), ranks) for piece in pieces]
        return np.fromiter(chain.from_iterable(found), "u4"), np.array([len(x) for x in found], "i8")

    return encode


@lru_cache(maxsize=1)
def _chunks(path: str, pattern: str) -> Chunks:
    """One a worker process, so that later tasks find what earlier ones have seen."""
    return Chunks(pattern, _pieces(path))


def encode_texts(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in a row (unsigned 32-bit), and where each text's begin, and the end."""
    return _chunks(path, pattern)(texts)


@lru_cache(maxsize=2)
def _tokens(path: str) -> pa.Array:
    return pa.array(vocabulary(path)[1], pa.large_binary())


def binary(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """raw cut into binary values at starts, which are places of items of raw."""
    places = (starts * raw.itemsize).astype("i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def decode_ids(ids: np.ndarray, starts: np.ndarray, path: str) -> pa.Array:
    """The bytes of each text whose ids begin at starts."""
    taken = _tokens(path).take(pa.array(ids))
    places = np.frombuffer(taken.buffers()[1], "i8")[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, "i8")
    return binary(np.frombuffer(taken.buffers()[2] or b"", "u1"), places[starts] - places[0])


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row of docs; with decode also the bytes they decode to.

    Null and empty texts have no tokens. Long texts are encoded whole: they are cut into chunks that no token crosses, and each
    distinct chunk is merged once, in a tree of one level if it has at most 64 bytes. The vocabulary is read from path on each executor, once a worker. Rows are handled
    in the order they come, so repeated rows and ties need no rule; no rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                ids, starts = encode_texts(part["text"], path, pattern)
                out = {"doc_id": part["doc_id"], "n_tokens": pa.array(np.diff(starts)), "ids": binary(ids, starts)}
                if decode:
                    out["decoded"] = decode_ids(ids, starts, path)
                yield pa.RecordBatch.from_pydict(out)

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that ids (as encode() gives them) stand for. Null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["ids"]):
                part = batch.slice(start, stop - start)
                rows = [np.frombuffer(x or b"", "<u4") for x in part["ids"].to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype="i8")])
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "decoded": decode_ids(np.concatenate(rows), starts, path)})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
