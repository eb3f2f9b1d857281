"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id and a bitmap that says which ids go on; level
k + 1 holds the next chunk of those that do. A directory of the ones before each 512 bits makes rank, and so access to any
token, independent of its place: no block is decoded to reach one.

A file is, little-endian: b"DAC1", then unsigned 32-bit numbers of documents, tokens and levels; document ids (int64; the
lowest value stands for null); the documents' first tokens and the end (uint32); per level its number of chunks and whether it
has a bitmap (uint32 each), the chunks (uint8), the bitmap (lowest bit first, padded to 64 bytes) and the directory (uint32,
one for each 64 bytes and one for the end); last, the crc32 of all that stands before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Chunks, lists, slices
from .common import documents, saved, shared_dir, small

_NULL = -(1 << 63)
#: Tokens after which a partition begins its next file. A file is read as one row, so this bounds a row.
FILE_TOKENS = 1 << 21


def pack(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 0xFF
        levels.append((rest.astype("u1"), more if more.any() else None))
        if levels[-1][1] is None:
            break
        rest = rest[more] >> 8
    out = [b"DAC1", struct.pack("<3I", len(doc_ids), len(ids), len(levels)), doc_ids.astype("<i8").tobytes(), offsets.astype("<u4").tobytes()]
    for chunks, more in levels:
        out += [struct.pack("<2I", len(chunks), more is not None), chunks.tobytes()]
        if more is not None:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 64, "u1")])
            ones = np.bitwise_count(bits.reshape(-1, 64)).sum(axis=1, dtype="u4")
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()]
    whole = b"".join(out)
    return whole + struct.pack("<I", zlib.crc32(whole))


class Reader:
    """Random access to a packed file's documents and tokens."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1" or struct.unpack_from("<I", raw, len(raw) - 4)[0] != zlib.crc32(memoryview(raw)[:-4]):
            raise ValueError("not a whole token file")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<3I", raw, 4)
        at = 16
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        self.offsets = np.frombuffer(raw, "<u4", n_docs + 1, at)
        at += 4 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n, has_bits = struct.unpack_from("<2I", raw, at)
            at += 8
            chunks = np.frombuffer(raw, "u1", n, at)
            at += n
            bits = directory = None
            if has_bits:
                width = -(-n // 512) * 64
                bits = np.frombuffer(raw, "u1", width, at)
                at += width
                directory = np.frombuffer(raw, "<u4", width // 64 + 1, at)
                at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before bit i: the directory, and at most 64 bytes."""
        block = i >> 9
        whole = int(np.bitwise_count(bits[block * 64 : i >> 3]).sum())
        return int(directory[block]) + whole + int(np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1)) if i & 7 else 0)

    def token(self, i: int) -> int:
        value = shift = 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, directory, i), shift + 8
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end, reading only their own chunks on each level."""
        first, stop, shift = start, end, 0
        out = np.zeros(end - start, "<u4")
        at = np.arange(end - start)
        for chunks, bits, directory in self.levels:
            out[at] |= chunks[first:stop].astype("<u4") << shift
            if bits is None or first == stop:
                break
            more = np.unpackbits(bits[first >> 3 : (stop + 7) >> 3], bitorder="little")[first & 7 :][: stop - first].astype(bool)
            at, shift = at[more], shift + 8
            first = self._rank(bits, directory, first)
            stop = first + len(at)
        return out


@lru_cache(maxsize=1)
def _library(path: str, pattern: str):
    """The library's tokenizer, and a lookup of pieces that it has encoded."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    size = tokenizer.get_vocab_size()
    space = tokenizer.encode(" ", add_special_tokens=False).tokens[0]
    leads = np.array([(tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)])

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words behind a space are put in rows of many, as the library takes long over each call: a token with a space begins a word."""
        is_word = np.array([piece[0] == " " and piece[1:].isalpha() for piece in pieces], bool)
        words = [piece for piece, yes in zip(pieces, is_word, strict=True) if yes]
        rows = ["".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
        ids = np.fromiter(chain.from_iterable(encode(rows)), "u4")
        begins = np.flatnonzero(leads[ids])
        if len(begins) != len(words):
            raise ValueError("a word's tokens hold another space")
        others = encode([piece for piece, yes in zip(pieces, is_word, strict=True) if not yes])
        found = [lists(ids, np.diff(begins, append=len(ids))), lists(np.fromiter(chain.from_iterable(others), "u4"), np.array([len(x) for x in others], "i8"))]
        # back into the order of pieces
        place = np.where(is_word, np.cumsum(is_word) - 1, len(words) + np.cumsum(~is_word) - 1)
        whole = pa.concat_arrays(found).take(pa.array(place))
        return whole.flatten().to_numpy(), pc.list_value_length(whole).to_numpy()

    return encode, Chunks(pattern, encode_pieces)


def _ids(texts: pa.Array, path: str, pattern: str) -> list[np.ndarray]:
    """The library's ids of texts. It is asked for each distinct piece once in a while; its own pre-tokenizer cuts at the same places."""
    whole, chunks = _library(path, pattern)
    # a text may hold a special token's name, which the library looks for across pieces
    named = pc.fill_null(pc.match_substring(texts, "<|"), False)
    ids, starts = chunks(pc.if_else(named, "", texts))
    out = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    some = np.flatnonzero(named.to_numpy(zero_copy_only=False))
    for i, found in zip(some, whole(texts.take(pa.array(some)).to_pylist()), strict=True):
        out[i] = np.array(found, "<u4")
    return out


def _put(folder: str, name: str, raw: bytes) -> None:
    """Write under another name first: a task that runs twice leaves one whole file."""
    import os
    import uuid

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{os.getpid()}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(raw)
    store.move(part, f"{root}/{name}")


def write(docs: DataFrame, path: str, pattern: str, folder: str | None = None, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Encode docs and write their ids, each document's followed by end_id, in ascending order of doc_id (nulls first).

    Returns the folder and a table of its files (file, part, seq, n_docs, n_tokens). Null and empty texts hold the end id alone;
    rows with the same id follow each other in the order of their texts' hashes. The order is made by range partitions, so no task
    holds more than its range, and a file at most about file_tokens tokens or one document.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, made = TaskContext.get().partitionId(), 0, []
        doc_ids, rows, held = [], [], 0

        def flush() -> None:
            nonlocal seq, held
            offsets = np.cumsum([0] + [len(x) + 1 for x in rows])
            name = f"{part:07d}-{seq:07d}.dac"
            _put(folder, name, pack(np.array(doc_ids, "i8"), offsets, np.concatenate([x for row in rows for x in (row, end)])))
            made.append((name, part, seq, len(rows), int(offsets[-1])))
            seq, held = seq + 1, 0
            doc_ids.clear()
            rows.clear()

        for batch in batches:
            for start, stop in slices(batch["text"]):
                few = batch.slice(start, stop - start)
                for doc_id, ids in zip(few["doc_id"].to_pylist(), _ids(few["text"], path, pattern), strict=True):
                    doc_ids.append(_NULL if doc_id is None else doc_id)
                    rows.append(ids)
                    held += len(ids) + 1
                    if held >= file_tokens:
                        flush()
        if rows:
            flush()
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "seq", "n_docs", "n_tokens"), row, strict=True)) for row in made])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = ordered.mapInArrow(run, "file string, part long, seq long, n_docs long, n_tokens long")
    return folder, saved(files, "token_files")


def read(spark, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files.

    start counts the tokens of all documents before it: sums by part, of which there are as many as tasks wrote, and within a part.
    """
    by_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    by_part = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = files.withColumn("within", within).join(by_part, "part").select("file", (F.col("within") + F.col("before_part")).alias("file_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                reader = Reader(bytes(raw))
                offsets = reader.offsets.astype("i8")
                for at in range(0, len(reader.doc_ids), 512):
                    to = min(at + 512, len(reader.doc_ids))
                    ids = reader.tokens(int(offsets[at]), int(offsets[to])).tobytes()
                    cuts = (offsets[at : to + 1] - offsets[at]) * 4
                    yield pd.DataFrame(
                        {
                            "file": path.rsplit("/", 1)[-1],
                            "doc_id": pd.array([None if x == _NULL else x for x in reader.doc_ids[at:to].tolist()], "Int64"),
                            "within_file": offsets[at:to],
                            "n_tokens": np.diff(offsets[at : to + 1]),
                            "ids": [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                        }
                    )

    if files.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    docs = raw.mapInPandas(run, "file string, doc_id long, within_file long, n_tokens long, ids binary")
    return docs.join(small(saved(starts, "file_starts")), "file").select("doc_id", (F.col("file_start") + F.col("within_file")).alias("start"), "n_tokens", "ids")
