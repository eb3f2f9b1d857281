"""Language identification: known words by their log frequency in each language, unseen words by ever shorter n-grams.

Spark counts words by language over the training rows, then the character n-grams of those words. A text's words that the
model knows add their log frequencies; for any other word, each place takes the longest n-gram known there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import held_out

#: Documents to learn from, at most about so many of each language, chosen by a hash of their id.
FIT_DOCUMENTS = 1000
#: Words seen less often than this in the training rows count as unseen; their n-grams still count.
LEAST_WORD = 2
LONGEST_GRAM = 4
#: Longer runs of letters are read in pieces of so many, each a word; without spaces a text is a single run.
PIECE = 64
#: Words after which more evidence no longer makes a prediction surer.
SURE_WORDS = 12
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]

    def vector(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language."""
        known = self.words.get(word)
        return self.backed_off(word) if known is None else known

    def backed_off(self, word: str) -> np.ndarray:
        marked, n, total, places = f"^{word}$", len(word) + 2, np.zeros(len(self.langs)), 0
        for i in range(1, n):
            for size in range(min(LONGEST_GRAM, i + 1), 0, -1):
                found = self.grams.get(marked[i + 1 - size : i + 1])
                if found is not None:
                    total += found
                    break
            places += 1
        return total / max(places, 1)

    def predict(self, texts: list[str | None], held: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Of each text the best language (the first in alphabetical order among equals) and its share of the likelihood.

        Each distinct word of the texts is looked up once; held keeps the vectors of words seen lately.
        """
        found = [words(text or "") for text in texts]
        sizes = np.array([len(x) for x in found], "i8")
        known = (sizes > 0) & bool(self.langs)
        if not known.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        vectors = []
        for word in coded.dictionary.to_pylist():
            vector = held.get(word)
            if vector is None:
                vector = held[word] = self.vector(word)
            vectors.append(vector)
        each = np.array(vectors)[coded.indices.to_numpy()]
        starts = (np.cumsum(sizes) - sizes)[known]
        mean = np.add.reduceat(each, starts) / sizes[known, None] * np.minimum(sizes[known], SURE_WORDS)[:, None]
        share = np.exp(mean - mean.max(1, keepdims=True))
        best = share.argmax(1)
        langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        langs[known] = np.array(self.langs, object)[best]
        scores[known] = share.max(1) / share.sum(1)
        return langs.tolist(), scores


#: Letters are those of the Unicode category L, here as in the expressions that Spark evaluates.
_WORD = regex.compile(rf"\p{{L}}{{1,{PIECE}}}")


def words(text: str) -> list[str]:
    """Maximal runs of letters, in lower case and in pieces."""
    return _WORD.findall(text.lower())


def _logs(counts: pd.DataFrame, key: str, langs: list[str]) -> dict[str, np.ndarray]:
    """Log of (count + 1/2) over each language's total."""
    at = {lang: i for i, lang in enumerate(langs)}
    sums, rows = np.zeros(len(langs)), {}
    for lang, item, n in zip(counts["lang"], counts[key], counts["n"], strict=True):
        row = rows.get(item)
        if row is None:
            row = rows[item] = np.full(len(langs), 0.5)
        row[at[lang]] += n
        sums[at[lang]] += n
    scale = np.log(sums + 0.5 * max(len(rows), 1))
    return {item: np.log(row) - scale for item, row in rows.items()}


def fit(docs: DataFrame, documents_per_language: int = FIT_DOCUMENTS) -> Model:
    """Learn from text and non-null lang of rows that are not held out.

    At most about documents_per_language rows of each language, by a hash of the id, so the model's size is bounded. Rows with
    the same id are in or out together. Null texts teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], {}, {})
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    limits = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, math.ceil((1 << 30) * min(1.0, documents_per_language / n)))))
    chosen = rows.where(bucket < F.element_at(limits, F.col("lang")))
    counted = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{PIECE}}})"), F.lit(1))).alias("word"))
    counted = counted.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).cache()
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    ends = F.sequence(F.lit(2), F.length("marked"))
    sizes = F.array(*(F.lit(i) for i in range(1, LONGEST_GRAM + 1)))
    grams = (
        counted.select("lang", "n", marked.alias("marked"))
        .select("lang", "n", "marked", F.explode(ends).alias("end"))
        .select("lang", "n", "marked", "end", F.explode(sizes).alias("size"))
        .where("size <= end")
        .select("lang", "n", F.expr("substring(marked, end - size + 1, size)").alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    langs = sorted(counts)
    model = Model(langs, _logs(counted.where(F.col("n") >= LEAST_WORD).toPandas(), "word", langs), _logs(grams.toPandas(), "gram", langs))
    counted.unpersist()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs.

    lang_pred is a learned language, or und with score 0 if the text is null or has no letter or nothing was learned. The model,
    whose size the training sample bounds, is sent to each executor once. Long texts are read whole.
    Rows come as they are: repeated ones are predicted alike; no rows in, no rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = sent.value, {}
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                langs, scores = own.predict(part["text"].to_pylist(), held)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)})
                if len(held) > 200_000:
                    held.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict every row."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
