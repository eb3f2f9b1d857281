"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; cyclic boosting of shallow trees learns one lookup table of log odds a feature, then, on what
is left, one table for each of the strongest pairs. A score is the sum of the bins' values through the logistic function.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows to learn from, at most about so many, chosen by a hash of their id.
FIT_ROWS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF = 150, 40, 0.15, 10
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
#: ASCII marks that end or join ordinary sentences; other ASCII marks count as symbols.
_MARKS = b".,;:'\"-()?"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "mark", "symbol", "bang", "bar", "other_bytes",
    "distinct_words", "top_word", "long_word", "line_words", "duplicate_lines", "symbol_words", "upper_words", "sentence_words", "vocabulary",
]


def features(text: str | None) -> list[float]:
    """Numbers that depend on the text alone. Null and empty texts have zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [math.log1p(size)] + [0.0] * (len(FEATURES) - 1)
    letters_upper, letters_lower = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _LOWER))
    digits, marks, symbols = (size - len(raw.translate(None, x)) for x in (_DIGIT, _MARKS, _SYMBOLS))
    inked = sum(map(len, words))
    other = inked - letters_upper - letters_lower - digits - marks - symbols
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbol_words = sum(c for w, c in counts.items() if w[-1] in _SYMBOLS)
    upper_words = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return [
        math.log1p(size),
        math.log1p(n),
        inked / n,
        letters_upper / inked,
        letters_lower / inked,
        digits / inked,
        marks / inked,
        symbols / inked,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        other / inked,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        math.log1p(max(map(len, counts))),
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        symbol_words / n,
        upper_words / n,
        n / (ends + 1),
        math.log1p(len(counts)) / math.log1p(n),
    ]


@dataclass
class Model:
    """cuts[i]: inner bin edges of feature i; tables[i]: its log odds by bin; pairs: (i, j, coarse edges of i, of j, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, i], "right")]
        for i, j, a, b, values in self.pairs:
            total += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(gradient: np.ndarray, hessian: np.ndarray, number: np.ndarray, leaves: int = 3) -> np.ndarray:
    """One shallow tree over ordered bins: split the leaf that gains most until there are so many leaves."""
    parts, out = [(0, len(gradient))], np.zeros(len(gradient))
    g, h, c = (np.concatenate([[0.0], np.cumsum(v)]) for v in (gradient, hessian, number))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            at = at[(c[at] - c[a] >= LEAST_LEAF) & (c[b] - c[at] >= LEAST_LEAF)]
            if len(at):
                gains = worth(a, at) + worth(at, b) - worth(a, b)
                m = int(gains.argmax())
                if gains[m] > best[0]:
                    best = (float(gains[m]), k, int(at[m]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _sums(flat: np.ndarray, size: int, residual: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.bincount(flat, residual, size), np.bincount(flat, spread, size), np.bincount(flat, minlength=size)


def _quarters(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The two cuts, one a side, whose four quarters fit best: gain and values by cell."""
    grow = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch, cn = grow(g), grow(h), grow(n.astype(float))

    def quarter(c):
        a, rows, columns, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return np.stack([a, rows - a, columns - a, whole - rows - columns + a])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    qg, qh, qn = quarter(cg), quarter(ch), quarter(cn)
    gain = (qg**2 / (qh + 1.0)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    gain[qn.min(0) < LEAST_LEAF] = 0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = qg[:, i, j] / (qh[:, i, j] + 1.0)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on one matrix of features. Without both labels the model is their smoothed share."""
    n = len(y)
    p = (y.sum() + 0.5) / (n + 1.0)
    model = Model(math.log(p / (1 - p)), [], [], [])
    if n == 0:
        model.cuts, model.tables = [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES)
        return model
    model.cuts = [_cuts(x[:, i], BINS) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(model.cuts)]
    total = np.full(n, model.base)
    for _ in range(ROUNDS):
        for values, at in zip(model.tables, binned, strict=True):
            p = 1 / (1 + np.exp(-total))
            add = RATE * _step(*_sums(at, len(values), y - p, p * (1 - p)))
            values += add
            total += add[at]
    coarse = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(coarse)]
    p = 1 / (1 + np.exp(-total))
    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            sums = _sums(cells[i] * shape[1] + cells[j], shape[0] * shape[1], y - p, p * (1 - p))
            found.append((_quarters(*(s.reshape(shape) for s in sums))[0], i, j))
    for _, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:PAIRS]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(PAIR_ROUNDS):
        for i, j, _a, _b, values in model.pairs:
            p = 1 / (1 + np.exp(-total))
            sums = _sums(cells[i] * values.shape[1] + cells[j], values.size, y - p, p * (1 - p))
            add = RATE * _quarters(*(s.reshape(values.shape) for s in sums))[1]
            values += add
            total += add[cells[i], cells[j]]
    return model


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], "f8").reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn quality from at most about `rows` labelled rows that are not held out, chosen by a hash of the id.

    Null labels and ids teach nothing; an id with several labels counts with its lowest, and several documents that share an id
    count as one, with the smallest features. Only ids and labels of the sample are broadcast, and only one row of features an id
    reaches the driver. Null and empty texts teach as what they are; without any rows the model gives one half.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    n = marked.count()
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    marked = marked.where(bucket < math.ceil((1 << 30) * min(1.0, rows / max(n, 1))))
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "label": batch["label"].array, "x": list(_matrix(batch["text"]))})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(marked), "doc_id")
    # one row an id, whatever number of documents shares it, before anything reaches the driver
    each = texts.mapInPandas(run, "doc_id long, label double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("one"))
    got = each.select("doc_id", "one.*").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), "f8").reshape(-1, len(FEATURES))
    return boost(x, (got["label"].to_numpy("f8") > 0).astype("f8"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored by the bins of their zeros, long texts whole, rows that repeat an id each by its own text;
    no rows in, no rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": sent.value.score(_matrix(batch["text"]))})

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, columns unchanged, whose text scores at least the threshold.

    Null and empty texts are scored as such; rows alike are kept alike; long texts are scored whole; no rows in, no rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(_matrix(texts)))

    return docs.where(scored(F.col("text").cast("string")) >= THRESHOLD)
