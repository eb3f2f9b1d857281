"""The language and quality gate: every row gets one decision and one reason, cheap tests first, predictions only where needed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pieces import by_pieces
from ..functions.text import meaningful_words

# Modes a description can come in.
MODES = ("plain_text", "description_html", "full_page_html")
ACCEPTED = ("HIGH_CONFIDENCE_ENGLISH", "ENGLISH_CONFIRMED_BY_TWO_CHUNKS")
# Tokens that do not count as prose in a confirmation chunk: technologies, and the words of a page's frame.
TECHNOLOGY_WORDS = (
    "python java javascript typescript aws azure gcp docker kubernetes react angular vue sql linux git node django flask spring php ruby golang rust scala kotlin swift "
    "html css mongodb postgres mysql redis kafka spark hadoop terraform ansible jenkins graphql nosql oracle postgresql csharp cpp dotnet js ts k8s pytorch tensorflow "
    "pandas numpy sap odoo"
).split()
FRAME_WORDS = "cookie cookies privacy newsletter unsubscribe sitemap navigation menu footer header facebook linkedin twitter instagram youtube copyright".split()
_NOT_PROSE = frozenset(TECHNOLOGY_WORDS + FRAME_WORDS)


@dataclass(frozen=True)
class Config:
    sure: float = 0.95
    chunk_sure: float = 0.80
    least_words: int = 60
    chunk_words: int = 80
    chunk_least: int = 30
    most_chars: int = 50_000


def refusal(description: Column, cleaned: Column, source: Column, identity: Column, mode: Column, config: Config = Config()) -> Column:
    """The reason that refuses a row before any prediction; null if none does. The order of the tests is part of the result."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(F.coalesce(identity, F.lit("")).eqNullSafe("") | blank(source), "MISSING_JOB_IDENTITY")
        .when(~F.coalesce(mode, F.lit("")).isin(*MODES), "UNSUPPORTED_INPUT_MODE")
        .when(blank(description), "MISSING_DESCRIPTION")
        .when(F.coalesce(cleaned, F.lit("")) == "", "EMPTY_DESCRIPTION")
        .when(F.length(cleaned) > config.most_chars, "DESCRIPTION_TOO_LARGE")
        .when(meaningful_words(cleaned) < config.least_words, "DESCRIPTION_TOO_SHORT")
    )


def prose_windows(text: str | None, config: Config = Config()) -> list[str] | None:
    """The first two windows of prose that do not overlap; None if there are none.

    Windows of half the tokens, 80 at most, begin every quarter of a window; the second search begins where the first ends.
    """
    tokens = (text or "").split()
    window = min(config.chunk_words, len(tokens) // 2)
    if window < config.chunk_least:
        return None
    # running counts of tokens with a letter, and of those that are prose
    lettered, real = [0], [0]
    for token in tokens:
        letter = any(c.isalpha() for c in token)
        plain = letter and re.sub(r"\W+", "", token).casefold() not in _NOT_PROSE and not token.startswith(("http", "www."))
        lettered.append(lettered[-1] + letter)
        real.append(real[-1] + plain)
    found, at = [], 0
    while at + window <= len(tokens) and len(found) < 2:
        n, all_ = real[at + window] - real[at], lettered[at + window] - lettered[at]
        if n >= config.chunk_least and 2 * n >= all_:
            found.append(" ".join(tokens[at : at + window]))
            at += window
        else:
            at += max(1, window // 4)
    return found if len(found) == 2 else None


def chunks(text: Column, config: Config = Config()) -> Column:
    cut = by_pieces(lambda t: None if t is None else prose_windows(t, config), T.ArrayType(T.StringType()), pa.list_(pa.string()))
    return cut(text)


def run(offers: DataFrame, predict: Callable[[Column], Column] | None, config: Config = Config()) -> DataFrame:
    """offers (source, identity, mode, description, cleaned, ...) with decision, reason, language, score, predictions_count.

    predict gives struct(language, score) of a text. One pass over the rows: rows that a cheap test refuses are predicted from a
    null text, and so are the chunks of all but rows of unsure English; a null costs a predictor next to nothing.
    """
    checked = offers.withColumn("refused", refusal(*(F.col(c) for c in ("description", "cleaned", "source", "identity", "mode")), config))
    keep = [F.col(c) for c in offers.columns]
    none, open_ = F.lit(None).cast("string"), F.col("refused").isNull()
    if predict is None:
        reason = F.coalesce("refused", F.lit("LANGUAGE_MODEL_UNAVAILABLE"))
        return _decided(checked.select(*keep, reason.alias("reason"), none.alias("language"), none.cast("double").alias("score"), F.lit(0).alias("predictions_count")))
    line = F.trim(F.regexp_replace("cleaned", r"\s+", " "))
    # the row's own state says which predictions count, whatever a predictor makes of a null
    rows = checked.withColumn("p", predict(F.when(open_, line)))
    rows = rows.withColumn("language", F.when(open_, F.col("p.language"))).withColumn("score", F.when(open_, F.col("p.score"))).drop("p")
    unsure = open_ & F.coalesce((F.col("language") == "en") & ~(F.col("score") >= config.sure), F.lit(False))
    rows = rows.withColumn("parts", chunks(F.when(unsure, F.col("cleaned")), config)).withColumn("cut", unsure & F.col("parts").isNotNull())
    chunk = lambda i: predict(F.when(F.col("cut"), F.get("parts", F.lit(i))))
    rows = rows.withColumn("a", chunk(0)).withColumn("b", chunk(1))
    reason = (
        F.when(~open_, F.col("refused"))
        .when(F.col("language").isNull(), "LANGUAGE_PREDICT_FAILED")
        .when(F.col("language") != "en", "NON_ENGLISH_DESCRIPTION")
        .when(F.col("score") >= config.sure, "HIGH_CONFIDENCE_ENGLISH")
        .when(~F.col("cut"), "INSUFFICIENT_TEXT_FOR_CHUNK_CONFIRMATION")
        .when((F.col("a.language") != "en") | (F.col("b.language") != "en"), "CHUNK_LANGUAGE_MISMATCH")
        .when(F.least("a.score", "b.score") < config.chunk_sure, "LOW_CHUNK_ENGLISH_CONFIDENCE")
        .otherwise("ENGLISH_CONFIRMED_BY_TWO_CHUNKS")
    )
    count = F.when(~open_, 0).when(F.col("cut"), 3).otherwise(1)
    return _decided(rows.select(*keep, reason.alias("reason"), "language", "score", count.alias("predictions_count")))


def _decided(rows: DataFrame) -> DataFrame:
    decision = F.when(F.col("reason").isin(*ACCEPTED), "ACCEPT").otherwise("REFUSE")
    return rows.withColumn("decision", decision).withColumn("clean_description", F.when(F.col("decision") == "ACCEPT", F.col("cleaned")))


def metrics(decided: DataFrame) -> DataFrame:
    """Counts by decision, reason and number of predictions, with the class of the reason."""
    group = (
        F.when(F.col("reason") == "DESCRIPTION_SELECTOR_NOT_FOUND", "selector_failures")
        .when(F.col("reason") == "HTML_PARSE_FAILED", "parse_failures")
        .when(F.col("reason").isin("NON_ENGLISH_DESCRIPTION", "CHUNK_LANGUAGE_MISMATCH", "LOW_CHUNK_ENGLISH_CONFIDENCE", "INSUFFICIENT_TEXT_FOR_CHUNK_CONFIRMATION"), "language_refusals")
        .when(F.col("reason") == "LANGUAGE_MODEL_UNAVAILABLE", "model_unavailable")
    )
    return decided.groupBy("decision", "reason", "predictions_count").agg(F.count(F.lit(1)).alias("n")).withColumn("metric", group)


# Frequent function words by language, for the default predictor.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was are this on be by as it you have not",
    "fr": "le la les de des du et en un une est pour que qui dans sur avec par au ce",
    "de": "der die das und in den von zu mit ist nicht ein eine auf dem des im für sich auch",
    "es": "el la los las de y en un una es que por con para del se su al no lo",
}


_LISTED = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}


def _by_function_words(line: str | None) -> dict:
    """The language of most function words, and its share of all those found."""
    counts = Counter(re.findall(r"\w+", line.lower())) if line else {}
    found = {lang: sum(counts[w] for w in words) for lang, words in _LISTED.items()} if counts else {}
    best = max(found, key=lambda lang: found[lang], default=None)
    return {"language": best, "score": found[best] / sum(found.values())} if best and found[best] else {"language": "und", "score": 0.0}


#: Default predictor, a substitute for a trained one: struct(language, score) of a text.
predict_by_function_words = by_pieces(
    _by_function_words, T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())]), pa.struct([("language", pa.string()), ("score", pa.float64())])
)
