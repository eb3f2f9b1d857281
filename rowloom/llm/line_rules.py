"""Quality rules on whole texts, and the frequency of lines across a host's documents, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, n_words, saved, small

#: A line is removed if more than so many documents of its host hold it ...
LIMIT = 20
#: ... and more than this share of them.
SHARE = 0.001
#: A document is rejected if its lines keep less than this share of its words.
LEAST_KEPT = 0.3
FEWEST_WORDS = 10
WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def repeated_words(hashes: Column) -> Column:
    """Number of places that lie in a window of five words found twice or more.

    hashes: a hash of each window in order. The windows are sorted by hash and place; a repeated one equals a neighbour. Back in
    order of place, each adds the places that the one before it does not cover.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes)

    def places(sorted_windows: Column) -> Column:
        repeated = F.filter(
            F.transform(
                sorted_windows,
                lambda w, k: F.when(
                    ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == w["h"])) | ((k + 1 < last) & (F.get(sorted_windows, k + 1)["h"] == w["h"])),
                    w["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(repeated)

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    # a single-element array carries the sorted windows, and then the places, into lambdas that use them more than once
    once = F.transform(F.array(placed), places)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(F.element_at(once, 1)))


def base(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed beside doc_id, source and text. Null text: as if empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"))
    rows = rows.withColumn("tokens", words(F.col("text")))
    count = F.size("tokens")
    hashes = F.transform(F.col("tokens"), lambda w: F.xxhash64(w))
    rows = rows.withColumn("n_words", count.cast("long")).withColumn("tokens", hashes)
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*(F.get(F.col("tokens"), i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    rows = rows.withColumn("windows", windows).withColumn("lines", lines)
    rows = rows.select(
        "doc_id",
        "source",
        "text",
        "n_words",
        F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def frequent_lines(docs: DataFrame, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """host and line_hash of lines that more than `limit` documents, and more than `share` of the documents, of a host hold.

    A document counts once however often it repeats a line. Counts are summed before they are shuffled.
    """
    hosts = docs.groupBy(_host(F.col("source")).alias("host")).agg(F.count(F.lit(1)).alias("docs"))
    lines = docs.select(_host(F.col("source")).alias("host"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: x["line_hash"]))).alias("line_hash"))
    counts = lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return counts.join(hosts, "host").where(F.col("n") > share * F.col("docs")).select("host", "line_hash")


def _host(source: Column) -> Column:
    """Documents without a source are of one host, which no name can equal."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _lines(text: Column) -> Column:
    """Lines with a word: a hash of the line in lower case, white space at its ends dropped and inside made one space, and its words."""
    with_words = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))
    normal = lambda line: F.trim(F.regexp_replace(F.lower(line), _SPACE, " "))
    return F.transform(with_words, lambda line: F.struct(F.xxhash64(normal(line)).alias("line_hash"), n_words(line).alias("n")))


def verdicts(docs: DataFrame, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """Every row of docs (doc_id, text, source) with its base counts, n_removed_words and kept.

    kept is false if base_failed, else if frequent lines leave the document less than LEAST_KEPT of its words. Null and empty
    texts have no words and fail. Rows that share an id count as documents of their own, for the lines' frequencies and for what
    is left of them; rows alike have one verdict. Texts are read whole, and no rows in give no rows out. A host's row count is summed before any shuffle, and a line's too, so a host with a third
    of all rows makes no task longer than others.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    frequent = small(saved(frequent_lines(narrow, limit, share), "frequent_lines"))
    own = F.xxhash64("text", "source").alias("own")
    lines = narrow.select("doc_id", own, _host(F.col("source")).alias("host"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    hits = lines.select("doc_id", "own", "host", "at", "line.line_hash", "line.n").join(frequent, ["host", "line_hash"])
    removed = hits.groupBy("doc_id", "own", "at").agg(F.max("n").alias("n")).groupBy("doc_id", "own").agg(F.sum("n").alias("n_removed_words"))
    counted = base(narrow).withColumn("own", own).drop("text").alias("c")
    joined = counted.join(removed.alias("r"), F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("c.own") == F.col("r.own")), "left")
    gone = F.coalesce(F.col("r.n_removed_words"), F.lit(0)).cast("long")
    depleted = (F.col("n_words") - gone) < LEAST_KEPT * F.col("n_words")
    return joined.select(*(F.col(f"c.{x}") for x in base(narrow).columns if x != "text"), gone.alias("n_removed_words"), (~F.col("base_failed") & ~depleted).alias("kept"))


def cleaned(docs: DataFrame, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """doc_id and text without the lines that are frequent in its host, for documents that are kept; one row an id.

    Null and empty texts are never kept. An id of several rows is kept if one of them is, and its lines follow each other by
    place. Lines without a word stay where they are.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    frequent = small(saved(frequent_lines(narrow, limit, share), "frequent_lines"))
    kept = verdicts(docs, limit, share).where("kept").select("doc_id").distinct()
    lines = narrow.join(kept, "doc_id", "left_semi").select("doc_id", _host(F.col("source")).alias("host"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hashed = lines.withColumn("line_hash", F.xxhash64(F.trim(F.regexp_replace(F.lower("line"), _SPACE, " "))))
    left = hashed.join(frequent, ["host", "line_hash"], "left_anti")
    parts = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
