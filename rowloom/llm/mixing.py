"""Mixing sources to target weights by Pareto order sampling.

A document is expected to occur e times in the mix. It gets floor(e) certain whole copies; for the rest, pi = e - floor(e),
documents of a source are ranked by their random odds over their inclusion odds, (u / (1 - u)) / (pi / (1 - pi)), and the
lowest are taken until the words that are left to the source are used up: a sample of fixed size with unequal
probabilities. One more document a source, that whose size is nearest to what then lacks, fills the gap. u is a hash of the id,
the text and an ordinal among rows that agree in both and in their source, so that no two rows draw together and a rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, saved, small

#: A document is taken this many times at most, and a source's target is at most so many times its size.
MOST_COPIES = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Documents of fewer words get half the weight of others of their source.
SHORT_WORDS, SHORT_WEIGHT = 50, 0.5
#: Ranks are found by two digits of this size, so that no task sorts a whole source.
RADIX = 4096
#: Equal rows that one task numbers or copies.
BLOCK = 1 << 16


def document_weight(size: Column) -> Column:
    return F.when(size < SHORT_WORDS, F.lit(SHORT_WEIGHT)).otherwise(F.lit(1.0))


def _uniform(doc_id: Column, seed: int, *more: Column) -> Column:
    """In (0, 1), from 52 bits of a hash of the id and more."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed), *more), 12).cast("double") + 0.5) / float(1 << 52)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (any alias) with the columns that tell its rows apart but for equal ones: doc_id, source_key and text_key, in a struct `own row`."""
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), source))
    text = F.col("text").cast("string")
    return docs.withColumn("own row", F.struct(F.col("doc_id").cast("long").alias("doc_id"), key.alias("source_key"), F.xxhash64(text, F.octet_length(text)).alias("text_key")))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_key, text_key, weight and ordinal of every row: equal rows are counted and then numbered, so that no task gathers them."""
    classes = _keyed(docs).select("own row.*", n_words(F.col("text").cast("string")).alias("size")).groupBy("doc_id", "source_key", "text_key", "size").agg(F.count(F.lit(1)).alias("rows"))
    alone = classes.where("rows = 1").withColumn("ordinal", F.lit(0).cast("long")).drop("rows")
    blocks = classes.where("rows > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {BLOCK})")))
    blocks = blocks.repartition("doc_id", "text_key", "block")
    upto = F.expr(f"sequence(block * {BLOCK}, least((block + 1) * {BLOCK}, rows) - 1)")
    rows = alone.unionByName(blocks.withColumn("ordinal", F.explode(upto)).drop("rows", "block"))
    source = F.when(F.col("source_key") != "2", F.substring("source_key", 2, 1 << 30))
    return rows.withColumn("source", source).withColumn("weight", document_weight(F.col("size")))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """Per source key: source_size and target. One row a source goes through the unpartitioned window, never the documents.

    Targets share the sum of sizes by weight. Where that would pass cap times a source's size the target stops there and the
    others share what is left; that is min(cap * size, level * weight) for the level at which targets sum to the total.
    """
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("source_key")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by_source = by_source.withColumn("weight", weight)
    # those that reach their cap first come first
    filled = Window.orderBy(F.when(F.col("source_size") == 0, F.lit(float("inf"))).otherwise(F.col("weight") / F.col("source_size")).desc(), "source_key")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = by_source.withColumn("level", level)
    valid = F.when(F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"), F.col("level"))
    first = F.first(valid, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return leveled.select("source_key", "source_size", target.alias("target"))


def expectations(sizes: DataFrame, by_source: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """Per source and document weight: the expected copies e = min(cap, level * weight) for which the source's words sum to its target."""
    classes = sizes.groupBy("source_key", "weight").agg(F.sum("size").alias("words")).join(by_source, "source_key")
    order = Window.partitionBy("source_key").orderBy(F.col("weight").desc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.coalesce(F.sum(F.lit(float(cap)) * F.col("words")).over(before), F.lit(0.0))
    leveled = classes.withColumn("level", left / F.nullif(F.sum(F.col("words") * F.col("weight")).over(after), F.lit(0.0)))
    first = F.first(F.when(F.col("level") * F.col("weight") <= cap, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = F.least(F.lit(float(cap)), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return leveled.select("source_key", "weight", "source_size", "target", e.alias("expected"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    Null text or text without words: size 0, nothing taken (any copies count 0 words). A null source is a source of its own,
    the last. Rows that share an id, null ids among them, each draw their own number, so that a source meets its target within
    about a document whatever its ids; equal rows are given copies in any order. Long texts count whole. No rows in, no rows out.
    """
    sizes = saved(_rows(docs), "sizes")
    plan = small(saved(expectations(sizes, targets(sizes, weights, cap), cap), "plan"))
    u = _uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), seed, F.col("text_key"), F.col("ordinal"))
    pi = F.col("expected") - F.floor("expected")
    order = ["rank", "doc_id", "text_key", "ordinal"]  # differs for any two rows of a source
    drawn = (
        sizes.join(plan, ["source_key", "weight"])
        .withColumn("certain", F.floor("expected").cast("long"))
        .withColumn("pi", pi)
        .withColumn("u", u)
        # odds / (1 + odds): the same order, between 0 and 1
        .withColumn("rank", F.when(F.col("pi") > 0, F.col("u") * (1 - F.col("pi")) / (F.col("u") * (1 - F.col("pi")) + (1 - F.col("u")) * F.col("pi"))))
        .withColumn("digit", F.least(F.floor(F.col("rank") * RADIX), F.lit(RADIX - 1)).cast("int"))
        .withColumn("digit2", F.least(F.floor((F.col("rank") * RADIX - F.col("digit")) * RADIX), F.lit(RADIX - 1)).cast("int"))
    )
    # words that the drawn copies have to make up, by source
    open_words = drawn.groupBy("source_key").agg(F.sum(F.col("pi") * F.col("size")).alias("open_words"))

    def boundary(rows: DataFrame, digit: str, keys: list) -> DataFrame:
        """Of each source, the digit within which the open words run out, and the words before it."""
        sums = rows.groupBy(*keys, "open_words", digit).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy(*keys).orderBy(digit))
        edge = sums.withColumn("upto", upto).where((F.col("upto") > F.col("open_words")) & (F.col("upto") - F.col("words") <= F.col("open_words")))
        edge = edge.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(digit))).where("n = 1")
        return edge.select(*keys, F.col(digit).alias(f"edge_{digit}"), (F.col("open_words") - (F.col("upto") - F.col("words"))).alias("open_words"))

    ranked = drawn.where("rank is not null").join(small(saved(open_words, "open")), "source_key")
    edge = small(saved(boundary(ranked, "digit", ["source_key"]), "edge"))
    inner = ranked.drop("open_words").join(edge, "source_key").where("digit = edge_digit")
    edge2 = small(saved(boundary(inner, "digit2", ["source_key"]), "edge2"))
    # what is left: of each source, documents that agree in 24 bits of their rank
    last = inner.drop("open_words").join(edge2, "source_key").where("digit2 = edge_digit2")
    upto = F.sum("size").over(Window.partitionBy("source_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).where(F.col("upto") <= F.col("open_words"))
    last = last.groupBy("source_key").agg(F.max(F.struct(*order)).alias("top"), F.max("upto").alias("last_words"))
    limits = edge.withColumnRenamed("open_words", "open_words1").join(edge2.withColumnRenamed("open_words", "open_words2"), "source_key", "left")
    limits = limits.join(last, "source_key", "left")
    lacking = F.coalesce("open_words2", "open_words1") - F.coalesce(F.col("last_words"), F.lit(0))
    limits = small(saved(limits.select("source_key", "edge_digit", "edge_digit2", "top", lacking.alias("lacking")), "limits"))
    inside = (
        F.col("edge_digit").isNull()
        | (F.col("digit") < F.col("edge_digit"))
        | ((F.col("digit") == F.col("edge_digit")) & (F.col("digit2") < F.col("edge_digit2")))
        | ((F.col("digit") == F.col("edge_digit")) & (F.col("digit2") == F.col("edge_digit2")) & (F.struct(*order) <= F.col("top")))
    )
    chosen = drawn.join(limits, "source_key", "left").withColumn("extra", F.col("rank").isNotNull() & F.coalesce(inside, F.lit(False)))
    # the document at the limit is mostly longer than what lacks: the first of those after it that come nearest fills the gap
    gap = F.abs(F.col("size") - F.col("lacking"))
    rest = chosen.where(F.col("rank").isNotNull() & ~F.col("extra") & (gap < F.col("lacking")))
    filler = rest.groupBy("source_key").agg(F.min(F.struct(gap.alias("gap"), *order)).alias("filler"))
    filled = chosen.join(small(saved(filler, "filler")), "source_key", "left")
    filling = F.struct(*order) == F.struct(*(F.col(f"filler.{c}") for c in order))
    copies = (F.col("certain") + F.when(F.col("extra") | F.coalesce(filling, F.lit(False)), 1).otherwise(0)).cast("long")
    return filled.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_key", "text_key"
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Columns as in docs.

    Rows that agree in id, source and text share the copies that they were given: each gets as many as the others or one more.
    Null and empty texts come as often as their weight says; long texts count whole; no rows in, no rows out.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    given = mix(docs, seed).groupBy("doc_id", "source_key", "text_key").agg(F.sum("copies").alias("mix copies"), F.count(F.lit(1)).alias("mix rows"))
    given = saved(given.where(F.col("mix copies") > 0).select(F.struct("doc_id", "source_key", "text_key").alias("given row"), F.col("mix copies"), F.col("mix rows")), "given")
    met = _keyed(docs).join(given.hint("merge"), _same(F.col("own row"), F.col("given row")))
    alone = met.where("`mix rows` = 1").withColumn("nth copy", F.explode(F.expr("sequence(1L, `mix copies`)"))).select(*columns)
    # rows that are equal in every column are counted, numbered within those that agree in id, source and text, and copied by blocks
    groups = met.where("`mix rows` > 1").groupBy(*columns, "own row", "mix copies", "mix rows").agg(F.count(F.lit(1)).alias("equal rows"))
    before = F.sum("equal rows").over(Window.partitionBy("own row").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.lit(0), F.least(F.col("equal rows"), F.expr("`mix copies` % `mix rows`") - F.coalesce(before, F.lit(0))))
    groups = groups.withColumn("own copies", F.expr("`mix copies` div `mix rows`") * F.col("equal rows") + more).where("`own copies` > 0")
    blocks = groups.withColumn("nth block", F.explode(F.expr(f"sequence(0L, (`own copies` - 1) div {BLOCK})"))).repartition("own row", "nth block")
    each = F.expr(f"sequence(`nth block` * {BLOCK}, least((`nth block` + 1) * {BLOCK}, `own copies`) - 1)")
    return alone.unionByName(blocks.withColumn("nth copy", F.explode(each)).select(*columns))


def _same(a: Column, b: Column) -> Column:
    return a["text_key"].eqNullSafe(b["text_key"]) & a["doc_id"].eqNullSafe(b["doc_id"]) & (a["source_key"] == b["source_key"])
