"""Queries on titles, rules, tiers, recommendations and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, titles
from ..operators import layout, ranking
from ..sources.tables import table
from .registry import query

# Patterns, leaves and parents of the rule catalogue, by position.
PATTERNS = [
    (0, "ring", "RING", "JEWEL", 80), (1, "(small|large) ring", "SIZED_RING", "JEWEL", 90), (2, "widget", "WIDGET", "TOOL", 75),
    (3, "bolt|screw", "FASTENER", "TOOL", 85), (4, "^(red|blue|green)", "COLOURED", "LOOK", 60), (5, "gear", "GEAR", "TOOL", 75),
]
_VALUES = ", ".join(f"({p}, '{x}', '{leaf}', '{parent}', {n})" for p, x, leaf, parent, n in PATTERNS)


@query(
    f"WITH r(position, pattern, leaf, parent, priority) AS (VALUES {_VALUES}), "
    "c AS (SELECT p_partkey AS title_id, leaf, parent, priority, regexp_extract(p_name, pattern) AS matched, position FROM part, r WHERE regexp_matches(p_name, pattern)), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY priority DESC, length(matched) DESC, position) AS n FROM c) "
    "SELECT title_id, leaf, parent, matched FROM b WHERE n = 1 AND (priority >= 70 OR length(matched) >= 4)"
)
def pattern_rules(spark, d):
    """The leaf of every part's name by the rule catalogue."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"))
    rules = spark.createDataFrame([(p, x, leaf, parent, n) for p, x, leaf, parent, n in PATTERNS], "position int, pattern string, leaf string, parent string, priority int")
    return ranking.resolved(ranking.pattern_candidates(names, rules), "title_id").select("title_id", "leaf", "parent", "matched")


@query(
    "WITH u AS (SELECT o_custkey AS k, 'URGENT' AS answer FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1), "
    "f AS (SELECT o_custkey AS k, max(o_orderstatus) AS answer FROM orders GROUP BY 1) "
    "SELECT c_custkey, coalesce(u.answer, f.answer, 'UNKNOWN') AS answer, CASE WHEN u.k IS NOT NULL THEN 'urgent' WHEN f.k IS NOT NULL THEN 'status' ELSE 'NONE' END AS method "
    "FROM customer LEFT JOIN u ON u.k = c_custkey LEFT JOIN f ON f.k = c_custkey"
)
def tier_cascade(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    urgent = orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("c_custkey").distinct().withColumn("answer", F.lit("URGENT"))
    status = orders.groupBy("c_custkey").agg(F.max("o_orderstatus").alias("answer"))
    return ranking.first_tier(table(spark, d, "customer"), "c_custkey", [("urgent", urgent), ("status", status)])


@query(
    "WITH jobs AS (SELECT DISTINCT l_suppkey AS job_id, l_partkey AS skill_id, CASE WHEN l_linestatus = 'O' THEN 'PROFESSIONAL' ELSE 'TECHNOLOGY' END AS kind, "
    "CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.4 ELSE 0.7 END AS w, l_returnflag = 'R' AS req FROM lineitem WHERE l_quantity >= 45), "
    "held AS (SELECT o_custkey AS candidate_id, l_partkey AS skill_id, max(CASE WHEN l_tax < 0.03 THEN 0.5 WHEN l_tax < 0.05 THEN 0.75 ELSE 1.0 END) AS credit FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2), "
    "t AS (SELECT job_id, sum(w) FILTER (kind = 'PROFESSIONAL') AS wp, sum(w) FILTER (kind = 'TECHNOLOGY') AS wt, count(*) FILTER (req) AS required FROM jobs GROUP BY 1), "
    "h AS (SELECT candidate_id, job_id, coalesce(sum(w * credit) FILTER (kind = 'PROFESSIONAL'), 0) AS sp, coalesce(sum(w * credit) FILTER (kind = 'TECHNOLOGY'), 0) AS st, count(*) FILTER (req AND (credit >= 0.85 OR kind = 'TECHNOLOGY')) AS covered "
    "FROM jobs JOIN held USING (skill_id) GROUP BY 1, 2), "
    "s AS (SELECT candidate_id, job_id, round(CAST((CASE WHEN wp IS NOT NULL THEN 0.55 * CAST(sp AS DOUBLE) / CAST(wp AS DOUBLE) ELSE 0 END + CASE WHEN wt IS NOT NULL THEN 0.45 * CAST(st AS DOUBLE) / CAST(wt AS DOUBLE) ELSE 0 END) / (CASE WHEN wp IS NOT NULL THEN 0.55 ELSE 0 END + CASE WHEN wt IS NOT NULL THEN 0.45 ELSE 0 END) "
    "* CASE WHEN required > 0 THEN 0.5 + 0.5 * covered / required ELSE 1 END AS DOUBLE), 6) AS score FROM h JOIN t USING (job_id)) "
    "SELECT candidate_id, job_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) AS rank FROM s) WHERE rank <= 5"
)
def job_recommendations(spark, d):
    """Customers stand for candidates, what they bought for the skills they hold, suppliers for jobs."""
    lines = table(spark, d, "lineitem")
    kind, requirement = F.when(F.col("l_linestatus") == "O", "PROFESSIONAL").otherwise("TECHNOLOGY"), F.when(F.col("l_returnflag") == "R", "REQUIRED").when(F.col("l_returnflag") == "A", "PREFERRED").otherwise("UNSPECIFIED")
    jobs = lines.where("l_quantity >= 45").select(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("skill_id"), kind.alias("kind"), requirement.alias("requirement")).distinct()
    level = F.when(F.col("l_tax") < 0.03, "BEGINNER").when(F.col("l_tax") < 0.05, "INTERMEDIATE").otherwise("ADVANCED")
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'")
    held = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("candidate_id"), F.col("l_partkey").alias("skill_id")).agg(F.max(ranking.proficiency_factor(level)).alias("credit"))
    return ranking.recommend(jobs, held, 5)


@query(
    "SELECT p_partkey, regexp_split_to_array(p_name || ' / ' || p_brand || ' (' || p_type || ')', '\\s*(?:[|/,;:()])\\s*') [1:3] AS segments FROM part"
)
def title_segments(spark, d):
    made = F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", titles.segments(made).alias("segments"))


@query(
    "SELECT p_partkey, p_name AS retrieval, 'senior ' || p_name || ', $' || p_size || 'k | paris' AS rule, list_concat(string_split(p_name, ' '), [p_size || 'k', 'paris']) AS tokens FROM part"
)
def retrieval_titles(spark, d):
    """Retrieval and rule forms, and tokens, of titles made of names, salaries and places in the tables."""
    made = F.concat(F.lit("Senior "), F.col("p_name"), F.lit(", $"), F.col("p_size").cast("string"), F.lit("k | Paris"))
    return table(spark, d, "part").select("p_partkey", titles.retrieval_title(made).alias("retrieval"), titles.rule_title(made).alias("rule"), titles.title_tokens(made).alias("tokens"))


@query()
def fuzzy_names(spark, d):
    """Different part names that share a token and are alike by token sets; blocked by token, not all with all."""
    names = table(spark, d, "part").select("p_name").distinct()
    cut = names.select("p_name", F.explode(similarity.blocked(F.col("p_name"))).alias("token"))
    pairs = cut.alias("a").join(cut.alias("b"), "token").where("a.p_name < b.p_name").select(F.col("a.p_name").alias("left_name"), F.col("b.p_name").alias("right_name")).distinct()
    return pairs.withColumn("score", F.round(similarity.token_set_column("left_name", "right_name"), 3)).where("score >= 60")


def _words(spark, d):
    """Turns as pages of positioned words: ten points a line, six a character."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    # a word begins behind a blank: places of a line's blanks are found once, not once a word
    blanks = F.transform(F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)), lambda c, i: F.when(c == " ", i + 1))
    starts = F.concat(F.array(F.lit(0)), F.filter(blanks, lambda i: i.isNotNull()))
    words = lines.select("conv_id", "turn", "row", F.inline(F.arrays_zip(F.split("line", " ").alias("word"), starts.alias("before"))))
    x0 = (6.0 * F.col("before")).cast("double")
    y0 = (10.0 * F.col("row")).cast("double")
    placed = words.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.col("word").alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 6.0 * F.length("word")).alias("x1"), (y0 + 8.0).alias("y1"), F.lit(8.0).alias("font"))
    return placed.where("text <> ''")


@query(
    "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) "
    "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ' ') AS text, count(*) AS n FROM l WHERE len(list_filter(string_split(line, ' '), lambda w: w <> '')) > 0 GROUP BY 1, 2, 3"
)
def page_lines(spark, d):
    """Lines found again from words and their boxes."""
    return layout.lines(layout.distinct_words(_words(spark, d))).groupBy("doc_id", "page", "text").agg(F.count(F.lit(1)).alias("n"))


@query()
def page_reading_order(spark, d):
    """Blocks of every page in reading order, and the section of each line's block."""
    rows = layout.blocks(layout.sections(layout.lines(_words(spark, d))))
    placed = layout.reading_order(rows, F.collect_set("section").alias("sections"))
    return placed.select("doc_id", "page", "block", F.explode("sections").alias("section"), "band", "column", "place")


@query(
    "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, CASE WHEN sum(length(w)) < 40 OR sum(length(regexp_replace(w, '[\\p{L}\\p{N}\\p{M}_\\p{P}\\p{S}\\s]', '', 'g'))) > 0.02 * sum(length(w)) OR avg(CASE WHEN length(w) = 1 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'POOR' ELSE 'GOOD' END AS state "
    "FROM (SELECT conv_id, turn, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY 1, 2"
)
def page_states(spark, d):
    return layout.page_state(_words(spark, d))
