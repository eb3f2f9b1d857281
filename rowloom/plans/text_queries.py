"""Queries over names and technologies in text, closures of graphs and joins of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.phrases import bound
from ..operators import geometry, graphs, mentions, packing, paths, policy, sections, technologies
from ..operators.steps import kept
from ..sources.tables import table
from .registry import query


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names out of the benchmark's items: their first three words, and their first word of seven letters."""
    words = F.split(F.regexp_replace("text", "[.,]", ""), "[ \\n]+")
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w"))
    names = F.array(F.array_join(F.slice("w", 1, 3), " "), F.get(F.filter("w", lambda x: x.rlike("^[A-Za-z]{7,}$")), F.lit(0)))
    return rows.select("item_id", F.explode(F.array_compact(names)).alias("name")).distinct()


@query(
    "WITH b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[.,]', '', 'g'), '[ \\n]+'), lambda x: true) AS w FROM benchmark), "
    "n AS (SELECT DISTINCT item_id, unnest([array_to_string(w[1:3], ' '), list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]{7,}'))[1]]) AS name FROM b), "
    "m AS (SELECT doc_id, item_id, name, text, unnest(range(1, length(text) - length(name) + 2)) AS \"at\" FROM documents JOIN n ON contains(lower(text), lower(name))) "
    "SELECT doc_id, item_id, name, substr(text, \"at\", length(name)) AS surface, CAST(\"at\" - 1 AS INTEGER) AS \"start\", CAST(\"at\" - 1 + length(name) AS INTEGER) AS \"end\" FROM m "
    "WHERE lower(substr(text, \"at\", length(name))) = lower(name) AND NOT regexp_matches(substr(' ' || text, \"at\", 1), '[\\p{L}\\p{N}_+#.]') AND NOT regexp_matches(substr(text, \"at\" + length(name), 1), '[\\p{L}\\p{N}_+#]')"
)
def literal_mentions(spark, d):
    """Every place where a document names an item of the benchmark."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return mentions.mentions(docs, "doc_id", "text", _names(spark, d), "name")


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon of technologies out of the benchmark's items: names, aliases with blanks and slashes, and all policies."""
    words = F.filter(F.split(F.regexp_replace("text", "[.,|]", ""), "[ \\n]+"), lambda x: F.length(x) >= 3)
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("position"), words.alias("w"), F.pmod("item_id", F.lit(5)).alias("kind")).where("size(w) >= 8")
    policies = F.when(F.col("kind") == 0, "CONTEXT_REQUIRED").when(F.col("kind") == 1, "DISABLED").when(F.col("kind") == 2, None).otherwise("SAFE")
    w = F.col("w")
    aliases = F.concat(F.array_join(F.slice("w", 1, 2), " "), F.lit("|"), F.array_join(F.slice("w", 1, 3), " "), F.lit(" ; "), w[3], F.lit("/"), w[4], F.lit("|"), w[5])
    return rows.select("position", F.concat(F.lit("B"), "position").alias("tech_id"), F.initcap(w[6]).alias("canonical"), aliases.alias("aliases"), policies.alias("policy"), F.lit("OTHER_IT_TECH").alias("category"))


def common_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that every tenth document holds."""
    docs = table(spark, d, "documents").select("text")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("lemma"))
    return words.groupBy("lemma").count().where(F.col("count") * 10 >= docs.count()).select("lemma")


@query()
def technology_hits(spark, d):
    """Technologies of a lexicon in every document, in three passes over its text; the first place of each."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return technologies.recover(docs, "doc_id", "text", lexicon(spark, d), common_words(spark, d), "lemma")


@query(
    "WITH lemma AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS w FROM part WHERE p_size % 10 = 0 UNION SELECT unnest([" + ", ".join(f"'{w}'" for w in policy.COMMON) + "])), "
    "e AS (SELECT p_partkey AS tech_id, p_name, unnest(list_concat([p_name], string_split(p_name, ' '))) AS alias, p_size % 4 AS n, p_size % 5 = 0 OR p_size % 11 = 0 AS wanted, p_size % 7 <> 0 AS it, CASE WHEN p_size % 3 = 0 THEN 'DB' ELSE 'OTHER_IT_TECH' END AS cat FROM part), "
    "k AS (SELECT *, alias IN (SELECT w FROM lemma) AS common, length(alias) <= 2 AS tiny, p_name IN (SELECT w FROM lemma) AS main FROM e), "
    "p AS (SELECT *, CASE WHEN NOT it THEN 'DISABLED_BY_DEFAULT' WHEN bool_or(tiny) OVER w THEN 'CONTEXT_REQUIRED' WHEN bool_or(common) OVER w THEN CASE WHEN main AND n <= 1 AND cat = 'OTHER_IT_TECH' THEN 'DISABLED_BY_DEFAULT' ELSE 'CONTEXT_REQUIRED' END "
    "WHEN n >= 2 OR wanted OR cat <> 'OTHER_IT_TECH' THEN 'SAFE' ELSE 'CONTEXT_REQUIRED' END AS recommended_policy FROM k WINDOW w AS (PARTITION BY tech_id)) "
    "SELECT tech_id, alias, recommended_policy FROM p WHERE common"
)
def policy_audit(spark, d):
    """Names of catalogue entries that are common words, with the policy that their entry should have."""
    part = table(spark, d, "part")
    lemmas = part.where("p_size % 10 = 0").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("lemma"))
    entries = part.select(
        F.col("p_partkey").alias("tech_id"), F.col("p_name").alias("canonical"), F.split("p_name", " ").alias("aliases"), (F.col("p_size") % 4).alias("source_count"), (F.col("p_size") % 5 == 0).alias("hot"),
        (F.col("p_size") % 11 == 0).alias("demand"), (F.col("p_size") % 7 != 0).alias("any_it"), F.when(F.col("p_size") % 3 == 0, "DB").otherwise("OTHER_IT_TECH").alias("category"), F.lit("SAFE").alias("policy"),
    )
    return policy.collisions(entries, lemmas, "lemma").select("tech_id", "alias", "recommended_policy")


_EDGES = "e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey * 2 + 5 FROM part WHERE p_partkey % 97 = 1)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each part below two others, and some above again, which closes cycles."""
    key, part = F.col("p_partkey"), table(spark, d, "part")
    down = part.where("p_partkey > 0").select(key.alias("child"), F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("parent"))
    return down.unionByName(part.where("p_partkey % 97 = 1").select(key.alias("child"), (key * 2 + 5).alias("parent")))


@query("WITH RECURSIVE " + _EDGES + ", c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child) SELECT child, parent FROM c")
def ancestor_closure(spark, d):
    """Every node of a graph of many parents with all its ancestors."""
    return graphs.closure(_edges(spark, d), "child", "parent").drop("steps")


@query("WITH RECURSIVE " + _EDGES + ", c AS (SELECT p_partkey AS node FROM part WHERE p_size = 50 UNION SELECT e.parent FROM c JOIN e ON c.node = e.child) SELECT node FROM c")
def broader_concepts(spark, d):
    """All that the concepts in use stand below, in any number of steps."""
    seeds = table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    return graphs.reachable(_edges(spark, d), "child", "parent", seeds, "node").drop("steps")


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS k, epoch(l_shipdate) / 86400 AS s, epoch(l_shipdate) / 86400 + l_quantity AS e FROM lineitem), r AS (SELECT k, date_trunc('month', to_timestamp(s * 86400) AT TIME ZONE 'UTC') AS m, min(s) AS s, min(s) + 20 + count(*) AS e FROM l GROUP BY 1, 2) "
    "SELECT l.k AS l_suppkey, count(*) AS n_pairs, sum(least(l.e, r.e) - greatest(l.s, r.s)) AS days FROM l JOIN r ON l.k = r.k AND l.s < r.e AND r.s < l.e GROUP BY 1"
)
def overlapping_spans(spark, d):
    """Deliveries beside their supplier's monthly spans of work: pairs that overlap, and the days they share."""
    day = F.unix_timestamp("l_shipdate") / 86400
    left = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("s"), (day + F.col("l_quantity")).alias("e"), F.date_trunc("month", "l_shipdate").alias("m"))
    right = left.groupBy("k", "m").agg(F.min("s").alias("s"), (F.min("s") + 20 + F.count(F.lit(1))).alias("e"))
    pairs = geometry.overlap_join(left.select("k", "s", "e"), right.select("k", "s", "e"), ["k"], ("s", "e"), ("s", "e"), 16.0)
    days = F.least("l.e", "r.e") - F.greatest("l.s", "r.s")
    return pairs.groupBy(F.col("l.k").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(days).alias("days"))


@query(
    "WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, year(o_orderdate + INTERVAL 400 DAY) AS y2, month(o_orderdate + INTERVAL 400 DAY) AS m2 FROM orders) "
    "SELECT o_orderkey, CASE WHEN k = 5 THEN NULL WHEN k = 2 THEN y2 ELSE y END AS start_year, CASE WHEN k IN (0, 1, 2) THEN m END AS start_month, CASE WHEN k IN (0, 2, 3) THEN y2 END AS end_year, CASE WHEN k IN (0, 2) THEN m2 END AS end_month, CASE WHEN k < 5 THEN k = 1 END AS is_current FROM o"
)
def date_ranges(spark, d):
    """Ranges of dates read from lines that write them in six ways."""
    a, b, k = F.col("o_orderdate"), F.date_add("o_orderdate", 400), F.col("o_orderkey") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("Clerk, "), F.date_format(a, "MM/yyyy"), F.lit(" - "), F.date_format(b, "M.yyyy"), F.lit(", "), "o_orderpriority"))
        .when(k == 1, F.concat(F.lit("since "), F.upper(F.date_format(a, "MMM yyyy")), F.lit(" to Present")))
        .when(k == 2, F.concat(F.date_format(a, "MMMM"), F.lit(" – "), F.date_format(b, "MMM. yyyy")))
        .when(k == 3, F.concat(F.date_format(a, "yyyy"), F.lit(" à "), F.date_format(b, "yyyy")))
        .when(k == 4, F.concat(F.lit("certified "), F.date_format(a, "yyyy"), F.lit(", order "), F.lit("A7")))
        .otherwise("neither a month nor a year")
    )
    rows = table(spark, d, "orders").select("o_orderkey", dates.date_range(line).alias("r"))
    return rows.select("o_orderkey", F.col("r.start.year").alias("start_year"), F.col("r.start.month").alias("start_month"), F.col("r.end.year").alias("end_year"), F.col("r.end.month").alias("end_month"), "r.is_current")


_HEADS = ["Education", "Missions:", "Requirements -", "Atouts", "Preferred:"]


# a heading may also stand in a turn, at the beginning of a line and as the beginning of a longer word
_HEADINGS = (
    "profil recherch[ée]|missions?|responsabilit[ée]s|activit[ée]s principales(?: du poste)?|comp[ée]tences (?:et )?connaissances requises|"
    "qualifications?|[ée]ducation|exp[ée]rience|requirements?|required skills|nice to have|atouts?|preferred"
)


@query(
    "WITH t AS (SELECT conv_id, string_agg(['Education', 'Missions:', 'Requirements -', 'Atouts', 'Preferred:'][CAST(turn % 5 + 1 AS INTEGER)] || ' ' || text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1), "
    f"c AS (SELECT conv_id, string_split(regexp_replace(text, '(?im)(^|\\n)(\\s*)({_HEADINGS})', chr(1) || '\\3', 'g'), chr(1)) AS bodies FROM t), "
    "b AS (SELECT conv_id, unnest(bodies) AS body, unnest(range(len(bodies))) AS part FROM c), "
    "s AS (SELECT conv_id, part, list_filter(string_split_regex(body, '[\\s\\p{Z}]+'), lambda x: x <> '') AS w, "
    f"lower(CASE WHEN part > 0 THEN regexp_extract(body, '(?i)^({_HEADINGS})', 1) ELSE '' END) AS h FROM b), "
    "p AS (SELECT *, CASE WHEN regexp_matches(h, 'mission|responsabilit|activit|role') THEN 1 WHEN regexp_matches(h, 'profil recherch|compétence|competence|connaissance requise|requirement|required skill') THEN 2 "
    "WHEN regexp_matches(h, 'qualification|education|expérience|experience|diplôme|diplome') THEN 3 WHEN regexp_matches(h, 'nice to have|atout|preferred') THEN 4 ELSE 5 END AS p FROM s WHERE len(w) > 0), "
    "u AS (SELECT *, sum(len(w)) OVER (PARTITION BY conv_id ORDER BY p, part) AS upto FROM p) "
    "SELECT conv_id, string_agg(array_to_string(w[1:CAST(least(len(w), 150 - (upto - len(w))) AS INTEGER)], ' '), ' ' ORDER BY p, part) AS packed_words FROM u WHERE upto - len(w) < 150 GROUP BY 1"
)
def packed_views(spark, d):
    """The turns of each conversation as headed sections, packed by priority into 150 words."""
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("turn") % 5 + 1).cast("int"))
    turns = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.concat(head, F.lit(" "), "text").alias("part"))
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("text"))
    views = packing.packed(texts, "conv_id", "text", F.lit(150))
    return views.select("conv_id", F.array_join(packing.words(F.col("view")), " ").alias("packed_words"))


@query(
    "WITH t AS (SELECT doc_id, CASE WHEN trim(text) = '' OR text IS NULL THEN [] ELSE string_split_regex(trim(regexp_replace(text, '[\\s\\p{Z}\\x0B\\x{85}]+', ' ', 'g')), ' ') END AS w FROM documents), "
    "n AS (SELECT doc_id, w, CASE WHEN len(w) <= 61 THEN 1 ELSE CAST(ceil((len(w) - 61) / 30.0) AS INTEGER) + 1 END AS n FROM t WHERE len(w) > 0) "
    "SELECT doc_id, n AS n_windows, md5(array_to_string(w[(n - 1) * 30 + 1:(n - 1) * 30 + 61], ' ')) AS last_window FROM n"
)
def token_windows(spark, d):
    """Windows of 61 words by steps of 30 over every document: their number, and the last."""
    # a text without a word has no window
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"(?U)\S"))
    last = lambda w: F.md5(F.substring(F.element_at(w, -1), len(packing.PREFIX) + 1, 1 << 30))
    found = bound(packing.windows(F.col("text")), lambda w: F.struct(F.size(w).alias("n_windows"), last(w).alias("last_window")))
    return docs.select("doc_id", F.inline(F.array(found)))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of conversations: a short line without a full stop is a heading, and its look depends on its length."""
    turns = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", "[\n.]")).alias("nth", "text"))
    rows = turns.where(F.trim("text") != "").withColumn("line", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "nth")))
    words = F.size(packing.words(F.col("text")))
    return rows.select("conv_id", "line", F.trim("text").alias("text"), (words <= 9).alias("is_heading"), F.concat(F.lit("look"), F.length("text") % 3).alias("style"))


def _headings(lines: DataFrame) -> DataFrame:
    """Distinct headings and their number, written once: what follows reads them many times."""
    return kept(lines.where("is_heading").groupBy("text").count())


def aliases(spark: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    """Names of sections out of the most frequent short lines, some a letter short, of types in turn."""
    counts = _headings(_lines(spark, d)) if counts is None else counts
    place = F.row_number().over(Window.orderBy(F.desc("count"), "text"))
    kinds = F.array(*map(F.lit, ["PROFESSIONAL_EXPERIENCE", "SKILLS", "EDUCATION", "IGNORED"]))
    top = counts.orderBy(F.desc("count"), "text").limit(200).withColumn("place", place)
    alias = F.when(F.col("place") % 3 == 0, F.col("text")).otherwise(F.expr("substring(text, 1, length(text) - 1)"))
    return top.select(alias.alias("alias"), F.element_at(kinds, (F.col("place") % 4 + 1).cast("int")).alias("section_type"), "place")


def headed_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(_lines(spark, d))
    counts = _headings(rows)
    kinds = sections.classify_headings(counts, "text", aliases(spark, d, counts))
    return rows.join(kinds, rows["text"] == kinds["heading"], "left").select(*(rows[c] for c in rows.columns), F.coalesce("section_type", F.lit("UNKNOWN")).alias("section_type"), F.coalesce("method", F.lit("UNKNOWN")).alias("method"), "score")


@query()
def heading_kinds(spark, d):
    """Every short line of the conversations as a heading: by its name, by a name much like it, or unknown."""
    counts = _headings(_lines(spark, d))
    return sections.classify_headings(counts, "text", aliases(spark, d, counts))


@query()
def section_starts(spark, d):
    """Sections of every conversation, their lines read in order."""
    return sections.sections(headed_lines(spark, d), "conv_id").select("conv_id", "section", "section_type", "method", "first_line", "last_line")


@query(
    "WITH h AS (SELECT 'L' || p_partkey AS leaf, p_brand AS family, p_type AS parent FROM part WHERE p_partkey < 60), "
    "c AS (SELECT l_suppkey * 40 + month(l_shipdate) AS key, l_returnflag AS source, 'L' || (l_partkey % 70) AS leaf, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'Brand#1' END AS family, round(l_discount * 10, 1) AS score, l_quantity = 50 AS forced FROM lineitem), "
    "m AS (SELECT key, leaf, h.family, h.parent, max(score) AS score, list_sort(list(DISTINCT source)) AS sources, bool_or(forced) AS forced FROM c JOIN h USING (leaf) WHERE (coalesce(c.family, '') = '' OR c.family = h.family) AND (score <> 0 OR forced) GROUP BY 1, 2, 3, 4), "
    "r AS (SELECT 'L' || 3 * p_partkey AS winner, 'L' || (3 * p_partkey + 1) AS loser FROM part UNION SELECT 'L' || 3 * p_partkey, 'L' || (6 * p_partkey + 3) FROM part), "
    "p AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS w JOIN r ON w.leaf = r.winner WHERE w.key = m.key AND r.loser = m.leaf)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY forced DESC, score DESC, len(sources) DESC, leaf) AS rank FROM p) "
    "SELECT key, leaf, family, parent, score, array_to_string(sources, ',') AS sources, forced, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5"
)
def occupation_paths(spark, d):
    """The five best paths of each key: candidates checked against the catalogue, merged, and without those that others cover."""
    part, item = table(spark, d, "part"), table(spark, d, "lineitem")
    leaf = lambda n: F.concat(F.lit("L"), n.cast("string"))
    n = F.col("p_partkey")
    hierarchy = part.where("p_partkey < 60").select(leaf(n).alias("leaf"), F.col("p_brand").alias("family"), F.col("p_type").alias("parent"))
    candidates = item.select(
        (F.col("l_suppkey") * 40 + F.month("l_shipdate")).alias("key"), F.col("l_returnflag").alias("source"), leaf(F.col("l_partkey") % 70).alias("leaf"),
        F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "Brand#1").alias("family"), F.lit(None).cast("string").alias("parent"),
        F.round(F.col("l_discount") * 10, 1).alias("score"), (F.col("l_quantity") == 50).alias("forced"),
    )
    rules = part.select(leaf(n * 3).alias("winner"), F.explode(F.array(leaf(n * 3 + 1), leaf(n * 6 + 3))).alias("loser"))
    return paths.selected(candidates, hierarchy, rules).withColumn("sources", F.array_join("sources", ","))
