"""Queries over names, titles, skills and field results: lookups with their precedence, statuses and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import lookups as L
from ..sources.tables import table
from .registry import query


def _lower(text):
    return F.lower(F.trim(text))


@query(
    "WITH f AS (SELECT lower(p_type) AS k, min(p_partkey) AS first_part FROM part GROUP BY 1) "
    "SELECT s_suppkey, first_part FROM supplier LEFT JOIN (SELECT p_partkey, first_part FROM part JOIN f ON k = lower(p_type)) ON p_partkey = s_suppkey * 3"
)
def leaf_by_name(spark, d):
    """Names with hyphens and in another case looked up in a catalogue whose first row of a name wins; without a match: null."""
    part = table(spark, d, "part").select("p_partkey", "p_type")
    names = part.select(F.col("p_partkey").alias("key"), F.upper(F.translate("p_type", " ", "-")).alias("name"))
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("key")).join(names, "key", "left")
    found = L.by_name(rows, "name", part, "p_type", F.col("p_partkey"))
    return found.select("s_suppkey", F.col("p_partkey").alias("first_part"))


@query(
    "WITH n AS (SELECT c_custkey, unnest([c_mktsegment, c_name, 'No One']) AS name FROM customer), k AS (SELECT lower(c_name) AS k, min(c_custkey) AS id FROM customer WHERE c_acctbal > 0 GROUP BY 1) "
    "SELECT CASE WHEN id IS NULL THEN name ELSE 'matched' END AS name, count(*) AS n FROM n LEFT JOIN k ON k = lower(name) GROUP BY 1"
)
def list_edges(spark, d):
    """Lists of names apart by semicolons as edges, and the names that match nothing."""
    customer = table(spark, d, "customer")
    rows = customer.select("c_custkey", F.concat_ws(" ; ", "c_mktsegment", F.upper("c_name"), F.lit("No One")).alias("names"))
    known = customer.where("c_acctbal > 0").select(F.col("c_name").alias("label"), F.col("c_custkey").alias("id"))
    edges, unmatched = L.list_edges(rows, "c_custkey", "names", known, "label", "id")
    # an upper-case name stands for the table's own spelling
    own = customer.select(F.upper("c_name").alias("name"), F.col("c_name").alias("spelling"))
    left = unmatched.join(own, "name", "left").select(F.coalesce("spelling", "name").alias("name"), F.col("n_rows").alias("n"))
    return edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("matched").alias("name"), "n").unionByName(left)


@query(
    "WITH t AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' (' || p_brand || ')' END AS title FROM part), a AS (SELECT lower(trim(p_name)) AS k, min(p_partkey) AS id FROM part GROUP BY 1), "
    "e AS (SELECT title, id FROM t JOIN a ON k = lower(title)), s AS (SELECT title, id FROM t JOIN a ON k = lower(trim(split_part(title, '(', 1))) WHERE title NOT IN (SELECT title FROM e) AND contains(title, '(')) "
    "SELECT title, id, 'exact' AS method FROM e UNION ALL SELECT title, id, 'before_bracket' FROM s"
)
def title_alias_match(spark, d):
    """Titles by equal normal form, else by the text before the bracket."""
    part = table(spark, d, "part")
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    aliases = part.groupBy(_lower("p_name").alias("label")).agg(F.min("p_partkey").alias("id"))
    return L.match_titles(part.select(title.alias("title")).distinct(), aliases, _lower)


@query(
    "WITH p AS (SELECT p_type AS title, p_partkey AS r, p_brand AS f, 'P' || p_size % 7 AS p, CASE WHEN p_size > 40 THEN 'L' || p_size % 3 END AS l, p_size % 11 = 0 AS s, p_size % 5 <> 0 AS dir FROM part WHERE p_size > 25), "
    "g AS (SELECT title, count(DISTINCT CASE WHEN l IS NOT NULL THEN f || '/' || p || '/' || l END) AS n_paths, arg_min(struct_pack(f := f, p := p, l := l), r) FILTER (WHERE l IS NOT NULL) AS best, arg_min(struct_pack(f := f, p := p, l := l), r) AS one, bool_or(s) AS s, bool_and(dir) FILTER (WHERE l IS NOT NULL) AS dir FROM p GROUP BY 1), "
    "x AS (SELECT t.title, coalesce(n_paths, 0) AS n_paths, CASE WHEN one IS NULL THEN 'no_match' WHEN n_paths = 0 THEN 'candidate_title_parent_only' WHEN s AND NOT dir THEN 'candidate_title_requires_description' WHEN n_paths = 1 THEN 'resolved_title' ELSE 'resolved_title_with_alternatives' END AS status, coalesce(best, one) AS c FROM (SELECT DISTINCT p_type AS title FROM part) t LEFT JOIN g ON g.title = t.title) "
    "SELECT title, status, n_paths, c.f AS family_id, c.p AS parent_id, CASE WHEN status LIKE 'resolved%' THEN c.l END AS leaf_id FROM x"
)
def title_states(spark, d):
    """Each title's status by the paths that it has, and the first of them."""
    part = table(spark, d, "part")
    paths = part.where("p_size > 25").select(
        F.col("p_type").alias("title"), F.col("p_partkey").alias("rank"), F.col("p_brand").alias("family_id"), F.concat(F.lit("P"), F.col("p_size") % 7).alias("parent_id"),
        F.when(F.col("p_size") > 40, F.concat(F.lit("L"), F.col("p_size") % 3)).alias("leaf_id"), (F.col("p_size") % 11 == 0).alias("reviewed_set"), (F.col("p_size") % 5 != 0).alias("direct"),
    )
    return L.title_status(part.select(F.col("p_type").alias("title")), paths)


@query(
    "WITH a AS (SELECT p_partkey AS s, lower(p_name) AS k, true AS pref FROM part UNION ALL SELECT p_partkey, lower(p_brand), false FROM part), b AS (SELECT k, max(pref) AS pref FROM a GROUP BY 1), "
    "g AS (SELECT a.k, count(DISTINCT s) AS n, min(s) AS one FROM a JOIN b ON a.k = b.k AND a.pref = b.pref GROUP BY 1), "
    "i AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 4 = 0 THEN lower(p_brand) WHEN p_partkey % 4 = 1 THEN lower(p_name) WHEN p_partkey % 4 = 2 THEN 'nothing' END AS k FROM part), "
    "x AS (SELECT item, i.k, coalesce(n, 0) AS n, one, p_size % 10 = 0 AS waits FROM i LEFT JOIN g ON g.k = i.k LEFT JOIN part ON p_partkey = one) "
    "SELECT item, CASE WHEN k IS NULL THEN CASE WHEN item % 8 = 7 THEN 'unknown_id' ELSE 'resolved_id' END WHEN n = 0 THEN 'unknown_label' WHEN n > 1 THEN 'ambiguous_label' WHEN waits THEN 'context_required' ELSE 'resolved_label' END AS status, "
    "CASE WHEN k IS NULL THEN CASE WHEN item % 8 <> 7 THEN item END WHEN n = 1 AND NOT waits THEN one END AS skill_id FROM x"
)
def skill_states(spark, d):
    """Items by id or label against preferred names and shared aliases, with the status of each."""
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    label = F.when(key % 4 == 0, F.col("p_brand")).when(key % 4 == 1, F.col("p_name")).when(key % 4 == 2, F.lit("nothing"))
    none = F.lit(None).cast("string")
    items = part.select(key.alias("item"), F.when(key % 4 == 3, F.when(key % 8 == 7, -key).otherwise(key)).alias("skill_id"), none.alias("namespace"), none.alias("external_id"), label.alias("label"))
    resolution = part.select(key.alias("source_skill_id"), key.alias("resolved_skill_id"))
    skills = part.select(key.alias("skill_id"), F.when(F.col("p_size") % 10 == 0, "CONTEXT_REQUIRED").alias("matching_policy"))
    aliases = part.select(key.alias("skill_id"), F.lower("p_name").alias("normalized_label"), F.lit("preferred").alias("alias_type"))
    aliases = aliases.unionByName(part.select(key.alias("skill_id"), F.lower("p_brand").alias("normalized_label"), F.lit("alias").alias("alias_type")))
    external = part.limit(0).select(none.alias("namespace"), none.alias("external_id"), key.alias("skill_id"), none.alias("review_status"), none.alias("relation"))
    return L.resolve_skills(items, resolution, skills, aliases, external, _lower)


@query(
    "WITH r AS (SELECT doc_id, coalesce(lang, 'UNKNOWN') AS v, 0.9 AS c FROM documents WHERE doc_id % 3 > 0), m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END AS v, CAST(n_chars % 100 AS DOUBLE) / 100 AS c FROM documents WHERE doc_id % 5 > 0) "
    "SELECT coalesce(r.doc_id, m.doc_id) AS doc_id, CASE WHEN coalesce(r.v, 'UNKNOWN') <> 'UNKNOWN' THEN r.v WHEN m.c >= 0.65 THEN m.v ELSE 'UNKNOWN' END AS value, CASE WHEN coalesce(r.v, 'UNKNOWN') <> 'UNKNOWN' THEN r.c WHEN m.c >= 0.65 THEN m.c ELSE 0 END AS confidence, "
    "CASE WHEN coalesce(r.v, 'UNKNOWN') <> 'UNKNOWN' OR m.c >= 0.65 THEN 'HYBRID' ELSE 'UNKNOWN' END AS source, CAST(CASE WHEN coalesce(r.v, 'UNKNOWN') <> 'UNKNOWN' AND m.v <> r.v THEN 1 ELSE 0 END AS INTEGER) AS n_warnings FROM r FULL JOIN m ON m.doc_id = r.doc_id"
)
def hybrid_results(spark, d):
    """Rule first, a confident model next, a warning where both know different values."""
    docs = table(spark, d, "documents")
    rules = docs.where("doc_id % 3 > 0").select("doc_id", F.coalesce("lang", F.lit("UNKNOWN")).alias("value"), F.lit(0.9).alias("confidence"))
    models = docs.where("doc_id % 5 > 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr").alias("value"), ((F.col("n_chars") % 100).cast("double") / 100).alias("confidence"))
    found = E.hybrid_fields(rules, models, ["doc_id"])
    return found.select("doc_id", "value", "confidence", "source", F.size("warnings").alias("n_warnings"))


@query(
    "WITH x AS (SELECT c_custkey, c_mktsegment AS p, 'N' || c_nationkey AS l, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' WHEN c_custkey % 3 = 1 THEN 'UNKNOWN' END AS m, c_acctbal / 10000 AS c FROM customer), "
    "y AS (SELECT *, CASE WHEN m <> 'UNKNOWN' AND c >= 0.55 THEN m ELSE p END AS parent FROM x) "
    "SELECT c_custkey, parent, CASE WHEN p = parent THEN l ELSE 'UNKNOWN' END AS leaf, CASE WHEN c >= 0.7 THEN p WHEN m <> 'UNKNOWN' THEN m ELSE p END AS preferred, "
    "CASE WHEN c >= 0.9 THEN p WHEN m <> 'UNKNOWN' AND c >= 0.7 THEN m ELSE 'UNKNOWN' END AS level FROM y"
)
def field_conflicts(spark, d):
    """A taxonomy's parent and leaf against a model's, and a rule's value against it."""
    key, sure = F.col("c_custkey"), F.col("c_acctbal") / 10000
    model = F.when(key % 3 == 0, "BUILDING").when(key % 3 == 1, "UNKNOWN")
    both = E.parent_and_leaf(F.col("c_mktsegment"), F.concat(F.lit("N"), F.col("c_nationkey")), model, sure)
    level = E.seniority_of(F.col("c_mktsegment"), sure, model, sure, F.lit(None).cast("string"))
    return table(spark, d, "customer").select("c_custkey", both.alias("b"), E.preferred(F.col("c_mktsegment"), sure, model).alias("preferred"), level.alias("level")).select("c_custkey", "b.*", "preferred", "level")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_ids(spark, d):
    return L.missing_ids(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id")


@query(
    "WITH k AS (SELECT DISTINCT 'k_' || p_brand AS id, p_brand AS name FROM part WHERE p_size > 45), n AS (SELECT lower(v) AS lo, min(v) AS name FROM (SELECT p_brand AS v FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT upper(p_type) FROM part) GROUP BY 1) "
    "SELECT id, name FROM k UNION ALL SELECT 'new_' || left(sha256(lo), 16), name FROM n WHERE lo NOT IN (SELECT lower(name) FROM k)"
)
def find_or_create(spark, d):
    """Names found in any case, and a row with a key of its own for each that is new."""
    part = table(spark, d, "part")
    known = part.where("p_size > 45").select(F.concat(F.lit("k_"), "p_brand").alias("id"), F.col("p_brand").alias("name")).distinct()
    names = part.select(F.explode(F.array("p_brand", "p_type", F.upper("p_type"))).alias("name"))
    return L.find_or_create(names, known, "name", "id")


@query()
def page_offers(spark, d):
    """Pages that every page links to, by the last part of the link, the first link of each."""
    number = lambda link: F.nullif(F.regexp_extract(link, r"/([^/?]+)$", 1), F.lit(""))
    return L.listing_offers(table(spark, d, "pages").select("page_id", "url", "html"), "page_id", number)
