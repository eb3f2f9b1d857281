"""Queries over texts, pages, conversations and vectors: gate, cleaning, fields, lexicon, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fields, html
from ..functions import text as T
from ..operators import gate, lexicon
from ..operators import relational as R
from ..operators import vectors as V
from ..sources.tables import table
from .registry import query

_SPACE = r"\s+"


@query(
    "WITH c AS (SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), "
    "w AS (SELECT *, len(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '\\p{L}'))) AS n FROM c), "
    "r AS (SELECT CASE WHEN t = '' THEN 'MISSING_DESCRIPTION' WHEN length(t) > 50000 THEN 'DESCRIPTION_TOO_LARGE' WHEN n < 60 THEN 'DESCRIPTION_TOO_SHORT' "
    "WHEN lang IS NULL THEN 'LANGUAGE_PREDICT_FAILED' WHEN lang <> 'en' THEN 'NON_ENGLISH_DESCRIPTION' ELSE 'HIGH_CONFIDENCE_ENGLISH' END AS reason FROM w) "
    "SELECT CASE WHEN reason = 'HIGH_CONFIDENCE_ENGLISH' THEN 'ACCEPT' ELSE 'REFUSE' END AS decision, reason, count(*) AS n FROM r GROUP BY 1, 2"
)
def gate_reasons(spark, d):
    docs = table(spark, d, "documents")
    cleaned = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _SPACE, " "))
    offers = docs.select(
        F.lit("corpus").alias("source"), F.col("doc_id").cast("string").alias("identity"), F.lit("plain_text").alias("mode"),
        F.col("text").alias("description"), cleaned.alias("cleaned"), "lang",
    )
    # the table's language stands for a sure prediction
    decided = gate.run(offers, lambda _text: F.struct(F.col("lang").alias("language"), F.lit(1.0).alias("score")))
    return decided.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def gate_predicted(spark, d):
    """The whole gate, cleaning and default predictor included: metrics by decision, reason and number of predictions."""
    docs = table(spark, d, "documents")
    offers = docs.select(
        F.lit("corpus").alias("source"), F.col("doc_id").cast("string").alias("identity"), F.lit("plain_text").alias("mode"),
        F.col("text").alias("description"), html.clean_description("text").alias("cleaned"),
    )
    return gate.metrics(gate.run(offers, gate.predict_by_function_words))


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}', ' ', 'g'), '(?i)https?://[^\\s<>]+|www\\.[^\\s<>]+', ' ', 'g') AS scrubbed FROM documents"
)
def contact_scrub(spark, d):
    mail, link = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?i)https?://[^\s<>]+|www\.[^\s<>]+"
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", mail, " "), link, " ").alias("scrubbed"))


@query(
    "WITH a AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS t FROM documents), b AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS t FROM benchmark), "
    "rare AS (SELECT t FROM b WHERE t <> '' GROUP BY t HAVING count(*) = 1), n AS (SELECT item_id, count(*) AS size FROM b JOIN rare USING (t) GROUP BY 1) "
    "SELECT doc_id, item_id, count(*) AS shared, round(count(*) / max(size), 6) AS overlap FROM a JOIN b USING (t) JOIN rare USING (t) JOIN n USING (item_id) GROUP BY 1, 2"
)
def token_overlap(spark, d):
    """Documents and benchmark items by the words that one item alone has: an equi-join on tokens, never a cross join."""
    split = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("t"))
    docs, items = split(table(spark, d, "documents"), "doc_id"), split(table(spark, d, "benchmark"), "item_id").where("t <> ''")
    rare = items.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id")).where("n = 1").select("t", "item_id")
    size = rare.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    shared = docs.join(rare, "t").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(size, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("overlap"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '\\p{L}'))) AS n_words FROM documents")
def meaningful_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.meaningful_words(F.col("text")).cast("long").alias("n_words"))


@query("SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)\\?', 1), '') AS number, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/en/') THEN url "
       "WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/fr/') THEN regexp_replace(url, '^([a-z]+://[^/?#]*)/fr/', '\\1/en/') ELSE regexp_replace(url, '^([a-z]+://[^/?#]*)', '\\1/en') END AS english FROM pages")  # fmt: skip
def page_urls(spark, d):
    number, site = F.nullif(F.regexp_extract("url", r"/([0-9]+)\?", 1), F.lit("")), F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", number.alias("number"), site.alias("site"), T.english_url(F.col("url")).alias("english"))


@query()
def html_visible_text(spark, d):
    """Readable text of every page."""
    return table(spark, d, "pages").select("page_id", html.visible_text("html").alias("visible"))


@query()
def alias_scan(spark, d):
    """Technologies that every document names, with places and the reason of acceptance."""
    return lexicon.scan(table(spark, d, "documents"), lexicon.technologies(spark)).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query()
def offer_fields(spark, d):
    """Every page as a normalised offer: record, gate decision, and for accepted ones contract, work mode, education, experience, seniority."""
    pages = table(spark, d, "pages")
    raw = pages.select("page_id", html.parse_offer("url", "html").alias("o"), html.visible_text("html").alias("visible")).select("page_id", "visible", "o.*")
    described = raw.withColumn("description", F.coalesce("description", "visible")).drop("visible")
    offers = described.withColumn("source", F.lit("board")).withColumn("identity", F.coalesce(F.nullif("job_id", F.lit("")), "url")).withColumn("mode", F.lit("plain_text"))
    decided = gate.run(offers.withColumn("cleaned", html.clean_description("description")), gate.predict_by_function_words)
    text = F.col("clean_description")
    experience = F.when(fields.experience_line(F.col("experience")) != "UNKNOWN", fields.experience_line(F.col("experience"))).otherwise(fields.minimum_experience(text))
    accepted = F.col("decision") == "ACCEPT"
    contract = F.coalesce(F.get(fields.contract_types(F.col("title"), F.coalesce("contract", text)), F.lit(0)), F.lit("UNKNOWN"))
    return decided.select(
        "page_id", "url", "title", "decision", "reason", "language", "predictions_count",
        F.when(accepted, contract).alias("contract_type"),
        F.when(accepted, fields.work_mode(F.col("title"), text, F.col("teleworking"))).alias("work_mode"),
        F.when(accepted, fields.education_levels(F.coalesce("education", text))).alias("education"),
        F.when(accepted, experience).alias("experience_bracket"),
        F.when(accepted, fields.seniority(F.col("title"), experience)).alias("seniority_level"),
    )


@query(
    "WITH p AS (SELECT label, vec_id, embedding AS v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1), "
    "s AS (SELECT e.vec_id, p.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(p.v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(p.v AS DOUBLE[]), CAST(p.v AS DOUBLE[])))) AS score FROM embeddings e CROSS JOIN p), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n, score - coalesce(lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, label), 0) AS margin FROM s) "
    "SELECT vec_id, label, round(score, 6) AS score, round(margin, 6) AS margin FROM r WHERE n = 1 AND score >= 0.1 AND margin >= 0.015"
)
def margin_gate(spark, d):
    """Each vector's nearest prototype (the first vector of a label) if it is near enough and leads the next."""
    embeddings = table(spark, d, "embeddings")
    prototypes = R.first_by(embeddings, ["label"], F.col("vec_id")).select("label", F.col("embedding").alias("v"))
    scored = V.similarities(embeddings.select("vec_id", F.col("embedding").alias("q")), prototypes)
    chosen = R.margin_choice(scored, ["vec_id"], "label", "score", 0.1, 0.015)
    return chosen.select("vec_id", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


_ITEMS = "SELECT label, vec_id AS item, n, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 4"
_SCORES = (
    f"WITH p AS ({_ITEMS}), s AS (SELECT e.vec_id, p.label, p.item, p.n, list_dot_product(CAST(e.embedding AS DOUBLE[]), p.v) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) "
    "* sqrt(list_dot_product(p.v, p.v))) AS score FROM embeddings e CROSS JOIN p) "
)


def _scored(spark, d):
    embeddings = table(spark, d, "embeddings")
    items = R.top_k(embeddings, ["label"], 4, F.col("vec_id"), rank="n").select("label", F.col("vec_id").alias("item"), "n", F.col("embedding").alias("v"))
    return V.similarities(embeddings.select("vec_id", F.col("embedding").alias("q")), items)


@query(
    _SCORES + ", g AS (SELECT vec_id, label, greatest(max(score), 0) AS title, avg(score) AS tasks, max(CASE WHEN n = 1 THEN score END) AS technology, max(CASE WHEN n = 2 THEN score END) AS definition FROM s GROUP BY 1, 2), "
    "m AS (SELECT vec_id, label, 0.70 * title + 0.15 * technology + 0.15 * (definition + tasks) / 2 AS score FROM g) "
    "SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS r FROM m) WHERE r = 1"
)
def leaf_scores(spark, d):
    """The leaf of each vector: labels stand for leaves, four of their vectors for title, technology, definition and tasks."""
    scored = _scored(spark, d)
    owners = scored.groupBy("vec_id", "label").agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("title"), F.avg("score").alias("tasks"),
        F.max(F.when(F.col("n") == 1, F.col("score"))).alias("technology"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("definition"),
    )
    mixed = owners.select("vec_id", "label", V.mixed_score(*(F.col(c) for c in ("title", "technology", "definition", "tasks"))).alias("score"))
    best = R.first_by(mixed, ["vec_id"], F.round("score", 9).desc(), F.col("label"))
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    _SCORES + ", t AS (SELECT vec_id, label, max(score) AS m FROM s GROUP BY 1, 2) "
    "SELECT vec_id, label, round(m + 0.10 * ln(sum(exp((score - m) / 0.05))), 6) AS score FROM s JOIN t USING (vec_id, label) GROUP BY vec_id, label, m"
)
def logsumexp_leaf(spark, d):
    soft = V.soft_maximum(_scored(spark, d), ["vec_id", "label"])
    return soft.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "WITH s AS (SELECT conv_id, turn, role, length(text) AS n, text FROM conversations) SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(n) AS BIGINT) AS chars, "
    "CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS asked FROM s GROUP BY 1"
)
def conversation_profile(spark, d):
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), roles.alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.col("role") == "user").alias("asked")
    )


@query(
    "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_lines, len(regexp_extract_all(text, '\\b(?:19|20)[0-9]{2}\\b')) AS n_years, "
    "round(len(list_filter(string_split(text, chr(10)), lambda l: length(l) < 40)) / len(string_split(text, chr(10))), 6) AS short_ratio FROM documents WHERE text IS NOT NULL"
)
def parse_quality(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id",
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_lines"),
        F.size(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))).cast("long").alias("n_years"),
        F.round(F.size(F.filter(lines, lambda x: F.length(x) < 40)) / F.size(lines), 6).alias("short_ratio"),
    )


@query(
    "WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents), f AS (SELECT w, count(*) AS df FROM t WHERE w <> '' GROUP BY w), "
    "q AS (SELECT w, df FROM f WHERE df BETWEEN 2 AND 5) SELECT doc_id, count(*) AS matched, round(sum(ln(1 + (SELECT count(*) FROM documents) / CAST(df AS DOUBLE))), 6) AS score FROM t JOIN q USING (w) GROUP BY doc_id "
    "ORDER BY score DESC, doc_id LIMIT 25"
)
def inverted_index_search(spark, d):
    """A token index over documents, and the 25 that match most of the rare words by weight."""
    docs = table(spark, d, "documents")
    index = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).where("w <> ''")
    rare = index.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df between 2 and 5")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = index.join(rare, "w").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), F.round(F.sum(F.log(1 + F.col("n") / F.col("df").cast("double"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(25)


@query(
    "WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM g GROUP BY user_id, s"
)
def event_sessions(spark, d):
    """An addition: sessions by a gap of 30 minutes; the same function serves a stream."""
    from ..streaming.append import sessions

    return sessions(table(spark, d, "events"))


@query(
    "SELECT doc_id, text_key FROM (SELECT doc_id, md5(coalesce(text, '')) AS text_key, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1"
)
def exact_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_key")


@query(
    "SELECT doc_id, CASE WHEN r.n > 0 THEN 'UNKNOWN' ELSE 'NONE' END AS state, r.n AS pipes FROM (SELECT doc_id, length(text) - length(replace(text, '|', '')) AS n FROM documents WHERE text IS NOT NULL) r"
)
def section_state(spark, d):
    pipes = (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("long")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(pipes > 0, "UNKNOWN").otherwise("NONE").alias("state"), pipes.alias("pipes"))


@query(
    "SELECT conv_id, turn, gap, CASE WHEN gap > 1.5 * coalesce(med, gap) THEN 'HEADING' ELSE 'BODY' END AS kind FROM (SELECT conv_id, turn, length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS gap, "
    "median(length(text)) OVER (PARTITION BY conv_id) AS med FROM conversations)"
)
def gap_headings(spark, d):
    order, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    n = F.length("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", (n - F.coalesce(F.lag(n).over(order), F.lit(0))).cast("long").alias("gap"), F.median(n).over(whole).alias("med"))
    return rows.select("conv_id", "turn", "gap", F.when(F.col("gap") > 1.5 * F.coalesce("med", "gap"), "HEADING").otherwise("BODY").alias("kind"))
