"""Names, titles and skills looked up in a catalogue: equi-joins on keys, precedence by anti-joins, one status a row."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity
from ..functions.text import english_url, name_key, offer_id, parts
from . import relational as R


def by_name(rows: DataFrame, name: str, catalogue: DataFrame, label: str, *order: Column) -> DataFrame:
    """rows, and beside each the catalogue's first row whose label has the same key; nulls where none has."""
    keyed = R.first_by(catalogue.withColumn("name_key__", name_key(F.col(label))).where("name_key__ is not null"), ["name_key__"], *order)
    return rows.withColumn("name_key__", name_key(F.col(name))).join(keyed, "name_key__", "left").drop("name_key__")


def registry(leaves: DataFrame, sides: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Leaves joined by name key with the first row of each side (tables with leaf_name), and the problems: table, problem, name.

    A name that a table has twice and a leaf that a side lacks are problems; neither drops a leaf.
    """
    out = leaves.withColumn("name_key__", name_key(F.col("leaf_name")))
    problems = []
    for table, df in {"leaves": leaves, **sides}.items():
        keyed = df.withColumn("name_key__", name_key(F.col("leaf_name")))
        twice = keyed.groupBy("name_key__").agg(F.count(F.lit(1)).alias("n"), F.min("leaf_name").alias("name")).where("n > 1")
        problems.append(twice.select(F.lit(table).alias("table"), F.lit("duplicate").alias("problem"), "name"))
        if table in sides:
            own = R.first_by(keyed.drop("leaf_name"), ["name_key__"], *(F.col(c) for c in keyed.columns if c not in ("leaf_name", "name_key__")))
            lacking = out.join(own, "name_key__", "left_anti")
            problems.append(lacking.select(F.lit(table).alias("table"), F.lit("missing").alias("problem"), F.col("leaf_name").alias("name")))
            out = out.join(own, "name_key__", "left")
    every = problems[0]
    for more in problems[1:]:
        every = every.unionByName(more)
    return out.drop("name_key__"), every


def list_edges(rows: DataFrame, key: str, names: str, catalogue: DataFrame, label: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Edges key -> target for each name of a list apart by semicolons, and the names that match none, with their number of rows."""
    cut = rows.select(key, F.explode(parts(F.col(names))).alias("name")).withColumn("name_key__", name_key(F.col("name")))
    keyed = catalogue.select(name_key(F.col(label)).alias("name_key__"), target).groupBy("name_key__").agg(F.min(target).alias(target))
    edges = cut.join(keyed, "name_key__").select(key, target).distinct()
    return edges, cut.join(keyed, "name_key__", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def match_titles(titles: DataFrame, aliases: DataFrame, normal) -> DataFrame:
    """titles (title) with the ids (aliases: label, id) of equal normal forms; a title without any is tried again up to its bracket.

    Columns: title, id, method (exact, before_bracket), a row each match; titles without a match have none.
    """
    known = aliases.select(normal(F.col("label")).alias("key"), "id").where("key <> ''").distinct()
    exact = titles.withColumn("key", normal(F.col("title"))).join(known, "key").select("title", "id", F.lit("exact").alias("method"))
    left = titles.join(exact.select("title").distinct(), "title", "left_anti").where(F.contains("title", F.lit("(")))
    short = left.withColumn("key", normal(F.trim(F.get(F.split("title", r"\("), F.lit(0))))).join(known, "key")
    return exact.unionByName(short.select("title", "id", F.lit("before_bracket").alias("method")))


# Words that say the level of a title, in front of it and behind it; the route stays the same.
FRONT, BACK = ["senior", "sr", "sr.", "junior", "jr", "jr.", "lead", "principal", "staff"], ["1", "2", "3", "4", "5", "6", "7", "8", "9", "i", "ii", "iii", "iiii", "v"]


def without_level(key: Column) -> Column:
    """A title's key without one level word in front and one behind; a title that is nothing else stays."""
    words = F.split(key, " ")
    front = F.get(words, F.lit(0)).isin(FRONT) & (F.size(words) > 1)
    rest = F.when(front, F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    back = F.try_element_at(rest, F.lit(-1)).isin(BACK) & (F.size(rest) > 1)
    return F.array_join(F.when(back, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest), " ")


def title_status(titles: DataFrame, paths: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """title, status, n_paths and the first path of each title.

    paths (title, rank, family_id, parent_id, leaf_id, reviewed_set, direct): a path with parent and leaf is a candidate; equal
    ones count once. One candidate: resolved_title; several: resolved_title_with_alternatives; candidates of a reviewed set of
    which one is not direct: candidate_title_requires_description, without a leaf; paths without a leaf alone:
    candidate_title_parent_only; none: no_match. replacements (key, rank, family_id, parent_id, leaf_id) stand in for a title
    without any path, by its key without level words.
    """
    if replacements is not None:
        keyed = titles.join(paths.select("title").distinct(), "title", "left_anti").withColumn("key", without_level(F.lower(F.trim("title"))))
        more = keyed.join(replacements, "key").select("title", "rank", "family_id", "parent_id", "leaf_id", F.lit(False).alias("reviewed_set"), F.lit(True).alias("direct"))
        paths = paths.unionByName(more)
    whole = F.col("parent_id").isNotNull() & F.col("leaf_id").isNotNull()
    path = F.struct("rank", "family_id", "parent_id", "leaf_id")
    by_title = paths.groupBy("title").agg(
        F.count_distinct(F.when(whole, F.struct("family_id", "parent_id", "leaf_id"))).alias("n_paths"),
        F.min(F.when(whole, path)).alias("best"),
        F.min(path).alias("any"),
        F.max(F.coalesce("reviewed_set", F.lit(False))).alias("reviewed_set"),
        F.min(F.when(whole, F.coalesce("direct", F.lit(True)))).alias("direct"),
    )
    rows = titles.select("title").distinct().join(by_title, "title", "left")
    needs = F.col("reviewed_set") & ~F.col("direct")
    status = (
        F.when(F.col("any").isNull(), "no_match").when(F.col("n_paths") == 0, "candidate_title_parent_only").when(needs, "candidate_title_requires_description")
        .when(F.col("n_paths") == 1, "resolved_title").otherwise("resolved_title_with_alternatives")
    )
    chosen = F.coalesce("best", "any")
    leaf = F.when(status.startswith("resolved"), chosen["leaf_id"])
    return rows.select("title", status.alias("status"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"), chosen["family_id"].alias("family_id"), chosen["parent_id"].alias("parent_id"), leaf.alias("leaf_id"))


def resolve_skills(items: DataFrame, resolution: DataFrame, skills: DataFrame, aliases: DataFrame, external: DataFrame, normal) -> DataFrame:
    """item, status and skill_id of each item (item, skill_id, namespace, external_id, label), by the first of the three that it has.

    An id is resolved or unknown. An outer id counts by reviewed exact or equivalent crosswalks and must lead to one skill. A label
    matches aliases (skill_id, normalized_label, alias_type) that are not hidden; preferred ones hide the others; several skills
    are ambiguous, and a skill whose policy is CONTEXT_REQUIRED stays open.
    """
    root = resolution.select("source_skill_id", "resolved_skill_id")
    has_id, has_outer = F.col("skill_id").isNotNull(), F.col("namespace").isNotNull() & F.col("external_id").isNotNull()
    by_id = items.where(has_id).join(root, items["skill_id"] == root["source_skill_id"], "left")
    by_id = by_id.select("item", F.when(F.col("resolved_skill_id").isNull(), "unknown_id").otherwise("resolved_id").alias("status"), F.col("resolved_skill_id").alias("skill_id"))

    def counted(rows: DataFrame, keys: list[str], targets: DataFrame, words: tuple[str, str, str]) -> DataFrame:
        """item, status and skill: by how many different skills its keys lead to, which is counted by key before items are joined."""
        found = targets.groupBy(*keys).agg(F.count_distinct("resolved_skill_id").alias("n"), F.min("resolved_skill_id").alias("one"))
        n = F.coalesce("n", F.lit(0))
        status = F.when(n == 0, words[0]).when(n == 1, words[1]).otherwise(words[2])
        return rows.join(found, keys, "left").select("item", status.alias("status"), F.when(n == 1, F.col("one")).alias("skill_id"))

    outer = items.where(~has_id & has_outer).select("item", "namespace", "external_id")
    links = external.where("review_status = 'reviewed' and relation in ('exact', 'equivalent')").select("namespace", "external_id", F.col("skill_id").alias("source_skill_id"))
    by_outer = counted(outer, ["namespace", "external_id"], links.join(root, "source_skill_id"), ("external_crosswalk_missing", "resolved_crosswalk", "ambiguous_external_crosswalk"))
    labelled = items.where(~has_id & ~has_outer).select("item", normal(F.coalesce("label", F.lit(""))).alias("key"))
    shown = aliases.where("alias_type <> 'hidden_label'").select(F.col("skill_id").alias("source_skill_id"), F.col("normalized_label").alias("key"), (F.col("alias_type") == "preferred").alias("preferred"))
    targets = shown.join(root, "source_skill_id").join(skills.select(F.col("skill_id").alias("resolved_skill_id")), "resolved_skill_id")
    best = targets.groupBy("key").agg(F.max("preferred").alias("preferred"))
    by_label = counted(labelled, ["key"], targets.join(best, ["key", "preferred"]), ("unknown_label", "resolved_label", "ambiguous_label"))
    policy = skills.select("skill_id", "matching_policy")
    by_label = by_label.join(policy, "skill_id", "left")
    waits = (F.col("status") == "resolved_label") & F.col("matching_policy").eqNullSafe("CONTEXT_REQUIRED")
    by_label = by_label.select("item", F.when(waits, "context_required").otherwise(F.col("status")).alias("status"), F.when(~waits, F.col("skill_id")).alias("skill_id"))
    return by_id.unionByName(by_outer).unionByName(by_label)


def task_candidates(skills: DataFrame, occupation_skills: DataFrame, occupation_tasks: DataFrame, task_domains: DataFrame, skill_domains: DataFrame, mentions: DataFrame, k: int = 12) -> DataFrame:
    """The first k tasks of each skill (skill_id) through the occupations that share it: literal mentions first, then shared domains, then id.

    Overlap and mentions are counted by pair before they are joined, so no join multiplies them.
    """
    shared = skills.select("skill_id").distinct().join(occupation_skills.select("skill_id", "occupation_id").distinct(), "skill_id").join(occupation_tasks.select("occupation_id", "task_id").distinct(), "occupation_id")
    pairs = shared.groupBy("skill_id", "task_id").agg(F.count_distinct("occupation_id").alias("n_occupations"))
    overlap = pairs.join(skill_domains.select("skill_id", "domain_id").distinct(), "skill_id").join(task_domains.select("task_id", "domain_id").distinct(), ["task_id", "domain_id"])
    overlap = overlap.groupBy("skill_id", "task_id").agg(F.count(F.lit(1)).alias("functional_overlap"))
    literal = mentions.select("skill_id", "task_id").distinct().withColumn("has_literal_mention", F.lit(True))
    rows = pairs.join(overlap, ["skill_id", "task_id"], "left").join(literal, ["skill_id", "task_id"], "left")
    rows = rows.withColumn("functional_overlap", F.coalesce("functional_overlap", F.lit(0))).withColumn("has_literal_mention", F.coalesce("has_literal_mention", F.lit(False)))
    relation = F.when(F.col("has_literal_mention"), "literal_mention_needs_usage_review").otherwise("candidate_via_shared_occupation_not_direct_usage")
    return R.top_k(rows, ["skill_id"], k, F.col("has_literal_mention").desc(), F.col("functional_overlap").desc(), F.col("task_id")).withColumn("relation", relation)


def alphanumeric_key(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def reassigned(entries: DataFrame, leaves: DataFrame, aliases: DataFrame) -> DataFrame:
    """entries (leaf) with leaf_id and method: exact_id, else lexical_alias if one leaf alone has an alias of the same key, else unresolved.

    Unresolved ones carry the three leaves whose ids are most alike of those that share a word with it, for review.
    """
    named = entries.select("leaf").distinct()
    exact = named.join(leaves.select(F.col("leaf_id").alias("leaf")), "leaf", "left_semi").select("leaf", F.col("leaf").alias("leaf_id"), F.lit("exact_id").alias("method"))
    key = alphanumeric_key(F.translate("leaf", "_", " "))
    left = named.join(exact, "leaf", "left_anti").withColumn("key", key)
    keyed = aliases.select(alphanumeric_key(F.col("label")).alias("key"), "leaf_id").distinct()
    alone = R.unambiguous(keyed, "key", "leaf_id")
    lexical = left.join(alone, "key").select("leaf", "leaf_id", F.lit("lexical_alias").alias("method"))
    open_ = left.join(lexical, "leaf", "left_anti")
    words = leaves.select("leaf_id", alphanumeric_key(F.translate("leaf_id", "_", " ")).alias("other"))
    pairs = open_.select("leaf", "key", F.explode(F.split("key", " ")).alias("word")).join(words.select("leaf_id", "other", F.explode(F.split("other", " ")).alias("word")), "word").select("leaf", "key", "leaf_id", "other").distinct()
    scored = pairs.withColumn("score", similarity.ratio_column("key", "other"))
    near = R.top_k(scored, ["leaf"], 3, F.col("score").desc(), F.col("leaf_id")).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("rank", "leaf_id"))).alias("near"))
    review = open_.select("leaf", F.lit(None).cast("string").alias("leaf_id"), F.lit("unresolved").alias("method")).join(near, "leaf", "left")
    none = F.array().cast("array<string>")
    done = exact.unionByName(lexical).withColumn("near", none)
    return done.unionByName(review.select("leaf", "leaf_id", "method", F.coalesce(F.transform("near", lambda n: n["leaf_id"]), none).alias("near")))


def missing_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids, each once, that are not known; a request may be confirmed only if there are none."""
    return requested.select(key).distinct().join(known.select(key), key, "left_anti")


def find_or_create(names: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """known, and a row for each name (by lower case, its least spelling) that it lacks, with a key made of the name."""
    lowered = names.where(F.trim(F.coalesce(name, F.lit(""))) != "").groupBy(F.lower(F.trim(name)).alias("lower__")).agg(F.min(F.trim(name)).alias(name))
    new = lowered.join(known.select(F.lower(name).alias("lower__")).distinct(), "lower__", "left_anti")
    return known.select(key, name).unionByName(new.select(F.concat(F.lit("new_"), F.substring(F.sha2("lower__", 256), 1, 16)).alias(key), name))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.found.append(href.split("#", 1)[0])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _hrefs(markup: pd.Series, base: pd.Series) -> pd.Series:
    def joined(root: str | None, href: str) -> str | None:
        try:
            return urljoin(root or "", href)
        except ValueError:  # no address
            return None

    def one(text: str, root: str | None) -> list[str | None]:
        walk = _Links()
        walk.feed(text)
        walk.close()
        return [joined(root, href) for href in walk.found]

    return pd.Series([None if m is None else one(m, b) for m, b in zip(markup, base, strict=True)])


def listing_offers(pages: DataFrame, key: str, number=offer_id) -> DataFrame:
    """key, offer_id, url and place of the offers that each page (key, url, html) links to; the first link of each offer, in order."""
    links = pages.select(key, F.posexplode(_hrefs("html", "url")).alias("place", "link")).withColumn("offer_id", number(F.col("link"))).where("offer_id is not null")
    firsts = links.groupBy(key, "offer_id").agg(F.min_by("link", "place").alias("link"), F.min("place").alias("place"))
    return firsts.select(key, "offer_id", english_url(F.col("link")).alias("url"), "place")
