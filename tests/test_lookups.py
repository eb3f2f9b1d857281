"""Lookups, their precedence and statuses, and results of rules against models, on small fixtures."""

from pyspark.sql import functions as F

from rowloom.operators import evidence as E
from rowloom.operators import lookups as L


def lower(c):
    return F.lower(F.trim(c))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_registry(spark):
    leaves = spark.createDataFrame([("L1", "Back-end dev"), ("L2", "Front end dev"), ("L3", "Ops")], "leaf_id string, leaf_name string")
    sides = {"definitions": spark.createDataFrame([("back end  DEV", "d1"), ("Ops", "d3"), ("ops", "d4")], "leaf_name string, definition string")}
    found, problems = L.registry(leaves, sides)
    assert rows(found.select("leaf_id", "definition")) == [("L1", "d1"), ("L2", None), ("L3", "d3")]
    assert rows(problems) == [("definitions", "duplicate", "Ops"), ("definitions", "missing", "Front end dev")]
    named = L.by_name(spark.createDataFrame([("ops",), (None,), ("x",)], "n string"), "n", leaves, "leaf_name", F.col("leaf_id"))
    assert rows(named.select("n", "leaf_id")) == [("ops", "L3"), ("x", None), (None, None)]


def test_title_statuses(spark):
    paths = spark.createDataFrame([("a", 1, "F", "P", "L", False, True), ("a", 2, "F", "P", "L", False, True), ("b", 2, "F", "P", "L", False, True), ("b", 1, "F", "P", "M", False, True), ("c", 1, "F", "P", None, False, True), ("d", 1, "F", "P", "L", True, False)],
                                  "title string, rank int, family_id string, parent_id string, leaf_id string, reviewed_set boolean, direct boolean")
    titles = spark.createDataFrame([(t,) for t in ("a", "b", "c", "d", "Senior Boss II", "e")], "title string")
    instead = spark.createDataFrame([("boss", 1, "F", "P", "N")], "key string, rank int, family_id string, parent_id string, leaf_id string")
    assert rows(L.title_status(titles, paths, instead).select("title", "status", "n_paths", "leaf_id")) == [
        ("Senior Boss II", "resolved_title", 1, "N"), ("a", "resolved_title", 1, "L"), ("b", "resolved_title_with_alternatives", 2, "M"), ("c", "candidate_title_parent_only", 0, None),
        ("d", "candidate_title_requires_description", 1, None), ("e", "no_match", 0, None),
    ]
    keys = spark.createDataFrame([("senior dev 3",), ("lead",), ("dev",), ("sr. ops i",)], "k string").select("k", L.without_level(F.col("k")))
    assert dict(map(tuple, keys.collect())) == {"senior dev 3": "dev", "lead": "lead", "dev": "dev", "sr. ops i": "ops"}


def test_skill_statuses(spark):
    items = spark.createDataFrame([(1, "S2", None, None, None), (2, "S9", None, None, None), (3, None, "n", "e1", None), (4, None, "n", "e2", None), (5, None, "n", "e3", None), (6, None, None, None, " Python "), (7, None, None, None, "shared"), (8, None, None, None, "go"), (9, None, None, None, "hid"), (10, None, None, None, None)],
                                  "item int, skill_id string, namespace string, external_id string, label string")
    resolution = spark.createDataFrame([("S1", "S1"), ("S2", "S1"), ("S3", "S3"), ("S4", "S4")], "source_skill_id string, resolved_skill_id string")
    skills = spark.createDataFrame([("S1", None), ("S3", None), ("S4", "CONTEXT_REQUIRED")], "skill_id string, matching_policy string")
    aliases = spark.createDataFrame([("S1", "python", "preferred"), ("S3", "python", "alias"), ("S1", "shared", "alias"), ("S3", "shared", "alias"), ("S4", "go", "preferred"), ("S3", "hid", "hidden_label")], "skill_id string, normalized_label string, alias_type string")
    external = spark.createDataFrame([("n", "e1", "S1", "reviewed", "exact"), ("n", "e1", "S2", "reviewed", "equivalent"), ("n", "e2", "S1", "open", "exact"), ("n", "e3", "S1", "reviewed", "exact"), ("n", "e3", "S3", "reviewed", "exact")], "namespace string, external_id string, skill_id string, review_status string, relation string")
    assert {r.item: (r.status, r.skill_id) for r in L.resolve_skills(items, resolution, skills, aliases, external, lower).collect()} == {
        1: ("resolved_id", "S1"), 2: ("unknown_id", None), 3: ("resolved_crosswalk", "S1"), 4: ("external_crosswalk_missing", None), 5: ("ambiguous_external_crosswalk", None),
        6: ("resolved_label", "S1"), 7: ("ambiguous_label", None), 8: ("context_required", None), 9: ("unknown_label", None), 10: ("unknown_label", None),
    }


def test_task_candidates(spark):
    make = spark.createDataFrame
    found = L.task_candidates(
        make([("S1",)], "skill_id string"), make([("S1", "O1"), ("S1", "O2"), ("S2", "O3")], "skill_id string, occupation_id string"),
        make([("O1", "T1"), ("O2", "T1"), ("O1", "T2"), ("O2", "T3"), ("O3", "T4")], "occupation_id string, task_id string"), make([("T2", "D1"), ("T2", "D2"), ("T1", "D1")], "task_id string, domain_id string"),
        make([("S1", "D1"), ("S1", "D2")], "skill_id string, domain_id string"), make([("S1", "T3"), ("S1", "T3")], "skill_id string, task_id string"), 2,
    )
    assert [(r.task_id, r.functional_overlap, r.has_literal_mention, r.rank) for r in found.orderBy("rank").collect()] == [("T3", 0, True, 1), ("T2", 2, False, 2)]


def test_reassigned(spark):
    entries = spark.createDataFrame([("DATA_ENGINEER",), ("web_dev",), ("DATA_WIZARD",), ("NOBODY",)], "leaf string")
    leaves = spark.createDataFrame([("DATA_ENGINEER",), ("WEB_DEVELOPER",), ("DATA_ANALYST",)], "leaf_id string")
    aliases = spark.createDataFrame([("Web  Dev", "WEB_DEVELOPER"), ("nobody", "DATA_ANALYST"), ("Nobody!", "WEB_DEVELOPER")], "label string, leaf_id string")
    found = {r.leaf: (r.leaf_id, r.method, r.near) for r in L.reassigned(entries, leaves, aliases).collect()}
    assert found["DATA_ENGINEER"] == ("DATA_ENGINEER", "exact_id", []) and found["web_dev"] == ("WEB_DEVELOPER", "lexical_alias", [])
    assert found["DATA_WIZARD"][1] == "unresolved" and set(found["DATA_WIZARD"][2]) == {"DATA_ENGINEER", "DATA_ANALYST"} and found["NOBODY"] == (None, "unresolved", [])


def test_listing_offers(spark):
    page = '<a href="/fr/x-offre-12.html#top">a</a> <a href="/en/y-offre-12.html">b</a><a name="z">c</a> <a href="https://o.org/z-offre-7.html?a=1">d</a>'
    found = L.listing_offers(spark.createDataFrame([(1, "https://s.org/list", page), (2, None, None)], "page_id int, url string, html string"), "page_id")
    assert rows(found) == [(1, "12", "https://s.org/en/x-offre-12.html", 0), (1, "7", "https://o.org/en/z-offre-7.html?a=1", 2)]


def test_evidence(spark):
    cases = [("Dev", "We want Java", "Java", 8, 12, "DESCRIPTION", True), ("Dev", "We want Java", "Dev", 0, 3, "title", True), ("Dev", "x", "Java", 0, 4, "DESCRIPTION", False), ("Dev", "a@b.org", "a@b.org", 0, 7, "DESCRIPTION", False), ("Dev", "x", None, None, None, None, False)]
    df = spark.createDataFrame(cases, "t string, d string, x string, s int, e int, w string, ok boolean")
    assert all(r.ok == r.found for r in df.select("ok", E.stands(*(F.col(c) for c in "tdxsew")).alias("found")).collect())
    made = df.limit(1).select(E.result(F.lit("A"), F.lit(1.7), F.lit("RULE"), F.lit(True)).alias("a"), E.result(F.lit("A"), F.lit(0.7), F.lit("RULE"), F.lit(False)).alias("b")).first()
    assert tuple(made.a) == ("A", 1.0, "RULE") and tuple(made.b) == ("UNKNOWN", 0.0, "UNKNOWN")
    side = lambda r: spark.createDataFrame(r, "k int, value string, confidence double")
    found = E.hybrid_fields(side([(1, "A", 0.5), (2, "UNKNOWN", 0.0), (3, "A", 0.9)]), side([(1, "B", 0.9), (2, "B", 0.7), (4, "C", 0.2)]), ["k"])
    assert rows(found) == [(1, "A", 0.5, "HYBRID", ["RULE_ML_CONTRADICTION"]), (2, "B", 0.7, "HYBRID", []), (3, "A", 0.9, "HYBRID", []), (4, "UNKNOWN", 0.0, "UNKNOWN", [])]
