"""Rules on small fixtures: brackets, fields, gate, pages, lexicon, appends, snapshots."""

from pyspark.sql import functions as F

from rowloom.functions import fields, html
from rowloom.functions import text as T
from rowloom.operators import gate, lexicon
from rowloom.operators import relational as R
from rowloom.sources import records
from rowloom.streaming import append


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", *columns).orderBy("i").drop("i").collect()]


def test_brackets(spark):
    months = [(0.0,), (11.0,), (12.0,), (35.0,), (36.0,), (59.0,), (60.0,), (95.0,), (96.0,), (None,)]
    found = [r[0] for r in values(spark, months, "m double", T.bracket(F.col("m")))]
    assert found == ["0_YEARS"] * 2 + ["1_2_YEARS"] * 2 + ["3_5_YEARS"] * 2 + ["5_7_YEARS"] * 2 + ["8_PLUS_YEARS", "UNKNOWN"]


def test_experience_lines(spark):
    lines = [("3 to 5 years",), ("Mid Level (3 to 5 years) - Senior (5 to 10 years)",), ("Senior (5 to 10 years) - Expert (10 to 20 years)",), ("two years",), (None,), ("none",)]
    found = [r[0] for r in values(spark, lines, "x string", fields.experience_line(F.col("x")))]
    assert found == ["3_5_YEARS", "3_5_YEARS", "5_7_YEARS", "1_2_YEARS", "UNKNOWN", "UNKNOWN"]


def test_minimum_experience(spark):
    texts = [("No experience required.",), ("You need at least 4 years of experience. Founded 20 years ago.",), ("Relevant experience is required.",), ("Nothing here",), (None,)]
    found = [r[0] for r in values(spark, texts, "x string", fields.minimum_experience(F.col("x")))]
    assert found == ["0_YEARS", "3_5_YEARS", "1_2_YEARS", "UNKNOWN", "UNKNOWN"]


def test_experience_cues(spark):
    """Tenures count by what their clause says of them; those of companies and of studies don't."""
    rows = [
        ("3 years of Python experience required", "3_5_YEARS"), ("minimum 2 years of AWS experience", "1_2_YEARS"), ("5+ years working with Java", "5_7_YEARS"), ("at least 4 years of SAP experience", "3_5_YEARS"),
        ("3 years preferred", "3_5_YEARS"), ("ideally 5 years of experience", "5_7_YEARS"), ("2+ years is a plus", "1_2_YEARS"), ("experience required", "1_2_YEARS"), ("no experience required", "0_YEARS"),
        ("The company has 20 years of experience", "UNKNOWN"), ("5 years of university education", "UNKNOWN"), ("We need 18 months of experience.", "1_2_YEARS"), ("two to four yrs of experience", "1_2_YEARS"),
    ]
    found = values(spark, rows, "x string, e string", fields.experience(F.col("x")), "e")
    assert [r[0].bracket for r in found] == [r[1] for r in found] and [r[0].assumed for r in found].count(True) == 1
    assert [(r[0].months, r[0].comparator) for r in found[:3]] == [(36.0, "EQ"), (24.0, "GTE"), (60.0, "GTE")] and found[12][0].comparator == "RANGE"


def test_requirement_clauses(spark):
    text = "Requirements:\n- a Bachelor's degree\nNice to have: Master in computing. But no degree is needed; our founders met at school"
    found = values(spark, [(text,)], "x string", fields.requirement_clauses(F.col("x")), fields.clause_at(fields.requirement_clauses(F.col("x")), F.lit(25)))[0]
    parts = [(c.words.strip(), c.modality, c.is_heading) for c in found[0]]
    assert parts[:2] == [("requirements", None, True), ("a bachelor s degree", "REQUIRED", False)] and parts[2] == ("nice to have", None, True)
    assert ("master in computing", "PREFERRED", False) in parts and ("no degree is needed", "NEGATED", False) in parts and parts[-1][1] == "BACKGROUND"
    assert found[1].words == " a bachelor s degree " and all(F_ in text[c.start : c.end].lower() for c in found[0] for F_ in [c.words.split()[0]])


def test_education_requirements(spark):
    rows = [
        ("", "Bachelor's degree required. Master preferred.", "BACHELOR", "STATED", "MASTER_OR_HIGHER", False), ("", "Bachelor or Master degree", "BACHELOR", "STATED", None, False),
        ("", "Bachelor and Master degree", "MASTER_OR_HIGHER", "STATED", None, False), ("", "No degree required", "UNKNOWN", "EXPLICIT_NO_REQUIREMENT", None, False), (None, None, "UNKNOWN", "NOT_STATED", None, False),
        ("", "Bac+5 or equivalent experience", "MASTER_OR_HIGHER", "STATED", None, True), ("", "Our founders hold a PhD; a licence is essential", "BACHELOR", "STATED", None, False), ("Dev", "", "UNKNOWN", "NOT_STATED", None, False),
    ]
    found = values(spark, rows, "t string, d string, v string, s string, p string, l boolean", fields.education(F.col("t"), F.col("d")), "v", "s", "p", "l")
    assert [(r[0].value, r[0].status, r[0].preferred, r[0].experience_in_lieu) for r in found] == [r[1:] for r in found]


def test_work_modes(spark):
    rows = [
        ("", "", "Teleworking : Hybrid", "HYBRID"), ("", "", "Teleworking : No", "ONSITE"), ("", "", "Teleworking : Yes", "REMOTE"),
        ("", "Hybrid role. Office attendance is required.", None, "HYBRID"), ("", "The role is remote and also in the office.", None, "HYBRID"),
        ("", "This role is on-site.", None, "ONSITE"), ("", "Fully remote position.", None, "REMOTE"), ("", "Experience with remote desktop support.", None, None), (None, None, None, None),
    ]
    found = values(spark, rows, "t string, d string, w string, e string", fields.work_mode(F.col("t"), F.col("d"), F.col("w"), None), "e")
    assert [r[0] for r in found] == [r[1] for r in found]


def test_contracts(spark):
    rows = [
        ("Dev", "Contract type: CDI", ["PERMANENT"]), ("Dev", "A 6 month contract in Paris", ["FIXED_TERM"]), ("Intern data", "", ["INTERNSHIP"]),
        ("Dev", "This is a permanent role.", ["PERMANENT"]), ("Dev", "This is not a permanent role.", []), ("Dev", "Type de contrat : non précisé", []), (None, None, []),
    ]
    found = values(spark, rows, "t string, d string, e array<string>", fields.contract_types(F.col("t"), F.col("d")), "e")
    assert [r[0] for r in found] == [r[1] for r in found]


def test_consistency(spark):
    rows = [("INTERNSHIP", "SENIOR", "5_7_YEARS", "INTERNSHIP", "INTERN", "0_YEARS", True), (None, "INTERN", None, "INTERNSHIP", "INTERN", "0_YEARS", True),
            ("PERMANENT", "MID", None, "PERMANENT", "MID", "3_5_YEARS", True), ("PERMANENT", "MID", "1_2_YEARS", "PERMANENT", "MID", "1_2_YEARS", False)]
    made = fields.consistent(F.col("c"), F.col("l"), F.col("x"))
    found = values(spark, rows, "c string, l string, x string, ec string, el string, ex string, eb boolean", made)
    assert [tuple(r[0]) for r in found] == [r[3:] for r in rows]


def test_education(spark):
    rows = [("Associate degree and a Bachelor's degree", ["ASSOCIATE", "BACHELOR"]), ("Master in computing", ["MASTER_OR_HIGHER"]), ("No degree required, Master a plus", []), ("Bac+5", ["MASTER_OR_HIGHER"]), (None, [])]
    found = values(spark, rows, "x string, e array<string>", fields.education_levels(F.col("x")), "e")
    assert [r[0] for r in found] == [r[1] for r in found]


def test_urls_and_keys(spark):
    rows = [("https://x.com/offre-12345.html?a=1",), ("https://x.com/fr/a",), ("https://x.com/en/a",), ("https://x.com",)]
    assert values(spark, rows, "u string", T.offer_id(F.col("u")), T.english_url(F.col("u"))) == [
        ("12345", "https://x.com/en/offre-12345.html?a=1"), (None, "https://x.com/en/a"), (None, "https://x.com/en/a"), (None, "https://x.com/en/"),
    ]
    assert values(spark, [("  Full-Stack  Dev ",), (None,)], "n string", T.name_key(F.col("n")), T.squash(F.col("n"))) == [("full stack dev", "Full-Stack Dev"), (None, None)]


def scripted(language, score):
    return lambda _text: F.struct(F.lit(language).alias("language"), F.lit(score).alias("score"))


def test_gate(spark):
    prose = " ".join(["the plain words of a posting"] * 40)
    rows = [("s", "1", "plain_text", prose), ("", "1", "plain_text", prose), ("s", None, "plain_text", prose), ("s", "1", "pdf", prose), ("s", "1", "plain_text", "  "), ("s", "1", "plain_text", "too short"), ("s", "1", "plain_text", "x " * 30000)]
    offers = spark.createDataFrame(rows, "source string, identity string, mode string, description string").withColumn("cleaned", F.trim("description"))
    reasons = lambda predict: sorted((r.reason, r.decision, r.predictions_count) for r in gate.run(offers, predict).collect())
    cheap = [("DESCRIPTION_TOO_LARGE", "REFUSE", 0), ("DESCRIPTION_TOO_SHORT", "REFUSE", 0), ("MISSING_DESCRIPTION", "REFUSE", 0), ("MISSING_JOB_IDENTITY", "REFUSE", 0), ("MISSING_JOB_IDENTITY", "REFUSE", 0), ("UNSUPPORTED_INPUT_MODE", "REFUSE", 0)]
    for (language, score), last in {
        ("en", 0.95): ("HIGH_CONFIDENCE_ENGLISH", "ACCEPT", 1), ("fr", 0.99): ("NON_ENGLISH_DESCRIPTION", "REFUSE", 1),
        ("en", 0.90): ("ENGLISH_CONFIRMED_BY_TWO_CHUNKS", "ACCEPT", 3), ("en", 0.70): ("LOW_CHUNK_ENGLISH_CONFIDENCE", "REFUSE", 3),
    }.items():
        assert reasons(scripted(language, score)) == sorted([*cheap, last])
    assert reasons(None) == sorted([*cheap, ("LANGUAGE_MODEL_UNAVAILABLE", "REFUSE", 0)])


def test_cleaning():
    text = html.clean("Mail a.b@c.com or +33 6 12 34 56 78, 3+ years C++ since 2023-09-01, 15%&amp; https://x.y/z  end\n\n\n\nbye")
    assert "@" not in text and "34 56" not in text and "https" not in text
    assert all(kept in text for kept in ("3+ years", "C++", "2023-09-01", "15%&", "end\n\nbye"))


def test_cleaning_of_contacts():
    lines = ["Call (01) 45 67 89 00 now", "since 2019 - 2023 here", "a\u200bb\x07c", "see www.x.org, or write <jo@mail.org>!", "Spam line", "1.234.567 items", "+1-555-010-9999; 12 months"]
    assert html.clean("\r\n".join(lines), frozenset({"spam line"})).split("\n") == ["Call now", "since 2019 - 2023 here", "ab c", "see or write", "1.234.567 items", "12 months"]
    assert html.clean(None) is None and html.clean("a\n\n\n b ") == "a\n\nb"


def test_offer_page():
    page = """<html><script type="application/ld+json">{"@type":"JobPosting","title":"Dev &amp; Ops","hiringOrganization":{"name":"Acme"}}</script>
    <ul><li title="Contract type">CDI</li><li title="Teleworking">Teleworking : Hybrid</li></ul><div class="contentbloc"><div class="blc info">skip this one that is quite long indeed yes</div>
    <div class="blc"><p>Job: a long enough description of what is to be done here.</p></div><div class="blc">Head office somewhere far away with many words in it</div></div></html>"""
    row = html.offer("https://x.com/en/offre-77.html", page)
    assert (row["job_id"], row["title"], row["company"], row["contract"], row["teleworking"]) == ("77", "Dev & Ops", "Acme", "CDI", "Teleworking : Hybrid")
    assert row["description"] == "Job: a long enough description of what is to be done here."
    assert html.readable("<p>a<script>x</script><li>b</li><!-- c --></p>") == "a- b" or html.readable("<p>a</p><ul><li>b</li></ul>") == "a\n- b"
    assert html.readable("<<<") is not None and html.readable(None) is None


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "We use Python, Go, SQL and C++."), (2, "go to the shop"), (3, None), (4, "Apache Spark with Python; pythonic")], "doc_id long, text string")
    found = {r.doc_id: [h.name for h in r.hits] for r in lexicon.scan(docs, lexicon.technologies(spark)).collect()}
    assert found == {1: ["Python", "Go", "SQL", "C++"], 2: [], 3: [], 4: ["Apache Spark", "Python"]}


def test_resolution_and_islands(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "n int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 7), (6, 8)], "a int, b int")
    assert sorted(map(tuple, R.resolve(nodes, edges, "n", "a", "b").collect())) == [(1, 3), (2, 3), (3, 3), (6, 6), (7, 7), (8, 8)]
    spans = spark.createDataFrame([("x", 1, 3), ("x", 2, 5), ("x", 6, 7), ("x", 9, 9), ("y", 1, 1)], "k string, s int, e int")
    assert sorted(map(tuple, R.islands(spans, ["k"], "s", "e").collect())) == [("x", 1, 5), ("x", 6, 7), ("x", 9, 9), ("y", 1, 1)]
    assert sorted(map(tuple, R.islands(spans, ["k"], "s", "e", adjacent=1).collect())) == [("x", 1, 7), ("x", 9, 9), ("y", 1, 1)]


def offers(spark, rows):
    return spark.createDataFrame([{"job_id": i, "url": u} for i, u in rows], records.OFFER_SCHEMA)


def test_append_twice(spark, tmp_path):
    raw = offers(spark, [("1", "u/a-1.html"), ("1", "u/b-1.html"), ("2", "u/a-2.html")])
    out = str(tmp_path / "out")
    shape = lambda df: df.select("job_id", "url")
    assert append.append(raw, out, shape, [F.col("url")]) == 2
    assert append.append(raw, out, shape, [F.col("url")]) == 0
    assert sorted(r.url for r in spark.read.json(out).collect()) == ["u/a-1.html", "u/a-2.html"]


def test_stream_appends_once(spark, tmp_path):
    folder, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    raw = offers(spark, [("1", "u/a-1.html"), ("2", "u/a-2.html")])
    raw.write.json(folder)
    for _ in range(2):
        append.stream(spark, folder, out, marks, lambda df: df.select("job_id", "url")).awaitTermination()
        raw.write.mode("append").json(folder)
    assert spark.read.json(out).count() == 2


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), "b": spark.createDataFrame([(1.5,)], "f double")}
    before = {r.table: tuple(r) for r in records.export_snapshot(tables, str(tmp_path / "snap")).collect()}
    again = records.rebuild_snapshot(spark, str(tmp_path / "snap"), {k: v.schema for k, v in tables.items()})
    assert {k: (k, *records.fingerprint(v).first()) for k, v in again.items()} == before


def test_offer_pages_with_loose_data():
    from rowloom.functions import html

    dirty = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Data &amp; AI  Engineer", "datePosted": "2024-05-01", "hiringOrganization": {"@type": "x", "name": "Acme"}, oops }</script>'
    found = html.offer("https://x/offer-77.html", dirty + '<h1>Other - Acme</h1><span class="a newjob">until <b> </b><b>2024 <i>06</i></b></span>')
    assert (found["title"], found["company"], found["date_posted"], found["deadline"], found["job_id"]) == ("Data & AI Engineer", "Acme", "2024-05-01", "2024 06", "77")
    clean = '<script type="application/ld+json">[{"@type": "jobPosting", "title": "T", "validThrough": "2025"}]</script><span class="newjob"><b>2024</b></span><b>never</b>'
    found = html.offer(None, clean)
    assert (found["title"], found["deadline"], found["company"]) == ("T", "2025", None)
    assert html.offer(None, "<b>x</b>")["deadline"] is None and html.offer(None, None)["title"] is None
