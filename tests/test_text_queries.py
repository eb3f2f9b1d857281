"""Queries without SQL against plain loops over the same rows."""

import re

import duckdb
from pyspark.sql import functions as F

from rowloom.functions.similarity import ratio
from rowloom.plans import registry
from rowloom.plans import text_queries as Q

from . import test_sections_dates as S
from . import test_technologies as T

DATA = "/root/testdata/sf0.001"


def test_technology_hits(spark, monkeypatch):
    lexicon = [(r.position, r.tech_id, r.canonical, r.aliases, r.policy, r.category) for r in Q.lexicon(spark, DATA).orderBy("position").collect()]
    lemmas = [r.lemma for r in Q.common_words(spark, DATA).collect()]
    monkeypatch.setattr(T, "LEXICON", lexicon)
    monkeypatch.setattr(T, "LEMMAS", lemmas)
    names, found = T.plain_names(), {}
    for r in Q.technology_hits(spark, DATA).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    words = {re.split(r"\W", n[2].lower())[0] for n in names}
    checked = 0
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        if len(text) < 6000 and words & set(re.findall(r"\w+", text.lower())):
            assert sorted(found.get(r.doc_id, [])) == T.plain_recover(text, names), r.doc_id
            checked += bool(found.get(r.doc_id))
    assert checked > 20


def test_heading_kinds_and_sections(spark):
    aliases = [(r.alias, r.section_type) for r in Q.aliases(spark, DATA).orderBy("place").collect()]
    key = lambda t: t.strip().rstrip(":").strip().casefold()
    kinds = {r.heading: (r.section_type, r.method, r.score) for r in Q.heading_kinds(spark, DATA).collect()}
    first = {}
    for a, s in aliases:
        first.setdefault(key(a), s)
    last = {key(a): s for a, s in aliases}
    for heading, got in kinds.items():
        k = key(heading)
        scores = [(ratio(k, a), -i, a) for i, a in enumerate(first)] if len(k.split()) <= 6 else []
        best = max(scores, default=(0,))
        expected = (last[k], "ALIAS_EXACT", 100.0) if k in last else (last[best[2]], "FUZZY_HEADING", best[0]) if best[0] >= 90 else ("UNKNOWN", "UNKNOWN", None)
        assert got == expected, heading
    assert len({m for _, m, _ in kinds.values()}) == 3
    docs = {}
    for r in Q.headed_lines(spark, DATA).orderBy("conv_id", "line").collect():
        docs.setdefault(r.conv_id, []).append(r)
    starts = {}
    for r in Q.section_starts(spark, DATA).collect():
        starts.setdefault(r.conv_id, set()).add(r.first_line)
    for conv, rows in docs.items():
        opens = S.plain_boundaries([(r.text, r.is_heading, r.section_type, r.method, r.style) for r in rows])
        assert starts[conv] == {r.line for i, (r, o) in enumerate(zip(rows, opens)) if o or i == 0}


def test_packed_views_with_headings_in_turns(spark, tmp_path):
    turns = [(1, 0, "one two\nAtouth three four\n\n Experience: five"), (1, 1, "six\nseven missions"), (1, 3, "word " * 160 + "\nqualification\nrole: x"), (2, 2, "a b\nÉducation c"), (3, 4, ""), (4, 0, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'user', ?)", turns)
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    got = {r.conv_id: r.packed_words for r in Q.packed_views(spark, str(tmp_path)).collect()}
    assert got[1].startswith("Missions: six seven missions Education one two Experience: five qualification role: x Atouth three four Atouts word")
    assert len(got[1].split(" ")) == 150 and got[3] == "Preferred:"
    assert got == dict(con.sql(registry.ORACLES["packed_views"]).fetchall())


def test_literal_mentions_of_items_without_long_words(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 1 AS item_id, 'a cat sat, on' AS text UNION ALL SELECT 2, 'one elephant. ran') TO '{tmp_path}/benchmark.parquet'")
    con.execute(f"COPY (SELECT 7 AS doc_id, 'A cat sat by an ELEPHANT' AS text) TO '{tmp_path}/documents.parquet'")
    found = {(r.item_id, r.surface, r.start, r.end) for r in Q.literal_mentions(spark, str(tmp_path)).collect()}
    assert found == {(1, "A cat sat", 0, 9), (2, "ELEPHANT", 16, 24)}
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert {tuple(r[1:2]) + tuple(r[3:]) for r in con.sql(registry.ORACLES["literal_mentions"]).fetchall()} == found


def test_plans_of_headings_stay_small(spark):
    # the plan of a query reads what was written and holds its inputs' windows no more
    for made in (Q.heading_kinds, Q.section_starts):
        plan = made(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and plan.count("Relation") <= 8, plan.count("Relation")
