"""Similarity, titles, ranking and layout on small fixtures."""

import random
from statistics import median

import duckdb
from pyspark.sql import functions as F

from rowloom.functions import similarity, titles
from rowloom.operators import layout, ranking
from rowloom.plans import matching_queries, registry


def test_similarity():
    assert similarity.ratio("kitten", "sitting") == 100 * 8 / 13 and similarity.ratio("", "") == 100 and similarity.ratio("a", "") == 0
    assert similarity.common_length("abcbdab", "bdcaba") == 4
    assert similarity.token_set_ratio("software engineer", "bioinformatics software engineer") == 100
    assert similarity.token_set_ratio("", "a") == 0 and 0 < similarity.token_set_ratio("data engineer", "data analyst") < 100


def test_titles(spark):
    rows = [("Senior Back-End Developer | Paris",), ("Data Engineer (m/f), €60k – req A1234",), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string")
    found = df.select(titles.retrieval_title(F.col("t")), titles.rule_title(F.col("t")), titles.title_tokens(F.col("t"))).collect()
    assert found[0][0] == "Back-End Developer" and found[0][1] == "senior backend developer | paris" and found[0][2] == ["back", "end", "developer", "paris"]
    assert found[1][0] == "Data Engineer" and (found[2][0], found[2][1], found[2][2]) == ("", "", [])
    kinds = spark.createDataFrame([("Java Developer",), ("Paris",), ("Senior",), ("C++",), ("xyz",), ("Fintech",), ("Cloud",)], "s string").select(titles.segment_kind(F.col("s"), ["java", "c++"]))
    assert [r[0] for r in kinds.collect()] == ["occupation", "location", "seniority", "technology", "unknown", "domain", "specialisation"]
    cut = spark.createDataFrame([("Dev / Ops & dev, C++ - Paris + Tunis",)], "s string").select(titles.segments(F.col("s"))).first()[0]
    assert cut == ["Dev", "Ops", "C++", "Paris", "Tunis"]


def test_recommendations(spark):
    jobs = spark.createDataFrame([(1, 10, "PROFESSIONAL", "REQUIRED"), (1, 11, "TECHNOLOGY", "PREFERRED"), (2, 10, "PROFESSIONAL", "REQUIRED"), (2, 12, "PROFESSIONAL", "REQUIRED"), (3, 11, "TECHNOLOGY", None)], "job_id long, skill_id long, kind string, requirement string")
    held = spark.createDataFrame([(7, 10, 1.0), (7, 11, 0.5)], "candidate_id long, skill_id long, credit double")
    assert [(r.job_id, r.score) for r in ranking.recommend(jobs, held).orderBy("rank").collect()] == [(1, 0.775), (3, 0.5), (2, 0.375)]
    assert [r[0] for r in spark.createDataFrame([(0.95,), (0.8,), (0.7,)], "c double").select(ranking.semantic_credit(F.col("c"))).collect()] == [0.9, 0.7, 0.0]


def test_tiers(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    make = lambda r: spark.createDataFrame(r, "k int, answer string")
    found = ranking.first_tier(rows, "k", [("a", make([(1, "x")])), ("b", make([(1, "y"), (2, "z")]))])
    assert sorted(map(tuple, found.collect())) == [(1, "x", "a"), (2, "z", "b"), (3, "UNKNOWN", "NONE")]


def test_layout(spark):
    word = lambda text, x, y: (1, 0, text, float(x), float(y), x + 20.0, y + 10.0, 10.0)
    words = [word("Experience", 0, 0), word("Dev", 30, 1), word("left", 0, 40), word("right", 200, 41), word("left2", 0, 52), word("right2", 200, 52.5), word("left", 0, 40.2)]
    df = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, font double")
    assert layout.distinct_words(df).count() == 6
    lines = layout.lines(layout.distinct_words(df))
    assert [r.text for r in lines.orderBy("line").collect()] == ["Experience Dev", "left right", "left2 right2"]
    blocks = layout.blocks(lines)
    assert [r.block for r in blocks.orderBy("line").collect()] == [0, 1, 1]
    assert [(r.place, r.block) for r in layout.reading_order(blocks).orderBy("place").collect()] == [(1, 0), (2, 1)]
    heads = lines.withColumn("text", F.when(F.col("line") == 1, "Skills:").otherwise(F.col("text")))
    assert [r.section for r in layout.sections(heads).orderBy("line").collect()] == ["HEADER", "SKILLS", "SKILLS"]
    assert layout.page_state(df).first().state == "POOR"


def test_lines_in_one_pass(spark):
    rng = random.Random(8)
    words = [(d, p, f"w{i}", float(x := rng.randrange(9) * 10), y := rng.randrange(60) / 2, x + 9.0, y + rng.choice([0.0, 4.0, 9.0]), rng.choice([8.0, 9.5, None])) for d in (1, 2, None) for p in range(3) for i in range(25)]
    expected = []
    for page in sorted({w[:2] for w in words}, key=str):
        found, mean, high = [], 0.0, 0.0
        for w in sorted((w for w in words if w[:2] == page), key=lambda w: ((w[4] + w[6]) / 2, w[3], w[2])):
            mid, height = (w[4] + w[6]) / 2, (w[6] - w[4]) or 1.0
            if found and abs(mid - mean) <= max(height, high) / 2:
                found[-1].append(w)
                mean, high = mean + (mid - mean) / len(found[-1]), max(high, height)
            else:
                found.append([w])
                mean, high = mid, height
        for n, line in enumerate(found):
            fonts = [w[7] for w in line if w[7]]
            expected.append((*page, n, " ".join(w[2] for w in sorted(line, key=lambda w: w[3])), *(f(w[k] for w in line) for f, k in ((min, 3), (min, 4), (max, 5), (max, 6))), median(fonts) if fonts else None))
    df = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, font double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")  # pages and lines reach over batches
    try:
        lines = layout.lines(df)
        assert sorted(map(tuple, lines.collect()), key=str) == sorted(expected, key=str)
        # no call of Python for each page
        assert "FlatMapGroups" not in lines._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(size)
    assert layout.lines(df.limit(0)).count() == 0


def test_words_stand_behind_blanks(spark, tmp_path):
    rows = [(1, 0, "user", "a  bc \n\U0001f600 d"), (1, 1, "user", ""), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = matching_queries._words(spark, str(tmp_path))
    assert sorted((r.text, r.x0, r.y0, r.x1) for r in found.collect()) == [("a", 0.0, 0.0, 6.0), ("bc", 18.0, 0.0, 30.0), ("d", 12.0, 10.0, 18.0), ("\U0001f600", 0.0, 10.0, 6.0)]


def test_recommendations_round_as_sql(spark, tmp_path):
    # candidates whose scores lie halfway between two numbers of six digits
    data, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{data}/orders.parquet' WHERE o_custkey IN (4886, 4929, 5314, 10469, 12759, 14085, 14982)) TO '{tmp_path}/orders.parquet'")
    (tmp_path / "lineitem.parquet").symlink_to(f"{data}/lineitem.parquet")
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    rows = registry.QUERIES["job_recommendations"](spark, str(tmp_path)).select("candidate_id", "job_id", "score", "rank").collect()
    assert len(rows) == 35
    assert sorted(map(tuple, rows)) == sorted(con.sql(registry.ORACLES["job_recommendations"]).fetchall())
