"""Zones and rules beside leaves, against plain loops and stated cases."""

import random
import re

from pyspark.sql import functions as F

from rowloom.functions import leaf_rules as L
from rowloom.operators import zones as Z


def test_zones(spark):
    rng = random.Random(14)
    lines = ["Requirements:", " What you'll need ", "profile", "experience in x", "Experienced", "plain text", "", ":: Benefits ::", "The company", "contract", "missions", "mission", "x" * 90, "Education " * 9]
    rows = [(i, "".join(rng.choice(lines) + rng.choice(["\n", "\r\n", "\n\n", "\r"]) for _ in range(rng.randrange(9))) + rng.choice(["", "tail"])) for i in range(200)] + [(900, None), (901, " \n ")]
    df = spark.createDataFrame(rows, "id int, body string")
    found = {}
    zoned = Z.zones(df, "id", "body")
    for r in zoned.orderBy("id", "start").collect():
        found.setdefault(r.id, []).append((r.kind, r.start, r.end))
    for i, body in rows:
        body, heads, at = body or "", [], 0
        if not body.strip():
            assert i not in found
            continue
        for line in body.splitlines(keepends=True):
            bare = line.strip().strip(":").strip()
            kind = next((k for k, f in Z.KINDS.items() if re.match(rf"(?:{f})\b", bare, re.I)), None) if bare and len(bare) < 80 else None
            if kind:
                heads.append((kind, at))
            at += len(line)
        expected = [(k, s, e) for (k, s), e in zip(heads, [s for _, s in heads[1:]] + [len(body)])]
        if not heads or heads[0][1] > 0:
            expected.insert(0, ("OTHER", 0, heads[0][1] if heads else len(body)))
        assert found[i] == expected, (body, found[i], expected)
    places = [(i, rng.randrange(60)) for i in range(200)] + [(900, 0)]
    for r in Z.zone_at(spark.createDataFrame(places, "id int, at int"), zoned, "id", "at").collect():
        assert r.zone == next((k for k, s, e in found.get(r.id, []) if s <= r.at < e), "OTHER")


def test_leaf_rules(spark):
    parts = ["intro\nJob : do this\nand that\n Required profile : a degree", "Job: x\nrequired PROFILE:", "no parts", None, ""]
    got = [tuple(r.p) for r in spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, d string").orderBy("i").select(L.job_parts(F.col("d")).alias("p")).collect()]
    assert got == [("do this\nand that", " a degree", "OK"), ("x", "", "OK"), ("", "no parts", "LOW"), ("", "", "LOW"), ("", "", "LOW")]
    titles = {"Comptable Senior": True, "Commercial B2B": True, "Commercial support engineer": False, "Developer": False, "Assistant sédentaire": True, None: False}
    got = {r.t: r.o for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", L.out_of_domain(F.col("t"), F.lit(None).cast("string")).alias("o")).collect()}
    assert got == titles
    cases = [
        ("Chef de projet IA", "", "Machine Learning Engineer", "IT Project Manager"), ("Python Developer", "", "DevOps Engineer", "Backend Developer"), ("Python Developer machine learning", "", "DevOps Engineer", None),
        ("Salesforce cloud", "crm work", "Cloud Engineer", "IT Consultant"), ("Salesforce cloud", "on AWS", "Cloud Engineer", None), ("Support N2", "handle tickets", "Test Automation Engineer", "Application Support Specialist"),
        ("Support Java", None, "Software Test Engineer", "Application Support Specialist"), ("Support", "", "Software Test Engineer", None), ("Chef de projet", "", "Web Developer", None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, d string, w string, leaf string")
    assert [r.o for r in df.orderBy("i").select(L.overruled([F.col("t")], F.col("d"), F.col("w")).alias("o")).collect()] == [c[3] for c in cases]
