"""Closures and overlap joins against plain loops."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from rowloom.operators import geometry, graphs
from rowloom.plans import registry, relational_queries


def test_closure(spark):
    rng = random.Random(2)
    for n, m in ((12, 14), (30, 90), (5, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (2, None)]
        edges += edges[:2]
        df = spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, steps string")
        above = {}
        for a, b in edges:
            if a is not None and b is not None:
                above.setdefault(a, set()).add(b)

        def least(starts):
            seen, last, steps = {}, set(starts), 0
            while last:
                seen |= {x: steps for x in last}
                last = {y for x in last for y in above.get(x, ())} - seen.keys()
                steps += 1
            return seen

        expected = {(a, b, s + 1) for a in above for b, s in least(above[a]).items()}
        assert sorted(map(tuple, graphs.closure(df, "a", "b").collect())) == sorted(expected)
        seeds = spark.createDataFrame([(1,), (1,), (None,), (99,)], "n long")
        assert dict(map(tuple, graphs.reachable(df, "a", "b", seeds, "n").collect())) == least([1, 99])
        assert graphs.reachable(df, "a", "b", seeds.limit(0), "n").count() == 0


def test_closure_writes_each_pair_once(spark):
    n, root = 8, Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    found = graphs.closure(spark.range(n).selectExpr("id as a", "id + 1 as b"), "a", "b")
    assert sorted(map(tuple, found.collect())) == [(a, b, b - a) for a in range(n) for b in range(a + 1, n + 1)]
    # the edges twice, as they are and in buckets, and the pairs
    written = sum(spark.read.parquet(str(p)).count() for p in set(root.iterdir()) - before)
    assert written == 2 * n + n * (n + 1) // 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("rowloom_")]


def test_overlap_join(spark):
    rng = random.Random(4)
    spans = lambda n: [(i, rng.randrange(3), a := rng.uniform(-50, 200), rng.choice([a, a + rng.uniform(0, 2), a + rng.uniform(0, 3000), float(int(a)) + 8, None])) for i in range(n)]
    left, right = spans(200), spans(150)
    left += [(900, 1, 16.0, 32.0), (901, 1, 0.0, 16.0), (902, None, 0.0, 9.0)]
    right += [(900, 1, 32.0, 48.0), (901, 1, 16.0, 16.5)]
    frame = lambda rows: spark.createDataFrame(rows, "i int, k int, s double, e double")
    expected = sorted((a, b) for a, k, s, e in left for b, m, t, f in right if k == m and k is not None and None not in (e, f) and s < e and t < f and s < f and t < e)
    for width in (1.0, 16.0, 1e6):
        pairs = geometry.overlap_join(frame(left), frame(right), ["k"], ("s", "e"), ("s", "e"), width)
        assert sorted((r.l.i, r.r.i) for r in pairs.collect()) == expected
    assert geometry.overlap_join(frame(left).limit(0), frame(right), ["k"], ("s", "e"), ("s", "e"), 1.0).count() == 0


def box(rng):
    x, y = rng.randrange(100), rng.randrange(100)
    return x + 0.0, y + 0.0, x + rng.randrange(30) + 0.0, y + rng.randrange(12) + 0.0


def test_styles_of_words(spark):
    rng = random.Random(5)
    words = [(i, rng.randrange(3), *box(rng)) for i in range(120)]
    spans = [(rng.randrange(3), i, *box(rng), 9.0 + i % 4) for i in range(60)]
    found = geometry.style_of_words(spark.createDataFrame(words, "i int, page int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(spans, "page int, nth int, x0 double, y0 double, x1 double, y1 double, size double"), ["page"], "nth")
    got = {r.i: r.style and r.style.nth for r in found.collect()}
    for i, page, x0, y0, x1, y1 in words:
        best, top = None, 0.0
        for p, n, a0, b0, a1, b1, _ in spans:
            area = max(0.0, min(x1, a1) - max(x0, a0)) * max(0.0, min(y1, b1) - max(y0, b0))
            if p == page and area > top:
                best, top = n, area
        assert got[i] == best
    assert len(got) == len(words) and len(set(got.values())) > 10


def test_box_columns(spark):
    rows = [((0.0, 0.0, 4.0, 2.0), (2.0, 1.0, 6.0, 5.0)), ((0.0, 0.0, 1.0, 1.0), (3.0, 4.0, 5.0, 6.0)), ((5.0, 5.0, 6.0, 6.0), (0.0, 0.0, 1.0, 1.0)), ((0.0, 0.0, 0.0, 5.0), (0.0, 0.0, 9.0, 9.0))]
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    x = lambda f: f(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1"))
    got = df.select(x(geometry.overlap).alias("o"), x(geometry.gap).alias("g"), geometry.shared_area("a", "b").alias("s"), geometry.shared_ratio("a", "b").alias("r"), geometry.normalised("a", F.lit(2.0), F.lit(4.0)).alias("n"), geometry.normalised("a", F.lit(0.0), F.lit(4.0)).alias("z")).collect()
    assert [(r.o, r.g, r.s, r.r) for r in got] == [(2.0, 0.0, 2.0, 0.25), (0.0, 2.0, 0.0, 0.0), (0.0, 4.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    assert tuple(got[0].n) == (0.0, 0.0, 2.0, 0.5) and tuple(got[0].z) == (0.0,) * 4
    assert tuple(df.select("a.*").agg(geometry.union_of("").alias("u")).first().u) == (0.0, 0.0, 6.0, 6.0)


def test_reading_order(spark):
    rng = random.Random(6)
    blocks = [(p, i, *box(rng)) for p in range(6) for i in range(15)]
    rows = spark.createDataFrame(blocks, "page int, block int, x0 double, y0 double, x1 double, y1 double")
    found = sorted((r.page, r.reading_order, r.block, r.band, r.column_number) for r in geometry.reading_order(rows, ["page"], F.lit(2.0), F.lit(6.0)).collect())

    def merged(spans, gap):
        out = []
        for a, b in sorted(spans):
            if out and a - out[-1][1] <= gap:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    expected = []
    for p in range(6):
        own, n = [b for b in blocks if b[0] == p], 0
        for i, (low, high) in enumerate(merged([(b[3], b[5]) for b in own], 2.0)):
            band = [b for b in own if b[3] < high and b[5] > low]
            for j, (left, right) in enumerate(merged([(b[2], b[4]) for b in band], 6.0)):
                for b in sorted((b for b in band if b[2] < right and b[4] > left), key=lambda b: (b[3], b[1])):
                    expected.append((p, n, b[1], i, j))
                    n += 1
    assert found == expected


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(relational_queries, "SHARE", 1000)
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert registry.QUERIES["subsumption_prune"](spark, data).rdd.getNumPartitions() == -(-rows // 1000)
