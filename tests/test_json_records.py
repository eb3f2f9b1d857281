"""JSON of any depth, and record files, against plain Python."""

import copy
import json
import random

from pyspark.sql import types as T

from rowloom.operators import json_tree
from rowloom.sources import records


def made(rng, depth=0):
    kind = rng.random()
    if depth > 5 or kind < 0.3:
        return rng.choice([1, "é", None, True, 2.5, "x y"])
    if kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    out = {rng.choice("abcde"): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if rng.random() < 0.5:
        out[rng.choice(["leaf_id", "sibling_leaf_id"])] = rng.choice(["OLD", "NEW"])
    return out


def plain_prune(value):
    if isinstance(value, list):
        out, n = [], 0
        for item in value:
            if isinstance(item, dict) and "OLD" in (item.get("leaf_id"), item.get("sibling_leaf_id")):
                n += 1
            else:
                item, more = plain_prune(item)
                out.append(item)
                n += more
        return out, n
    if isinstance(value, dict):
        if value.get("leaf_id") == "OLD":
            return None, 1
        pairs = {k: plain_prune(v) for k, v in value.items()}
        return {k: v for k, (v, _) in pairs.items()}, sum(n for _, n in pairs.values())
    return value, 0


def plain_nodes(value, path=()):
    yield path, value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        yield from plain_nodes(v, (*path, str(k)))


def test_prune_and_nodes(spark):
    rng = random.Random(13)
    values = {i: made(rng) for i in range(300)}
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in values.items()] + [(900, None), (901, "no json{"), (902, "[" * 300 + "1" + "]" * 300)]
    df = spark.createDataFrame(rows, "id int, body string")
    removed = 0
    for r in df.select("id", json_tree.pruned(["leaf_id"], ["sibling_leaf_id"], ["OLD"])("body").alias("p")).select("id", "p.*").collect():
        if r.id < 900:
            expected, n = plain_prune(copy.deepcopy(values[r.id]))
            assert (json.loads(r.json), r.removed) == (expected, n)
            removed += n
        else:
            assert r.removed == 0 and r.json == dict(rows)[r.id]
    assert removed > 50
    found = {}
    for r in json_tree.nodes(df.where("id < 902"), "id", "body").collect():
        found.setdefault(r.id, []).append((tuple(r.path), r.depth, json.loads(r.value) if r.value is not None else None))
    assert set(found) == set(values)
    for i, v in values.items():
        line = lambda p, n, x: f"{p} {n} {json.dumps(x, sort_keys=True)}"
        assert sorted(line(*n) for n in found[i]) == sorted(line(p, len(p), x) for p, x in plain_nodes(v)), i


def test_leaves(spark):
    tree = {"families": [{"id": "F1", "parents": [{"id": "P1", "leaves": [{"id": "L1", "titles": [{"title_id": "T1", "t": "A"}, {"title_id": "T2"}]}, {"id": "L2"}]}]}, {"id": "F2", "parents": []}, {"id": "F3"}]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "{}")], "k int, body string")
    rows = json_tree.leaves(df, "k", "body", ["families", "parents", "leaves", "titles"], [["id"], ["id"], ["id"], ["title_id", "t"]]).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "F1", "P1", "L1", "T1", "A"), (1, "F1", "P1", "L1", "T2", None)]


def test_record_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    (tmp_path / "lines.json").write_text('{"a": "x", "b": 1}\n\n{"a": "é"}\n')
    (tmp_path / "whole.json").write_text('[{"a": "x",\n "b": 2}, {"b": 3}]')
    assert sorted(map(tuple, records.records(spark, str(tmp_path / "lines.json"), schema).collect()), key=str) == [("x", 1), ("é", None)]
    assert sorted(map(tuple, records.records(spark, str(tmp_path / "whole.json"), schema, whole=True).collect()), key=str) == [("x", 2), (None, 3)]
    (tmp_path / "offers.json").write_text('{"job_id": "1", "title": "T", "extra": 5}\n')
    offer = records.offers(spark, str(tmp_path / "offers.json")).first()
    assert offer.job_id == "1" and offer.title == "T" and offer.url is None and list(offer.asDict()) == records.OFFER_FIELDS
    (tmp_path / "t.csv").write_text('﻿name, n\n"a ""b""\nc",1\n', encoding="utf-8")
    table = records.csv(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["name", "n"] and table.first().name == 'a "b"\nc'
    records.write_csv(table, str(tmp_path / "out"))
    assert list(map(tuple, records.csv(spark, str(tmp_path / "out")).collect())) == list(map(tuple, table.collect()))
    folder = tmp_path / "files" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.bin").write_bytes(b"abc")
    import hashlib

    found = records.file_registry(spark, str(tmp_path / "files")).first()
    assert found.bytes == 3 and found.sha256 == hashlib.sha256(b"abc").hexdigest() and found.path.endswith("deep/one.bin")
    tables = {"one": spark.createDataFrame([("x", 1), ("x", 1), (None, 2)], schema), "two": spark.createDataFrame([], schema)}
    prints = {r.table: r for r in records.export_snapshot(tables, str(tmp_path / "snapshot")).collect()}
    again = records.rebuild_snapshot(spark, str(tmp_path / "snapshot"), dict.fromkeys(tables, schema))
    for name, df in again.items():
        assert tuple(records.fingerprint(df).first()) == tuple(prints[name])[1:]
        assert sorted(map(str, df.collect())) == sorted(map(str, tables[name].collect()))
