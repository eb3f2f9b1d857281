"""The pipeline's stages keep columns and take effect; the whole runs."""

import base64
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as public
import tiktoken

from rowloom.llm import mixing, quality
from tests.llm.test_operators import brute_links, brute_spans, smallest

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > 0 and counts[1] >= counts[2] == counts[3] > 0
    assert docs.where("text rlike '[a-z]@[a-z0-9]+\\\\.example'").count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert tokens.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"] and tokens.count() == counts[4]
    # the ids give the mixed texts back
    mixed = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(r.decoded_sha256 for r in tokens.collect()) == mixed


def test_run_against_plain_stages(spark):
    """run() against the stages' plain forms: kept by score, one of each component by full sets, redacted by spans, repeated by copies."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).where("predicted = 1").select("doc_id")
    rows = {r.doc_id: r.asDict() for r in docs.join(scored, "doc_id").collect()}
    ids = sorted(rows)
    _, links = brute_links([rows[i]["text"] for i in ids])
    label = smallest(range(len(ids)), links)
    rows = {i: rows[i] for k, i in enumerate(ids) if label[k] == k}
    ids = sorted(rows)
    spans, _ = brute_spans([rows[i]["text"] or "" for i in ids])
    for k, i in enumerate(ids):
        text, done = rows[i]["text"] or "", ""
        at = 0
        for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans[k].split(",") if s)):
            if a >= at:
                done += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        rows[i]["text"] = done + text[at:]
    clean = spark.createDataFrame(list(rows.values()), docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    truth = sorted((i, np.array(library.encode_ordinary(rows[i]["text"]), "<u4").tobytes()) for i in ids for _ in range(copies[i]))
    assert truth and sorted((r.doc_id, bytes(r.token_ids)) for r in corpus_pipeline.run(spark, DATA).collect()) == truth


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, empty tables and columns with the names that stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kind string, odds double, component_id long, pii_id__ string, size long"
    long = " ".join(f"word{i % 977} stands here." for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (6, "one two"), (6, "one two"), (None, "mail a.b@c.org now"), (7, "mail a.b@c.org now"), (8, "The plain words of an ordinary line of prose stand here.")]
    full = spark.createDataFrame([(i, t, None, None if i == 7 else "s", 0, "k", 0.5, 9, "p", 1) for i, t in texts], schema)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, DATA)
            assert kept.columns == docs.columns, name
            left = kept.collect()
            assert all(r.kind == "k" and r.component_id == 9 for r in left) and (docs is full or not left)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
    near = corpus_pipeline.drop_near_duplicates(spark, full, DATA).collect()
    assert sorted((r.doc_id or 0) for r in near) == [0, 1, 2, 3, 4, 6, 6, 7, 8]
    redacted = corpus_pipeline.redact_personal_data(spark, full, DATA).collect()
    assert sorted((r.text or "") for r in redacted if r.doc_id in (None, 7)) == ["mail [EMAIL] now"] * 2 and [r.n_chars for r in redacted if r.doc_id == 7] == [16]
    mixed = corpus_pipeline.mix_sources(spark, full, DATA).collect()
    assert all(r.doc_id in (None, *range(9)) for r in mixed) and len(mixed) <= 3 * len(texts)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
