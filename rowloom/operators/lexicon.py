"""Skills and technologies found in text by a lexicon: longest alias first, token boundaries, context where an alias needs it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A small lexicon of technologies: id, name, aliases, policy.
TECHNOLOGIES = [
    ("T001", "Python", "python", "SAFE"), ("T002", "Java", "java", "SAFE"), ("T003", "JavaScript", "javascript;js", "SAFE"), ("T004", "C++", "c++;cpp", "SYMBOLIC"),
    ("T005", "C#", "c#;csharp", "SYMBOLIC"), ("T006", "Go", "go;golang", "CONTEXT_REQUIRED"), ("T007", "R", "r", "CONTEXT_REQUIRED"), ("T008", "SQL", "sql", "SAFE"),
    ("T009", "Apache Spark", "apache spark;spark;pyspark", "CONTEXT_REQUIRED"), ("T010", "Kubernetes", "kubernetes;k8s", "SAFE"), ("T011", "Docker", "docker", "SAFE"),
    ("T012", "Amazon Web Services", "aws;amazon web services", "SAFE"), ("T013", "React", "react;react.js;reactjs", "CONTEXT_REQUIRED"), ("T014", ".NET", ".net;dotnet", "SYMBOLIC"),
    ("T015", "PostgreSQL", "postgresql;postgres", "SAFE"), ("T016", "Machine Learning", "machine learning", "SAFE"), ("T017", "Git", "git", "SAFE"), ("T018", "Linux", "linux", "SAFE"),
]
HIT = "array<struct<skill_id:string,name:string,surface:string,start:int,end:int,reason:string>>"
_TOKEN = re.compile(r"[A-Za-z0-9.+#]+")
_NEAR = 30


def aliases(lexicon: DataFrame) -> DataFrame:
    """skill_id, name, alias, policy: one row an alias, trimmed, lower case; an alias of several skills is left out."""
    rows = lexicon.select("skill_id", "name", F.coalesce("policy", F.lit("SAFE")).alias("policy"), F.explode(F.split("aliases", r"[;|]")).alias("alias"))
    rows = rows.withColumn("alias", F.lower(F.trim("alias"))).where("alias <> ''").distinct()
    alone = rows.groupBy("alias").agg(F.countDistinct("skill_id").alias("n")).where("n = 1").select("alias")
    return rows.join(alone, "alias")


def _index(rows) -> dict:
    """Tokens to skills, by first token, longest first."""
    index: dict[str, list] = {}
    for r in rows:
        tokens = tuple(t.rstrip(".") or t for t in _TOKEN.findall(r["alias"]))
        if tokens:
            index.setdefault(tokens[0], []).append((tokens, r["skill_id"], r["name"], r["policy"]))
    for found in index.values():
        found.sort(key=lambda x: (-len(x[0]), x[1]))
    return index


def hits(text: str | None, index: dict) -> list[tuple]:
    """Accepted matches. Safe aliases first; an alias that needs context is accepted on a line within 30 characters of one, or in a list."""
    if not text:
        return []
    tokens = []
    for m in _TOKEN.finditer(text):
        word = m.group().rstrip(".") or m.group()
        tokens.append((word.lower(), m.start(), m.start() + len(word)))
    found, at = [], 0
    while at < len(tokens):
        step = 1
        for alias, skill, name, policy in index.get(tokens[at][0], ()):
            if tuple(t[0] for t in tokens[at : at + len(alias)]) == alias:
                start, end = tokens[at][1], tokens[at + len(alias) - 1][2]
                found.append((skill, name, text[start:end], start, end, policy))
                step = len(alias)
                break
        at += step
    sure = [f for f in found if f[5] != "CONTEXT_REQUIRED"]
    out, seen = [], set()
    for skill, name, surface, start, end, policy in found:
        reason = "safe"
        if policy == "CONTEXT_REQUIRED":
            near = any(max(s[3] - end, start - s[4]) <= _NEAR and "\n" not in text[min(end, s[4]) : max(start, s[3])] for s in sure)
            listed = text[max(0, start - 40) : end + 40].count(",") >= 2
            if not (near or (listed and surface[:1].isupper())):
                continue
            reason = "context" if near else "list"
        if skill not in seen:
            seen.add(skill)
            out.append((skill, name, surface, start, end, reason))
    return out


def scan(docs: DataFrame, lexicon: DataFrame, most: int = 200_000) -> DataFrame:
    """docs (doc_id, text) with their hits. The lexicon's aliases, whose number is checked, go to each executor once."""
    rows = aliases(lexicon).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} aliases")
    sent = docs.sparkSession.sparkContext.broadcast(_index(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["skill_id", "name", "surface", "start", "end", "reason"]
        for batch in batches:
            found = [[dict(zip(names, h, strict=True)) for h in hits(t, sent.value)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "hits": found})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, hits {HIT}")


def technologies(spark) -> DataFrame:
    return spark.createDataFrame(TECHNOLOGIES, "skill_id string, name string, aliases string, policy string")
