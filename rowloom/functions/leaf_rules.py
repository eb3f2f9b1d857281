"""Rules beside the assignment of leaves: parts of a description, titles out of the domain, winners that a title overrules."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The part of a description that holds the duties, up to the profile.
DUTIES = r"(?is)(?:^|\n)\s*job\s*:\s*(.*?)\n\s*required profile\s*:"
# Words of titles out of the domain, words of sales, and those that bring a title of sales back.
OUT, SALES, TECHNICAL = ["comptable", "accountant"], ["commercial", "sédentaire", "sedentaire", "inside sales"], ["engineer", "developer", "support", "analyst", "informatique"]
# Winners that a title overrules: any of each list of the title's words, none of those, any or none of the duties' words, the winners, the leaf instead.
OVERRULES = [
    {"title": [["chef de projet", "project manager"]], "winners": ["Artificial Intelligence Engineer", "Machine Learning Engineer", "NLP Engineer", "Computer Vision Engineer"], "leaf": "IT Project Manager"},
    {"title": [["python developer", "python engineer"]], "not title": ["machine learning", "data scientist"], "winners": ["Machine Learning Engineer", "Artificial Intelligence Engineer", "DevOps Engineer", "Cloud Engineer"], "leaf": "Backend Developer"},
    {"title": [["salesforce", "servicenow", "workday", "oracle"], ["cloud"]], "not duties": ["aws", "azure", "gcp", "landing zone", "vpc"], "winners": ["Cloud Engineer", "Cloud Architect"], "leaf": "IT Consultant"},
    {"title": [["support"]], "either": ["ticket", "sla", "incident", "applicatif", "java"], "winners": ["Software Test Engineer", "Test Automation Engineer"], "leaf": "Application Support Specialist"},
]


def _says(text: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def _folded(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def job_parts(description: Column) -> Column:
    """duties, rest and quality (OK, or LOW if the description has no such parts: then all of it is rest). Null is as if empty."""
    text = F.coalesce(description, F.lit(""))
    found, whole = text.rlike(DUTIES), F.regexp_extract(text, DUTIES, 0)
    rest = F.substring(text, F.position(whole, text) + F.length(whole), F.length(text) + 1)
    duties = F.regexp_replace(F.regexp_extract(text, DUTIES, 1), r"(?U)^\s+|\s+$", "")
    return F.struct(F.when(found, duties).otherwise("").alias("duties"), F.when(found, rest).otherwise(text).alias("rest"), F.when(found, "OK").otherwise("LOW").alias("quality"))


def out_of_domain(*titles: Column) -> Column:
    """A title of accounting, or of sales without a technical word. Null titles say nothing."""
    text = _folded(*titles)
    return _says(text, OUT) | (_says(text, SALES) & ~_says(text, TECHNICAL))


def overruled(titles: list[Column], duties: Column, winner: Column) -> Column:
    """The leaf that a title puts in the place of a winner, by the first rule that holds; null if none does."""
    text, tasks = _folded(*titles), _folded(duties)
    out = F.when(F.lit(False), "")
    for rule in OVERRULES:
        tests = [winner.isin(rule["winners"]), *(_says(text, words) for words in rule["title"])]
        tests += [~_says(text, rule["not title"])] if "not title" in rule else []
        tests += [~_says(tasks, rule["not duties"])] if "not duties" in rule else []
        tests += [_says(tasks, rule["either"]) | _says(text, rule["either"])] if "either" in rule else []
        out = out.when(reduce(and_, tests), rule["leaf"])
    return out
