"""Long texts made to fit: sections by priority within a budget of tokens, heads with tails, and sliding windows.

Tokens come from a function of a text column that gives an array of strings, and texts from one of such an array; by default they
are words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import bound

Tokens, Joined = Callable[[Column], Column], Callable[[Column], Column]

# Headings within a description, and the words that tell what a section is about, in order of priority.
HEADING = (
    r"(?imu)(?:^|\n)\s*(profil recherch[ée]|missions?|responsabilit[ée]s|activit[ée]s principales(?: du poste)?|comp[ée]tences (?:et )?connaissances requises|"
    r"qualifications?|[ée]ducation|exp[ée]rience|requirements?|required skills|nice to have|atouts?|preferred)\s*[:\-]?"
)
BUCKETS = [
    ("role", ["mission", "responsabilit", "activit", "role"]),
    ("requirements", ["profil recherch", "compétence", "competence", "connaissance requise", "requirement", "required skill"]),
    ("qualifications", ["qualification", "education", "expérience", "experience", "diplôme", "diplome"]),
    ("nice", ["nice to have", "atout", "preferred"]),
]
# Tokens of a head, of a tail, and of a pair's marks; a window's tokens, its prefix and the tokens of its marks.
HEAD, TAIL, PAIR_MARKS, MOST = 250, 200, 3, 512
PREFIX, WINDOW_TOKENS, WINDOW_MARKS, LEAST_WINDOW = "query: ", 64, 2, 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def spaced(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bucket(heading: Column) -> Column:
    """What a section is about, by words in its heading; else other."""
    lower = F.lower(heading)
    out = F.when(F.lit(False), "")
    for name, keys in BUCKETS:
        out = out.when(lower.rlike("|".join(keys)), name)
    return out.otherwise("other")


def parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, part (from 0), body (heading included) and bucket of the sections of each text; texts without words have none."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.size(words(F.col("text"))) > 0)
    # a heading and what follows, up to the next: the text is cut at headings, which are put back before what they head
    rows = rows.withColumn("heads", F.regexp_extract_all("text", F.lit(HEADING), F.lit(0))).withColumn("names", F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)))
    rows = rows.withColumn("bodies", F.split("text", HEADING, -1))
    lead = F.array(F.struct(F.element_at("bodies", 1).alias("body"), F.lit("other").alias("bucket")))
    headed = F.zip_with(F.arrays_zip("heads", "names"), F.slice("bodies", F.lit(2), F.size("heads")), lambda h, b: F.struct(F.concat(h["heads"], b).alias("body"), bucket(h["names"]).alias("bucket")))
    found = F.when(F.size("heads") == 0, lead).otherwise(F.concat(lead, headed))
    each = rows.select(key, F.posexplode(found).alias("part", "one")).select(key, "part", _stripped(F.col("one.body")).alias("body"), F.col("one.bucket").alias("bucket"))
    return each.where("body <> ''")


def packed(docs: DataFrame, key: str, text: str, budget: Column, tokens: Tokens = words, joined: Joined = spaced) -> DataFrame:
    """key and view: the sections of each text by priority, whole while they fit into the budget of tokens, the next cut to what is left.

    budget is a column of docs. Keys must be distinct. A text of which nothing fits, or without sections, is returned as it is; null as ''.
    """
    budgets = docs.select(F.col(key), budget.alias("budget"))
    priority = F.array_position(F.array(*(F.lit(name) for name, _ in BUCKETS), F.lit("other")), F.col("bucket"))
    rows = parts(docs, key, text).withColumn("tokens", tokens(F.col("body"))).where("size(tokens) > 0").join(budgets, key)
    order = Window.partitionBy(key).orderBy(priority, "part")
    upto = F.sum(F.size("tokens")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("left", F.col("budget") - (F.col("upto") - F.size("tokens"))).withColumn("place", F.row_number().over(order)).where("left > 0")
    fits = F.when(F.col("upto") <= F.col("budget"), F.col("body")).otherwise(joined(F.slice("tokens", F.lit(1), F.col("left").cast("int"))))
    views = rows.select(key, "place", fits.alias("view")).groupBy(F.col(key).alias("own key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "view"))), lambda x: x["view"]), "\n").alias("view"))
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(views, F.col(key) == F.col("own key"), "left").select(key, F.coalesce("view", "text").alias("view"))


def head_tail(tokens: Column, head: Column, tail: Column) -> Column:
    """The first and last tokens of an array; where the head ends as the tail begins, that is kept once. Short arrays stay whole."""
    first, last = F.slice(tokens, F.lit(1), head), F.slice(tokens, -tail, tail)
    n = F.least(head, tail)
    shared = F.filter(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.slice(first, head - i + 1, i) == F.slice(last, F.lit(1), i))
    overlap = F.coalesce(F.try_element_at(shared, F.lit(1)), F.lit(0))
    return F.when(F.size(tokens) <= head + tail, tokens).otherwise(F.concat(first, F.slice(last, overlap + 1, F.greatest(tail - overlap, F.lit(0)))))


def view(text: Column, budget: Column | None = None, head: int = HEAD, tail: int = TAIL, tokens: Tokens = words, joined: Joined = spaced) -> Column:
    """A text within a budget of tokens (head and tail, if none is given): as it is if it fits, else its head and tail."""
    own = tokens(text)
    most = F.lit(head + tail) if budget is None else budget
    h = F.least(F.lit(head), F.greatest(F.lit(1), F.floor(most / 2).cast("int")))
    t = F.least(F.lit(tail), F.greatest(F.lit(1), most - h))
    return F.when(F.size(own) <= most, F.coalesce(text, F.lit(""))).otherwise(joined(F.slice(head_tail(own, h, t), F.lit(1), most)))


def budget_beside(title: Column, most: int = MOST, tokens: Tokens = words) -> Column:
    """Tokens that a description may have beside a whole title and the marks of a pair."""
    return F.greatest(F.lit(0), F.lit(most) - F.size(tokens(title)) - PAIR_MARKS)


def windows(text: Column, tokens: Tokens = words, joined: Joined = spaced) -> Column:
    """Windows of tokens that overlap by half, each with a prefix, up to the first that reaches the end; none of an empty text."""
    width = F.greatest(F.lit(LEAST_WINDOW), F.lit(WINDOW_TOKENS - WINDOW_MARKS) - F.size(tokens(F.lit(PREFIX))))
    step = F.greatest(F.lit(1), F.floor(width / 2).cast("int"))

    def cut(own: Column) -> Column:
        n = F.size(own)
        number = F.when(n <= width, 1).otherwise(F.ceil((n - width) / step).cast("int") + 1)
        starts = F.transform(F.sequence(F.lit(0), number - 1), lambda i: i * step)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.concat(F.lit(PREFIX), joined(F.slice(own, s + 1, width)))))

    # the text is cut into tokens once, not once a window
    return bound(tokens(text), cut)
