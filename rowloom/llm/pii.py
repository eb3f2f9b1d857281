r"""Personal data by fixed forms, and by bootstrapped contextual extraction. DataFrame functions alone.

Base spans are those of four fixed forms. They are seeds, and so are keys and hexadecimal tokens: the words before a seed induce
lexical patterns. A looser form proposes further mentions; patterns and the values that they introduce make a graph, in which the
scores of values rate patterns and the scores of patterns rate values, for a few rounds. Values that only high-confidence patterns
introduce become spans too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, small

#: Kinds of base spans, and the kind that only the method adds.
KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
# Possessive, and held from starting within a run, so that no text costs more than its length; the matches are those of the
# plain forms: a run of an address's first part can only match as a whole, from its start or from the end of the last match.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be personal data if its context says so: spelt-out addresses, colon-parted addresses, grouped digits.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    ADDED: r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+",
    "number": r"(?<![0-9A-Za-z+._-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
}
#: Secrets that are seeds: access key ids, which no prose holds and so are spans themselves, and hexadecimal tokens.
KEY, HEX = r"^A[KS]IA[0-9A-Z]{16}$", r"^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,64}$"
#: Words of a context.
WORDS = 3
_BLOCK = 64
#: A pattern is trusted from this score, and from so many different seeds that it introduces.
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 3, 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda part: F.regexp_replace(part, r"^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda part: F.when(F.length(bare(part)) <= 3, bare(part).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _may(form: str, text: Column) -> Column:
    """Cheap and necessary for the form: whether the text holds what it needs."""
    return {
        "base:email": F.contains(text, F.lit("@")),
        "base:phone": F.contains(text, F.lit("+")),
        "loose:email": F.contains(text, F.lit(" at ")) | text.rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]"),
        "loose:ip": F.contains(text, F.lit(":")),
    }.get(form, text.rlike("[0-9]"))


def _found(form: str, pattern: str, text: Column) -> Column:
    """Leftmost non-overlapping matches in order: form, pos, length of the gap before it, its last words, value.

    Splitting at the form gives the gaps between matches, whose lengths and those of the values give the places.
    """
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    tail = lambda g: F.substring_index(F.regexp_replace(g, r"\s+", " "), " ", -1 - WORDS)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), F.lower(tail(g)).alias("tail")))

    def placed(found: Column) -> Column:
        return F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(F.lit(form).alias("form"), g["gap"].alias("gap"), g["tail"].alias("tail"), v.alias("value")))

    none = F.array().cast("array<struct<form:string,gap:int,tail:string,value:string>>")
    return F.when(_may(form, text), placed(values)).otherwise(none)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, kind, start, end, value and tail (the words before, in lower case) of every mention; a row each.

    base ones are those of the four fixed forms; others are proposed by the looser forms and touch no base one. Rows of docs that
    repeat an id and a text count once. Sums of lengths and the latest end of a base span run over each text's own mentions, so
    a text of any number of them costs no more than sorting them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    forms = {f"base:{k}": v for k, v in FORMS.items()} | {f"loose:{k}": v for k, v in LOOSE.items()}
    found = F.flatten(F.array(*(F.transform(_found(k, v, F.col("text")), lambda m, i: F.struct(i.alias("pos"), m["form"].alias("form"), m["gap"].alias("gap"), m["tail"].alias("tail"), m["value"].alias("value"))) for k, v in forms.items())))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(found).alias("m")).select("doc_id", "text_key", "m.*")
    rows = rows.dropDuplicates(["doc_id", "text_key", "form", "pos"])
    upto = Window.partitionBy("doc_id", "text_key", "form").orderBy("pos")
    size = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto).cast("int")).withColumn("start", F.col("end") - size)
    base, kind = F.col("form").startswith("base:"), F.substring_index("form", ":", -1)
    valid = F.lit(False)
    for k in KINDS:
        valid = F.when(F.col("form") == f"base:{k}", _valid(k, F.col("value"))).otherwise(valid)
    rows = rows.select("doc_id", "text_key", base.alias("base"), kind.alias("kind"), "start", "end", "value", "tail", valid.alias("valid")).where("valid or not base")
    # a base span that starts before a mention ends, and ends after it starts, touches it
    order = F.when(F.col("base"), F.col("start")).otherwise(F.col("end"))
    earlier = Window.partitionBy("doc_id", "text_key").orderBy(order, "base").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(earlier), F.lit(0))
    shape = F.when(F.col("kind") != "number", F.col("kind")).when(F.length(_digits(F.col("value"))) >= 13, "card").otherwise("phone")
    rows = rows.withColumn("covered", covered).where(F.col("base") | (F.col("covered") <= F.col("start")))
    return rows.select("doc_id", "text_key", "base", shape.alias("kind"), "start", "end", "value", "tail")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and loose (arrays of start, end, kind, value) of every row."""
    part = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("start", "end", "kind", "value"))))
    found = mentions(docs).groupBy("doc_id", "text_key").agg(part(F.col("base")).alias("base"), part(~F.col("base")).alias("loose"))
    return _with_texts(docs, found, ["base", "loose"])


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _with_texts(docs: DataFrame, found: DataFrame, arrays: list[str]) -> DataFrame:
    """doc_id, text_key and the arrays of found, empty where it has none, of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"))
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
    joined = rows.alias("d").join(found.alias("m"), on, "left")
    return joined.select("d.doc_id", "d.text_key", *(F.coalesce(f"m.{c}", F.array().cast(found.schema[c].dataType)).alias(c) for c in arrays))


def _patterns(tail: Column) -> Column:
    """The last word before a mention, the last two and the last three, marks at their ends kept (a label's colon tells most).

    None where a word holds a digit or an at sign: that is no context but a mention itself. None, either, without two letters in a
    row: marks alone, such as a quote, stand before anything.
    """
    words = F.filter(F.split(tail, " "), lambda w: w != "")
    last = F.slice(words, F.greatest(F.size(words) - WORDS + 1, F.lit(1)), F.lit(WORDS))
    n = F.size(last)
    phrases = F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda k: F.when(k <= n, F.array_join(F.slice(last, F.greatest(n - k + 1, F.lit(1)), k), " ")))
    return F.filter(phrases, lambda p: p.isNotNull() & ~p.rlike("[0-9@]") & p.rlike(r"\p{L}{2}"))


def _seed(kind: Column, value: Column, base: Column) -> Column:
    return base | ((kind == ADDED) & (value.rlike(KEY) | value.rlike(HEX)))


def graph(found: DataFrame) -> DataFrame:
    """Edges: pattern, kind, value, seed (whether the value is of a seed's form), mentions summed. Small beside the texts."""
    seed = _seed(F.col("kind"), F.col("value"), F.col("base"))
    edges = found.select("kind", F.xxhash64("value").alias("value"), seed.alias("seed"), F.explode(_patterns(F.col("tail"))).alias("pattern"))
    return edges.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))


def bootstrap(edges: DataFrame) -> DataFrame:
    """Patterns that may be trusted: pattern, kind, confidence.

    A pattern's score for a kind is the sum of its values' scores over the number of values it introduces, of any kind, plus one;
    a value's is the chance that one of its patterns is right; seeds score 1. Sums by pattern and by value are made before
    each join, so a pattern or value of a third of all mentions is no task of its own.
    """
    values = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    patterns = None
    for _ in range(ROUNDS):
        total = values.groupBy("pattern").agg(F.count(F.lit(1)).alias("all_values"))
        kinds = values.groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        rated = kinds.where(F.col("seeds") >= SUPPORT).join(total, "pattern").select("pattern", "kind", (F.col("good") / (F.col("all_values") + 1)).alias("confidence"))
        patterns = saved(rated, "patterns")
        # a single trusted pattern gives its values its own score; several, more
        doubt = values.join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))).alias("doubt"))
        scored = edges.join(doubt, ["kind", "value"], "left")
        values = saved(scored.select(*edges.columns, F.when(F.col("seed"), 1.0).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("score")), "values")
    return patterns.where(F.col("confidence") >= CONFIDENCE)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and all_spans of every text that has a span."""
    found = saved(mentions(docs), "mentions")
    trusted = small(saved(bootstrap(saved(graph(found), "graph")), "trusted"))
    loose = found.where("not base")
    hits = loose.withColumn("pattern", F.explode(_patterns(F.col("tail")))).join(trusted, ["pattern", "kind"], "left_semi")
    sure = loose.where((F.col("kind") == ADDED) & F.col("value").rlike(KEY))
    columns = ["doc_id", "text_key", "base", "kind", "start", "end"]
    order = F.array_position(F.array(*(F.lit(k) for k in (*KINDS, ADDED))), F.col("kind")).cast("int")
    each = found.where("base").select(columns).unionByName(hits.select(columns)).unionByName(sure.select(columns)).withColumn("order", order)
    span = F.struct("order", "start", "end", "kind")
    sets = each.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("all_spans"))
    return saved(sets, "spans")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and all_spans (arrays of kind, start, end) for every row of docs (doc_id, text).

    Places count code points, the end exclusive. Null text is as if empty. Rows are alike if id and text are, and have the same
    spans. Order: by kind as in KINDS, the added kind last, then start. Spans that the method adds touch no base span. Texts are
    read whole, however long. Nothing in, nothing out.
    """
    plain = lambda found: F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    whole = _with_texts(docs, spans(docs), ["base", "all_spans"])
    return whole.select("doc_id", "text_key", plain("base").alias("base"), plain("all_spans").alias("all_spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, each span in text replaced by its kind in brackets; where spans overlap, by the first's.

    Texts without spans, null ones among them, stay as they are; rows that repeat an id and a text change alike. Spans are cut out
    by blocks of a few, so that a long text with many is not read from its start for each.
    """
    each = spans(docs).select("doc_id", "text_key", F.explode("all_spans").alias("s")).select("doc_id", "text_key", "s.*")
    few = each.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    earlier = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "order").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("from", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    cut = F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("start", "end", "from", "kind")))).alias("cuts")
    cuts = each.groupBy("doc_id", "text_key").agg(cut, F.max("end").alias("last"))
    cuts = saved(cuts, "cuts")
    cuts = F.broadcast(cuts) if few else cuts  # places without texts, as many as there are spans
    text = F.col("d.text")
    condition = F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col("c.text_key"))
    joined = docs.alias("d").join(cuts.alias("c"), condition, "left")
    found = F.col("c.cuts")

    def block(i: Column) -> Column:
        """The text from the end of the block before to the end of this one's last span, spans replaced."""
        own = F.slice(found, i * _BLOCK + 1, F.lit(_BLOCK))
        begin = F.element_at(own, 1)["from"]
        part = F.substring(text, begin + 1, F.element_at(own, -1)["start"] - begin)
        piece = lambda t, s: F.concat(F.substring(t, s["from"] - begin + 1, s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.transform(F.array(part), lambda t: F.array_join(F.transform(own, lambda s: piece(t, s)), ""))[0]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), block)
    rest = F.substring(text, F.col("c.last") + 1, F.length(text))
    clean = F.when(found.isNull(), text).otherwise(F.concat(F.array_join(blocks, ""), rest))
    return joined.select(*(clean.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
