"""Which lexicon entries are names of technologies, and which of their matches in a text count: rules as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that count wherever they stand, compared in lower case.
STRONG = [
    "python", "java", "javascript", "typescript", "docker", "kubernetes", "postgresql", "mysql", "mongodb", "redis", "react", "angular", "vue.js",
    "node.js", "django", "flask", "amazon web services", "microsoft azure", "google cloud platform", "git", "github", "gitlab", "jenkins", "terraform",
    "ansible", "nginx", "apache", "kafka", "html", "css", "sql", "nosql", "linux", "php", "c#", "c++", "go", "rust", "swift", "kotlin", "ruby",
    "symfony", "laravel", "flutter", "datadog", "prometheus", "grafana", "cmake", "makefile",
]
# Common words beside those of a table of lemmas.
COMMON = (
    "fluent basic analyze analyse analyzing analyzed embrace keep play move make making made clear just kind less man reach score choices "
    "processing unstructured scale reason factor fear fish gas spring star edge near red reduce"
).split()
# Common words that are no alias of a product of another name.
GENERIC = "make just man gas red near fish fear score reach kind clear keep play move scale reason edge spring star factor embrace fluent basic analyze analyse processing unstructured choices".split()
# Expressions of a line that lists technologies, of a language behind a match, and of prose around it.
LIST_LINE = (
    r"(?iU)(technolog|stack|frameworks?|langages?|platforms?|libraries|database|cloud|outils?|environnement|\btools?\b|"
    r"experience with|knowledge of|familiar with|proficient in|hands[- ]on)"
)
LANGUAGE_AFTER = r"(?iU)^\s*(english|french|arabic|german|spanish|italian|mandarin|dutch|portuguese|chinese|japanese|korean|russian|turkish|hindi)\b"
PROSE = [
    r"(?iU)\bfluent\s+(english|french|german|arabic|spanish|italian)\b",
    r"(?iU)\b(basic|good|solid|strong)\s+(knowledge|understanding|skills?|grasp)\b",
    r"(?iU)\bmake\s+(sure|adjustments|decisions|recommendations|progress)\b",
    r"(?iU)\banaly[sz]e\s+(and|the|data|processes|requirements|customer)\b",
    r"(?iU)\bembrace\s+(design|change|new|our|the|a)\b",
    r"(?iU)\bkeep\s+(up|track|in\s+mind|your|the|our)\b",
    r"(?iU)\bplay\s+(an?\s+)?(important|key|active|critical|major)\b",
    r"(?iU)\bmove\s+(to|into|forward|quickly|fast)\b",
    r"(?iU)\bscale\s+(up|down|our|the|your)\b",
    r"(?iU)\bclear\s+(communication|understanding|vision|objectives)\b",
    r"(?iU)\bprocessing\s+(of|data|information|requests)\b",
    r"(?iU)\bunstructured\s+(data|text|information)\b",
    r"(?iU)\bjust\s+(a|an|the|need|want|have|to)\b",
    r"(?iU)\bkind\s+of\b",
    r"(?iU)\bman\s+(page|pages)\b",
]
# One of these, within one token, is in all that an expression of prose, and of a line that lists technologies, finds.
# FOLD: letters that expressions take for others and lower case doesn't.
PROSE_PARTS = "fluent basic good solid strong make analyse analyze embrace keep play move scale clear processing unstructured just kind man".split()
LIST_PARTS = "technolog stack framework langage platform libraries database cloud outil environnement tool experience knowledge familiar proficient hands".split()
FOLD = str.maketrans("ſKıİ", "skii")
# Characters around a match that are read for prose, for a language behind it and for separators of a list.
PROSE_BEFORE, PROSE_AFTER, LANGUAGE_REACH, LIST_REACH, NEIGHBOUR_REACH = 15, 40, 24, 40, 30
REACH = max(PROSE_BEFORE, PROSE_AFTER, LANGUAGE_REACH, LIST_REACH)
SEPARATORS = r"[,;|•/]"


def strong(*names: Column) -> Column:
    return reduce(or_, (F.coalesce(F.lower(n).isin(STRONG), F.lit(False)) for n in names))


def _slice(text: Column, start: Column, end: Column) -> Column:
    """Characters from start (0 is the first, and the least) to end, exclusive."""
    begin = F.greatest(start, F.lit(0))
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


def in_prose(text: Column, start: Column, end: Column) -> Column:
    """A prose expression's first place around a match overlaps it."""
    base = F.greatest(start - PROSE_BEFORE, F.lit(0))
    window = _slice(text, base, end + PROSE_AFTER)

    def overlaps(form: str) -> Column:
        at = F.regexp_instr(window, F.lit(form)) - 1 + base
        return window.rlike(form) & (at < end) & (at + F.length(F.regexp_extract(window, form, 0)) > start)

    return F.when(window.rlike("|".join(PROSE)), reduce(or_, map(overlaps, PROSE))).otherwise(False)


def line_of(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Where the line of start begins, and where that of end ends."""
    begin = start - F.length(F.substring_index(_slice(text, F.lit(0), start), "\n", -1))
    rest = F.position(F.lit("\n"), text, end + 1)
    return begin, F.when(rest > 0, rest - 1).otherwise(F.length(text))


def distinctive(surface: Column, alias: Column, canonical: Column) -> Column:
    """Written as a name, not as prose."""
    ref = F.when(F.coalesce(canonical, F.lit("")) != "", canonical).otherwise(alias)
    return (
        surface.rlike(r"^[A-Z0-9][A-Z0-9+#./_-]+$")
        | surface.rlike(r"[+#./]")
        | ((F.lower(surface) == F.lower(ref)) & (surface != F.lower(surface)))
        | ((alias != "") & (surface == alias))
    )


def flags(text: Column, surface: Column, alias: Column, canonical: Column, policy: Column, start: Column, end: Column, common: Column, lines: tuple | None = None, maybe: Column | None = None) -> Column:
    """What verdict() needs of a match but for its neighbours, as a struct. common: the alias or the surface is a common word.

    Reading lines and prose costs more than all else. Where lines (where they begin and end, and whether one of them lists technologies)
    are given, text may be what REACH characters around the match hold, with start and end counted in it; where maybe is false, the
    match is known not to be in prose.
    """
    begin, stop = line_of(text, start, end) if lines is None else lines[:2]
    return F.struct(
        policy.alias("policy"),
        (in_prose(text, start, end) if maybe is None else F.when(maybe, in_prose(text, start, end)).otherwise(False)).alias("prose"),
        _slice(text, end, end + LANGUAGE_REACH).rlike(LANGUAGE_AFTER).alias("language"),
        (common & ~strong(canonical, alias, surface)).alias("common"),
        F.contains(F.trim(surface), F.lit(" ")).alias("several"),
        (surface == F.lower(surface)).alias("lower"),
        ((surface == F.upper(surface)) & (surface != F.lower(surface)) & (F.length(surface) >= 3)).alias("capitals"),
        (_slice(text, begin, stop).rlike(LIST_LINE) if lines is None else lines[2]).alias("listed"),
        _slice(text, start - LIST_REACH, end + LIST_REACH).rlike(SEPARATORS).alias("separated"),
        distinctive(surface, alias, canonical).alias("distinctive"),
        (F.length(F.trim(alias)) <= 5).alias("short"),
        begin.cast("int").alias("line"),
        stop.cast("int").alias("line_end"),
    )


def verdict(f: Column, neighbour: Column) -> Column:
    """Why a match is refused, '' if it counts. neighbour: a match that counts stands near on the same line. To be listed is worth as much as to have a neighbour."""
    context = f["listed"] | neighbour
    common = (
        F.when(f["lower"], "common_lowercase").when(f["capitals"] & (context | f["separated"]), "").when(~context, "common_no_tech_context").otherwise("")
    )
    needing = F.when(context, "").when(~f["distinctive"], "context_required").when(f["short"] & ~f["listed"], "short_alias_no_list").otherwise("")
    return (
        F.when(f["policy"] == "DISABLED_BY_DEFAULT", "disabled_by_default")
        .when(f["prose"], "prose_antipattern")
        .when(f["language"], "language_proficiency")
        .when(f["several"] & f["common"] & ~context, "common_multiword_prose")
        .when(f["common"], common)
        .when(f["policy"] == "CONTEXT_REQUIRED", needing)
        .otherwise("")
    )


def lemma_set(lemmas: DataFrame, word: str) -> DataFrame:
    """Distinct common words in lower case, the fixed ones among them: column lemma."""
    fixed = lemmas.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, COMMON))).alias("lemma"))
    own = lemmas.select(F.lower(F.trim(word)).alias("lemma")).where("lemma <> ''")
    return own.unionByName(fixed).distinct()


def assign(lexicon: DataFrame, lemmas: DataFrame, word: str) -> DataFrame:
    """lexicon with the column recommended_policy.

    lexicon: tech_id, canonical, aliases (array), source_count, hot, demand, any_it (booleans), category. Null arrays are empty,
    null flags false; a row is one entry, whatever its id.
    """
    names = F.array_compact(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = lexicon.withColumn("entry of lexicon", F.struct("tech_id", "canonical", names))
    keys = rows.select("entry of lexicon", "canonical", "aliases").distinct().select("entry of lexicon", F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))).alias("key"), F.lower(F.trim("canonical")).alias("main")).where("key <> ''")
    known = lemma_set(lemmas, word)
    met = keys.join(known, F.col("key") == F.col("lemma"), "left").groupBy(F.col("entry of lexicon").alias("entry met")).agg(
        F.coalesce(F.max(F.col("lemma").isNotNull()), F.lit(False)).alias("any common"),
        F.coalesce(F.max(F.col("lemma").isNotNull() & (F.col("key") == F.col("main"))), F.lit(False)).alias("main common"),
        F.max(F.length("key") <= 2).alias("tiny"),
    )
    safe = strong(F.col("canonical")) | F.exists(names, lambda n: strong(n))
    other = F.col("category").isin("OTHER_IT_TECH", "SECURITY_TOOL")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    policy = (
        F.when(~yes("any_it"), "DISABLED_BY_DEFAULT")
        .when(safe, "SAFE")
        .when(yes("tiny"), "CONTEXT_REQUIRED")
        .when(yes("any common"), F.when(yes("main common") & (F.col("source_count") <= 1) & other, "DISABLED_BY_DEFAULT").otherwise("CONTEXT_REQUIRED"))
        .when((F.col("source_count") >= 2) | yes("hot") | yes("demand") | (F.col("category") != "OTHER_IT_TECH"), "SAFE")
        .otherwise("CONTEXT_REQUIRED")
    )
    return rows.join(met, F.col("entry of lexicon") == F.col("entry met"), "left").select(*(F.col(f"`{c}`") for c in lexicon.columns), policy.alias("recommended_policy"))


def generic_alias(alias: Column, canonical: Column) -> Column:
    """A common word that does not name a product of another name."""
    key = F.lower(F.trim(alias))
    return key.isin(GENERIC) & ~strong(canonical, alias) & (key != F.lower(F.trim(canonical)))


def collisions(lexicon: DataFrame, lemmas: DataFrame, word: str) -> DataFrame:
    """tech_id, alias, canonical, policy, category, strong_safe, recommended_policy of each name of an entry that is a common word."""
    rows = assign(lexicon, lemmas, word)
    names = F.array_compact(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    each = rows.select("tech_id", F.explode(names).alias("alias"), "canonical", F.coalesce("policy", F.lit("SAFE")).alias("policy"), "category", strong(F.col("canonical")).alias("strong_safe"), "recommended_policy")
    return each.join(lemma_set(lemmas, word), F.lower(F.trim("alias")) == F.col("lemma"), "left_semi")
