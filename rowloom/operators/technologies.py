"""Technologies of a lexicon recognised in text: slash names, slash compounds, then the longest names by their words.

Names without slashes are looked up while a text is read once; only of a lexicon that is too large for a task the names meet the
texts by joins of narrow rows (words and runs of words), as names with slashes always do. Each candidate takes along the characters
around it and what its lines hold, so that it is judged by columns (policy.verdict), with and without a neighbour, apart from the
text. What then depends on earlier matches, which places are taken and which matches stand near, is one sweep over a text's few
candidates.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from . import policy
from .mentions import mentions, row_key
from .steps import kept

# A token, a compound with slashes, what may not stand beside a slash name, what is stripped for a second key.
TOKEN = re.compile(r"[\w][\w+#./_-]*")
PARTS = re.compile(f"({TOKEN.pattern})")
COMPOUND = re.compile(r"[\w+#.][\w+#./_-]*(?:/[\w+#./_-]+)+")
SLASH_WORDS, SLASH_EDGES, STRIPPED = r"[A-Za-z0-9+#]+", ("A-Za-z0-9+#", "A-Za-z0-9+#"), r"[ .,;:|()\[\]]"
SPAN = "array<struct<surface:string,start:int,end:int>>"
# Characters and candidates that are Python objects at once.
PIECE_CHARS, PIECE_CANDIDATES = 1 << 18, 4_000
# Fixed value: names, and common words, that a task holds. More are joined.
HELD = 50_000
# Fixed value: tokens that a task remembers.
TOLD = 200_000
HIT = "tech_id:string,canonical:string,surface:string,start:int,end:int,policy:string,match_type:string"


REC = ["tech_id", "canonical", "alias", "policy", "common"]


def normal(text: Column) -> Column:
    """The key form of a name: lower case, dashes alike, other marks blank, slashes and hyphens without blanks."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[–—]", "-")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w+#./\s-]", " "), r"(?U)\s+", " "))
    return F.replace(F.replace(s, F.lit(" / "), F.lit("/")), F.lit(" - "), F.lit("-"))


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to `most`, or of one larger row: what is held as Python objects at once."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def _spans(form: re.Pattern):
    @F.pandas_udf(SPAN)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            for a, b in pieces([len(t or "") for t in text], PIECE_CHARS):
                yield pd.Series([[{"surface": m.group(), "start": m.start(), "end": m.end()} for m in form.finditer(t or "")] for t in text.iloc[a:b]])

    return spans


def names(lexicon: DataFrame, lemmas: DataFrame, word: str) -> DataFrame:
    """One row a usable name: tech_id, canonical, alias, policy, category, place (its order in the lexicon), key, common.

    lexicon: position (order), tech_id, canonical, aliases ('|' or ';' between them), policy (null: SAFE), category. Disabled entries,
    names under two characters and one or two letters or digits but for a final mark (unless the technology is a strong one) are no names.
    """
    rows = lexicon.withColumn("policy", F.coalesce(F.nullif(F.trim("policy"), F.lit("")), F.lit("SAFE"))).where("policy not in ('DISABLED', 'DISABLED_BY_DEFAULT')")
    canonical = F.trim(F.coalesce("canonical", F.lit("")))
    others = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), "[|;]"), lambda a: F.trim(a)), lambda a: a != "")
    rows = rows.withColumn("canonical", canonical).select("position", "tech_id", "canonical", "policy", "category", F.posexplode(F.concat(F.array("canonical"), others)).alias("nth", "alias"))
    core = F.trim(F.regexp_replace("alias", r"[*+#]+$", ""))
    rows = rows.where((F.length("alias") >= 2) & ~((F.length(core) <= 2) & core.rlike(r"(?U)^[\p{L}\p{N}]+$") & ~policy.strong(F.col("canonical"), F.col("alias"))))
    rows = rows.select("tech_id", "canonical", "alias", "policy", "category", F.struct("position", "nth").alias("place"), normal(F.col("alias")).alias("key"), F.lower("alias").alias("alias_key"))
    known = policy.lemma_set(lemmas, word)
    return rows.join(known, F.col("alias_key") == F.col("lemma"), "left").withColumn("common", F.col("lemma").isNotNull()).drop("lemma", "alias_key")


def by_key(names: DataFrame) -> DataFrame:
    """Of each key the name that answers for it: safe before others, strong before others, the longest, the first."""
    order = F.struct((F.col("policy") != "SAFE").alias("a"), (~policy.strong(F.col("canonical"), F.col("alias"))).alias("b"), (-F.length("alias")).alias("c"), F.col("place").alias("d"))
    return names.groupBy(F.col("key").alias("name key")).agg(F.min_by(F.struct(*REC), order).alias("rec"))


def lookup(rows: DataFrame, surface: str, keyed: DataFrame) -> DataFrame:
    """rows whose surface has a name under one of its three keys, with rec and match_type. rows must differ in all their columns or be alike."""
    own = normal(F.col(surface))
    stripped = F.regexp_replace(F.regexp_replace(F.col(surface), f"^{STRIPPED}+", ""), f"{STRIPPED}+$", "")
    keys = F.array(own, F.when(stripped != "", normal(stripped)), F.replace(own, F.lit(" "), F.lit("/")))
    each = rows.distinct().select(*rows.columns, F.posexplode(keys).alias("nth key", "name key")).join(keyed, "name key")
    found = each.groupBy(*rows.columns).agg(F.min_by(F.struct("rec", "name key"), "nth key").alias("first"))
    kind = F.when(normal(F.col("first.rec.canonical")) == F.col("first.`name key`"), "CANONICAL_EXACT").when(F.col("first.`name key`") != own, "NORMALIZED_EXACT").otherwise("ALIAS_EXACT")
    return found.select(*rows.columns, "first.rec", kind.alias("match_type"))


def _trie(names: DataFrame) -> DataFrame:
    """The names' trie as a table: a row for each list of words, with the name that ends there."""
    words = F.transform(F.regexp_extract_all("alias", F.lit(f"(?U){TOKEN.pattern}"), F.lit(0)), lambda t: F.lower(t))
    listed = names.withColumn("words", words).where("size(words) > 0")
    # of several names of the same words the longest answers, then the greatest, then the first
    order = F.struct(F.length("alias"), "alias", -F.col("place.position"), -F.col("place.nth"))
    return listed.groupBy("words").agg(F.max_by(F.struct(*REC), order).alias("rec"))


def _by_words(tokens: DataFrame, trie: DataFrame) -> DataFrame:
    """The longest name that begins at each token: row, at, after (numbers of tokens), start, end, rec.

    A text's tokens meet the names' first words, and a run of as many tokens as the longest name has is all that is carried along.
    """
    trie = trie.withColumn("first", F.col("words")[0])
    longest = trie.agg(F.max(F.size("words"))).first()[0] or 1  # one number
    runs = F.transform("tokens", lambda t, i: F.struct(i.alias("at"), F.transform(F.slice("tokens", i + 1, longest), lambda x: F.struct(F.lower(x["surface"]).alias("word"), x["start"].alias("start"), x["end"].alias("end"))).alias("run")))
    each = tokens.select("row", F.explode(runs).alias("one")).select("row", "one.at", "one.run").withColumn("first", F.col("run")[0]["word"])
    met = each.join(trie, "first").where(F.transform(F.slice("run", F.lit(1), F.size("words")), lambda x: x["word"]) == F.col("words"))
    best = met.groupBy("row", "at").agg(F.max_by(F.struct("run", "rec", F.size("words").alias("n")), F.size("words")).alias("one"))
    return best.select("row", "at", (F.col("at") + F.col("one.n")).alias("after"), F.col("one.run")[0]["start"].alias("start"), F.element_at("one.run", F.col("one.n"))["end"].alias("end"), F.col("one.rec").alias("rec"))


CANDIDATE = ["pass", "n", "at", "after", "start", "end", "rec", "match_type"]


def _of(rows: DataFrame, number: int, kind: str, n: Column, at: Column, after: Column) -> DataFrame:
    return rows.select("row", F.lit(number).alias("pass"), n.cast("long").alias("n"), at.cast("int").alias("at"), after.cast("int").alias("after"), "start", "end", "rec", F.lit(kind).alias("match_type"))


def _slashed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """row, pass, n (order in the pass), at, after (null), start, end, rec, match_type of all that the first two passes look at, in texts that hold a slash."""
    rows = rows.where(F.contains("text", F.lit("/")))
    none = F.lit(None)
    slashed = names.where(F.contains("alias", F.lit("/"))).groupBy("alias").agg(F.max_by(F.struct(*REC), "place").alias("rec"), F.min("place").alias("first place"))
    zero = mentions(rows, "row", "text", slashed, "alias", SLASH_WORDS, SLASH_EDGES)
    zero = _of(zero, 0, "SLASH_ALIAS", F.rank().over(Window.partitionBy("row").orderBy(-F.length("alias"), "first place", "start")), none, none)
    compounds = rows.select("row", F.explode(_spans(COMPOUND)("text")).alias("c"))
    parts = F.split("c.surface", "/", -1)
    pieces = F.transform(parts, lambda p, i: F.struct(p.alias("surface"), F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, q: n + F.length(q) + 1).alias("offset")))
    pieces = F.concat(F.filter(pieces, lambda p: p["surface"] != ""), F.array(F.struct(F.col("c.surface").alias("surface"), F.lit(0).alias("offset"))))
    one = compounds.select("row", F.col("c.start").alias("from"), F.posexplode(pieces).alias("nth", "piece"))
    one = one.select("row", "from", "nth", F.col("piece.surface").alias("surface"), (F.col("from") + F.col("piece.offset")).alias("start"))
    one = lookup(one, "surface", by_key(names)).withColumn("end", F.col("start") + F.length("surface"))
    return zero.unionByName(_of(one, 1, "SLASH_COMPOUND", F.col("from").cast("long") * (1 << 24) + F.col("nth"), none, none))


def _met(rows: DataFrame, found: DataFrame, lemma: DataFrame) -> DataFrame:
    """rows (row, text, held) with their candidates of found, null if they have none; each knows whether its surface is a common word."""
    placed = rows.select("row", "text").join(found.withColumnRenamed("row", "own row"), F.col("row") == F.col("own row"))
    placed = placed.select("row", *CANDIDATE, F.expr("substring(text, start + 1, end - start)").alias("surface"))
    known = placed.join(lemma, F.lower(F.trim("surface")) == F.col("lemma"), "left").withColumn("known", F.col("lemma").isNotNull())
    by_row = known.groupBy(F.col("row").alias("own row")).agg(F.collect_set(F.struct(*CANDIDATE, "known")).alias("more"))
    return rows.join(by_row, F.col("row") == F.col("own row"), "left").drop("own row")


class _Told(dict):
    """What is known of a token: how many words the names have that begin with it, the most first, and whether it may be part of prose, and of a list's line; 0 if nothing."""

    def __init__(self, words: list):
        super().__init__()
        self.names = {tuple(r["words"]): i for i, r in enumerate(words)}
        # a common word in lower case never counts, whatever stands around it, unless it is a strong name
        weak = [r["rec"]["common"] and not {r["rec"][f].lower() for f in ("canonical", "alias")} & set(policy.STRONG) for r in words]
        self.weak = {i for i, w in enumerate(weak) if w}
        self.sizes: dict[str, list] = {}
        for own in sorted(self.names, key=len, reverse=True):
            sizes = self.sizes.setdefault(own[0], [])
            if len(own) not in sizes:
                sizes.append(len(own))
        self.either, self.prose, self.lists = (re.compile("|".join(parts)).search for parts in (policy.PROSE_PARTS + policy.LIST_PARTS, policy.PROSE_PARTS, policy.LIST_PARTS))

    def __missing__(self, token: str) -> tuple | int:
        lower = token.lower()
        folded, sizes = lower if token.isascii() else token.translate(policy.FOLD).lower(), self.sizes.get(lower)
        if self.either(folded):
            told = sizes, self.prose(folded) is not None, self.lists(folded) is not None
        else:
            told = (sizes, False, False) if sizes else 0
        if len(self) < TOLD and len(token) < 50:
            self[token] = told
        return told


class _Text:
    """A text's candidates by its words, its lines that may list technologies, and what is told of a place."""

    def __init__(self, text: str, told: _Told):
        self.text, parts = text, PARTS.split(text)
        ends, tokens = list(accumulate(map(len, parts))), parts[1::2]
        marked = [(i, own) for i, own in enumerate(map(told.__getitem__, tokens)) if own]
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        prose = [i for i, own in marked if own[1]]
        self.prose, self.prose_ends = [ends[2 * i] for i in prose], [ends[2 * i + 1] for i in prose]
        self.lists = sorted({bisect.bisect_left(self.breaks, ends[2 * i]) for i, own in marked if own[2]})
        self.named = []  # at, after, start, end, number of the name
        for i, (sizes, _, _) in marked:
            for n in sizes or ():
                name = told.names.get(tuple([t.lower() for t in tokens[i : i + n]]))
                if name is not None and i + n <= len(tokens):
                    start, end = ends[2 * i], ends[2 * (i + n) - 1]
                    if not (name in told.weak and (surface := text[start:end]).isascii() and surface == surface.lower() and surface not in policy.STRONG):
                        self.named.append((i, i + n, start, end, name))
                    break

    def line(self, n: int) -> tuple[int, int]:
        return self.breaks[n - 1] + 1 if n else 0, self.breaks[n] if n < len(self.breaks) else len(self.text)

    def lines(self, start: int, end: int) -> tuple[int, int, int, int]:
        """Where the line of start begins and that of end ends, and which of the lines that may list technologies these are."""
        first, last = bisect.bisect_left(self.breaks, start), bisect.bisect_left(self.breaks, end)
        return self.line(first)[0], self.line(last)[1], bisect.bisect_left(self.lists, first), bisect.bisect_right(self.lists, last)

    def may_be_prose(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.prose, end + policy.PROSE_AFTER) - 1
        return at >= 0 and self.prose_ends[at] > start - policy.PROSE_BEFORE


def _reader(words: list, lemma: set | None, kind: StructType):
    """Batches of row, text, held and more (candidates) to row, found, held with its lines and the lines that may list technologies, as in kind.

    words: the trie's rows; lemma: the common words, None if all candidates are in more.
    """
    types = to_arrow_schema(StructType(kind.fields[1:]))
    one = types.field("found").type.value_type
    recs = pa.array([r["rec"].asDict() for r in words], one.field("rec").type)
    told = _Told(words if lemma is not None else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(pc.utf8_length(batch.column("text")).to_pylist(), PIECE_CHARS):
                piece = batch.slice(a, b - a)
                rows, ends, found, more, held, lines = [], [0], [], [], [], []
                for i, (text, taken, others) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("text", "held", "more")), strict=True)):
                    read = _Text(text, told)
                    own = [(2, at, at, after, start, end, name, "TRIE_EXACT", text[start:end].strip(" ").lower() in lemma) for at, after, start, end, name in read.named]
                    for c in others or ():
                        own.append((c["pass"], c["n"], c["at"], c["after"], c["start"], c["end"], len(recs) + len(more), c["match_type"], c["known"]))
                        more.append(c["rec"])
                    if own:
                        rows.append(i)
                        found += [(*c, text[max(c[4] - policy.REACH, 0) : c[5] + policy.REACH], text[c[4] : c[5]], *read.lines(c[4], c[5]), read.may_be_prose(c[4], c[5])) for c in own]
                        ends.append(len(found))
                        held.append(None if taken is None else [dict(zip(("start", "end", "line", "line_end"), (s["start"], s["end"], *read.lines(s["start"], s["end"])[:2]), strict=True)) for s in taken])
                        lines.append([text[slice(*read.line(n))] for n in read.lists])
                columns = [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in one]
                every = pa.concat_arrays([recs, pa.array(more, recs.type)])
                columns = [every.take(pa.array(c, pa.int64())) if f.name == "rec" else pa.array(c, f.type) for c, f in zip(columns, one, strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(one)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row").take(pa.array(rows, pa.int64())), listed, pa.array(held, types.field("held").type), pa.array(lines, types.field("lines").type)], ["row", "found", "held", "lines"]
                )

    return run


def _judged(rows: DataFrame, lemma: DataFrame) -> DataFrame:
    """rows (text, surface, start, end, rec) with flags of policy.flags()."""
    rec = F.col("rec")
    joined = rows.join(lemma, F.lower(F.trim("surface")) == F.col("lemma"), "left")
    common = rec["common"] | F.col("lemma").isNotNull()
    return joined.withColumn("flags", policy.flags(F.col("text"), F.col("surface"), rec["alias"], rec["canonical"], rec["policy"], F.col("start"), F.col("end"), common)).drop("lemma")


class Taken:
    """Places that are taken, by start: (start, end, line, line_end)."""

    def __init__(self, spans: list[tuple[int, int, int, int]]):
        self.spans = sorted(spans)
        self.longest = max((b - a for a, b, *_ in spans), default=0)

    def _around(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """Those that hold a character from start on and before end."""
        low, high = bisect.bisect_left(self.spans, (start - self.longest,)), bisect.bisect_left(self.spans, (end,))
        return [s for s in self.spans[low:high] if s[1] > start]

    def overlaps(self, start: int, end: int) -> bool:
        return bool(self._around(start, end))

    def near(self, start: int, end: int) -> bool:
        """Another place within reach, whose lines hold this one's start."""
        reach = policy.NEIGHBOUR_REACH
        return any((a, b) != (start, end) and line <= start < line_end for a, b, line, line_end in self._around(start - reach, end + reach))

    def add(self, *span: int) -> None:
        bisect.insort(self.spans, span)
        self.longest = max(self.longest, span[1] - span[0])


SWEPT = ["pass", "n", "at", "after", "start", "end", "line", "line_end", "counts", "counts_near", "first_list", "last_list"]


def sweep(candidates: list[tuple], taken: Taken, lists: list[bool]) -> list[int]:
    """Of candidates (SWEPT and a number) the numbers of those that count, in order; each takes its place, which bars what overlaps it, and is a neighbour of what follows."""
    out, cursor = [], 0
    for number, _, at, after, start, end, line, line_end, counts, counts_near, first, last, own in sorted(candidates):
        if number == 2 and at < cursor or taken.overlaps(start, end):
            continue
        # a piece of a compound has the compound as its neighbour, and the compound its pieces; to be listed is worth as much
        near = number == 1 or any(lists[first:last]) or taken.near(start, end)
        if counts_near if near else counts:
            taken.add(start, end, line, line_end)
            out.append(own)
            cursor = after if number == 2 else cursor
    return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of row, found, held and lists to row and hit."""
    fields = ["tech_id", "canonical", "surface", "start", "end", "policy", "match_type"]
    for batch in batches:
        for a, b in pieces(pc.list_value_length(batch.column("found")).to_pylist(), PIECE_CANDIDATES):
            piece = batch.slice(a, b - a)
            each = pc.list_flatten(piece.column("found"))
            columns = dict(zip((f.name for f in each.type), each.flatten(), strict=True))
            own = list(zip(*(columns[f].to_pylist() for f in SWEPT), range(len(each)), strict=True))
            rows, hits, at = [], [], 0
            for i, (n, spans, lists) in enumerate(zip(pc.list_value_length(piece.column("found")).to_pylist(), *(piece.column(c).to_pylist() for c in ("held", "lists")), strict=True)):
                held = Taken([(s["start"], s["end"], s["line"], s["line_end"]) for s in spans or ()])
                firsts: dict = {}
                for c in sweep(own[at : at + n], held, lists):
                    firsts.setdefault(columns["tech_id"][c].as_py(), c)
                at += n
                rows += [i] * len(firsts)
                hits += firsts.values()
            hit = pa.StructArray.from_arrays([columns[f].take(pa.array(hits, pa.int64())) for f in fields], fields)
            yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(rows, pa.int64())), hit], ["row", "hit"])


def _lined(text: Column, spans: Column) -> Column:
    def one(s: Column) -> Column:
        line, line_end = policy.line_of(text, s["start"], s["end"])
        return F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), line.cast("int").alias("line"), line_end.cast("int").alias("line_end"))

    return F.transform(spans, one)


def recover(texts: DataFrame, key: str, text: str, lexicon: DataFrame, lemmas: DataFrame, word: str, taken: str | None = None) -> DataFrame:
    """key, tech_id, canonical, surface, start, end, policy, match_type: of each text, the first place of each technology that counts.

    Passes: names with slashes, longest first; pieces and wholes of compounds with slashes; names by words, the longest at each
    token and, if that is refused, none shorter. A place that an earlier match, or the column `taken` (array of start and end),
    holds bars later ones. Null and empty texts give no rows; rows that share key and text are answered once; an empty lexicon
    answers nothing. A text's candidates meet in one row; they are no more than its tokens.
    """
    lemmas = kept(policy.lemma_set(lemmas, word))
    known = kept(names(lexicon, lemmas, "lemma"))
    held = F.lit(None).cast("array<struct<start:int,end:int>>") if taken is None else F.col(taken)
    rows = texts.where(F.col(text).isNotNull()).select(row_key(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"), held.alias("held"))
    trie = _trie(known)
    words, common = trie.limit(HELD + 1).collect(), lemmas.limit(HELD + 1).collect()
    found = _slashed(rows, known)
    if fits := len(words) <= HELD and len(common) <= HELD:
        slash = F.contains("text", F.lit("/"))
        met = _met(rows.where(slash), found, lemmas)
        met = met.unionByName(rows.where(~slash).withColumn("more", F.lit(None).cast(met.schema["more"].dataType)))
    else:
        tokens = rows.select("row", _spans(TOKEN)("text").alias("tokens"))
        met = _met(rows, found.unionByName(_of(_by_words(tokens, trie), 2, "TRIE_EXACT", F.col("at"), F.col("at"), F.col("after"))), lemmas)
    rec = known.select(F.struct(*REC).alias("rec")).schema["rec"].dataType.simpleString()
    one = f"struct<pass:int,n:bigint,at:int,after:int,start:int,end:int,rec:{rec},match_type:string,known:boolean,window:string,surface:string,line:int,line_end:int,first_list:int,last_list:int,maybe:boolean>"
    kind = StructType([met.schema["row"], *StructType.fromDDL(f"found array<{one}>, held array<struct<start:int,end:int,line:int,line_end:int>>, lines array<string>").fields])
    read = met.select("row", "text", "held", "more").mapInArrow(_reader(words if fits else [], {r["lemma"] for r in common} if fits else None, kind), kind)

    def flagged(c: Column) -> Column:
        """A candidate with the flags of its verdict, which are computed once; counted in its window it starts at `start`."""
        start = F.least(c["start"], F.lit(policy.REACH))
        end = start + c["end"] - c["start"]
        lines = c["line"], c["line_end"], F.lit(False)  # what its lines list is seen to in the sweep
        flags = policy.flags(c["window"], c["surface"], c["rec"]["alias"], c["rec"]["canonical"], c["rec"]["policy"], start, end, c["rec"]["common"] | c["known"], lines, c["maybe"])
        around = F.concat(F.when(c["start"] > 0, F.substring(c["window"], start, F.lit(1))).otherwise(" "), F.substring(c["window"], end + 1, F.lit(1)))
        edges = (c["pass"] < 2) | ~around.rlike(r"[\p{L}\p{N}]")
        own = ["pass", "n", "at", "after", "start", "end", "surface", "match_type", "line", "line_end", "first_list", "last_list"]
        return F.struct(*(c[f].alias(f) for f in own), edges.alias("edges"), flags.alias("flags"), *(c["rec"][f].alias(f) for f in ("tech_id", "canonical", "policy")))

    def ruled(c: Column) -> Column:
        counts, counts_near = (policy.verdict(c["flags"], F.lit(near)) == "" for near in (False, True))
        return c.dropFields("flags", "edges").withField("counts", c["edges"] & counts).withField("counts_near", c["edges"] & counts_near)

    ready = F.filter(F.transform(F.transform("found", flagged), ruled), lambda c: c["counts"] | c["counts_near"])
    ready = read.select("row", ready.alias("found"), "held", F.transform("lines", lambda line: line.rlike(policy.LIST_LINE)).alias("lists"))
    hits = ready.mapInArrow(_swept, StructType([ready.schema["row"], StructField("hit", StructType.fromDDL(HIT))]))
    hits = hits.groupBy("row", "hit.tech_id").agg(F.min("hit").alias("hit"))
    return hits.select(F.col("row.key").alias(key), "hit.*")


def classify_spans(spans: DataFrame, key: str, lexicon: DataFrame, lemmas: DataFrame, word: str) -> DataFrame:
    """key, tech_id, canonical, surface, start, end, policy, match_type of each span that names a technology; if none does, of its tokens that do.

    spans: key (its own for each span), text, surface, start, end, confirmed (array of start and end: matches that count already).
    """
    lemma = kept(policy.lemma_set(lemmas, word))
    keyed = kept(by_key(names(lexicon, lemma, "lemma")))
    own = spans.select(F.col(key).alias("key"), "text", "surface", "start", "end", F.coalesce("confirmed", F.array().cast("array<struct<start:int,end:int>>")).alias("confirmed"))

    def accepted(places: DataFrame) -> DataFrame:
        """Places (key, surface, start, end) with a name that counts there."""
        found = lookup(places, "surface", keyed).withColumnRenamed("key", "own key")
        judged = _judged(own.select("key", "text", "confirmed").join(found, F.col("key") == F.col("own key")).drop("own key"), lemma)
        reach = policy.NEIGHBOUR_REACH

        def near(s: Column) -> Column:
            line, line_end = s["line"], s["line_end"]
            other = (s["start"] != F.col("start")) | (s["end"] != F.col("end"))
            return other & (line <= F.col("start")) & (F.col("start") < line_end) & (s["start"] < F.col("end") + reach) & (s["end"] > F.col("start") - reach)

        neighbour = F.exists(_lined(F.col("text"), F.col("confirmed")), near)
        return judged.where(policy.verdict(F.col("flags"), neighbour) == "").select("key", "rec.tech_id", "rec.canonical", "surface", "start", "end", "rec.policy", "match_type")

    whole = accepted(own.select("key", "surface", "start", "end"))
    rest = own.join(whole.select("key").distinct(), "key", "left_anti").where(F.contains(F.trim("surface"), F.lit(" ")) | F.contains("surface", F.lit("/")))
    tokens = rest.select("key", F.col("start").alias("base"), F.explode(_spans(TOKEN)("surface")).alias("t"))
    tokens = tokens.select("key", F.col("t.surface").alias("surface"), (F.col("base") + F.col("t.start")).alias("start"), (F.col("base") + F.col("t.end")).alias("end")).where(F.length("surface") >= 2)
    contained = accepted(tokens).withColumn("match_type", F.lit("CONTAINED_EXACT"))
    return whole.unionByName(contained).withColumnRenamed("key", key)
