"""Technologies in text and literal mentions against plain loops over one text at a time."""

import random
import re

from rowloom.operators import policy as P
from rowloom.operators import technologies as T
from rowloom.operators.mentions import mentions

LEXICON = [
    (1, "T1", "Python", "py thon|python 3", "SAFE", "LANG"), (2, "T2", "Oracle Database", "Oracle PL/SQL;PL/SQL|Oracle", "SAFE", "DB"), (3, "T3", "Spring", "spring boot", "CONTEXT_REQUIRED", "FW"),
    (4, "T4", "CI/CD", "ci / cd", "SAFE", "OPS"), (5, "T5", "Less", "less", "SAFE", "WEB"), (6, "T6", "Go", "golang|go", "SAFE", "LANG"), (7, "T7", "Dead", "dead", "DISABLED", "X"),
    (8, "T8", "R", "r|rr", "SAFE", "LANG"), (9, "T9", "Django", None, None, "FW"), (10, "T10", "Make", "make", "CONTEXT_REQUIRED", "OPS"), (11, "T11", "Zed", "zed shop|zed shop tool", "CONTEXT_REQUIRED", "OPS"),
    (12, "T12", "Python 3", "", "SAFE", "LANG"), (13, "T13", "C++", "cpp", "SAFE", "LANG"), (14, "T14", "Git", "Git/Bitbucket", "SAFE", "OPS"), (15, "T15", "Cloud Kit", "kit", "CONTEXT_REQUIRED", "X"),
]
SCHEMA = "position int, tech_id string, canonical string, aliases string, policy string, category string"
LEMMAS = ["shop", "kit", "clear", "Spring"]
PIECES = (
    "python Python 3 PL/SQL Oracle PL/SQL spring Spring boot CI/CD ci/cd-ready Less LESS less go Go golang Django Python/Django Git/Bitbucket make Make zed shop Zed shop tool kit KIT Cloud Kit r rr C++ cpp "
    "experience with|, |; |\n|\n\n| - |stack: |the| and |just a |make sure |clear vision |English|French|/|+|x|Spring English|a/b/python|//go|.|kind of|play a key|tools"
).split("|")
WORDS = [w for p in PIECES for w in ([p] if len(p.split()) < 2 or len(p) < 20 else p.split())] + ["Oracle PL/SQL", "Zed shop", "zed shop tool", "Spring boot", "Cloud Kit", "python 3"]


def plain_key(s):
    s = re.sub(r"[^\w+#./\s-]", " ", s.strip().lower().replace("–", "-").replace("—", "-"))
    return re.sub(r"\s+", " ", s).strip().replace(" / ", "/").replace(" - ", "-")


def plain_names():
    out = []
    for _, tech, canonical, aliases, kind, _ in LEXICON:
        if kind in ("DISABLED", "DISABLED_BY_DEFAULT"):
            continue
        for alias in [canonical] + [a.strip() for a in re.split(r"[|;]", aliases or "") if a.strip()]:
            core = alias.rstrip("*+#").strip()
            if len(alias) >= 2 and not (len(core) <= 2 and core.isalnum() and not ({canonical.lower(), alias.lower()} & set(P.STRONG))):
                out.append((tech, canonical, alias, kind or "SAFE"))
    return out


def plain_lookup(surface, names):
    stripped = surface.strip(" .,;:|()[]")
    for key in [plain_key(surface)] + ([plain_key(stripped)] if stripped else []) + [plain_key(surface).replace(" ", "/")]:
        found = [n for n in names if plain_key(n[2]) == key]
        if found:
            best = min(found, key=lambda n: (n[3] != "SAFE", not ({n[1].lower(), n[2].lower()} & set(P.STRONG)), -len(n[2])))
            return best, "CANONICAL_EXACT" if plain_key(best[1]) == key else "NORMALIZED_EXACT" if key != plain_key(surface) else "ALIAS_EXACT"
    return None, None


def plain_refusal(text, name, start, end, confirmed):
    _, canonical, alias, kind = name
    surface = text[start:end]
    common_words = {w.lower() for w in LEMMAS} | set(P.COMMON)
    common = bool({alias.lower(), surface.strip().lower()} & common_words) and not ({canonical.lower(), alias.lower(), surface.lower()} & set(P.STRONG))
    line = text[text.rfind("\n", 0, start) + 1 : text.find("\n", end) if "\n" in text[end:] else len(text)]
    listed = re.search(P.LIST_LINE.replace("(?iU)", "(?i)"), line) is not None
    near = False
    for a, b in confirmed:
        first, last = text.rfind("\n", 0, a) + 1, text.find("\n", b) if "\n" in text[b:] else len(text)
        near |= (a, b) != (start, end) and first <= start < last and a < end + 30 and b > start - 30
    context = listed or near
    base = max(0, start - 15)
    for form in P.PROSE:
        m = re.search(form.replace("(?iU)", "(?i)"), text[base : end + 40])
        if m and base + m.start() < end and base + m.end() > start:
            return "prose_antipattern"
    if re.match(P.LANGUAGE_AFTER.replace("(?iU)^", "(?i)"), text[end : end + 24]):
        return "language_proficiency"
    if " " in surface.strip() and common and not context:
        return "common_multiword_prose"
    if common:
        if surface == surface.lower():
            return "common_lowercase"
        if surface.isupper() and len(surface) >= 3 and (context or re.search(r"[,;|•/]", text[max(0, start - 40) : end + 40])):
            return ""
        return "" if context else "common_no_tech_context"
    if kind == "CONTEXT_REQUIRED" and not context:
        shaped = re.fullmatch(r"[A-Z0-9][A-Z0-9+#./_-]+", surface) or re.search(r"[+#./]", surface) or (surface.lower() == canonical.lower() and surface != surface.lower()) or surface == alias
        if not shaped:
            return "context_required"
        if len(alias) <= 5 and not listed:
            return "short_alias_no_list"
    return ""


def plain_recover(text, names, occupied=()):
    taken, hits = list(occupied), []
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)

    def offer(name, a, b, kind, confirmed):
        if free(a, b) and not plain_refusal(text, name, a, b, confirmed):
            taken.append((a, b))
            hits.append((name[0], name[1], text[a:b], a, b, name[3], kind))
            return True
        return False

    slashed = {n[2]: n for n in names if "/" in n[2]}
    for alias in sorted(slashed, key=len, reverse=True):
        for m in re.finditer(rf"(?<![A-Za-z0-9+#]){re.escape(alias)}(?![A-Za-z0-9+#])", text, re.I):
            offer(slashed[alias], m.start(), m.end(), "SLASH_ALIAS", taken)
    for m in T.COMPOUND.finditer(text):
        spans, at = [], m.start()
        for part in m.group().split("/"):
            if part:
                spans.append((at, at + len(part)))
            at += len(part) + 1
        spans.append(m.span())
        for a, b in spans:
            name, _ = plain_lookup(text[a:b], names)
            if name:
                offer(name, a, b, "SLASH_COMPOUND", taken + spans)
    tokens, i = [(m.group().lower(), *m.span()) for m in T.TOKEN.finditer(text)], 0
    while i < len(tokens):
        best = None
        for name in names:
            words = [t.lower() for t in T.TOKEN.findall(name[2])]
            if words and [t[0] for t in tokens[i : i + len(words)]] == words and (best is None or (len(words), len(name[2]), name[2]) > (best[0], len(best[1][2]), best[1][2])):
                best = (len(words), name)
        if best:
            a, b = tokens[i][1], tokens[i + best[0] - 1][2]
            if not (text[a - 1 : a] if a else "").isalnum() and not text[b : b + 1].isalnum() and offer(best[1], a, b, "TRIE_EXACT", taken):
                i += best[0]
                continue
        i += 1
    firsts = {}
    for h in hits:
        firsts.setdefault(h[0], h)
    return sorted(firsts.values())


def frames(spark):
    return spark.createDataFrame(LEXICON, SCHEMA), spark.createDataFrame([(w,) for w in LEMMAS], "lemma string")


def test_recover(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", "\n", ""]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += ["", None, "experience with python", "LESS, Sass", "Spring\nstack: Spring", "é" * 50 + " Python", "python " * 300]
    rows = [(i, t, [(0, 4)] if i % 5 == 0 else None) for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "Django", None)]
    lexicon, lemmas = frames(spark)
    df = spark.createDataFrame(rows, "id long, body string, held array<struct<start:int,end:int>>").drop("held")
    found = {}
    for r in T.recover(df, "id", "body", lexicon, lemmas, "lemma").collect():
        found.setdefault(r.id, []).append(tuple(r)[1:])
    names = plain_names()
    assert found.pop(None) == [("T9", "Django", "Django", 0, 6, "SAFE", "TRIE_EXACT")]
    kinds = set()
    for i, t in enumerate(texts):
        expected = plain_recover(t or "", names)
        kinds |= {h[-1] for h in expected}
        assert sorted(found.get(i, [])) == expected, (t, sorted(found.get(i, [])), expected)
    assert kinds == {"SLASH_ALIAS", "SLASH_COMPOUND", "TRIE_EXACT"}
    held = spark.createDataFrame([r for r in rows[:200] if r[2]], "id long, body string, held array<struct<start:int,end:int>>")
    barred = {}
    for r in T.recover(held, "id", "body", lexicon, lemmas, "lemma", "held").collect():
        barred.setdefault(r.id, []).append(tuple(r)[1:])
    assert all(sorted(barred.get(i, [])) == plain_recover(texts[i], names, [(0, 4)]) for i in range(0, 200, 5))
    assert T.recover(df, "id", "body", lexicon.limit(0), lemmas, "lemma").count() == 0 and T.recover(df.limit(0), "id", "body", lexicon, lemmas, "lemma").count() == 0


def test_recover_shuffles_hits_alone(spark, monkeypatch):
    """Texts without slashes: no more is shuffled than a part of their size; where names are too many for a task, joins give the same rows."""
    rng = random.Random(5)
    own = [w for w in WORDS if "/" not in w] + ["ſpring up", "Make\u0130", "clear\tvision"]
    texts = ["".join((rng.choice(own) if rng.randrange(4) == 0 else f"{rng.randrange(1 << 30):x}") + rng.choice([" ", " ", ", ", "\n"]) for _ in range(1500)) for _ in range(40)]
    lexicon, lemmas = frames(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").cache()
    df.count()
    sc = spark.sparkContext
    more = (None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def shuffled():
        found = sc._jsc.sc().statusStore().stageList(*more)
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = shuffled()
    found = sorted(map(tuple, T.recover(df, "id", "body", lexicon, lemmas, "lemma").collect()))
    moved = sum(n for k, n in shuffled().items() if k not in before)
    names = plain_names()
    assert found == sorted((i, *h) for i, t in enumerate(texts) for h in plain_recover(t, names))
    assert moved < sum(map(len, texts)) / 2
    monkeypatch.setattr(T, "HELD", 0)
    assert sorted(map(tuple, T.recover(df, "id", "body", lexicon, lemmas, "lemma").collect())) == found


def test_classify_spans(spark):
    rng = random.Random(5)
    names, rows = plain_names(), []
    for i in range(300):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n"]) for _ in range(12))
        start = rng.randrange(len(text))
        end = min(len(text), start + rng.randrange(1, 20))
        rows.append((i, text, text[start:end], start, end, [(0, 3)] if i % 2 else None))
    for i, surface in enumerate(["Python", "PL SQL", "(Django)", "python/Django", "Oracle PL/SQL stack", "spring boot", "CI / CD", "golang kit"]):
        rows.append((500 + i, f"tools: {surface} here", surface, 7, 7 + len(surface), None))
    lexicon, lemmas = frames(spark)
    found = {}
    df = spark.createDataFrame(rows, "id long, text string, surface string, start int, end int, confirmed array<struct<start:int,end:int>>")
    for r in T.classify_spans(df, "id", lexicon, lemmas, "lemma").collect():
        found.setdefault(r.id, []).append(tuple(r)[1:])
    some = 0
    for i, text, surface, start, end, confirmed in rows:
        name, kind = plain_lookup(surface, names)
        if name and not plain_refusal(text, name, start, end, confirmed or []):
            expected = [(name[0], name[1], surface, start, end, name[3], kind)]
        else:
            expected = []
            for m in T.TOKEN.finditer(surface) if " " in surface.strip() or "/" in surface else ():
                name, _ = plain_lookup(m.group(), names)
                if name and len(m.group()) >= 2 and not plain_refusal(text, name, start + m.start(), start + m.end(), confirmed or []):
                    expected.append((name[0], name[1], m.group(), start + m.start(), start + m.end(), name[3], "CONTAINED_EXACT"))
        some += len(expected)
        assert sorted(found.get(i, [])) == sorted(expected), (text, surface, found.get(i), expected)
    assert some > 30


def test_policies(spark):
    rows = [
        ("a", "Python", ["py"], 1, False, False, True, "LANG", "SAFE"), ("b", "Obscure", None, 1, None, None, True, "OTHER_IT_TECH", "SAFE"), ("c", "Obscure", [], 2, None, None, True, "OTHER_IT_TECH", None),
        ("d", "Clear", [], 1, None, None, True, "SECURITY_TOOL", "SAFE"), ("e", "Clear", [], 2, None, None, True, "SECURITY_TOOL", "SAFE"), ("f", "Widgetry", ["ab"], 5, True, True, True, "DB", "SAFE"),
        ("g", "Widgetry", ["kit"], 5, True, True, True, "DB", "SAFE"), ("h", "Widgetry", [], 1, None, True, True, "OTHER_IT_TECH", "SAFE"), ("i", "Python", [], 9, True, True, None, "LANG", "SAFE"), ("j", "Any", ["Docker", None], 1, None, None, True, "X", "SAFE"),
        ("a", "Python", ["py"], 1, False, False, True, "LANG", "SAFE"),
    ]
    lexicon = spark.createDataFrame(rows, "tech_id string, canonical string, aliases array<string>, source_count int, hot boolean, demand boolean, any_it boolean, category string, policy string")
    lemmas = spark.createDataFrame([(w,) for w in LEMMAS], "lemma string")
    found = sorted((r.tech_id, r.recommended_policy) for r in P.assign(lexicon, lemmas, "lemma").collect())
    need, off = "CONTEXT_REQUIRED", "DISABLED_BY_DEFAULT"
    assert found == sorted([("a", "SAFE"), ("a", "SAFE"), ("b", need), ("c", "SAFE"), ("d", off), ("e", need), ("f", need), ("g", need), ("h", "SAFE"), ("i", off), ("j", "SAFE")])
    audit = sorted((r.tech_id, r.alias, r.policy, r.recommended_policy) for r in P.collisions(lexicon, lemmas, "lemma").collect())
    assert audit == [("d", "Clear", "SAFE", off), ("e", "Clear", "SAFE", need), ("g", "kit", "SAFE", need)]
    generic = spark.createDataFrame([("make", "Makefile"), ("Make", "make"), ("make", "Automake"), ("other", "x")], "a string, c string")
    from pyspark.sql import functions as F

    assert [r.g for r in generic.select(P.generic_alias(F.col("a"), F.col("c")).alias("g")).collect()] == [False, False, True, False]


def test_mentions(spark):
    rng = random.Random(7)
    names = [(1, "c++"), (2, ".net"), (3, "red fox"), (4, "Fox"), (5, "a.b(c)"), (6, "++"), (7, None), (8, "été"), (9, "fox fox")]
    pieces = ["C++", ".NET", "x.net", "red fox", "Red  Fox", "fox", "foxes", "a.b(c)", "A.B(C)d", "++", "Été", "fox fox fox", "c++11", "#fox", "."]
    texts = [(i, "".join(rng.choice(pieces) + rng.choice([" ", "", "\n", ",", "."]) for _ in range(rng.randrange(12)))) for i in range(300)] + [(900, None), (None, "fox"), (901, ""), (902, "red fox"), (902, "red fox")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "id long, body string, name string")
    found = sorted((str(r.id), r.k, r.surface, r.start, r.end) for r in mentions(df, "id", "body", spark.createDataFrame(names, "k int, name string"), "name").collect())
    expected = []
    for i, t in texts:
        for k, n in names:
            if n and re.search(r"\w", n):
                expected += [(str(i), k, m.group(), m.start(), m.end()) for m in re.finditer(rf"(?<![\w+#.]){re.escape(n)}(?![\w+#])", t or "", re.I)]
    assert found == sorted(expected) and len(expected) > 300


def test_pieces_bound_what_is_held():
    from rowloom.operators.technologies import pieces

    assert list(pieces([3, 3, 3, 20, 1, 0], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(pieces([], 6)) == [] and list(pieces([9], 6)) == [(0, 1)]
