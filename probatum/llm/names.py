"""Variant spellings of the names of people and institutions, linked to the entity they mean.

Every distinct spelling is read into an anchor token (family name; place of an institution), the letters
of its other tokens, and those tokens. Spellings with one anchor and one letter form a node, so no group
is ever paired with itself. Anchors at small edit distance meet in a symmetric-delete index; two nodes
that meet, by their anchors or by given names beside one anchor, are linked where an optimal assignment of their tokens, permitting initials, abbreviations,
nicknames and small edits, leaves no contradiction. Nodes that hold contradicting full given names or
middle initials are divided first. Entities are the connected components.

Null and blank names, and names without a letter, belong to no entity. Repeated names count once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow
from probatum.operators.graph import components
from probatum.operators.packed import CONNECTORS, PARTICLES, TITLES
from probatum.session import checkpointed

#: A given name makes up at least this share of the names written with a comma, so there are at most 1 / GIVEN_SHARE.
GIVEN_SHARE = 5e-4
GIVEN_COUNT = 3
#: A given name whose first letter differs is a misspelling where its spellings are at most a third of the other's.
RARE = 3
#: Shortest anchor, and shortest given name in its first letter, that may differ by an edit.
ANCHOR_LENGTH = 5

# Short forms of given names, each with the names it stands for.
NICKNAMES = {
    nick: full.split()
    for nick, full in (
        line.split(": ")
        for line in """
alex: alexander
andy: andrew
bas: sebastian
becky: rebecca
ben: benjamin
beppe: giuseppe
beth: elizabeth
betty: elizabeth
bill: william
bob: robert
charlie: charles
chris: christopher
chuck: charles
dan: daniel
dick: richard
dima: dmitri
dot: dorothy
drew: andrew
ed: edward
fred: frederick friederike
gabi: gabriela
greg: gregory
hanna: johanna
harry: harold
iggy: ignatius
jim: james
joe: joseph
kate: katherine
kathy: katherine
katya: ekaterina
leo: leonardo
liv: olivia
liz: elizabeth
lucy: lucinda
maggie: margaret
mike: michael
mina: wilhelmina
misha: mikhail
nat: nathaniel
nick: nicholas
paco: francisco
pat: patricia
peggy: margaret
penny: penelope
pippa: philippa
quin: quentin
rick: richard
rike: friederike
rob: robert
sam: samantha samuel
sasha: alexander
sue: susan
ted: edward theodore
theo: theodore
tim: timothy
tina: valentina
tom: thomas
trish: patricia
uli: ulrich
vera: veronika
vicky: victoria
waldo: oswaldo
will: william
xavi: xaveria
yoli: yolanda
zack: zachary
""".strip().splitlines()
    )
}

# Letters that do not decompose, and what TeX calls them.
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th", "’": "'"})
_TEX_LETTERS = {"o": "o", "l": "l", "aa": "a", "ae": "ae", "oe": "oe", "ss": "ss", "i": "i", "j": "j", "O": "O", "L": "L", "AA": "A", "AE": "AE"}
_TEX_NAMED = re.compile(r"\\(o|l|aa|ae|oe|ss|i|j|O|L|AA|AE)(?![A-Za-z])\s*(?:\{\})?")
_TEX_ACCENT = re.compile(r"\\(?:[\"'`^~=.]|[uvHtcdbkr](?=[\s{]))\s*\{?(\\?[A-Za-z])\}?")
_GLUED = re.compile(r"^((?:" + "|".join(PARTICLES) + r")+)([A-Z].*)$")
_TOKEN = re.compile(r"[^\W\d_]+(?:['\-][^\W\d_]+)*\.?(?:-?[^\W\d_]\.)*")
_PAREN = re.compile(r"\([^()]*\)")
_DOTTED = re.compile(r"(?:[^\W\d_]\.-?)+[^\W\d_]?\.?")


def plain(text: str) -> str:
    """text without TeX and accents; letter case kept."""
    if "\\" in text:
        text = _TEX_ACCENT.sub(lambda m: m[1].lstrip("\\"), text)
        text = _TEX_NAMED.sub(lambda m: _TEX_LETTERS[m[1]], text)
    text = text.replace("{", "").replace("}", "").replace("\\&", "&").replace("~", " ")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions, or most + 1 where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # A letter that the other lacks costs an edit, so most pairs of unlike words end here.
    letters, others = set(a), set(b)
    if len(letters - others) > most or len(others - letters) > most:
        return most + 1
    # What both begin and end with costs nothing.
    start, short = 0, min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    end = 0
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) <= 1 and len(b) <= 1:
        return 1
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletes(token: str) -> set[str]:
    return {token[:i] + token[i + 1 :] for i in range(len(token))} | {token}


class GivenNames:
    """Known given names with their delete neighbourhood, so that a misspelt one is recognised."""

    def __init__(self, known: set[str]):
        self.known = known | set(NICKNAMES) | {f for fulls in NICKNAMES.values() for f in fulls}
        self.near: dict[str, set[str]] = {}
        for name in self.known:
            if len(name) >= 4:
                for d in deletes(name):
                    self.near.setdefault(d, set()).add(name)

    @lru_cache(maxsize=200_000)  # noqa: B019
    def canonical(self, token: str) -> str | None:
        """The full given name that token means, None where none is known."""
        if token in self.known:
            return NICKNAMES.get(token, [token])[0]
        if len(token) < 4:
            return None
        found = {n for d in deletes(token) for n in self.near.get(d, ()) if edits(token, n, 1) == 1}
        fulls = {NICKNAMES.get(n, [n])[0] for n in found}
        return fulls.pop() if len(fulls) == 1 else None


def _initials(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalpha())


def read_name(name: str | None, given: GivenNames) -> tuple[str, str, str, str, str, list[str]] | None:
    """(kind, anchor, letters, full given name, middle initials, other tokens); kind p person, o institution."""
    if not name:
        return None
    text = _PAREN.sub(" ", plain(name))
    parts = [p for p in (x.strip() for x in text.split(",")) if p]
    if not parts:
        return None
    tokens = [[t for t in _TOKEN.findall(_unglue(p)) if t.lower().rstrip(".") not in TITLES] for p in parts]
    tokens = [t for t in tokens if t]
    if not tokens:
        return None
    if _is_institution(tokens, text):
        return _institution(tokens)
    if len(tokens) == 1 and len(tokens[0]) == 2 and re.fullmatch(r"[A-Z]{2,6}", tokens[0][0]) and not re.fullmatch(r"[A-Z]+", tokens[0][1]):
        acronym, place = tokens[0]
        return "o", place.lower(), "".join(sorted(acronym.lower())), "", "", []
    family, rest = _person(tokens, given)
    if not family:
        return None
    anchor = re.sub(r"[^a-z]|\W", "", "".join(family).lower()) or "".join(family).lower()
    full, letters = "", ""
    for t in rest:
        low = t.lower().rstrip(".")
        if _is_initial(t):
            letters += _initials(t)
        else:
            if not full:
                full = given.canonical(low) or low
                letters += full[0]
            else:
                letters += low[0]
    return "p", anchor, letters[:1], full, letters[1:], [x.lower() for x in rest]


def _unglue(part: str) -> str:
    return " ".join(m[2] if (m := _GLUED.match(w)) else w for w in part.split())


def _is_initial(token: str) -> bool:
    return bool(_DOTTED.fullmatch(token)) or len(token) == 1 or bool(re.fullmatch(r"[A-Z]{2,3}", token))


def _is_institution(tokens: list[list[str]], text: str) -> bool:
    words = [t for p in tokens for t in p]
    if any(t.lower() in CONNECTORS or t.lower() == "and" for t in words) or "&" in text:
        return True
    if any(t.endswith(".") and not _DOTTED.fullmatch(t) and len(t) > 3 and t[0].isupper() for t in words):
        return True
    core = [t for t in tokens[0] if t.lower() not in PARTICLES]
    return len(tokens) > 1 and len(core) > 1 and not any(_is_initial(t) for t in core)


def _institution(tokens: list[list[str]]) -> tuple[str, str, str, str, str, list[str]]:
    skip = {*CONNECTORS, "and"}
    words = [t for t in tokens[0] if t.lower() not in skip]
    if len(tokens) > 1:
        place, others = tokens[-1][-1], words + [t for p in tokens[1:-1] for t in p]
    else:
        place, others = (words or tokens[0])[0], words[1:]
    others = [t.lower().rstrip(".") for t in others]
    return "o", place.lower().rstrip("."), "".join(sorted(t[0] for t in others)), "", "", others


def _person(tokens: list[list[str]], given: GivenNames) -> tuple[list[str], list[str]]:
    is_particle = lambda t: t.lower() in PARTICLES
    if len(tokens) > 1:
        family = [t for t in tokens[0] if not is_particle(t)] or tokens[0]
        return family, [t for p in tokens[1:] for t in p if not is_particle(t)]
    words = tokens[0]
    if len(words) == 1:
        return words, []
    initial = [i for i, t in enumerate(words) if _is_initial(t)]
    particle = [i for i, t in enumerate(words) if is_particle(t) and i + 1 < len(words)]
    if particle and particle[0] > 0:
        after = [t for t in words[particle[0] :] if not is_particle(t)]
        k = next((i for i, t in enumerate(after) if _is_initial(t)), len(after))
        return after[:k], words[: particle[0]] + after[k:]
    if particle:
        after = [t for t in words if not is_particle(t)]
        return after[:1], after[1:]
    if initial:
        after = words[initial[-1] + 1 :]
        if after:
            return after, words[: initial[-1] + 1]
        before = words[: initial[0]]
        if not before:  # initials alone
            return ["".join(words)], []
        if len(before) == 1:
            return before, words[1:]
        if given.canonical(before[0].lower()) and not given.canonical(before[-1].lower()):
            return before[-1:], before[:-1] + words[initial[0] :]
        return before[:1], before[1:] + words[initial[0] :]
    first, last = given.canonical(words[0].lower()), given.canonical(words[-1].lower())
    if last and not first:
        return words[:-1] if len(words) > 2 else words[:1], words[-1:]
    if first and len(words) > 2:
        # The words after the given names are a family name of several parts.
        k = 1
        while k < len(words) - 1 and given.canonical(words[k].lower()):
            k += 1
        return words[k:], words[:k]
    return words[-1:], words[:-1]


def token_cost(a: str, b: str) -> float:
    """0 where two tokens are the same, below 1 where one may stand for the other, else 2."""
    if a == b:
        return 0.0
    short, long = sorted((a.rstrip("."), b.rstrip(".")), key=len)
    if short == long:
        return 0.0
    if not short:
        return 2.0
    if len(short) == 1:
        return 0.2 if long[0] == short else 2.0
    if long in NICKNAMES.get(short, ()) or short in NICKNAMES.get(long, ()):
        return 0.1
    if len(long) >= 4 and edits(short, long, 1) == 1:
        return 0.3
    if len(long) >= 8 and edits(short, long, 2) == 2:
        return 0.6
    letters = iter(long)
    if len(short) >= 2 and short[0] == long[0] and all(c in letters for c in short) and len(short) <= 0.7 * len(long):
        return 0.4
    return 2.0


def assignment_cost(a: list[str], b: list[str]) -> float:
    """Least total cost of assigning each token of the shorter list to its own token of the longer, whatever their number.

    Shortest augmenting paths with potentials, a row at a time.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    costs = [[token_cost(x, y) for y in b] for x in a]
    if len(a) == 1:
        return min(costs[0])
    rows, cols = len(a), len(b)
    row_price, col_price = [0.0] * (rows + 1), [0.0] * (cols + 1)
    taken, came = [0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        taken[0], at = i, 0
        least, seen = [float("inf")] * (cols + 1), [False] * (cols + 1)
        while taken[at]:
            seen[at] = True
            row, step, nxt = taken[at], float("inf"), 0
            for j in range(1, cols + 1):
                if seen[j]:
                    continue
                slack = costs[row - 1][j - 1] - row_price[row] - col_price[j]
                if slack < least[j]:
                    least[j], came[j] = slack, at
                if least[j] < step:
                    step, nxt = least[j], j
            for j in range(cols + 1):
                if seen[j]:
                    row_price[taken[j]] += step
                    col_price[j] -= step
                else:
                    least[j] -= step
            at = nxt
        while at:
            taken[at], at = taken[came[at]], came[at]
    return sum(costs[taken[j] - 1][j - 1] for j in range(1, cols + 1) if taken[j])


_PARSED = "struct<kind:string,anchor:string,letters:string,full:string,mid:string,others:array<string>>"


def _reader(given: GivenNames):
    @arrow(_PARSED)
    def read(names: pd.Series) -> pd.DataFrame:
        rows = [read_name(n, given) or (None,) * 6 for n in names]
        return pd.DataFrame(rows, columns=["kind", "anchor", "letters", "full", "mid", "others"])

    return read


@arrow("double")
def _cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([assignment_cost(list(x), list(y)) for x, y in zip(a, b)])


@arrow("int")
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y, 1) for x, y in zip(a, b)])


def known_given(names: DataFrame) -> GivenNames:
    """Given names frequent after a comma; their number is bounded by the least share."""
    after = names.select(F.lower(F.regexp_extract("name", r"^[^,]*,\s*(?:Dr\.\s*)?(\p{L}{3,})(?:\s+(?:\p{L}\.?\s*)*)?$", 1)).alias("g")).filter("g <> ''")
    counts = checkpointed(after.groupBy("g").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.filter(F.col("count") >= max(GIVEN_COUNT, GIVEN_SHARE * total)).collect()
    return GivenNames({plain(r["g"]) for r in rows})


def _divide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers the entities within one node: signatures that contradict each other are parted.

    Signatures with most spellings seed entities; a signature joins the first entity, by size, whose full
    name and middle initials it does not contradict.
    """
    pdf = pdf.sort_values(["n", "full", "mid"], ascending=[False, True, True], kind="stable")
    pdf = pd.concat([pdf[(pdf.full != "") & (pdf.mid != "")], pdf[(pdf.full != "") & (pdf.mid == "")], pdf[pdf.full == ""]])
    seeds: list[list[str]] = []
    out = []
    for full, mid in zip(pdf.full, pdf.mid):
        for k, (f, m) in enumerate(seeds):
            if (not full or not f or token_cost(full, f) < 1) and (not mid or not m or mid[0] == m[0]):
                seeds[k] = [f or full, m or mid]
                out.append(k)
                break
        else:
            seeds.append([full, mid])
            out.append(len(seeds) - 1)
    return pdf.assign(part=out)[["kind", "anchor", "letters", "full", "mid", "part"]]


def name_entities(names: DataFrame) -> DataFrame:
    """(name, entity) of each distinct spelling in names(name) that names an entity."""
    names = checkpointed(names.select("name").filter(F.trim("name") != "").distinct())
    read = _reader(known_given(names))
    parsed = checkpointed(names.withColumn("r", read("name")).select("name", "r.*").filter("anchor is not null"))
    node = ["kind", "anchor", "letters"]

    signatures = parsed.groupBy(*node, "full", "mid").agg(F.count("*").alias("n"), F.first("others").alias("others"))
    mixed = (
        signatures.groupBy(*node)
        .agg(F.countDistinct(F.nullif("full", F.lit(""))).alias("nf"), F.countDistinct(F.nullif("mid", F.lit(""))).alias("nm"))
        .filter("kind = 'p' and (nf > 1 or nm > 1)")
        .select(*node)
    )
    parts = (
        signatures.join(mixed, node)
        .groupBy(*node)
        .applyInPandas(_divide, "kind string, anchor string, letters string, full string, mid string, part int")
    )
    key = F.concat_ws("|", "kind", "anchor", "letters", F.coalesce("part", F.lit(0)).cast("string"))
    placed = checkpointed(parsed.join(parts, [*node, "full", "mid"], "left").withColumn("node", key))

    # One token list per node: the anchor with the longest full name and the middle initials it has.
    nodes = checkpointed(
        placed.groupBy("node", "kind", "anchor", "letters").agg(
            F.count("*").alias("n"), F.max("full").alias("full"), F.max("mid").alias("mid"), F.max_by("others", F.struct(F.size("others"), "name")).alias("others")
        )
    )
    tokens = F.when(
        F.col("kind") == "p", F.filter(F.array(F.when(F.col("full") != "", F.col("full")).otherwise(F.col("letters")), F.substring("mid", 1, 1)), lambda t: t != "")
    ).otherwise(F.col("others"))
    nodes = nodes.withColumn("tokens", tokens)

    anchors = nodes.filter(F.length("anchor") >= ANCHOR_LENGTH).select("kind", "anchor").distinct()
    dropped = F.expr("array_distinct(transform(sequence(0, length(anchor)), i -> concat(substring(anchor, 1, i), substring(anchor, i + 2))))")
    index = anchors.select("kind", "anchor", F.explode(dropped).alias("d")).select("kind", "anchor", F.xxhash64("kind", "d").alias("d"))
    near = (
        index.join(index.select("d", F.col("anchor").alias("other"), F.col("kind").alias("k2")), "d")
        .filter("kind = k2 and anchor < other")
        .select("kind", "anchor", "other")
        .distinct()
        .filter(_edits("anchor", "other") <= 1)
    )
    left = nodes.select("kind", "letters", "anchor", F.col("node").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    right = nodes.select("kind", "letters", F.col("anchor").alias("other"), F.col("node").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    met = near.join(left, ["kind", "anchor"]).join(right, ["kind", "other", "letters"]).filter("letters <> ''").select("a", "b", "anchor", "other", "ta", "tb", "na", "nb")
    # The other tokens are in the index too, beside their anchor: a first letter may be the one that is misspelt.
    # Only the deletes of the first letters are wanted: names that differ further on have one first letter and one node.
    full = F.array_distinct(F.array(F.col("full"), F.expr("substring(full, 2)"), F.expr("concat(substring(full, 1, 1), substring(full, 3))")))
    given = nodes.filter((F.col("kind") == "p") & (F.length("full") >= ANCHOR_LENGTH)).select("node", "anchor", "letters", "full", "tokens", "n", F.explode(full).alias("d")).withColumn("d", F.xxhash64("anchor", "d"))
    misspelt = (
        given.select("d", F.col("node").alias("a"), "anchor", F.col("letters").alias("la"), F.col("full").alias("fa"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
        .join(given.select("d", F.col("node").alias("b"), F.col("anchor").alias("other"), F.col("letters").alias("lb"), F.col("full").alias("fb"), F.col("tokens").alias("tb"), F.col("n").alias("nb")), "d")
        .filter("anchor = other and la <> lb and a < b")
        .dropDuplicates(["a", "b"])
        .filter(_edits("fa", "fb") <= 1)
        .filter(F.least("na", "nb") * RARE <= F.greatest("na", "nb"))
    )
    met = met.unionByName(misspelt.select("a", "b", "anchor", "other", "ta", "tb", "na", "nb"))
    met = met.withColumn("cost", _cost("ta", "tb"))
    met = checkpointed(met.filter(F.col("cost") < F.greatest(F.lit(1.0), F.least(F.size("ta"), F.size("tb")) * 0.4)))
    # A node links to one node of another anchor, its nearest, so that it cannot bridge parted entities.
    first_b = met.groupBy("a", "other").agg(F.min_by("b", F.struct("cost", -F.col("nb"), "b")).alias("b"))
    first_a = met.groupBy("b", "anchor").agg(F.min_by("a", F.struct("cost", -F.col("na"), "a")).alias("a"))
    edges = first_b.select("a", "b").intersect(first_a.select("a", "b"))
    roots = components(edges)
    return placed.join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("entity"))


def entity_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of different spellings of one entity, the smaller first."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def all_names(*columns: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, columns).distinct()
