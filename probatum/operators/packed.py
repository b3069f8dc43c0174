"""Several values packed in one field: one row per value, with its position.

A field's text becomes a delimiter skeleton: every ordinary word is masked by the letter of its
class, delimiters stay. Splitting rules are worked out once per distinct skeleton, brought back to
the rows (broadcast where their measured size allows, else by a shuffle join) and applied as
positional extraction on the original text.

Null, empty or unreadable blocks give no row. Fields may stand in any order and letter case; a field
named twice in a block is split twice. Rows are treated alike whatever their number or length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow
from probatum.session import broadcast_if_small, checkpointed, spread

PERSON_FIELDS = ("author", "editor")
WORD_FIELDS = ("keywords",)

# Lower-case parts of family names, connecting words of institutions, titles before names.
PARTICLES = "von van der den de del della di da dos du la le ten ter zu zum zur af av".split()
CONNECTORS = "for of the in on at to".split()
TITLES = "dr prof mr mrs ms sir".split()

_NAME = re.compile(r"[\s,]*([A-Za-z][\w\-]*)\s*=\s*")
_BARE = re.compile(r"[^,}\n]*")
_WORD = re.compile(r"[^\s,;|&/·•{}\"]+")
_INITIALS = re.compile(r"(?:[^\W\d_]\.-?)+|(?:[^\W\d_]\.)*[^\W\d_]\.?")
_ACRONYM = re.compile(r"[^\W\d_a-z]{1,3}")


def _closing(text: str, at: int) -> int:
    """Index of the brace or quote that closes the one at `at`; the end of text where none does."""
    depth, quote = 0, text[at] == '"'
    i = at + quote
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if quote and c == '"' and depth == 0:
            return i
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and not quote:
                return i
        i += 1
    return len(text)


def block_fields(text: str | None) -> Iterator[tuple[str, str]]:
    """(name in lower case, value without its outer delimiters) of each field of a bibliography block."""
    if not text:
        return
    at = text.find(",", max(text.find("{"), 0)) + 1
    while at and (m := _NAME.match(text, at)) and m.end() < len(text):
        at = m.end()
        if text[at] in '{"':
            end = _closing(text, at)
            yield m[1].lower(), text[at + 1 : end]
            at = end + 1
        else:
            bare = _BARE.match(text, at)
            yield m[1].lower(), bare[0].strip()
            at = max(bare.end(), at)


def _person_class(word: str) -> str:
    low = word.lower()
    if low == "and":
        return "a"
    if low in ("others", "al", "al.", "etc", "etc."):
        return "o"
    if low == "et":
        return "e"
    if low.rstrip(".") in TITLES:
        return "t"
    if word in PARTICLES:
        return "p"
    if word in CONNECTORS:
        return "l"
    if "." in word and _INITIALS.fullmatch(word):
        return "I"
    if _ACRONYM.fullmatch(word):
        return "i"
    return "W"


def skeleton(value: str, persons: bool) -> tuple[str, list[int]]:
    """One letter per token of value, and the start and end of each token, flat.

    Words are masked; braces and double quotes protect what they hold (G); a group that touches a
    word belongs to it. Blanks are dropped except around a slash and for line breaks (n).
    """
    out: list[str] = []
    at: list[int] = []
    i, n = 0, len(value)
    while i < n:
        c = value[i]
        start = i
        if c in "\n\r":
            i += 1
            kind = "n"
        elif c.isspace():
            i += 1
            continue
        elif c in ",;|·•":
            i += 1
            kind = ";" if c in "·•" else c
        elif c == "&" or (c == "\\" and value[i + 1 : i + 2] == "&"):
            i += 1 if c == "&" else 2
            if not persons:
                kind = "W"
            else:
                kind = "&"
        elif c == "/" and (value[i - 1 : i].isspace() or value[i + 1 : i + 2].isspace() or i == 0 or i + 1 == n):
            i += 1
            kind = "/"
        else:
            grouped = False
            while i < n:
                d = value[i]
                if d == "\\" and value[i + 1 : i + 2] != "&":
                    i += 2
                elif d == "{" or (d == '"' and i == start):
                    grouped = True
                    i = _closing(value, i) + 1
                elif d.isspace() or d in ",;|·•&" or (d == "\\"):
                    break
                elif d == "/" and (value[i - 1 : i].isspace() or value[i + 1 : i + 2].isspace() or i + 1 == n):
                    break
                else:
                    i += 1
            i = min(i, n)
            word = value[start:i]
            if len(word) > 1 and not word.strip(".") or word == "…":
                kind = "o"
            elif grouped and word[0] in '{"' and _closing(word, 0) == len(word) - 1:
                kind = "G"
            else:
                kind = _person_class(word) if persons else "W"
        if kind == "W" and out and out[-1] == "W" and not persons:
            at[-1] = i
            continue
        out.append(kind)
        at += [start, i]
    return "".join(out), at


_FULL_NAME = re.compile(r"[tp]*(?:W[WIipt]*W|[Iip]+W[WIi]*|W[p]*i+|[WIi]*p+W|.*G.*|.*l.*)[p]*")
_FAMILY = re.compile(r"[tp]*W")
_GIVEN = re.compile(r"t?[WIi]+[p]*")
_PLACE = re.compile(r"[Wp]+")


def _comma_parts(parts: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Comma-separated parts of one segment joined to values: a family name takes the given names after it."""
    out, k = [], 0
    while k < len(parts):
        s, e, kinds = parts[k]
        follower = parts[k + 1] if k + 1 < len(parts) else None
        if follower and _FAMILY.fullmatch(kinds) and _GIVEN.fullmatch(follower[2]):
            out.append((s, follower[1], "F"))
            k += 2
        elif follower and "l" in kinds and "G" not in kinds and _PLACE.fullmatch(follower[2]) and len(follower[2]) == 1:
            out.append((s, follower[1], "F"))
            k += 2
        else:
            out.append((s, e, kinds))
            k += 1
    return out


def _runs(kinds: str, lo: int, hi: int, cuts: str) -> list[tuple[int, int, str]]:
    """(first token, last token, kinds without line breaks) of the non-empty runs between tokens in cuts."""
    out, start = [], lo
    for i in range(lo, hi + 1):
        if i == hi or kinds[i] in cuts:
            s, e = start, i
            while s < e and kinds[s] == "n":
                s += 1
            while e > s and kinds[e - 1] == "n":
                e -= 1
            if e > s:
                out.append((s, e - 1, kinds[s:e].replace("n", "")))
            start = i + 1
    return out


def _without_rest(run: tuple[int, int, str], kinds: str) -> tuple[int, int, str] | None:
    """The run without a mark of an unfinished list at its end."""
    s, e, k = run
    while True:
        while e >= s and kinds[e] in "n,":
            e -= 1
        if e > s and kinds[e] == "o" and kinds[e - 1] == "e":
            e -= 2
        elif e == s and kinds[e] == "o":
            e -= 1
        else:
            break
    return (s, e, kinds[s : e + 1].replace("n", "")) if e >= s else None


def resolve(kinds: str, persons: bool) -> list[int]:
    """First and last token of each value of a skeleton, flat."""
    if not persons:
        cuts = ",;|/" if re.search(r"[,;|/]", kinds) else "n"
        return [x for s, e, k in _runs(kinds, 0, len(kinds), cuts) if k.strip("o") for x in (s, e)]
    hard = bool(re.search(r"[;|&/]|a(?!n*o)", kinds))
    cuts = "a;|&/"
    segments = [x for r in _runs(kinds, 0, len(kinds), cuts) if (x := _without_rest(r, kinds))]
    if not hard and len(segments) == 1 and "n" in kinds[segments[0][0] : segments[0][1] + 1]:
        s, e, _ = segments[0]
        lines = [_comma_parts(_runs(kinds, a, b + 1, ",")) for a, b, _ in _runs(kinds, s, e + 1, "n")]
        if all(len(x) == 1 and (x[0][2] == "F" or _FULL_NAME.fullmatch(x[0][2])) for x in lines):
            return [v for x in lines for v in x[0][:2]]
    out: list[int] = []
    for s, e, _ in segments:
        for a, b, _ in _comma_parts(_runs(kinds, s, e + 1, ",")):
            out += [a, b]
    return out


_FIELDS = "array<struct<field_name:string,val:string,kinds:string,at:array<int>>>"


@arrow(_FIELDS)
def _fields_udf(texts: pd.Series) -> pd.Series:
    wanted = set(PERSON_FIELDS + WORD_FIELDS)
    known: dict[str | None, list] = {}

    def one(text: str | None) -> list:
        if text not in known:
            known[text] = [
                {"field_name": name, "val": val, "kinds": (sk := skeleton(val, name in PERSON_FIELDS))[0], "at": sk[1]}
                for name, val in block_fields(text)
                if name in wanted
            ]
        return known[text]

    return texts.map(one)


@arrow("array<int>")
def _resolve_udf(persons: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([resolve(k, p) for p, k in zip(persons, kinds)])


def packed_values(entries: DataFrame, keep_single: bool = False) -> DataFrame:
    """(entry_id, field_name, pos, val, n_values) of author, editor and keywords fields of entries(entry_id, text).

    keep_single keeps the fields that hold one value; n_values tells how many a field holds.
    """
    rows = (
        spread(entries.select("entry_id", "text")).select("entry_id", F.explode(_fields_udf("text")).alias("f"))
        .select("entry_id", F.col("f.field_name"), F.col("f.val").alias("raw"), F.col("f.kinds"), F.col("f.at"))
        .withColumn("persons", F.col("field_name").isin(*PERSON_FIELDS))
    )
    rows = checkpointed(rows)
    rules = checkpointed(
        rows.select("persons", "kinds").distinct().withColumn("cuts", _resolve_udf("persons", "kinds"))
    )
    rules = broadcast_if_small(rules, F.length("kinds") + F.size("cuts") * 4)
    # A value that is one group loses its braces or quotes: its piece starts and ends a character further in.
    pieces = F.expr(
        """
        filter(transform(sequence(0, size(cuts) div 2 - 1), k -> trim(regexp_replace(
            substring(raw,
                at[cuts[2 * k] * 2] + 1 + int(cuts[2 * k] = cuts[2 * k + 1] and substring(kinds, cuts[2 * k] + 1, 1) = 'G'),
                at[cuts[2 * k + 1] * 2 + 1] - at[cuts[2 * k] * 2]
                    - 2 * int(cuts[2 * k] = cuts[2 * k + 1] and substring(kinds, cuts[2 * k] + 1, 1) = 'G')),
            '[\\\\s\\\\x{A0}]+', ' '))), v -> v <> '')
        """
    )
    least = 1 if keep_single else 2
    return (
        rows.join(rules, ["persons", "kinds"])
        .filter(F.size("cuts") > 0)
        .select("entry_id", "field_name", pieces.alias("vals"))
        .filter(F.size("vals") >= least)
        .select("entry_id", "field_name", F.size("vals").alias("n_values"), F.posexplode("vals").alias("pos", "val"))
        .withColumn("pos", (F.col("pos") + 1).cast("int"))
    )


def found_values(entries: DataFrame) -> DataFrame:
    """(entry_id, field_name, pos, val) of the fields that hold two values or more, distinct."""
    return packed_values(entries).select("entry_id", "field_name", "pos", "val").distinct()
