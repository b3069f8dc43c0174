"""Text that reads the same in different characters: one consistent form of each.

The form: default-ignorable characters are dropped, blanks of every kind become a plain blank,
compatibility characters that only differ in width or joining become plain ones, letters of another
script that stand in a word with Latin letters for look-alikes of them become those (a word of look-alikes alone only
among Latin words: НАТО beside other Cyrillic words is a word), and the rest is composed
(an accented letter is one character). Raised digits, symbols and words that really are in another
script stay. The comparison key is the fully case-folded form with runs of blanks joined.

Work is done per distinct value of an Arrow batch; values of plain ASCII never leave the JVM.
Nulls stay null and are never in need of change; empty texts are their own form.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow

# Ranges of default-ignorable code points (Unicode property), variation selectors and tags included.
IGNORABLE = (
    "­͏؜ᅟ-ᅠ឴-឵᠋-᠏​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
# Letters of other scripts that are drawn as a Latin letter.
LOOKALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϲϳ" + "\u2010\u2011",
        "ABESIJKMHOPCTYXaeopcyxsijhdqwl" + "ABEZHIKMNOPTYXovicj" + "--",
        strict=True,
    )
)
# Letters drawn as a Latin one that also stand alone as symbols, so that only a word with Latin letters changes them.
IN_LATIN = {"ρ": "p"}
_MIXED_LIKE = frozenset(IN_LATIN)
_LETTERS_LIKE = "".join(c for c in LOOKALIKE if c.isalpha())
_IGNORED = re.compile(f"[{IGNORABLE}]+")
# A word that holds a letter of another script; marks may stand between its letters.
_MARKED = r"(?:[^\W\d_]|[\u0300-\u036f])"
_WORD = re.compile(rf"(?<![^\W\d_])[A-Za-z\u00c0-\u024f\u0300-\u036f]*[\u0370-\u052f]{_MARKED}*")
_LIKE = re.compile(f"[{_LETTERS_LIKE}]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")

#: What a value must hold for its form to differ, as a pattern of the JVM: anything beyond printable ASCII and line ends.
BEYOND_ASCII = r"[^\n\r\x20-\x7e]"


@lru_cache(maxsize=1)
def _plain() -> dict[int, str]:
    """Characters with a plainer form, by rule: wide, narrow, no-break and font variants, and joined Latin letters."""
    table: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1 if sys.maxunicode < 0x20000 else 0x1F000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Zs", "Zl", "Zp"):
            table[code] = " "
            continue
        d = unicodedata.decomposition(c)
        if not d.startswith("<"):
            continue
        tag = d.split()[0]
        full = unicodedata.normalize("NFKC", c)
        if tag in ("<wide>", "<narrow>", "<noBreak>", "<font>") or (tag == "<compat>" and "LIGATURE" in unicodedata.name(c, "")):
            table[code] = full
    table[ord("\t")] = " "
    table[0x2010] = table[0x2011] = "-"
    return table


@lru_cache(maxsize=1)
def _plain_characters() -> frozenset[str]:
    return frozenset(map(chr, _plain()))


_NEIGHBOUR_BEFORE, _NEIGHBOUR_AFTER = re.compile(r"([^\W\d_]+)[\W\d_]*\Z"), re.compile(r"[\W\d_]*([^\W\d_]+)")
#: How far the words beside a word are looked for.
BESIDE = 60


def _among_latin(m: re.Match) -> bool:
    """Whether the words beside a word are Latin: a word of look-alikes alone may be a real one. With none beside it a letter counts, a word does not."""
    text = m.string
    before = _NEIGHBOUR_BEFORE.search(text, max(0, m.start() - BESIDE), m.start())
    after = _NEIGHBOUR_AFTER.match(text, m.end(), m.end() + BESIDE)
    beside = [x[1] for x in (before, after) if x]
    return all(_LATIN.search(w) for w in beside) if beside else sum(c.isalpha() for c in m[0]) == 1


def _latin_word(m: re.Match) -> str:
    word = m[0]
    mixed = any(_LATIN.match(c) for c in word)
    if mixed and not _MIXED_LIKE.isdisjoint(word):
        return "".join(LOOKALIKE.get(c) or IN_LATIN.get(c, c) for c in word)
    if not _LIKE.search(word):
        return word
    if mixed or (all(c in LOOKALIKE for c in word if c.isalpha()) and _among_latin(m)):
        return "".join(LOOKALIKE.get(c, c) for c in word)
    return word


def consistent_form(text: str) -> str:
    """The one form of text; equal to text exactly where nothing has to change."""
    if text.isascii() and "\t" not in text:
        return text
    out = _IGNORED.sub("", text)
    if not _plain_characters().isdisjoint(out):
        out = out.translate(_plain())
    if _LIKE.search(out) or not _MIXED_LIKE.isdisjoint(out):
        out = _WORD.sub(_latin_word, out)
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def comparison_key(text: str) -> str:
    """The form under full case folding, composed again, with blanks joined and none at the ends."""
    return " ".join(unicodedata.normalize("NFC", consistent_form(text).casefold()).split())


def _per_distinct(texts: pd.Series, f) -> pd.Series:
    known: dict[str, object] = {}

    def one(t):
        if t is None:
            return None
        if t not in known:
            known[t] = f(t)
        return known[t]

    return texts.map(one)


@arrow("string")
def _form(texts: pd.Series) -> pd.Series:
    return _per_distinct(texts, consistent_form)


@arrow("string")
def _key(texts: pd.Series) -> pd.Series:
    return _per_distinct(texts, comparison_key)


@arrow("boolean")
def _differs(texts: pd.Series) -> pd.Series:
    return _per_distinct(texts, lambda t: consistent_form(t) != t)


def changed_rows(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The kept columns of the rows whose text is not in the consistent form.

    Only texts with a character beyond ASCII go to Python; the others are in the form already.
    """
    beyond = df.filter(F.col(text).rlike(BEYOND_ASCII)).select(*keep, F.col(text).alias("_text"))
    return beyond.filter(_differs("_text")).drop("_text")


def with_forms(df: DataFrame, text: str) -> DataFrame:
    """df with `form`, `match_key` and `changed` of the text column, all rows kept.

    ASCII texts get form and key from built-in expressions, the others from Python.
    """
    plain = ~F.col(text).rlike(BEYOND_ASCII)
    hard = F.when(~plain, F.col(text))
    form = F.coalesce(_form(hard), F.col(text))
    key = F.when(plain, F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))).otherwise(_key(hard))
    return df.withColumn("form", form).withColumn("match_key", key).withColumn("changed", F.col("form") != F.col(text))
