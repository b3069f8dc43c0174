import unicodedata

import pytest
from pyspark.sql import functions as F

from probatum.llm.visual import LOOKALIKE, changed_rows, comparison_key, consistent_form, with_forms

CASES = [
    ("plain text, 3 % of 7", None),
    ("", None),
    ("m² of wall, β-weight 5, μ-units, Δ is 2", None),
    ("beside таблица and μέτρο and 測定", None),
    ("naïve façade", None),
    ("line\nbreak", None),
    ("naïve", "naïve"),
    ("1­4", "14"),
    ("the  end", "the  end"),
    ("８９．９％", "89.9%"),
    ("conﬂict diﬀer", "conflict differ"),
    ("Тhе οne", "The one"),
    ("а", "a"),
    ("semi‐arid", "semi-arid"),
    ("café‍", "café"),
]


@pytest.mark.parametrize("text, form", CASES)
def test_form(text, form):
    assert consistent_form(text) == (text if form is None else form)
    assert consistent_form(consistent_form(text)) == consistent_form(text)


def test_lookalikes_are_letters_of_one_length():
    assert all(len(a) == len(b) == 1 and b.isascii() for a, b in LOOKALIKE.items())


def test_key_folds_case_fully():
    assert comparison_key(" Straße  NAÏVE ") == "strasse naïve"
    assert unicodedata.is_normalized("NFC", comparison_key("İ̇"))


def test_rows(spark):
    long = "word " * 50_000 + "é"
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(98, None, "x"), (99, long, "x"), (99, long, "x")]
    df = spark.createDataFrame(rows, "id long, text string, _text2 string")
    got = sorted(r["id"] for r in changed_rows(df, "text", F.col("id")).collect())
    assert got == [i for i, (t, f) in enumerate(CASES) if f is not None] + [99, 99]
    forms = {r["id"]: r for r in with_forms(df, "text").collect()}
    for i, (t, f) in enumerate(CASES):
        assert forms[i]["form"] == (t if f is None else f)
        assert forms[i]["match_key"] == comparison_key(t)
    assert forms[98]["form"] is None and forms[98]["match_key"] is None
    assert with_forms(df.limit(0), "text").count() == 0


@pytest.mark.parametrize(
    "text, form",
    [
        ("оса и сор а у нас", "оса и сор а у нас"),
        ("НАТО", "НАТО"),
        ("the НАТО treaty", "the HATO treaty"),
        ("ρaypal and ρ = 0.3", "paypal and ρ = 0.3"),
        ("ο λόγος", "ο λόγος"),
        ("а сold day", "a cold day"),
    ],
)
def test_real_words_of_other_scripts_stay(text, form):
    assert consistent_form(text) == form
