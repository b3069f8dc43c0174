import decimal
import fractions
import random

import pytest
from pyspark.sql import functions as F

from probatum.functions import exact, folds, numerals


def reference_agrees(stored, reported):
    """Half-even or, at an exact tie, either neighbour, by rounding."""
    s, r = decimal.Decimal(stored), decimal.Decimal(reported)
    q = decimal.Decimal(1).scaleb(r.as_tuple().exponent)
    decimal.getcontext().prec = 200
    return r in (s.quantize(q, decimal.ROUND_HALF_UP), s.quantize(q, decimal.ROUND_HALF_DOWN), s.quantize(q, decimal.ROUND_HALF_EVEN))


def test_agreement_is_rounding(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(400):
        s = f"{rng.choice(['', '-'])}{rng.randint(0, 99)}.{rng.choice(['5', '25', '125', str(rng.randint(0, 9999)).zfill(4)])}"
        p = rng.randint(0, 3)
        d = decimal.Decimal(s).quantize(decimal.Decimal(1).scaleb(-p)) + decimal.Decimal(rng.choice([-1, 0, 0, 1])).scaleb(-p)
        rows.append((s, str(d)))
    rows += [("4.25", "4.2"), ("4.25", "4.3"), ("4.25", "4.4"), ("0." + "1" * 60, "0.1"), ("1" * 50, "1" * 49 + "2"), ("12000", "1.2e4"), ("12499", "1.2e4"), ("12501", "1.2e4")]
    for _ in range(400):
        e, k = rng.randint(-40, 40), rng.randint(1, 12)
        m = "".join(rng.choice("0159") for _ in range(k))
        s = f"{rng.choice(['', '-'])}{m}e{e}"
        d = decimal.Decimal(s).quantize(decimal.Decimal(1).scaleb(e + rng.randint(0, k)), rng.choice([decimal.ROUND_FLOOR, decimal.ROUND_CEILING, decimal.ROUND_HALF_EVEN]))
        rows.append((format(decimal.Decimal(s), "f") if rng.random() < 0.5 else s, str(d)))
    rows += [("3.2e-11", "5.0e-12"), ("0.00000000012", "0.00000000034"), ("3.24e-11", "3.2e-11"), ("1e30", "1.0e30"), ("0", "0.00"), ("-0.004", "0.00"), ("0.5", "0"), ("-0.5", "-1"), ("9.96", "10.0")]
    got = spark.createDataFrame(rows, "s string, r string").select("s", "r", exact.agrees("s", "r").alias("a")).collect()
    assert all(g["a"] == reference_agrees(g["s"], g["r"]) for g in got), [g for g in got if g["a"] != reference_agrees(g["s"], g["r"])][:5]


def test_tolerances_means_and_renderings(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        e = rng.randint(-30, 30)
        s, r = f"{rng.randint(-999999, 999999)}e{e}", f"{rng.randint(-999, 999)}e{e + 3 * rng.randint(0, 1)}"
        rows.append((s, r, rng.choice(["absolute", "relative"]), rng.choice(["0.05", "1e-12", f"4e{e}", "1" * 30])))
    rows += [("1" * 40, "1" * 39 + "2", "absolute", "1"), ("1" * 40, "1" * 39 + "3", "absolute", "1"), ("3.2e-11", "5.0e-12", "relative", "0.5"), ("x", "1", "absolute", "1"), (None, "1", "relative", "1")]
    got = spark.createDataFrame(rows, "s string, r string, m string, t string").select("*", exact.within("s", "r", "m", "t").alias("a")).collect()
    for g in got:
        if g["s"] is None or g["s"] == "x":
            assert g["a"] is None
            continue
        s, r, t = (fractions.Fraction(decimal.Decimal(g[c])) for c in "srt")
        assert g["a"] == (abs(s - r) <= (t * abs(r) if g["m"] == "relative" else t)), g
    means = [("1e-12", 3, "3e-13"), ("1e-12", 3, "4e-13"), ("10", 4, "2.5"), ("10", 4, "2"), ("10", 4, "3"), ("10", 4, "4"), ("1" * 38, 7, "1"), (None, 3, "1"), ("5", 0, "1")]
    got = spark.createDataFrame(means, "s string, n int, r string").select(exact.mean_agrees(F.col("s"), F.col("n"), "r").alias("a")).collect()
    assert [g["a"] for g in got] == [True, False, True, True, True, False, False, None, None]
    shown = [("5e1", "50"), ("1.50e-3", "0.00150"), ("-12.5", "-12.5"), ("1e300", "1e300"), ("0.10e1", "1.0"), ("x", None), ("007", "7")]
    got = spark.createDataFrame(shown, "s string, w string").select("w", exact.rendered("s").alias("a")).collect()
    assert [g["a"] for g in got] == [w for _, w in shown]
    moved = spark.createDataFrame([("0.0426",), ("5e-1",)], "s string").select(exact.rendered(exact.shifted("s", F.lit(2))).alias("a")).collect()
    assert [g["a"] for g in moved] == ["4.26", "50"]
    members = spark.createDataFrame([("mean", ["1e-12", "2e-12"], "1.5e-12"), ("median", ["1", "2", "4", "x"], "3"), ("median", ["1", "2", "4"], "2"), ("sum", [], "0"), ("count", ["1", "9"], "2")], "k string, v array<string>, r string")
    assert [g["a"] for g in members.select(exact.statistic_of_members("k", "v", "r").alias("a")).collect()] == [True, None, True, None, True]


def test_numbers_and_nulls(spark):
    df = spark.createDataFrame([("1e3",), ("NaN",), ("inf",), (None,), ("+2.50",), ("x",), ("",), ("-.5",)], "t string")
    got = [r["v"] for r in df.select(exact.number("t").alias("v")).collect()]
    assert [None if v is None else float(v) for v in got] == [1000.0, None, None, None, 2.5, None, None, -0.5]
    assert [r["p"] for r in df.select(exact.printed_places("t").alias("p")).collect()][:5] == [-3, 0, 0, None, 2]
    assert spark.createDataFrame([("0012.500%",), ("1,234",), ("-0.0",)], "t string").select(exact.canonical("t").alias("c")).collect()[0]["c"] == "12.5"
    s = spark.createDataFrame([("0.0120",), ("100",), ("1.5e3",)], "t string").select(exact.significant_digits("t").alias("s")).collect()
    assert [r["s"] for r in s] == [3, 1, 2]


FOLDS = [("naïve  ﬁnal", "naive final"), ("inter-\n national", "international"), ("10-\n12", "10- 12"), ("a\x00b", "a b"), ("“So” – it’s", "\"so\" - it's"), ("", "")]


@pytest.mark.parametrize("text, form", FOLDS)
def test_folds(text, form):
    assert folds.passage_fold(text) == form


def test_hybrid_fold_is_the_fold(spark):
    texts = [t for t, _ in FOLDS] + ["Plain ASCII-\ntext  here", "tab\tand\rreturn", None, "x" * 100_000 + " é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folds.folded("t").alias("f")).collect()
    assert all(r["f"] == (None if r["t"] is None else folds.passage_fold(r["t"])) for r in got)


def test_skeleton_keeps_signs():
    assert folds.skeleton("p < 0.05") != folds.skeleton("p = 0.05") and folds.skeleton("-0.42") != folds.skeleton("0.42")
    assert folds.skeleton("prefix-matching of p_IOI") == folds.skeleton("prefixmatching ofpIOI")


def test_resolving():
    doc = "The catalogue holds 2,113 items. The sample size was 40. A sample size of -0.42 was not meant."
    assert folds.resolve("sample size", doc)[:2] == ("ambiguous", 2)
    assert folds.resolve("sample size", doc, prefix="A ")[0] == "found"
    assert folds.resolve("the catalog", doc)[0] == "found"  # cut only, so all places count
    assert folds.occurrences("113 items", doc.lower()) == folds.occurrences("113 items", doc.lower())
    assert folds.resolve("samplesize was40", doc) == ("found", 1, True)
    assert folds.resolve("nothing like it", doc)[0] == "not found" and folds.resolve("", doc)[0] == "not found"
    assert folds.divergence("the sample size was 50", doc)[0] == len("the sample size was ")
    gaps, span = folds.omission("The sample size was not meant.", doc)
    assert gaps and span.startswith("the sample size")
    assert folds.omission("wholly different words here", doc) is None
    p, s = folds.single_out("sample size", doc, 2)
    assert folds.resolve("sample size", doc, p, s)[0] == "found"
    assert folds.single_out("sample size", doc, 3) is None
    assert folds.context_notes("was meant", "This was not what was meant here.") == ["after_negation"]


def test_omission_is_the_best_of_all_ways():
    def brute(quote, text, least):
        q, doc = quote.split(), text.split()
        found = []

        def go(i, at, pieces):
            if i == len(q):
                if len(pieces) > 1:
                    found.append((pieces[-1][1] - pieces[0][0], len(pieces), pieces[0][0], pieces))
                return
            for j in range(at, len(doc)):
                for k in range(1, min(len(q) - i, len(doc) - j) + 1):
                    if q[i : i + k] == doc[j : j + k] and len(" ".join(q[i : i + k])) >= least:
                        go(i + k, j + k + 1, pieces + [(j, j + k)])

        go(0, 0, [])
        return min(found)[3] if found else None

    rng = random.Random(3)
    for _ in range(150):
        doc = [rng.choice("aa bb cc dd".split()) for _ in range(12)]
        q = " ".join(rng.choice("aa bb cc".split()) for _ in range(rng.randint(2, 5)))
        best, got = brute(q, " ".join(doc), 2), folds.omission(q, " ".join(doc), 2)
        assert (got is None) == (best is None), (q, doc)
        if best:
            assert got == ([" ".join(doc[a[1] : b[0]]) for a, b in zip(best, best[1:])], " ".join(doc[best[0][0] : best[-1][1]]))


def test_names_and_venues():
    assert folds.names_disagree("Hölscher, P. T.", "Peter Hoelscher") is None
    assert folds.names_disagree("Smith, Andrew J.", "Smith, Alastair J.") == "given"
    assert folds.names_disagree("Smith, A.", "Jones, A.") == "surname"
    assert folds.names_disagree("Del Tredici, Kelly", "Tredici, Kelly Del") is None
    assert folds.venue_fold("Proceedings of the 33rd Conference on Vision, vol. 2") == "vision"
    assert "cvpr" in folds.venue_forms("2016 Conference on Pattern Recognition (CVPR)")
    assert folds.name_variants("M\\\"uller") == {"muller"} and "mueller" in folds.name_variants("Müller")


def test_inventory():
    text = "In 2019, Table 3 lists 2,364 rows [12] and 12,13 (1) of gpt-4; v0.5.5 gave -0.42, ninety of 10-12, 3rd, one, rfc 6901, 2026-10-13, x=24.1%."
    got = [(n["text"], n["rule"]) for n in numerals.inventory(text)]
    assert got == [
        ("2019", "year"), ("3", "label"), ("2,364", None), ("12", "citation"), ("12", None), ("13", None), ("1", "list_marker"), ("4", "name"),
        ("0.5.5", "name"), ("-0.42", None), ("ninety", None), ("10", None), ("12", None), ("3", "ordinal"), ("one", "the_word_one"),
        ("6901", "document_identifier"), ("2026", "date"), ("10", "date"), ("13", "date"), ("24.1%", None),
    ]
    assert numerals.inventory(None) == numerals.inventory("") == []
    assert [n["line"] for n in numerals.inventory("1\n2\n\n3")] == [1, 2, 4]


def test_prose_anchors():
    assert numerals.located("it holds 8.3. Then", "holds", "") == [(9, "8.3")]
    assert numerals.located("0.318|", "0.3", "") == [] and numerals.located("| 0.318|", "|", "|")[0][1] == "0.318"
    assert numerals.located("v0.5", "v0.", "")[0][1] == "5" and numerals.located("x=-0.42", "x=-", "") == []
    assert numerals.read_value("1,062", "grouped") == "1062" and numerals.read_value("eighteen", "cardinal_word") == "18" and numerals.read_value("abc", "decimal") is None
