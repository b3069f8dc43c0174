from pyspark.sql import functions as F

from probatum.operators import manuscript as ms


def test_statements(spark):
    m = spark.createDataFrame([(1, "The rate rose to 4.5 percent in 2019, over 12 sites."), (2, "12 13 14"), (3, None)], "text_id int, text string")
    c = spark.createDataFrame([(7, "We say the rate rose to 4.5 overall."), (8, "4.5, 12, 13"), (9, None)], "claim_id int, text string")
    got = {(r["text_id"], r["at"], r["claim_id"]) for r in ms.stated(m, c).collect()}
    assert got == {(1, 4, 7)}
    assert ms.stated(m.limit(0), c).count() == 0


def test_held(spark):
    p = spark.createDataFrame([("0.5",), ("49.8",), ("7",)], "printed string")
    o = spark.createDataFrame([(1, "0.498"), (2, "9.4")], "output_id int, v string").select("output_id", F.col("v").cast("decimal(18,4)").alias("value"))
    assert {(r["printed"], r["output_id"]) for r in ms.held(p, o).collect()} == {("0.5", 1), ("49.8", 1)}


def test_exempt(spark):
    rows = [("1.96", "", "", "constant"), ("0.05", "p < ", "", "constant"), ("0.05", "a rate of ", "", None), ("7", "", " items", "single_digit"), ("12", "gpt-", "", "name"), ("12", "see Table ", "", "place"), ("12", "doi:10.1/", "", "identifier"), ("12", "gave ", "", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, b string, a string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", ms.needs_no_claim(F.col("n"), F.col("b"), F.col("a"))).collect())


def test_coverage(spark):
    df = spark.createDataFrame([("t", None, True, False), ("t", None, False, True), ("t", "year", False, False), ("t", None, None, None), ("u", "year", False, False)], "t string, exempt string, bound boolean, attributed boolean")
    got = {r["t"]: (r["n_exempt"], r["n_bound"], r["n_attributed"], r["n_unbound"], r["share"]) for r in ms.coverage(df, ["t"]).collect()}
    assert got == {"t": (1, 1, 1, 1, 0.333333), "u": (1, 0, 0, 0, None)}


def test_notes(spark):
    rows = [
        ("a", "4.3", "4.3", None, None, True, "It was 5.0.", ["4.3 here"]), ("b", "4.3", "4.3", None, None, True, "No number.", []), ("c", "0.0", "0.0491", None, None, True, "It was 0.0.", []),
        ("d", "0.05", "0.049", None, None, True, "It was 0.05.", None), ("e", "10", "11", "absolute", "2", True, "It was 10.", []), ("f", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, reported string, stored string, mode string, tolerance string, matched boolean, text string, passages array<string>")
    got = {r["k"]: r["notes"] for r in ms.reported_notes(df).collect()}
    assert got["a"] == ["reported_not_in_claim"] and got["b"] == ["reported_uncompared"] and got["c"] == ["coarse_precision"]
    assert got["d"] == ["coarse_precision", "rounding_crosses_threshold"] and got["e"] == ["loose_tolerance"]


def test_guards(spark):
    df = spark.createDataFrame([("0.648", "test accuracy", ["test"]), ("12", "test accuracy", ["train"]), ("100.0", "accuracy", [])], "w string, q string, words array<string>")
    assert [r["s"] for r in df.select(ms.specific("w").alias("s")).collect()] == [True, False, True]
    assert [r["s"] for r in df.select(ms.qualifiers_agree(F.col("q"), F.col("words")).alias("s")).collect()] == [True, False, True]


def test_attribution(spark):
    f = spark.createDataFrame([(1, "the rate rose in every site"), (2, "the rate fell in every site"), (3, "the rate fell in every site"), (4, "short"), (5, "nothing cited near this one")], "quotation_id int, fragment string")
    k = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "gone"), (4, "a")], "quotation_id int, key string")
    a = spark.createDataFrame([("a", "We saw the rate rose in every site."), ("gone", None)], "key string, text string")
    assert {r["quotation_id"]: r["finding"] for r in ms.attribute(f, k, a).collect()} == {1: "covered", 2: "uncovered", 3: "unresolvable", 4: "unresolvable", 5: "unresolvable"}


def test_plans(spark):
    old = "# Plan\n**Status:** FROZEN at `x`.\nWe test H1.\n"
    assert ms.plan_text(old) == "# Plan\nWe test H1.\n" and ms.plan_text(old + "---\n\n## Log\n- 2024-01-01 ok") == "# Plan\nWe test H1.\n"
    assert ms.added_beyond_log(old, old + "## Log\n- 2024-01-01 a deviation\n  goes on\n") is None
    assert ms.added_beyond_log(old, old + "A new criterion.\n") == "A new criterion." and ms.added_beyond_log(old, "Other\n") == ""
    assert spark.createDataFrame([(old, old), (None, None)], "a string, b string").select(ms.plan_udf("a", "b").alias("p")).filter("p.beyond is null").count() == 2


def test_small_joins(spark):
    o = ms.classify_outputs(spark.createDataFrame([("a.CSV", "see Table 2 and tables 10"), ("b.png", "not in the paper"), ("c", None)], "file string, comment string"))
    assert [(r["kind"], r["tables"], r["outside_paper"]) for r in o.collect()] == [("value", ["10", "2"], False), ("figure", [], True), ("other", [], False)]
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, value string"), spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, value string")
    assert {r["k"]: r["state"] for r in ms.reread(a, b, "k").collect()} == {1: "unchanged", 2: "changed", 3: "unreadable", 4: "unreadable"}
    assert ms.removed_lines(a.union(a), a, ["k"]).count() == 3
    labels = spark.createDataFrame([("Law",), ("sport",)], "label string")
    texts = spark.createDataFrame([("p", "the law, again"), ("q", None)], "project string, text string")
    assert {(r["project"], r["label"]) for r in ms.unmentioned(labels, texts, "project").collect()} == {("p", "sport"), ("q", "law"), ("q", "sport")}


def test_corrections():
    from probatum.functions.folds import corrected

    text = "the rnean was 4.2 in all sites"
    assert corrected("mean was 4.2", "The mean was 4.2", "the rnean was 4.2", text) == ("corrected", [])
    assert corrected("median", "The mean was 4.2", "the rnean was 4.2", text)[0] == "quotation not in passage"
    assert corrected("mean", "The mean was 4.2", "absent", text)[0] == "reading not in text"
    assert corrected("mean", "mean", "sites", text)[0] == "not alike" and corrected("x", "", "", text)[0] == "empty"
    assert corrected("mean", "mean " * 900, "rnean", text)[0] == "too long" and corrected("mean", "mean", "rnean " * 50, text)[0] == "too long"
    shown = "of 21 sites it was now shown that p < 0.05 may hold"
    assert corrected("12 sites", "of 12 sites it was now shown", "of 21 sites it was now shown", shown) == ("corrected", ["changes_number"])
    assert corrected("was not shown", "it was not shown that", "it was now shown that", shown) == ("corrected", ["adds_negation"])
    assert corrected("p > 0.05", "shown that p > 0.05 may", "shown that p < 0.05 may", shown) == ("corrected", ["changes_comparison"])
    assert corrected("0.05 hold", "that p < 0.05 hold", "that p < 0.05 may hold", shown) == ("corrected", ["removes_hedge"])
