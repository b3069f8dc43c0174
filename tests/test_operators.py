"""Edge cases of the relational operators: nulls, empty tables, ties, repeats, extra columns."""

import random

from pyspark.sql import functions as F

from probatum.operators import chain, library
from probatum.operators.aggregate import exact_median, exact_statistics, members_resolved
from probatum.operators.correspond import one_place, side_pairs, verdicts
from probatum.operators.decide import aliases, decide, locate_rows, pin_state
from probatum.operators.graph import components
from probatum.operators.lineage import upstream, worst_upstream
from probatum.operators.passages import inside, quote_states, triangulate
from probatum.operators.policy import assess, numbers_limit, policy_rules
from probatum.operators.survey import bindings, index_like, tree_digests


def test_locate_and_decide(spark):
    claims = spark.createDataFrame([("a", 1, "2.5", "x"), ("b", 2, "1", "x"), ("c", 9, "1", "x"), ("d", None, "1", "x"), ("e", 4, None, "x"), ("f", 5, "word", "x")], "claim_id string, k int, reported string, v string")
    cells = spark.createDataFrame([(1, "2.45"), (2, "1"), (2, "1"), (4, "7"), (5, "7"), (None, "3"), (6, None)], "key int, v string")
    got = {r["claim_id"]: (r["outcome"], r["reason"]) for r in decide(locate_rows(claims, cells, [("k", "key")], "v")).collect()}
    assert got == {
        "a": ("verified", "value_match"), "b": ("not_found", "row_ambiguous"), "c": ("not_found", "row_absent"), "d": ("mismatch", "value_mismatch"),
        "e": ("not_found", "value_not_numeric"), "f": ("not_found", "value_not_numeric"),
    }
    assert decide(locate_rows(claims, cells.limit(0), [("k", "key")], "v")).count() == 6
    assert locate_rows(claims.limit(0), cells, [("k", "key")], "v").count() == 0


def test_medians_by_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randint(0, 9)) for _ in range(301)] + [("two", 1), ("two", 2), ("one", 5), (None, 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = {r["k"]: float(r["median2"]) for r in exact_median(df, ["k"], "v").collect() if r["k"] is not None}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": 2 * hot[150], "two": 3, "one": 10}
    stats = {r["k"]: (r["n"], r["n_null"]) for r in exact_statistics(df, ["k"], "v").collect()}
    assert stats["none"] == (0, 1)


def test_members_and_pairs(spark):
    m = spark.createDataFrame([(1, 0, "resolved", None), (1, 2, "absent", "late"), (1, 1, "absent", "early"), (2, 0, "resolved", None)], "k int, pos int, resolution string, reason string")
    got = {r["k"]: (r["all_resolved"], r["first_reason"]) for r in members_resolved(m, ["k"], "pos", "resolution", "reason").collect()}
    assert got == {1: (False, "early"), 2: (True, None)}
    s = spark.createDataFrame(
        [("a", [("x", "1.23"), ("y", "1.2"), ("y", "9")]), ("b", [("x", "1"), ("y", None)]), ("c", [("x", "1")]), ("d", [])], "claim_id string, sides array<struct<name:string,raw:string>>"
    )
    got = {r["claim_id"]: r["comparison"] for r in verdicts(side_pairs(s)).collect()}
    assert got == {"a": "mismatch", "b": "not_applicable"}
    r = spark.createDataFrame([("a", "l", "f", 0, 5), ("a", "r", "f", 4, 9), ("a", "z", "g", 0, 9), ("b", "l", "f", 0, 4), ("b", "r", "f", 4, 9)], "claim_id string, side string, path string, start int, end int")
    assert [tuple(x) for x in one_place(r).collect()] == [("a", "l", "r")]


def test_pins(spark):
    a = spark.createDataFrame([("1", "p", "x"), ("2", "p", None), ("3", "gone", "x"), ("4", "q", "y"), ("5", "q", "x")], "artifact_id string, path string, sha256 string")
    f = spark.createDataFrame([("p", "x"), ("q", "x")], "path string, actual string")
    st = pin_state(a, f)
    assert {r["artifact_id"]: r["validity"] for r in st.collect()} == {"1": "authoritative", "2": "unpinned_artifact", "3": "artifact_absent", "4": "broken_pin", "5": "authoritative"}
    assert {(r["class_id"], r["n_same"]) for r in aliases(st).collect()} == {("1", 4)}


def test_policies(spark):
    rules = policy_rules(spark)
    facts = spark.createDataFrame([("c", "unchecked", True), ("d", "verified", False)], "subject string, fact string, confirmatory boolean")
    got = {r["profile"]: (r["n_errors"], r["n_warnings"], r["passed"]) for r in assess(facts, rules).collect()}
    assert got == {"permissive": (0, 1, True), "publication": (1, 0, False), "strict": (1, 0, False)}
    assert not any(r["passed"] for r in assess(facts.limit(0), rules).collect())
    assert [r["severity"] for r in numbers_limit(spark.createDataFrame([(1, 0), (2, 3), (3, 9)], "text_id int, n_unbound int"), 5).orderBy("text_id").collect()] == ["ignore", "warning", "error"]


def test_chain_edges(spark):
    cols = "ledger string, n long, raw string, prev_hash string, seq long, readable boolean"
    assert chain.verify_chain(spark.createDataFrame([], cols)).count() == 0
    one = spark.createDataFrame([("l", 0, "a", chain.ZERO, 0, True), ("l", 1, "b", None, 1, True)], cols)
    assert chain.verify_chain(one).collect()[0]["status"] == "corrupt"
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, at int, s string")
    assert sorted(r["at"] for r in chain.changes(e, ["k"], ["at"], "s").collect()) == [1, 3, 5]
    t = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-02T00:00:00+01:00"), ("2024-01-01T00:00:00", "2024-01-02T00:00:00Z"), ("soon", "2024-01-02T00:00:00Z"), (None, None)], "a string, b string")
    assert [r["p"] for r in t.select(chain.precedes(F.col("a"), F.col("b")).alias("p")).collect()] == [True, False, False, False]


def test_lineage(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "c")], "node string, above string")
    got = {(r["node"], r["above"]): r["distance"] for r in upstream(e).collect()}
    assert got[("a", "c")] == 1 and got[("a", "a")] == 2 and got[("d", "b")] == 3
    states = spark.createDataFrame([("a", "current"), ("b", "current"), ("c", "stale"), ("d", "never_rerun")], "node string, state string")
    assert {r["node"]: (r["state"], r["cause"]) for r in worst_upstream(states, upstream(e)).collect()}["d"] == ("stale", "c")
    assert upstream(e.limit(0)).count() == 0
    chain = spark.range(70).selectExpr("cast(id as string) node", "cast(id + 1 as string) above")
    got = upstream(chain, chain.filter("node = '0'"))
    assert got.count() == 70 and got.agg(F.max("distance")).first()[0] == 70


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(110)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(label[n] == r for n, r in got.items())


def test_inside_by_brute_force(spark):
    rng = random.Random(6)
    p = [(rng.randint(1, 2), rng.randint(0, 3000), i) for i in range(300)]
    iv = [(rng.randint(1, 2), a, a + rng.choice([0, 1, 10, 900]), j) for j, a in enumerate(rng.randint(0, 3000) for _ in range(60))]
    got = {(r["i"], r["j"]) for r in inside(spark.createDataFrame(p, "k int, at int, i int"), spark.createDataFrame(iv, "k int, lo int, hi int, j int"), ["k"], "at", "lo", "hi").collect()}
    assert got == {(i, j) for k, at, i in p for q, lo, hi, j in iv if k == q and lo <= at < hi}


def test_quotes(spark):
    texts = spark.createDataFrame([(1, "s", "We found that open-\naccess papers grow. They grow.", 1), (2, "s", "Nothing here", 2), (3, "t", "We found that", 1), (4, "s", None, 3)], "text_id int, source string, text string, page int")
    quotes = spark.createDataFrame(
        [(1, "s", "found that openaccess papers", 1), (2, "s", "They grow", 1), (3, "s", "we found that", 2), (4, "s", "grow", None), (5, "t", "papers grow fast", 1), (6, "s", None, 1), (7, "s", "", 1)],
        "quote_id int, source string, quote string, page int",
    )
    got = {r["quote_id"]: r["state"] for r in quote_states(quotes, texts).collect()}
    assert got == {1: "found", 2: "found", 3: "wrong_page", 4: "ambiguous", 5: "not found", 6: "not found", 7: "not found"}
    r = spark.createDataFrame([(1, "found"), (1, "found"), (2, "found"), (2, "not found")], "quote_id int, state string")
    assert {x["quote_id"]: x["state"] for x in triangulate(r).collect()} == {1: "found", 2: "indeterminate"}


def test_library(spark):
    new = spark.createDataFrame([("a", "", {"p": 1}), ("b", None, None), (None, "v", {})], "k string, venue string, m map<string,int>")
    old = spark.createDataFrame([("a", "old", {"p": 9, "q": 2}), ("a", "old", {"p": 9}), ("b", "old2", None)], new.schema)
    got = {r["k"]: (r["venue"], r["m"]) for r in library.fill_gaps(new, old, "k", ["venue", "m"]).collect()}
    assert got["a"] == ("old", {"p": 1, "q": 2}) and got["b"][0] == "old2" and got[None][0] == "v"
    assert {(r["k"], r["field"]) for r in library.losses(new.filter("k = 'a'"), old, "k", ["venue"]).collect()} == {("a", "venue"), ("b", "record")}
    assert library.roll_up(spark.createDataFrame([("a/b", 1), ("a/b", 1), ("a/c", 2), (None, 3)], "p string, i int"), "p", "i").count() == 3
    p = spark.createDataFrame([(1, ["A. Homon", "B. Sossim"], ["Homon, Anna"]), (2, None, ["X"]), (3, ["C. Kof"], ["D. Kof", "E"])], "pair_id int, ours array<string>, theirs array<string>")
    assert {(r["pair_id"], r["position"], r["problem"]) for r in library.author_positions(p).collect()} == {(1, 2, "extra"), (2, 1, "dropped"), (3, 1, "given"), (3, 2, "dropped")}
    v = spark.createDataFrame(
        [(1, "J. of X", "Journal of X", ["issn:1"], ["issn:1"]), (2, "A", "B", ["issn:1"], ["issn:2"]), (3, "A Workshop", "A", [], []), (4, "", "A", [], []), (5, "A", "B", ["openalex:1"], ["issn:2"])],
        "pair_id int, ours string, theirs string, our_ids array<string>, their_ids array<string>",
    )
    assert {r["pair_id"]: r["verdict"] for r in library.venue_verdict(v).collect()} == {1: "match", 2: "mismatch", 3: "not_comparable", 4: "not_comparable", 5: "not_comparable"}


def test_survey(spark):
    printed = spark.createDataFrame([("0.5",), ("12",), ("12",), ("4.3",), ("x",)], "printed string")
    stored = spark.createDataFrame([(1, "0.49"), (2, "0.12"), (3, "4.25"), (4, "12.5")], "value_id int, value string").withColumn("value", F.col("value").cast("decimal(18,2)"))
    got = {(r["printed"], r["value_id"], r["conversion"]) for r in bindings(printed, stored).collect()}
    assert got == {("0.5", 1, "none"), ("12", 2, "percent"), ("4.3", 3, "none"), ("12", 4, "none")}
    rows = spark.createDataFrame([(i, i % 12, 7) for i in range(40)], "k int, cyc int, same int")
    assert index_like(rows, ["k"], "cyc").collect()[0]["index_like"] and not index_like(rows, ["k"], "same").collect()[0]["index_like"]
    f = spark.createDataFrame([("t", f"p{i}", "h") for i in range(50)], "tree string, path string, sha string")
    a, b = (tree_digests(x, "tree", "path", "sha").collect()[0]["digest"] for x in (f, f.repartition(5)))
    assert a == b != tree_digests(f.filter("path <> 'p3'"), "tree", "path", "sha").collect()[0]["digest"]


def test_unknown_years_disagree_with_none(spark):
    from probatum.operators.library import best_candidate

    schema = "title string, authors array<string>, year string, venue string"
    works = [(1, "On the maize plot of Runut", ["Runut, K."], "2001", None), (2, "The vowel and the loanword", ["Homon, B."], None, None), (3, "Other things entirely", ["Runut, K."], "2001", None)]
    records = [(10, "On the maize plot of Runut", ["K. Runut"], None, None), (11, "The vowel and the loanword", ["B. Homon"], "1999", None), (12, "On the maize plot of Runut", ["K. Runut"], "2001", None),
               (13, "On the maize plot of Runut", ["K. Runut"], "1950", None), (14, "On the maize plot of Runut", None, "2001", None), (15, None, ["K. Runut"], None, None)]
    got = best_candidate(spark.createDataFrame(records, "record_id long, " + schema), spark.createDataFrame(works, "candidate_id long, " + schema))
    assert {r["record_id"]: r["candidate_id"] for r in got.collect()} == {10: 1, 11: 2, 12: 1}


def test_rerecorded_is_the_rule_pair_by_pair(spark):
    import random

    from probatum.operators.chain import rerecorded

    rng = random.Random(8)
    events = [("hot" if rng.random() < 0.6 else rng.choice("ab"), n, rng.choice(["run", "run", "seal", "retire"]), f"p{rng.randint(0, 4)}", str(rng.randint(0, 3))) for n in range(400)]
    seen, rows = {}, []
    for ledger, _, kind, path, sha in events:
        rows.append((ledger, seen.setdefault(ledger, 0), kind, path, sha))
        seen[ledger] += 1
    df = spark.createDataFrame([(a, n, k, p, s, f"r{n}") for a, n, k, p, s in rows], "ledger string, seq long, kind string, path string, sha256 string, run_id string")
    got = {(r["ledger"], r["path"]): (r["earlier_run"], r["later_run"]) for r in rerecorded(*[df.filter(F.col("kind") == k) for k in ("run", "seal", "retire")]).collect()}
    want = {}
    for ledger in seen:
        mine = [r for r in rows if r[0] == ledger]
        for path in {r[3] for r in mine}:
            runs = [r for r in mine if r[2] == "run" and r[3] == path]
            for one, two in zip(runs, runs[1:]):
                between = [r for r in mine if one[1] < r[1] < two[1]]
                if one[4] == two[4] or any(r[2] == "retire" and r[3] == path for r in between):
                    continue
                changed = False
                for s in (r for r in between if r[2] == "seal" and r[3] != path):
                    before = [r for r in mine if r[2] == "seal" and r[3] == s[3] and r[1] < s[1]]
                    changed |= bool(before) and before[-1][4] != s[4] and before[0][1] < one[1]
                if not changed:
                    want[ledger, path] = (f"r{one[1]}", f"r{two[1]}")
    assert got == want and want


def test_assessments_of_states(spark):
    from probatum.operators.policy import assess_states, quotation_report, state_rules

    states = spark.createDataFrame([("staleness", "stale"), ("staleness", "current"), ("reproduction", "changed"), ("staleness", None)], "area string, state string")
    got = {(r["profile"], r["area"]): (r["n_errors"], r["n_warnings"], r["n_states"], r["passed"]) for r in assess_states(states, state_rules(spark)).collect()}
    assert got["strict", "staleness"] == (1, 0, 3, False) and got["permissive", "staleness"] == (0, 1, 3, True) and got["permissive", "reproduction"] == (1, 0, 1, False)
    assert assess_states(states.limit(0), state_rules(spark)).count() == 0
    q = spark.createDataFrame([("a", "found"), ("a", "unchecked"), ("b", "unchecked"), ("c", "found"), ("d", "not found"), ("d", "found"), ("e", None)], "f string, state string")
    got = {r["f"]: (r["ok"], r["strict_ok"]) for r in quotation_report(q, ["f"]).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (True, True), "d": (False, False), "e": (True, True)}


def test_worst_through_is_the_closure(spark):
    import random

    from probatum.operators.lineage import worst_through

    rng = random.Random(6)
    edges = spark.createDataFrame([(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(45)] + [("x", "n1"), ("x", "n1")], "node string, above string")
    states = spark.createDataFrame([(f"n{i}", rng.choice(["current", "current", "stale", "undetermined", "never_rerun"])) for i in range(0, 31, 2)] + [("x", "current"), ("alone", "stale")], "node string, state string")
    rows = lambda df: {(r["node"], r["state"], r["cause"]) for r in df.collect()}
    assert rows(worst_through(states, edges)) == rows(worst_upstream(states, upstream(edges)))
    assert worst_through(states.limit(0), edges).count() == 0 and worst_through(states, edges.limit(0)).count() == states.count()
