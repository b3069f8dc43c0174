"""The conformance cases: declared artifacts, declared evidence, expected outcomes and reasons."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from probatum.operators.engine import EVIDENCE, verify
from probatum.sources.files import cells, listed

FILES = {
    "table.csv": "model,accuracy,n\nLASSO-Cox,0.6478999999999999,120\nCoxMLP,0.641,120\nCoxMLP,0.700,64\n",
    "results.json": '{"delta": 3.2, "label": "primary", "nested": {"a/b": 7}, "gone": null}',
    "source.txt": "The measured angle matches the Haar expectation for this ensemble.",
    "doc.md": "We checked eighteen fixtures in all.\nThe improvement was 3.2 points; n = 1,062 rows.\n| total | 19 |\n| total | 21 |\n",
    "counts.json": '{"fixtures": 19, "improvement": 3.2004}',
    "run0.json": '{"accuracy": 1}', "run1.json": '{"accuracy": 1}', "run2.json": '{"accuracy": 2}',
    "rates.json": '{"rate": 0.9123}', "halves.json": '{"half": 4.25}', "broken.json": '{"a": 1, "a": 2}',
}


def at(kind, **k):
    base = dict.fromkeys("kind pointer table_name column predicate row array_name index before after form".split())
    return base | {"kind": kind} | k


def side(artifact, locator, name="s", conversion=None):
    return {"name": name, "artifact_id": artifact, "conversion": conversion, "locator": locator}


def value(artifact, locator, reported, **k):
    return {"kind": "value", "reported": reported, "sides": [side(artifact, locator, conversion=k.pop("conversion", None))], **k}


def aggregate(statistic, reported, *artifacts):
    return {"kind": "aggregate", "statistic": statistic, "reported": reported, "sides": [side(a, at("pointer", pointer="/accuracy")) for a in artifacts]}


def both(*sides):
    return {"kind": "correspondence", "sides": [side(a, loc, f"s{i}") for i, (a, loc) in enumerate(sides)]}


P = lambda p: at("pointer", pointer=p)
ROW = lambda c, **w: at("table", column=c, predicate=w)
PROSE = lambda b, a=None, f=None: at("prose", before=b, after=a, form=f)

CASES = {
    "value_match": (value("results", P("/delta"), "3.2"), "verified", "value_match"),
    "value_mismatch": (value("results", P("/delta"), "3.3"), "mismatch", "value_mismatch"),
    "pointer_absent": (value("results", P("/none"), "3.2"), "not_found", "pointer_absent"),
    "null_is_absent": (value("results", P("/gone"), "3.2"), "not_found", "pointer_absent"),
    "pointer_escaped_key": (value("results", P("/nested/a~1b"), "7"), "verified", "value_match"),
    "container": (value("results", P("/nested"), "7"), "not_found", "selector_not_scalar"),
    "text_is_no_number": (value("results", P("/label"), "7"), "not_found", "value_not_numeric"),
    "printed_precision": (value("table", ROW("accuracy", model="LASSO-Cox"), "0.648"), "verified", "value_match"),
    "table_mismatch": (value("table", ROW("accuracy", model="LASSO-Cox"), "0.650"), "mismatch", "value_mismatch"),
    "table_column_absent": (value("table", ROW("auc", model="LASSO-Cox"), "0.6"), "not_found", "column_absent"),
    "table_row_absent": (value("table", ROW("accuracy", model="Other"), "0.6"), "not_found", "row_absent"),
    "table_row_ambiguous": (value("table", ROW("accuracy", model="CoxMLP"), "0.641"), "not_found", "row_ambiguous"),
    "table_two_columns": (value("table", ROW("accuracy", model="CoxMLP", n="64"), "0.70"), "verified", "value_match"),
    "table_position": (value("table", at("row", column="n", row=2), "64"), "verified", "value_match"),
    "undeclared": (value("nowhere", P("/a"), "1"), "unchecked", "artifact_undeclared"),
    "missing": (value("absent", P("/a"), "1"), "unchecked", "artifact_missing"),
    "unreadable": (value("broken", P("/a"), "1"), "unchecked", "artifact_unreadable"),
    "converted": (value("rates", P("/rate"), "91.2", conversion="percent"), "verified", "value_match"),
    "converted_mismatch": (value("rates", P("/rate"), "91.3", conversion="percent"), "mismatch", "value_mismatch"),
    "tie_down": (value("halves", P("/half"), "4.2"), "verified", "value_match"),
    "tie_up": (value("halves", P("/half"), "4.3"), "verified", "value_match"),
    "tie_no": (value("halves", P("/half"), "4.4"), "mismatch", "value_mismatch"),
    "places": (value("halves", P("/half"), "4.25", places=1), "mismatch", "places_mismatch"),
    "tolerance": (value("halves", P("/half"), "4.0", mode="absolute", tolerance="0.25"), "verified", "value_match"),
    "mean": (aggregate("mean", "1.33", "run0", "run1", "run2"), "verified", "value_match"),
    "mean_mismatch": (aggregate("mean", "1.34", "run0", "run1", "run2"), "mismatch", "value_mismatch"),
    "median": (aggregate("median", "1", "run0", "run1", "run2"), "verified", "value_match"),
    "aggregate_absent": (aggregate("sum", "4", "run0", "rates", "run2"), "not_found", "pointer_absent"),
    "correspondence": (both(("counts", P("/improvement")), ("doc", PROSE("improvement was"))), "verified", "value_match"),
    "correspondence_mismatch": (both(("counts", P("/fixtures")), ("doc", PROSE("n =", None, "grouped"))), "mismatch", "value_mismatch"),
    "correspondence_absent": (both(("counts", P("/none")), ("doc", PROSE("improvement was"))), "not_found", "pointer_absent"),
    "prose_word": (value("doc", PROSE("checked"), "18"), "not_found", "number_as_word"),
    "prose_word_asked_for": (value("doc", PROSE("checked", None, "cardinal_word"), "18"), "verified", "value_match"),
    "prose_grouped": (value("doc", PROSE("n =", None, "grouped"), "1062"), "verified", "value_match"),
    "prose_ambiguous": (value("doc", PROSE("| total |", "|"), "19"), "not_found", "passage_ambiguous"),
    "prose_absent": (value("doc", PROSE("nothing here"), "19"), "not_found", "passage_absent"),
    "prose_splits_number": (value("doc", PROSE("improvement was 3."), "2"), "not_found", "passage_absent"),
    "passage_present": ({"kind": "quote", "quote": "matches the Haar expectation", "sides": [side("source", None)]}, "verified", "passage_present"),
    "passage_absent": ({"kind": "quote", "quote": "refutes the Haar expectation", "sides": [side("source", None)]}, "mismatch", "passage_absent"),
    "not_offered": ({"kind": None, "sides": []}, "not_offered", "not_offered"),
}


@pytest.fixture(scope="module")
def decisions(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("artifacts")
    for name, text in FILES.items():
        (root / name).write_text(text, encoding="utf-8")
    found = listed(spark, str(root))
    read = cells(found)
    status = read.groupBy("path").agg(F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("status"))
    files = found.select("path", F.col("sha256").alias("actual")).join(status, "path", "left")
    texts = found.filter("format = 'prose'").select("path", F.decode("content", "utf-8").alias("text"))
    digest = lambda n: hashlib.sha256(FILES[n].encode()).hexdigest()
    rows = [(n.split(".")[0], f"file:{root}/{n}", digest(n)) for n in FILES] + [("absent", f"file:{root}/none.json", None)]
    rows = [(a, p, None if a == "source" else "0" * 64 if a == "doc" else s) for a, p, s in rows]
    artifacts = spark.createDataFrame(rows, "artifact_id string, path string, sha256 string")
    fields = [c.split()[0] for c in EVIDENCE.replace("array<struct", "x").split(", ")][:13]
    names = "claim_id ord kind reported mode tolerance places statistic n_declared quote prefix suffix sides".split()
    assert len(fields) == 13
    evidence = spark.createDataFrame([tuple({"claim_id": k, "ord": 0, **c[0]}.get(n) for n in names) for k, c in CASES.items()], EVIDENCE)
    return {r["claim_id"]: r for r in verify(evidence, artifacts, files, read, texts).collect()}


@pytest.mark.parametrize("case", CASES)
def test_case(decisions, case):
    row = decisions[case]
    assert (row["outcome"], row["reason"]) == CASES[case][1:]


def test_every_piece_of_evidence_has_one_decision(decisions):
    assert set(decisions) == set(CASES)
    assert decisions["passage_present"]["validity"] == "unpinned_artifact"
    assert decisions["prose_grouped"]["validity"] == "broken_pin"
    assert json.dumps(decisions["value_match"]["stored"]) == '"3.2"'
