import json

import pytest

from pyspark.sql import functions as F

from probatum.sources.files import cells, listed
from probatum.sources.manifests import manifests, parse, problems, verify_folder


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_folder(spark, tmp_path):
    for p, delta in (("one", "3.2"), ("two", "9")):
        _write(tmp_path / p, "r.json", '{"delta": %s, "runs": [1, 1, 2]}' % delta)
        _write(tmp_path / p, "t.csv", "k,v\na,0.5\nb,7\n")
        _write(tmp_path / p, "doc.md", "The delta was 3.2 points.")
        member = lambda i: {"artifact": "r", "locator": {"kind": "tree", "pointer": f"/runs/{i}"}}
        manifest = {
            "artifacts": [{"id": "r", "path": "r.json"}, {"id": "t", "path": "t.csv", "digest": {"value": "0" * 64}}, {"id": "d", "path": "doc.md"}],
            "claims": [
                {"id": "c1", "evidence": [
                    {"kind": "metric", "artifact": "r", "reported": "3.2", "pointer": "/delta"},
                    {"kind": "table", "artifact": "t", "reported": "50", "column": "v", "where": {"k": "a"}, "conversion": "percent"},
                    {"kind": "table", "artifact": "t", "reported": "7", "column": "v", "row": 1},
                    {"kind": "quote", "artifact": "d", "text": "delta was 3.2"},
                    {"kind": "aggregate", "reported": "1.33", "statistic": "mean", "count": 3, "members": [member(i) for i in range(3)]},
                    {"kind": "correspondence", "sides": [{"name": "a", "artifact": "d", "locator": {"kind": "prose", "before": "delta was", "after": ""}}, {"name": "b", "artifact": "r", "locator": {"kind": "tree", "pointer": "/delta"}}]},
                ]},
                {"id": "c2"},
            ],
        }
        _write(tmp_path / p, "manifest.json", json.dumps(manifest))
    _write(tmp_path / "bad", "manifest.json", '{"claims": [{"id": "x"}, {"id": "x"}]}')
    _write(tmp_path / "worse", "manifest.json", "{")
    got = {(r["project"].rsplit("/", 2)[1], r["claim_id"], r["ord"]): (r["outcome"], r["reason"]) for r in verify_folder(spark, str(tmp_path)).collect()}
    ok = ("verified", "value_match")
    assert [got["one", "c1", i] for i in range(6)] == [ok, ok, ok, ("verified", "passage_present"), ok, ok]
    assert [got["two", "c1", i][0] for i in range(6)] == ["mismatch", "verified", "verified", "verified", "verified", "mismatch"]
    assert got["one", "c2", 0] == ("not_offered", "not_offered") and len(got) == 14
    bad = {r["path"].rsplit("/", 2)[1]: r["problems"] for r in manifests(spark, str(tmp_path), "manifest.*").collect()}
    assert bad["bad"] and bad["worse"] and not bad["one"]


def test_pages_are_quoted_and_only_named_columns_read(spark, tmp_path):
    _write(tmp_path, "page.html", "<table><tr><td>alpha</td><td>0.5</td></tr></table><p>The effect held in <b>all</b> sites.</p>")
    _write(tmp_path, "t.csv", "k,v,unused\na,3.2e-11,x\n")
    _write(tmp_path, "d.json", "{}")
    quote = lambda a, t: {"kind": "quote", "artifact": a, "text": t}
    claims = [quote("p", "held in all sites"), quote("p", "alpha 0.5"), quote("p", "alpha | 0.5"), quote("d", "anything"), quote("t", "a | 3.2e-11"),
              {"kind": "table", "artifact": "t", "reported": "5.0e-12", "column": "v", "where": {"k": "a"}}]
    artifacts = [{"id": "p", "path": "page.html"}, {"id": "t", "path": "t.csv"}, {"id": "d", "path": "d.json"}]
    _write(tmp_path, "manifest.json", json.dumps({"artifacts": artifacts, "claims": [{"id": "c", "evidence": claims}]}))
    got = [r["reason"] for r in verify_folder(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == ["passage_present", "passage_absent", "passage_present", "extractor_missing", "passage_present", "value_mismatch"]
    files = listed(spark, str(tmp_path), "*.csv")
    wanted = files.select("path", F.array(F.lit("v")).alias("columns"))
    assert {r["column"] for r in cells(files, wanted).collect()} == {"v"} and {r["column"] for r in cells(files).collect()} == {"k", "v", "unused"}


def test_problems():
    e = {"kind": "aggregate", "count": 3, "members": [{"artifact": "a", "locator": {"kind": "tree", "pointer": "/x"}}] * 2}
    assert len(problems({"claims": [{"id": "c", "evidence": [e]}]})) == 2


def test_yaml():
    pytest.importorskip("yaml")
    m = parse("p/m.yaml", b"artifacts:\n- id: a\n  path: x.csv\nclaims:\n- id: c\n  evidence:\n  - kind: table\n    artifact: a\n    reported: 0.50\n    column: v\n    where: {k: 001}\n")
    assert m["artifacts"][0]["path"] == "p/x.csv" and m["evidence"][0]["reported"] == "0.50" and m["evidence"][0]["sides"][0]["locator"]["predicate"] == {"k": "001"}
