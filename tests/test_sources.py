import io
import json
import sqlite3
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from probatum.operators.chain import verify_chain
from probatum.sources import pages, sinks, trees
from probatum.sources.files import cells, holds_text, ledger_lines, listed, page_texts, render, shallowest_results, sniff


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("files")
    (r / "a.csv").write_text("﻿x; y\n1; 2\n3\n", encoding="utf-8")
    (r / "b.tsv").write_text("x\ty\n1\t2\n")
    (r / "twice.csv").write_text("x,x\n1,2\n")
    (r / "t.json").write_text('{"a": [0.910, 1e-7, 9007199254740993.0], "b~/c": true, "d": null}')
    (r / "bad.json").write_text("{")
    (r / "model.pkl").write_bytes(b"\x80\x04")
    (r / "old.sas7bdat").write_bytes(b"x")
    pq.write_table(pa.table({"k": [1, 2], "v": [0.5, None], "l": [[1], [2]]}), r / "p.parquet")
    np.save(r / "n.npy", np.array([[1.5, 2.0], [3.0, 4.25]], dtype=np.float32))
    np.savez(r / "z.npz", first=np.arange(3))
    con = sqlite3.connect(r / "d.sqlite")
    con.execute('CREATE TABLE "odd ""name" (k INTEGER, v REAL)')
    con.execute('INSERT INTO "odd ""name" VALUES (1, 2.5), (NULL, 3.0)')
    con.commit()
    con.close()
    (r / "page.html").write_text("<html><head><title>no</title></head><body><h1>Head &amp; tail</h1><p>One<br>two<script>x()</script></p></body></html>")
    (r / "article.xml").write_text("<article><title>On <i>it</i></title><p>First.</p><p>Second <b>one</b>.</p></article>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(r / "doc.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Kept</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p><w:r><w:t>Next</w:t></w:r></w:p></w:body></w:document>')
    return r


def test_cells(spark, root):
    rows = cells(listed(spark, str(root))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert [(r["column"], r["row_ord"], r["raw"]) for r in by["a.csv"]] == [("x", 0, "1"), ("y", 0, "2"), ("x", 1, "3"), ("y", 1, "")]
    assert len(by["b.tsv"]) == 2
    assert {by[n][0]["status"] for n in ("twice.csv", "bad.json")} == {"unreadable"}
    assert by["model.pkl"][0]["status"] == "never_opened" and by["old.sas7bdat"][0]["status"] == "unsupported"
    tree = {r["pointer"]: r["raw"] for r in by["t.json"]}
    assert tree["/a/0"] == "0.910" and tree["/a/1"] == "1e-7" and tree["/a/2"] == "9007199254740993.0" and tree["/b~0~1c"] == "true" and tree["/d"] is None
    assert {(r["column"], r["row_ord"]): (r["raw"], r["is_container"]) for r in by["p.parquet"]}[("l", 0)] == (None, True)
    assert {tuple(r["index"]): r["raw"] for r in by["n.npy"]} == {(0, 0): "1.5", (0, 1): "2", (1, 0): "3", (1, 1): "4.25"}
    assert {r["table_name"] for r in by["z.npz"]} == {"first"}
    assert [(r["table_name"], r["column"], r["raw"]) for r in by["d.sqlite"]] == [('odd "name', "k", "1"), ('odd "name', "v", "2.5"), ('odd "name', "k", None), ('odd "name', "v", "3")]
    assert shallowest_results(listed(spark, str(root))).count() > 0


def test_pages(spark, root):
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in page_texts(listed(spark, str(root))).collect()}
    assert got.pop("b.tsv") == "x | y\n1 | 2"
    assert {k: v for k, v in got.items() if not k.endswith(".csv")} == {"page.html": "Head & tail\nOne\ntwo", "article.xml": "On it\nFirst.\nSecond one.", "doc.docx": "Kept\nNext"}


def test_small_parts():
    assert sniff("a;b;c,d", "csv") == ";" and render(2.0)[0] == "2" and render(True)[0] == "true" and render([1])[2]
    assert trees.leaves('{"a": 1, "a": 2}') is None and trees.leaves("[NaN]") is None and trees.leaves(None) is None and trees.leaves("[" * 500 + "]" * 500) is None
    assert trees.pattern("/a/0/b/12") == "/a/*/b/*"
    assert holds_text("é".encode()) and not holds_text(b"\x00\x01")
    tex = "\\newcommand{\\n}{forty}\nWe saw \\n{} cases~\\cite{a}. % hidden\n\\input{part}\n"
    assert pages.tex_lines(tex, {"part": "Then \\emph{more}."})[-2:] == [(2, "We saw forty cases ."), (3, "Then more.")]
    q = pages.quotations("He wrote ``so it is said'' \\cite{one,two}.\n\\begin{quote}A ``nested'' one\\end{quote}")
    assert [(x["form"], x["keys"]) for x in q] == [("latex", ["one", "two"]), ("environment", ["one", "two"])]
    assert [e["cite_key"] for e in pages.bib_entries("@a{k1, t={x}}\n@b{open, t={\n@c{k2, t={y}}")] == ["k1", "k2"]


def test_yaml_where_there_is_a_reader():
    pytest.importorskip("yaml")
    assert {x["pointer"]: x["raw"] for x in trees.leaves("a: 0.910\nb: [1, yes]\n", "yaml")}["/a"] == "0.910"
    assert trees.leaves("a: 1\na: 2\n", "yaml") is None and trees.leaves("a: &x 1\nb: *x\n", "yaml") is None


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    sinks.append_events(path, [{"event": "seal", "note": "ünïcode \u2028 line"}, {"event": "run"}])
    head = sinks.append_events(path, [{"event": "claim"}])
    lines = ledger_lines(spark, str(tmp_path))
    heads = spark.createDataFrame([("file:" + path, head["count"], head["head"], 1)], "ledger string, count long, head string, canon_version int")
    row = verify_chain(lines, heads).collect()[0]
    assert (row["status"], row["n_lines"]) == ("intact", 3)
    raw = open(path, encoding="utf-8").read()
    open(path, "w", encoding="utf-8").write(raw.replace('"run"', '"Run"'))
    assert verify_chain(ledger_lines(spark, str(tmp_path)), heads).collect()[0]["status"] == "edited"
    open(path, "w", encoding="utf-8").write("\n".join(raw.split("\n")[:2]))
    assert verify_chain(ledger_lines(spark, str(tmp_path)), heads).collect()[0]["status"] == "truncated"
    open(path, "w", encoding="utf-8").write(raw + "not json\n")
    assert verify_chain(ledger_lines(spark, str(tmp_path)), heads).collect()[0]["status"] == "corrupt"
    with pytest.raises(ValueError):
        sinks.append_events(path, [{"event": "late"}])


def test_sinks(spark):
    d = spark.createDataFrame([("c1", 0, "verified", "value_match", "1", "1"), ("c2", 0, "verified", "value_mismatch", None, "1"), (None, 0, "odd", "x", None, None)], "claim_id string, ord int, outcome string, reason string, stored string, reported string")
    assert json.loads(sinks.check_records(d, "p", "now").filter("claim_id = 'c1'").collect()[0]["record"])["outcome"] == "verified"
    assert sorted(r["problem"] for r in sinks.record_problems(d).collect()) == ["no claim", "unknown outcome", "verified without a match"]
    v = spark.createDataFrame([("strict", "error", "mismatch", "c1")], "profile string, severity string, fact string, subject string")
    assert json.loads(sinks.sarif(v).collect()[0]["result"])["level"] == "error"
    e = spark.createDataFrame([("a", "File", "{}"), ("a", "File", "{}"), ("b", "File", "{}"), ("b", "Dataset", "{}")], "id string, type string, properties string")
    assert {r["id"]: r["conflict"] for r in sinks.ro_crate(e).collect()} == {"a": False, "b": True}
    old = spark.createDataFrame([("x", 1, "a")], "k string, at int, s string")
    assert {(r["k"], r["s"]) for r in sinks.merge_latest(old, spark.createDataFrame([("x", 2, "b"), ("y", 1, "c")], old.schema), ["k"], "at").collect()} == {("x", "b"), ("y", "c")}


def test_bytes_beyond_a_block(tmp_path):
    p = tmp_path / "long.txt"
    p.write_text("first\n" + "x" * 200_000 + "\n\n")
    assert sinks.last_line(str(p)) == "x" * 200_000
    assert io.BytesIO(b"").read() == b""


def _pdf(pages):
    """A small PDF: one compressed stream a page, the second font with a map of its own."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    objects[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    kids = []
    for i, ops in enumerate(pages):
        data = zlib.compress(ops)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, b) for n, b in objects.items()) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def test_pdf():
    from probatum.sources.pdf import pdf_pages

    one = rb"BT /F1 12 Tf 72 700 Td (The mean \(n = 40\)) Tj 0 -14 Td [(was) -250 (4) 20 (.2)] TJ ET"
    two = b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 1 0 0 1 99 700 Tm <00030004> Tj ET"
    assert pdf_pages(_pdf([one, two])) == ["The mean (n = 40)\nwas 4.2", "\u00e9a bc"]
    assert pdf_pages(_pdf([])) == []
    with pytest.raises(ValueError):
        pdf_pages(b"no pdf")


def _rds(columns, version=3):
    import gzip
    import struct

    i = lambda n: struct.pack(">i", n)
    chars = lambda s: i(9 | 64 << 12) + (i(-1) if s is None else i(len(s.encode())) + s.encode())
    strings = lambda xs: i(16) + i(len(xs)) + b"".join(map(chars, xs))
    tagged = lambda name, value: i(2 | 0x400) + i(1) + chars(name) + value
    body = i(19 | 0x300) + i(len(columns))
    for values in columns.values():
        if isinstance(values, tuple):  # a factor
            codes, levels = values
            body += i(13 | 0x300) + i(len(codes)) + b"".join(map(i, codes)) + tagged("levels", strings(levels)) + tagged("class", strings(["factor"])) + i(254)
        elif all(v is None or isinstance(v, int) for v in values):
            body += i(13) + i(len(values)) + b"".join(i(-(1 << 31)) if v is None else i(v) for v in values)
        elif all(v is None or isinstance(v, float) for v in values):
            body += i(14) + i(len(values)) + b"".join(b"\x7f\xf0\x00\x00\x00\x00\x07\xa2" if v is None else struct.pack(">d", v) for v in values)
        else:
            body += strings(values)
    body += tagged("names", strings(list(columns))) + tagged("class", strings(["data.frame"])) + tagged("row.names", i(13) + i(2) + i(-(1 << 31)) + i(-2)) + i(254)
    head = b"X\n" + i(version) + i(0x00040301) + i(0x00030500) + (i(5) + b"UTF-8" if version == 3 else b"")
    return gzip.compress(head + body)


def test_statistics_files(spark, tmp_path):
    from probatum.sources.statistics_files import r_frame

    (tmp_path / "d.rds").write_bytes(_rds({"k": ["a", None], "v": [0.5, None], "n": [7, None], "f": ([2, 1], ["lo", "hi"])}))
    (tmp_path / "e.rds").write_bytes(b"nothing")
    import pandas as pd

    pd.DataFrame({"site": pd.Series([1, 2], dtype="int8"), "x": pd.Series([0.1, 2.5], dtype="float32"), "s": ["p", "q"]}).to_stata(tmp_path / "t.dta", write_index=False, value_labels={"site": {1: "north", 2: "south"}})
    (tmp_path / "p.pdf").write_bytes(_pdf([b"BT /F1 12 Tf (A page) Tj ET"]))
    (tmp_path / "s.sav").write_bytes(b"$FL2")
    files = listed(spark, str(tmp_path))
    got = {(r["path"].rsplit("/", 1)[1], r["row_ord"], r["column"]): r["raw"] for r in cells(files).filter("status = 'ok'").collect()}
    assert got["d.rds", 0, "k"] == "a" and got["d.rds", 1, "k"] is None and got["d.rds", 0, "v"] == "0.5" and got["d.rds", 1, "v"] is None
    assert got["d.rds", 0, "n"] == "7" and got["d.rds", 0, "f"] == "hi" and got["d.rds", 1, "f"] == "lo"
    assert got["t.dta", 0, "site"] == "1" and got["t.dta", 0, "x"] == "0.1" and got["t.dta", 1, "x"] == "2.5" and got["t.dta", 1, "s"] == "q"
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in cells(files).filter("status <> 'ok'").collect()}
    assert status["e.rds"] == "unreadable" and status["p.pdf"] == "text" and status["s.sav"] in ("extractor_missing", "unreadable")
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in page_texts(files).collect()} == {"p.pdf": "A page"}
    assert page_texts(files, {"pdf": ("mine", lambda c: "other")}).first()["text"] == "other"
    assert r_frame(_rds({"a": [1, 2]}, 2), frozenset()) == ([], [])
