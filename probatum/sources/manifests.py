"""Manifests: what a project claims, in files of YAML or JSON, as tables the engine reads.

A manifest names artifacts (id, path, digest) and claims with evidence: quote, metric (a pointer), table (column with
where or row), value (any address), correspondence (sides) and aggregate (members). Manifests are small and many:
they are read where they lie, on Arrow batches, and become rows keyed by project.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators.engine import EVIDENCE, verify
from probatum.session import checkpointed
from probatum.sources.files import cells, listed, page_texts
from probatum.sources.trees import Unreadable, load_json, load_yaml

_LOCATOR = "kind pointer table_name column predicate row array_name index before after form".split()
_EVIDENCE = "claim_id ord kind reported mode tolerance places statistic n_declared quote prefix suffix sides".split()
# Names of address kinds in manifests.
ADDRESS = {"tree": "pointer", "table": "table", "table_position": "row", "array": "array", "sheet": "table", "sqlite": "table", "prose": "prose"}
MODES = {"printed_precision": None, "absolute": "absolute", "relative": "relative"}


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _locator(given: dict) -> dict:
    out = dict.fromkeys(_LOCATOR)
    out["kind"] = ADDRESS.get(given.get("kind"))
    out["pointer"], out["column"] = given.get("pointer"), given.get("column")
    out["table_name"] = given.get("sheet") or given.get("table")
    out["predicate"] = {str(k): _text(v) for k, v in (given.get("where") or {}).items()} or None
    out["row"] = int(given["row"]) if given.get("row") is not None else None
    out["array_name"], out["index"] = given.get("array"), [int(i) for i in given["index"]] if given.get("index") is not None else None
    out["before"], out["after"], out["form"] = given.get("before"), given.get("after") or None, given.get("form")
    return out


def _side(given: dict, name: str, locator: dict | None) -> dict:
    return {"name": given.get("name") or name, "artifact_id": given.get("artifact"), "conversion": given.get("conversion"), "locator": locator}


def _evidence(claim: str, ord_: int, e: dict) -> dict:
    kind = e.get("kind")
    row = dict.fromkeys(_EVIDENCE) | {"claim_id": claim, "ord": ord_, "reported": _text(e.get("reported")), "mode": MODES.get(e.get("mode")), "tolerance": _text(e.get("tolerance"))}
    row["places"] = int(e["places"]) if e.get("places") is not None else None
    if kind == "quote":
        return row | {"kind": "quote", "quote": e.get("text"), "prefix": e.get("prefix"), "suffix": e.get("suffix"), "sides": [_side(e, "source", None)]}
    if kind == "metric":
        return row | {"kind": "value", "sides": [_side(e, "file", _locator({"kind": "tree", "pointer": e.get("pointer")}))]}
    if kind == "table":
        address = {"kind": "table" if e.get("where") else "table_position", "column": e.get("column"), "where": e.get("where"), "row": e.get("row")}
        return row | {"kind": "value", "sides": [_side(e, "file", _locator(address))]}
    if kind == "value":
        return row | {"kind": "value", "sides": [_side(e, "file", _locator(e.get("locator") or {}))]}
    if kind == "correspondence":
        return row | {"kind": kind, "sides": [_side(s, f"side {i}", _locator(s.get("locator") or {})) for i, s in enumerate(e.get("sides") or ())]}
    if kind == "aggregate":
        members = [_side(m | {"conversion": m.get("conversion") or e.get("conversion")}, f"member {i}", _locator(m.get("locator") or {})) for i, m in enumerate(e.get("members") or ())]
        return row | {"kind": kind, "statistic": e.get("statistic"), "n_declared": int(e["count"]) if e.get("count") is not None else None, "sides": members}
    return row | {"kind": None, "sides": []}


def problems(tree: dict) -> list[str]:
    """What makes a manifest invalid: repeated ids, members that are not the declared number or not distinct, sides alike."""
    out = []
    for part in ("artifacts", "claims", "runs", "regenerations"):
        ids = [x.get("id") for x in tree.get(part) or ()]
        out += [f"{part}: id {i!r} is declared more than once" for i in dict.fromkeys(ids) if ids.count(i) > 1]
    for claim in tree.get("claims") or ():
        for e in claim.get("evidence") or ():
            parts = e.get("members") or e.get("sides") or ()
            said = [json.dumps([p.get("artifact"), p.get("locator")], sort_keys=True) for p in parts]
            if e.get("kind") == "aggregate" and e.get("count") is not None and int(e["count"]) != len(parts):
                out.append(f"{claim.get('id')}: {len(parts)} members and a count of {e['count']}")
            if len(set(said)) != len(said):
                out.append(f"{claim.get('id')}: one address is named twice")
            if e.get("places") is not None and e.get("mode") not in (None, "printed_precision"):
                out.append(f"{claim.get('id')}: places without printed precision")
    return out


def parse(path: str, content: bytes) -> dict:
    """One manifest as {artifacts, evidence, problems}; paths are taken from the manifest's own folder."""
    folder = path.rsplit("/", 1)[0]
    try:
        text = content.decode("utf-8")
        tree = load_json(text) if path.endswith(".json") else load_yaml(text)
        if not isinstance(tree, dict):
            raise Unreadable("no manifest")
    except (Unreadable, UnicodeDecodeError) as e:
        return {"artifacts": [], "evidence": [], "problems": [str(e)[:300]]}
    artifacts = [
        {"artifact_id": a.get("id"), "path": f"{folder}/{a.get('path')}", "sha256": (a.get("digest") or {}).get("value") if isinstance(a.get("digest"), dict) else a.get("digest")}
        for a in tree.get("artifacts") or ()
    ]
    evidence = []
    for c in tree.get("claims") or ():
        given = c.get("evidence") or ()
        evidence += [_evidence(c.get("id"), i, e) for i, e in enumerate(given)] or [_evidence(c.get("id"), 0, {})]
    return {"artifacts": artifacts, "evidence": evidence, "problems": problems(tree)}


_PARSED = f"path string, artifacts array<struct<artifact_id:string,path:string,sha256:string>>, evidence array<struct<{EVIDENCE.replace(' string', ':string').replace(' int', ':int').replace('sides array', 'sides:array')}>>, problems array<string>"


def manifests(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, artifacts, evidence, problems) of every manifest under a folder; glob names the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p} | parse(p, bytes(c)) for p, c in zip(b["path"], b["content"])], columns=["path", "artifacts", "evidence", "problems"])

    return listed(spark, root, glob).select("path", "content").mapInPandas(run, _PARSED)


def verify_folder(spark: SparkSession, root: str, glob: str = "manifest.*") -> DataFrame:
    """Decisions for all evidence of all manifests under a folder: (project, claim_id, ord, ..., outcome, reason, validity).

    Ids are local to a manifest; manifests with problems give no decisions, ask manifests() for those.
    """
    m = checkpointed(manifests(spark, root, glob)).filter(F.size("problems") == 0)
    qualify = lambda c: F.concat_ws("\u0002", "project", c)
    rows = m.withColumnRenamed("path", "project")
    artifacts = rows.select("project", F.explode("artifacts").alias("a")).select(qualify("a.artifact_id").alias("artifact_id"), F.col("a.path").alias("path"), F.col("a.sha256").alias("sha256"))
    e = rows.select("project", F.explode("evidence").alias("e")).select("project", "e.*")
    named = F.transform("sides", lambda s: s.withField("artifact_id", F.concat_ws("\u0002", F.col("project"), s["artifact_id"])))
    evidence = e.withColumn("sides", named).withColumn("claim_id", qualify("claim_id")).drop("project").select(*_EVIDENCE)
    found = listed(spark, root)
    declared = found.join(artifacts.select("path").distinct(), "path", "left_semi")
    side = evidence.select(F.explode("sides").alias("s")).select("s.artifact_id", F.array_compact(F.array_union(F.array("s.locator.column"), F.coalesce(F.map_keys("s.locator.predicate"), F.array().cast("array<string>")))).alias("c"))
    # A file's own columns bound what is gathered here.
    wanted = side.join(artifacts, "artifact_id").select("path", F.explode("c").alias("c")).groupBy("path").agg(F.collect_set("c").alias("columns"))
    read = checkpointed(cells(declared, wanted))
    status = read.groupBy("path").agg(F.max(F.when(~F.col("status").isin("ok", "text"), F.col("status"))).alias("status"))
    files = found.select("path", F.col("sha256").alias("actual")).join(status, "path", "left")
    pages = page_texts(declared)
    texts = checkpointed(pages.select("path", "text").unionByName(declared.filter("format = 'prose'").join(pages.select("path"), "path", "left_anti").select("path", F.decode("content", "utf-8").alias("text"))))
    out = verify(evidence, artifacts, files, read, texts)
    parts = F.split("claim_id", "\u0002")
    return out.withColumn("project", parts[0]).withColumn("claim_id", parts[1])
