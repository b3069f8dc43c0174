"""What leaves the engine: ledgers, check records, SARIF, RO-Crate, caches and latest states."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.operators.chain import CANON_VERSION, ZERO


def canonical(event: dict) -> str:
    """The one text an event is hashed as."""
    return json.dumps(event, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def append_events(path: str, events: list[dict]) -> dict:
    """Appends a batch of events to one chained ledger file and moves its head; a single writer, the batch bounded by the caller.

    Only the tail is read: the head tells count and last hash, and must fit the last line.
    """
    head_path = path + ".head"
    count, last = 0, ZERO
    if os.path.exists(head_path):
        with open(head_path, encoding="utf-8") as f:
            head = json.load(f)
        count, last = head["count"], head["head"]
        if hashlib.sha256((last_line(path) or "").encode()).hexdigest() != last:
            raise ValueError("the ledger's last line is not the one its head records")
    elif os.path.exists(path) and os.path.getsize(path):
        raise ValueError("the ledger has lines and no head")
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        for event in events:
            line = canonical(event | {"seq": count, "prev_hash": last})
            f.write(line + "\n")
            count, last = count + 1, hashlib.sha256(line.encode()).hexdigest()
    head = {"canon_version": CANON_VERSION, "count": count, "head": last}
    temporary = head_path + ".new"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(head, f)
    os.replace(temporary, head_path)
    return head


def last_line(path: str, block: int = 1 << 16) -> str | None:
    """The last line that is not blank, read backwards from the end."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        at, tail = f.tell(), b""
        while at:
            step = min(block, at)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
            lines = [x for x in tail.split(b"\n") if x.strip()]
            if len(lines) > 1 or (lines and not at):
                return lines[-1].decode("utf-8").strip()
    return None


def check_records(decisions: DataFrame, project: str, checked_at: str) -> DataFrame:
    """One flat interchange row per assertion, as JSON text; write with df.write.text or json."""
    fields = [c for c in ("claim_id", "ord", "outcome", "reason", "stored", "reported", "validity") if c in decisions.columns]
    row = F.struct(F.lit(1).alias("schema_version"), F.lit(project).alias("project"), F.lit(checked_at).alias("checked_at"), *fields)
    return decisions.select("claim_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("record"))


def record_problems(records: DataFrame) -> DataFrame:
    """Rows whose fields contradict each other: (claim_id, problem)."""
    problem = F.array_compact(
        F.array(
            F.when(F.col("claim_id").isNull(), F.lit("no claim")),
            F.when(~F.col("outcome").isin("verified", "mismatch", "not_found", "unchecked", "error", "not_offered"), F.lit("unknown outcome")),
            F.when((F.col("outcome") == "verified") & ~F.col("reason").isin("value_match", "passage_present"), F.lit("verified without a match")),
            F.when((F.col("outcome") == "mismatch") & F.col("reason").isin("value_match", "passage_present"), F.lit("mismatch with a match")),
        )
    )
    return records.select("claim_id", F.explode(problem).alias("problem"))


def sarif(violations: DataFrame) -> DataFrame:
    """SARIF results, one JSON text per rule: rules are few, their results are written as rows, not as one document."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    result = F.struct(F.col("fact").alias("ruleId"), level.alias("level"), F.struct(F.col("subject").alias("text")).alias("message"))
    return violations.select(F.col("fact").alias("rule_id"), F.to_json(result).alias("result"))


def ro_crate(entities: DataFrame) -> DataFrame:
    """entities(id, type, properties json) once each: (id, entity, conflict); conflict where one id is described in two ways."""
    return entities.groupBy("id").agg(F.min(F.to_json(F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), "properties"))).alias("entity"), (F.countDistinct("type", "properties") > 1).alias("conflict"))


def merge_latest(old: DataFrame, new: DataFrame, identity: list[str], at: str) -> DataFrame:
    """The latest row of each identity over the stored index and new rows."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (*identity, at)]
    return both.groupBy(*identity).agg(F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in rest])
