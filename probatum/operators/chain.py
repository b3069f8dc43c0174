"""Append-only ledgers as tables: hash chains, latest states, runs, seals, re-records.

A ledger's line is (ledger, n, raw, ...), n counting from 0. A line is compared with the one before it by
an equi-join on (ledger, n), so that one ledger of any length spreads over tasks. Null digests and unread
lines are faults, not missing rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.operators.ranking import numbered
from probatum.session import checkpointed

ZERO = "0" * 64
CANON_VERSION = 1


def with_previous(lines: DataFrame, keys: list[str], at: str, columns: dict[str, Column]) -> DataFrame:
    """lines with columns of the row before (at - 1) within keys, null at the first."""
    before = lines.select(*keys, (F.col(at) + 1).alias(at), *[c.alias(name) for name, c in columns.items()])
    return lines.join(before, [*keys, at], "left")


def verify_chain(lines: DataFrame, heads: DataFrame | None = None, ledger: str = "ledger") -> DataFrame:
    """Per ledger: status, lines, faulty lines and the first of them.

    lines(ledger, n, raw, prev_hash, seq, readable); heads(ledger, count, head, canon_version). The first fault
    seen names the status, corruption before all; an intact chain is held against its head.
    """
    own = lines.withColumn("_h", F.sha2(F.col("raw"), 256))
    linked = with_previous(own, [ledger], "n", {"_before": F.col("_h")})
    expected = F.when(F.col("n") == 0, ZERO).otherwise(F.col("_before"))
    fault = (
        F.when(~F.col("readable") | F.col("prev_hash").isNull(), "corrupt")
        .when(~F.col("prev_hash").eqNullSafe(expected), "edited")
        .when(F.col("seq").isNotNull() & (F.col("seq") != F.col("n")), "reordered")
    )
    seen = linked.withColumn("_fault", fault)
    each = seen.groupBy(ledger).agg(
        F.count("*").alias("n_lines"),
        F.count("_fault").alias("n_faults"),
        F.min(F.when(F.col("_fault").isNotNull(), F.col("n"))).alias("first_fault"),
        F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("n"))).alias("_first"),
        F.bool_or(F.coalesce(F.col("_fault") == "corrupt", F.lit(False))).alias("_corrupt"),
        F.max_by("_h", "n").alias("last_hash"),
    )
    status = F.when(F.col("_corrupt"), "corrupt").otherwise(F.col("_first"))
    if heads is None:
        return each.withColumn("status", F.coalesce(status, F.lit("no_anchor"))).drop("_first", "_corrupt")
    joined = each.join(heads.select(ledger, F.col("count").alias("_count"), F.col("head").alias("_head"), F.col("canon_version").alias("_canon")), ledger, "left")
    anchored = (
        F.when(F.col("_canon").isNotNull() & (F.col("_canon") != CANON_VERSION), "corrupt")
        .when(status.isNotNull(), status)
        .when(F.col("_canon").isNull(), "no_anchor")
        .when(F.col("n_lines") < F.col("_count"), "truncated")
        .when(F.col("n_lines") > F.col("_count"), "extended")
        .when(F.col("_head") != F.col("last_hash"), "edited")
        .otherwise("intact")
    )
    return joined.withColumn("status", anchored).drop("_first", "_corrupt", "_count", "_head", "_canon")


def diverge(one: DataFrame, other: DataFrame, ledger: str = "ledger") -> DataFrame:
    """Per ledger of either: the number of leading lines two copies have in common, and how many each holds."""
    a = one.select(ledger, "n", F.sha2("raw", 256).alias("_a"))
    b = other.select(ledger, "n", F.sha2("raw", 256).alias("_b"))
    return (
        a.join(b, [ledger, "n"], "full")
        .groupBy(ledger)
        .agg(F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("n"))).alias("_split"), F.count("_a").alias("n_one"), F.count("_b").alias("n_other"))
        .withColumn("n_common", F.coalesce("_split", F.col("n_one")))
        .drop("_split")
    )


def latest(events: DataFrame, identity: list[str], at: str, columns: list[str]) -> DataFrame:
    """The columns of the last event of each identity; partial maxima meet, no group is collected."""
    return events.groupBy(*identity).agg(F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in columns])


def earliest(events: DataFrame, identity: list[str], at: str, columns: list[str]) -> DataFrame:
    return events.groupBy(*identity).agg(F.min(at).alias(at), *[F.min_by(c, at).alias(c) for c in columns])


def changes(events: DataFrame, identity: list[str], order: list[str], state: str) -> DataFrame:
    """The events at which an identity's state differs from its state before (the first one included)."""
    ranked = numbered(events, identity, order, "_n")
    linked = with_previous(ranked, identity, "_n", {"_was": F.col(state), "_had": F.lit(True)})
    return linked.filter(F.col("_had").isNull() | ~F.col(state).eqNullSafe(F.col("_was"))).drop("_n", "_was", "_had")


def not_recorded(current: DataFrame, recorded: DataFrame, identity: list[str], state: str) -> DataFrame:
    """Rows of current whose state is not the latest recorded one: what a run has to append."""
    known = recorded.select(*identity, F.col(state).alias("_known"), F.lit(True).alias("_there"))
    joined = current.join(known, identity, "left")
    return joined.filter(F.col("_there").isNull() | ~F.col(state).eqNullSafe(F.col("_known"))).drop("_known", "_there")


def runs_after_seal(events: DataFrame, ledger: str = "ledger", seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Per ledger: runs, and runs with a seal before them."""
    first = events.filter(F.col(kind) == "seal").groupBy(ledger).agg(F.min(seq).alias("_seal"))
    runs = events.filter(F.col(kind) == "run").join(first, ledger, "left")
    return runs.groupBy(ledger).agg(F.count("*").alias("n_runs"), F.count_if(F.coalesce(F.col(seq) > F.col("_seal"), F.lit(False))).alias("n_sealed"))


def kinds_held(events: DataFrame, restarts: DataFrame, ledger: str = "ledger") -> DataFrame:
    """Event kinds a ledger held before its restart: (ledger, kind, n, first_seq); a ledger without a restart gives none.

    events(ledger, seq, kind), restarts(ledger, at): the number of the first event after the restart.
    """
    before = events.join(restarts.select(ledger, F.col("at").alias("_at")), ledger).filter(F.col("seq") < F.col("_at"))
    return before.groupBy(ledger, "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def rerecorded(recordings: DataFrame, seals: DataFrame, retirements: DataFrame, ledger: str = "ledger") -> DataFrame:
    """Paths that a later run recorded under other bytes without an input of the earlier run re-sealed between:
    (ledger, path, earlier_run, later_run), the latest pair of each path.

    recordings(ledger, path, seq, run_id, sha256); seals(ledger, path, seq, sha256); retirements(ledger, path, seq).
    """
    ranked = numbered(recordings.select(ledger, "path", "seq", "run_id", "sha256"), [ledger, "path"], ["seq"], "_n")
    pairs = with_previous(ranked, [ledger, "path"], "_n", {"_seq": F.col("seq"), "_run": F.col("run_id"), "_sha": F.col("sha256")})
    pairs = pairs.filter(F.col("_sha").isNotNull() & (F.col("_sha") != F.col("sha256")))
    retired = retirements.select(ledger, "path", F.col("seq").alias("_r"))
    kept = pairs.join(retired, (pairs[ledger] == retired[ledger]) & (pairs["path"] == retired["path"]) & (F.col("_r") > F.col("_seq")) & (F.col("_r") < F.col("seq")), "left_anti")
    # Seals that changed a path's bytes, with when that path was first sealed.
    s = numbered(seals.select(ledger, "path", "seq", "sha256"), [ledger, "path"], ["seq"], "_n")
    s = with_previous(s, [ledger, "path"], "_n", {"_was": F.col("sha256")})
    first = s.groupBy(ledger, "path").agg(F.min("seq").alias("_first"))
    changed = s.filter(F.col("_was").isNotNull() & (F.col("_was") != F.col("sha256"))).join(first, [ledger, "path"])
    # A seal between the two runs, of another path that was sealed before the first: the least such first sealing in a
    # range of the ledger. Ranges are put together from blocks of two to the power of k, a few for each level, and a
    # block keeps the least of all paths and the least of all others, so no pair of runs meets the seals themselves.
    levels = (seals.agg(F.max("seq")).first()[0] or 0).bit_length() + 1
    blocks = changed.select(ledger, "path", "_first", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_k"), "seq").withColumn("_b", F.expr("shiftright(cast(seq as bigint), _k)"))
    node = [ledger, "_k", "_b"]
    per_path = checkpointed(blocks.groupBy(*node, "path").agg(F.min("_first").alias("_first")))
    least = per_path.groupBy(*node).agg(F.min(F.struct("_first", "path")).alias("_m"))
    others = per_path.join(least, node).filter(F.col("path") != F.col("_m.path")).groupBy(*node).agg(F.min("_first").alias("_next"))
    least = least.join(others, node, "left").select(*node, F.col("_m.path").alias("_mp"), F.col("_m._first").alias("_mf"), "_next")
    parts = F.expr(
        f"flatten(transform(sequence(0, {levels}), k -> transform(filter(array("
        "struct(k as k, shiftright(_lo + shiftleft(1L, k) - 1, k) as b, shiftright(_hi, k) as e, true as l), "
        "struct(k as k, shiftright(_hi, k) - 1 as b, shiftright(_lo + shiftleft(1L, k) - 1, k) as e, false as l)), "
        "x -> if(x.l, x.b < x.e and x.b % 2 = 1, x.b >= x.e and x.b % 2 = 0)), x -> struct(x.k as _k, x.b as _b))))"
    )
    asked = kept.withColumn("_lo", F.col("_seq").cast("long") + 1).withColumn("_hi", F.col("seq").cast("long"))
    met = asked.select(ledger, "path", "seq", "_seq", F.explode(parts).alias("_n")).select(ledger, "path", "seq", "_seq", "_n.*").join(least, node)
    between = met.filter(F.when(F.col("_mp") != F.col("path"), F.col("_mf")).otherwise(F.col("_next")) < F.col("_seq")).select(ledger, "path", "seq").distinct()
    fresh = kept.join(between, [ledger, "path", "seq"], "left_anti")
    return fresh.groupBy(ledger, "path").agg(F.max_by("_run", "seq").alias("earlier_run"), F.max_by("run_id", "seq").alias("later_run"))


def superseded(claims: DataFrame, ledger: str = "ledger") -> DataFrame:
    """claims(ledger, seq, text) with the next later claim of the same text: (ledger, seq, by_seq)."""
    ranked = numbered(claims.select(ledger, "text", "seq"), [ledger, "text"], ["seq"], "_n")
    after = ranked.select(ledger, "text", (F.col("_n") - 1).alias("_n"), F.col("seq").alias("by_seq"))
    return ranked.join(after, [ledger, "text", "_n"]).select(ledger, "seq", "by_seq")


def precedes(earlier: Column, later: Column) -> Column:
    """Whether one written instant lies before another; false where either cannot be read or only one has a zone."""
    zoned = lambda c: c.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    a, b = F.try_to_timestamp(earlier), F.try_to_timestamp(later)
    return F.coalesce((zoned(earlier) == zoned(later)) & (a < b), F.lit(False))


def seen_before(runs: DataFrame, sightings: DataFrame, ledger: str = "ledger") -> DataFrame:
    """runs(ledger, seq, ts) with whether outcomes were seen before: by the earliest sighting(ledger, ts); null where unknown."""
    first = sightings.groupBy(ledger).agg(F.min("ts").alias("_seen"))
    return runs.join(first, ledger, "left").withColumn("exposed", F.col("_seen") < F.col("ts")).drop("_seen")
