"""Lineage: what rests on what, how far upstream, and how fresh it is."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.schema import AUTHORITY_RANK, FRESHNESS_RANK, rank_case
from probatum.session import checkpointed


def upstream(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(node, above, distance): everything node rests on, at its shortest distance; cycles end.

    edges(node, above), node resting directly on above. The frontier is joined with the edges until it
    adds nothing, visited pairs left out, each round cut off from the one before by a checkpoint.
    """
    direct = checkpointed(edges.select("node", "above").distinct())
    frontier = direct if starts is None else direct.join(starts.select("node").distinct(), "node", "left_semi")
    found = checkpointed(frontier.select("node", "above", F.lit(1).alias("distance")))
    frontier = found
    for distance in itertools.count(2):
        step = (
            frontier.select("node", F.col("above").alias("_via"))
            .join(direct.select(F.col("node").alias("_via"), "above"), "_via")
            .select("node", "above")
            .distinct()
            .join(found.select("node", "above"), ["node", "above"], "left_anti")
            .withColumn("distance", F.lit(distance))
        )
        frontier = checkpointed(step)
        if frontier.isEmpty():
            break
        found = checkpointed(found.unionByName(frontier))
    return found


def own_freshness(records: DataFrame, reruns: DataFrame, disk: DataFrame) -> DataFrame:
    """Each regeneration against its own re-runs: (regeneration, state, ran_at).

    records(regeneration, command, inputs, output), inputs a sorted array of artifact ids; disk(artifact, sha256);
    reruns(regeneration, seq, ran_at, command, read, expected, actual, reproduced), read a sorted array of
    'artifact=digest'. A file missing on disk leaves it undetermined; a later run of the same command over the
    same inputs that did not reproduce does too.
    """
    files = F.col("artifact")
    needed = records.select("regeneration", "command", "output", F.explode_outer("inputs").alias("artifact"))
    now = (
        needed.join(disk.withColumnRenamed("sha256", "_sha"), "artifact", "left")
        .groupBy("regeneration", "command", "output")
        .agg(
            F.sort_array(F.collect_list(F.when(files.isNotNull(), F.concat_ws("=", "artifact", "_sha")))).alias("declared"),
            F.count_if(files.isNotNull() & F.col("_sha").isNull()).alias("_missing"),
        )
        .join(disk.select(F.col("artifact").alias("output"), F.col("sha256").alias("written")), "output", "left")
    )
    joined = now.join(reruns.withColumnRenamed("command", "_cmd"), "regeneration", "left")
    same = (F.col("_cmd") == F.col("command")) & (F.col("read") == F.col("declared"))
    fits = same & F.col("reproduced") & ((F.col("written") == F.col("expected")) | (F.col("written") == F.col("actual")))
    each = joined.groupBy("regeneration").agg(
        F.max(F.when(F.col("reproduced"), F.col("seq"))).alias("_recorded"),
        F.max(F.when(fits, F.col("seq"))).alias("_fit"),
        F.max(F.when(same & ~F.col("reproduced"), F.col("seq"))).alias("_failed"),
        F.max_by("ran_at", F.when(F.col("reproduced"), F.col("seq"))).alias("ran_at"),
        F.first("_missing").alias("_missing"),
        F.bool_or(F.col("written").isNull()).alias("_unwritten"),
    )
    state = (
        F.when(F.col("_recorded").isNull(), "never_rerun")
        .when((F.col("_missing") > 0) | F.col("_unwritten"), "undetermined")
        .when(F.col("_fit").isNull(), "stale")
        .when(F.col("_failed") > F.col("_fit"), "undetermined")
        .otherwise("current")
    )
    return each.select("regeneration", state.alias("state"), "ran_at")


def worst_upstream(states: DataFrame, closure: DataFrame) -> DataFrame:
    """states(node, state) with the worst of its own and everything upstream, and the nearest node that causes it."""
    rank = F.expr(rank_case("state", FRESHNESS_RANK))
    own = states.select("node", F.col("node").alias("above"), F.lit(0).alias("distance"))
    reach = own.unionByName(closure.select("node", "above", "distance"))
    graded = reach.join(states.select(F.col("node").alias("above"), "state", rank.alias("_rank")), "above")
    return graded.groupBy("node").agg(F.min_by("state", "_rank").alias("state"), F.min(F.struct("_rank", "distance", "above"))["above"].alias("cause"))


def worst_through(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as worst_upstream(states, upstream(edges)) without the pairs of the closure: (node, state, cause).

    A node carries the worst state known to lie upstream, how far and where; in each round what the nodes directly above
    carry comes one step down, until nothing changes. A round costs the edges once, whatever lies above a node, and a
    node of many edges is a partial minimum. Cycles end, since a longer way to the same cause is never better.
    """
    links = checkpointed(edges.select("node", "above").distinct())
    rank = F.expr(rank_case("state", FRESHNESS_RANK))
    known = states.filter(rank.isNotNull()).select("node", F.struct(rank.alias("rank"), F.lit(0).alias("distance"), F.col("node").alias("cause"), "state").alias("w"))
    found = checkpointed(known.groupBy("node").agg(F.min("w").alias("w")))
    moved = found
    while not moved.isEmpty():
        one_on = F.col("w").withField("distance", F.col("w.distance") + 1)
        offered = links.join(moved.select(F.col("node").alias("above"), one_on.alias("w")), "above").groupBy("node").agg(F.min("w").alias("offer"))
        joined = checkpointed(found.join(offered, "node", "full").select("node", F.col("w").alias("was"), F.least("w", "offer").alias("w")))
        moved = joined.filter(F.col("was").isNull() | (F.col("w") < F.col("was"))).select("node", "w")
        found = joined.select("node", "w")
    return found.select("node", "w.state", F.col("w.cause").alias("cause"))


def weakest_authority(registrations: DataFrame, plan: str = "plan_id") -> DataFrame:
    """The weakest authority among the registrations of each plan: (plan, authority); one of an unknown kind is weaker than all."""
    rank = F.coalesce(F.expr(rank_case("authority", AUTHORITY_RANK)), F.lit(-1))
    return registrations.groupBy(plan).agg(F.min_by("authority", F.struct(rank, F.col("authority"))).alias("authority"))


def ordering(claims: DataFrame, outputs: DataFrame, plans: DataFrame) -> DataFrame:
    """Whether a confirmatory claim's evidence was produced after the plan it names: (claim_id, ordering, reason).

    claims(claim_id, confirmatory, artifact_id), a row per artifact read (null where none);
    outputs(artifact_id, run_id, plan_id, started_at, linked, changed); plans(plan_id, registered_at, validity).
    Several runs producing one artifact leave it open which did.
    """
    produced = outputs.groupBy("artifact_id").agg(
        F.count("*").alias("_runs"), *[F.first(c).alias(c) for c in ("plan_id", "started_at", "linked", "changed")]
    )
    j = claims.join(produced, "artifact_id", "left").join(plans, "plan_id", "left")
    reason = (
        F.when(~F.col("confirmatory"), "not_confirmatory")
        .when(F.col("artifact_id").isNull(), "no_evidence_offered")
        .when(F.col("_runs").isNull(), "no_run_record")
        .when(F.col("_runs") > 1, "ambiguous_producing_run")
        .when(~F.col("linked"), "run_output_unlinked")
        .when(F.col("changed"), "run_output_changed")
        .when(F.col("plan_id").isNull() | F.col("validity").isNull(), "no_registered_plan")
        .when(F.col("validity") == "unpinned_artifact", "registered_plan_unpinned")
        .when(F.col("validity") != "authoritative", "registered_plan_changed")
        .when(F.col("started_at").isNull() | F.col("registered_at").isNull(), "timestamp_missing")
        .when(F.col("started_at") < F.col("registered_at"), "run_precedes_registration")
        .otherwise("run_follows_registration")
    )
    priority = {r: i for i, r in enumerate(
        "not_confirmatory no_evidence_offered run_precedes_registration no_run_record ambiguous_producing_run run_output_unlinked "
        "run_output_changed no_registered_plan registered_plan_unpinned registered_plan_changed timestamp_missing run_follows_registration".split()
    )}
    each = j.withColumn("reason", reason).withColumn("_p", F.expr(rank_case("reason", priority)))
    out = each.groupBy("claim_id").agg(F.min_by("reason", "_p").alias("reason"))
    word = (
        F.when(F.col("reason") == "not_confirmatory", "not_applicable")
        .when(F.col("reason") == "run_precedes_registration", "violated")
        .when(F.col("reason") == "run_follows_registration", "ordered")
        .otherwise("unchecked")
    )
    return out.select("claim_id", word.alias("ordering"), "reason")
