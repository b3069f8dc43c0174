"""Policies: tables that grade facts. Facts carry no verdict of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity of each fact under the three profiles: for any claim, and for confirmatory ones.
PROFILES = """
profile     fact                   any      confirmatory
permissive  mismatch               error    error
permissive  error                  error    error
permissive  not_found              warning  warning
permissive  unchecked              ignore   warning
permissive  not_offered            ignore   ignore
permissive  broken_pin             error    error
permissive  unpinned_artifact      warning  warning
permissive  artifact_absent        error    error
publication mismatch               error    error
publication error                  error    error
publication not_found              error    error
publication unchecked              warning  error
publication not_offered            warning  error
publication broken_pin             error    error
publication unpinned_artifact      warning  warning
publication artifact_absent        error    error
strict      mismatch               error    error
strict      error                  error    error
strict      not_found              error    error
strict      unchecked              error    error
strict      not_offered            error    error
strict      broken_pin             error    error
strict      unpinned_artifact      error    error
strict      artifact_absent        error    error
"""


def policy_rules(spark: SparkSession) -> DataFrame:
    """(profile, fact, confirmatory, severity)."""
    rows = [line.split() for line in PROFILES.strip().splitlines()[1:]]
    return spark.createDataFrame(
        [(p, f, conf, sev) for p, f, a, c in rows for conf, sev in ((False, a), (True, c))],
        "profile string, fact string, confirmatory boolean, severity string",
    )


def violations(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts(subject, fact, confirmatory) graded by every profile: (profile, severity, fact, subject)."""
    graded = facts.join(F.broadcast(rules), ["fact", "confirmatory"])  # rules: a fixed table of some fifty rows
    return graded.filter("severity <> 'ignore'").select("profile", "severity", "fact", "subject")


def assess(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per profile: errors, warnings, checks made, and whether it passes.

    A run that evaluated nothing is no pass. Facts are counted before they meet the rules.
    """
    counted = facts.groupBy("fact", "confirmatory").agg(F.count("*").alias("n"))
    # A verified assertion is graded by no rule, and is a check all the same.
    ungraded = rules.filter("fact = 'mismatch'").withColumns({"fact": F.lit("verified"), "severity": F.lit("ignore")})
    graded = rules.unionByName(ungraded).join(counted, ["fact", "confirmatory"], "left")
    return (
        graded.groupBy("profile")
        .agg(
            F.sum(F.when(F.col("severity") == "error", F.coalesce("n", F.lit(0))).otherwise(0)).alias("n_errors"),
            F.sum(F.when(F.col("severity") == "warning", F.coalesce("n", F.lit(0))).otherwise(0)).alias("n_warnings"),
            F.sum(F.when(F.col("fact").isin("verified", "mismatch"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("n_checked"),
        )
        .withColumn("passed", (F.col("n_errors") == 0) & (F.col("n_checked") > 0))
    )


def only_stricter(graded: DataFrame, weaker: str, stricter: str) -> DataFrame:
    """Violations that are errors under the stricter profile and not under the weaker."""
    errors = lambda p: graded.filter((F.col("profile") == p) & (F.col("severity") == "error")).select("fact", "subject")
    return errors(stricter).distinct().join(errors(weaker).distinct(), ["fact", "subject"], "left_anti")


def numbers_limit(unbound: DataFrame, limit: int) -> DataFrame:
    """unbound(text_id, n_unbound) graded: more than limit is an error, any at all a warning."""
    return unbound.withColumn("severity", F.when(F.col("n_unbound") > limit, "error").when(F.col("n_unbound") > 0, "warning").otherwise("ignore"))


# What the profiles make of re-runs, freshness and corrected quotations; what is not named is no violation.
STATE_SEVERITIES = """
rule permissive publication strict
reproduction.changed error error error
reproduction.failed error error error
reproduction.unchecked warning warning error
reproduction.not_rerun ignore ignore warning
staleness.stale warning warning error
staleness.never_rerun ignore warning error
staleness.undetermined ignore warning error
citations.corrected ignore warning warning
"""


def state_rules(spark: SparkSession) -> DataFrame:
    """(profile, rule, severity) of the fixed table, a row each."""
    head, *rows = [line.split() for line in STATE_SEVERITIES.strip().splitlines()]
    return spark.createDataFrame([(p, r[0], s) for r in rows for p, s in zip(head[1:], r[1:])], "profile string, rule string, severity string")


def assess_states(states: DataFrame, rules: DataFrame) -> DataFrame:
    """states(area, state), a row per subject, against every profile: (profile, area, n_errors, n_warnings, n_states, passed).

    Subjects are counted by state before they meet the rules, fifty at most. A profile passes an area without an error.
    Null states are graded by no rule and counted.
    """
    counted = states.groupBy("area", "state").agg(F.count("*").alias("n")).withColumn("rule", F.concat_ws(".", "area", "state"))
    profiles = [r["profile"] for r in rules.select("profile").distinct().orderBy("profile").collect()]
    each = counted.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles]))).join(F.broadcast(rules), ["profile", "rule"], "left")
    out = each.groupBy("profile", "area").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("n_errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("n_warnings"),
        F.sum("n").alias("n_states"),
    )
    return out.withColumn("passed", F.col("n_errors") == 0)


def quotation_report(results: DataFrame, by: list[str]) -> DataFrame:
    """results(by..., state) as counters and verdicts: (by..., n, n_found, n_corrected, n_missing, n_unresolved, ok, strict_ok).

    A report without a quotation, or with none that was resolved, measured nothing and is no pass. strict_ok asks that
    nothing is left unresolved besides.
    """
    of = lambda *states: F.count_if(F.coalesce(F.col("state").isin(*states), F.lit(False)))
    out = results.groupBy(*by).agg(
        F.count("*").alias("n"), of("found").alias("n_found"), of("corrected").alias("n_corrected"), of("not found").alias("n_missing"),
        of("unchecked", "indeterminate", "ambiguous").alias("n_unresolved"),
    )
    ok = (F.col("n") > 0) & (F.col("n_unresolved") < F.col("n")) & (F.col("n_missing") == 0)
    return out.withColumn("ok", ok).withColumn("strict_ok", ok & (F.col("n_unresolved") == 0))
