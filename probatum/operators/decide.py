"""From locations and comparisons to decisions: three stages, one outcome that is only ever derived.

A row in gives a row out: absence, ambiguity and unreadable values are rows with a reason, never
missing rows. Nulls in an operand make the value not numeric; they never make it false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.exact import agrees, printed_places
from probatum.schema import ABSENT_REASON, RESOLUTION


def outcome(execution: Column, extraction: Column, comparison: Column) -> Column:
    return (
        F.when(execution == "failed", "error")
        .when(execution == "unavailable", "unchecked")
        .when(extraction == "not_attempted", "unchecked")
        .when(extraction.isin("absent", "invalid"), "not_found")
        .when(comparison == "match", "verified")
        .when(comparison == "mismatch", "mismatch")
        .otherwise("unchecked")
    )


def _lookup(column: Column, words: dict[str, str]) -> Column:
    out = None
    for k, v in words.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def resolution(matches: Column, container: Column | None = None) -> Column:
    """0 matches absent, 1 resolved, more ambiguous; a container is no scalar."""
    r = F.when(matches == 0, "absent").when(matches > 1, "ambiguous")
    return r.when(container, "not_scalar").otherwise("resolved") if container is not None else r.otherwise("resolved")


def locate_rows(claims: DataFrame, table: DataFrame, on: list[tuple[str, str]], value: str, claim_key: str = "claim_id") -> DataFrame:
    """claims with `stored` and `resolution`: the one cell of the rows that satisfy the equality predicate.

    on pairs claim columns with table columns. The table is reduced to one row per predicate value before
    the join (count and a value), so a value that repeats millions of times is never expanded.
    """
    keys = [t for _, t in on]
    once = table.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias("_value"))
    renamed = once.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", "_value")
    same = F.lit(True)
    for i, (c, _) in enumerate(on):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = claims.join(renamed, same, "left")
    n = F.coalesce("_n", F.lit(0))
    r = F.when((n == 1) & F.col("_value").isNull(), "absent").otherwise(resolution(n))
    return joined.withColumn("resolution", r).withColumn("stored", F.when(F.col("resolution") == "resolved", F.col("_value"))).drop(
        "_n", "_value", *[f"_k{i}" for i in range(len(keys))]
    )


def decide(located: DataFrame, kind: str = "table", reported: str = "reported", stored: str = "stored", agree: Column | None = None) -> DataFrame:
    """located with execution, extraction, comparison, outcome and reason.

    agree is the comparison of the two values, that at printed precision (of any number of digits) unless another is given.
    """
    # A column of its own, so that the comparison is made once however often it is asked.
    located = located.withColumn("_same", agrees(stored, reported) if agree is None else agree)
    same, res = F.col("_same"), F.col("resolution")
    numeric = same.isNotNull()
    extraction = F.when((res == "resolved") & ~numeric, "invalid").otherwise(_lookup(res, RESOLUTION))
    comparison = F.when((res != "resolved") | ~numeric, "not_applicable").when(same, "match").otherwise("mismatch")
    ambiguous = "passage_ambiguous" if kind == "prose" else "row_ambiguous"
    reason = (
        F.when(res == "absent", ABSENT_REASON[kind])
        .when(res == "ambiguous", ambiguous)
        .when(res == "not_scalar", "selector_not_scalar")
        .when(res == "invalid_selector", "row_selector_invalid")
        .when(~numeric, "value_not_numeric")
        .when(same, "value_match")
        .otherwise("value_mismatch")
    )
    out = located.withColumn("execution", F.lit("completed")).withColumn("extraction", extraction).withColumn("comparison", comparison)
    return out.withColumn("outcome", outcome(F.col("execution"), F.col("extraction"), F.col("comparison"))).withColumn("reason", reason).drop("_same")


def misplaced(decisions: DataFrame, places: str = "places", reported: str = "reported") -> DataFrame:
    """A declared number of places that the printed value does not have turns the decision to places_mismatch."""
    wrong = F.col(places).isNotNull() & (printed_places(F.col(reported)) != F.col(places)) & F.col("outcome").isin("verified", "mismatch")
    return (
        decisions.withColumn("reason", F.when(wrong, "places_mismatch").otherwise(F.col("reason")))
        .withColumn("comparison", F.when(wrong, "mismatch").otherwise(F.col("comparison")))
        .withColumn("outcome", F.when(wrong, "mismatch").otherwise(F.col("outcome")))
    )


def outcome_counts(decisions: DataFrame, *by: str) -> DataFrame:
    return decisions.groupBy(*(by or ("outcome", "reason"))).agg(F.count("*").alias("n"))


def pin_state(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """artifacts(artifact_id, path, sha256) with actual digest and validity, from files(path, actual)."""
    joined = artifacts.join(files.select("path", "actual"), "path", "left")
    validity = (
        F.when(F.col("actual").isNull(), "artifact_absent")
        .when(F.col("sha256").isNull(), "unpinned_artifact")
        .when(F.col("sha256") != F.col("actual"), "broken_pin")
        .otherwise("authoritative")
    )
    return joined.withColumn("validity", validity)


def aliases(states: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Artifacts that are one file or hold the same bytes: (key, class_id, n_same), one row per member of a class.

    Members of a class are not paired with each other; the class is named by its least member.
    """
    held = states.filter("actual is not null").select(key, "actual")
    classes = held.groupBy("actual").agg(F.count("*").alias("n_same"), F.min(key).alias("class_id")).filter("n_same > 1")
    return held.join(classes, "actual").select(key, "class_id", "n_same")
