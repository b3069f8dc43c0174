"""Verification queries: locate a stored value, compare it exactly with a printed one, decide, assess."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions.exact import agrees, mean_agrees, rendered, shift_of, within, within_decimals
from probatum.operators.aggregate import STATISTICS, exact_median, exact_statistics, statistic_agrees
from probatum.operators.correspond import side_pairs, verdicts
from probatum.operators.decide import aliases, decide, locate_rows, misplaced, outcome_counts, pin_state
from probatum.operators.policy import PROFILES, assess, only_stricter, policy_rules, violations
from probatum.operators.ranking import numbered
from probatum.session import table

_MONEY = "decimal(18,2)"


def _order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per order: its total printed to one place, every seventh off by 0.1, every eleventh about no order,
    every thirteenth addressed by its customer, who may have several orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(_MONEY).alias("total"))
    key = F.col("o_orderkey")
    printed = F.round("total", 1) + F.when(key % 7 == 0, F.lit("0.1").cast("decimal(3,1)")).otherwise(F.lit("0.0").cast("decimal(3,1)"))
    return o.select(
        F.concat(F.lit("c"), key).alias("claim_id"),
        F.when(key % 13 == 0, "o_custkey").otherwise("o_orderkey").alias("addressed"),
        F.when(key % 11 == 0, -key).when(key % 13 == 0, F.col("o_custkey")).otherwise(key).alias("wanted"),
        printed.cast("string").alias("reported"),
        (key % 5 == 0).alias("confirmatory"),
    )


def _order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _order_claims(spark, sf_dir)
    cells = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(_MONEY).cast("string").alias("value"))
    parts = [decide(locate_rows(claims.filter(F.col("addressed") == c), cells, [("wanted", c)], "value")) for c in ("o_orderkey", "o_custkey")]
    return parts[0].unionByName(parts[1])


def verify_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_decisions(spark, sf_dir).select("claim_id", "resolution", "stored", "reported", "outcome", "reason")


_CLAIMS_SQL = """
claims AS (
  SELECT 'c' || o_orderkey AS claim_id,
         CASE WHEN o_orderkey % 13 = 0 THEN 'o_custkey' ELSE 'o_orderkey' END AS addressed,
         CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey WHEN o_orderkey % 13 = 0 THEN o_custkey ELSE o_orderkey END AS wanted,
         round(CAST(o_totalprice AS DECIMAL(18,2)), 1) + CASE WHEN o_orderkey % 7 = 0 THEN 0.1 ELSE 0.0 END AS r,
         o_orderkey % 5 = 0 AS confirmatory
  FROM orders),
places AS (
  SELECT 'o_orderkey' AS addressed, o_orderkey AS wanted, count(*) AS n, min(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY o_orderkey
  UNION ALL SELECT 'o_custkey', o_custkey, count(*), min(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders GROUP BY o_custkey),
decided AS (
  SELECT claim_id, confirmatory, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution,
         CASE WHEN n = 1 THEN CAST(s AS VARCHAR) END AS stored, CAST(CAST(r AS DECIMAL(18,1)) AS VARCHAR) AS reported,
         CASE WHEN n IS NULL OR n > 1 THEN 'not_found' WHEN 2 * abs(s - r) <= 0.1 THEN 'verified' ELSE 'mismatch' END AS outcome,
         CASE WHEN n IS NULL THEN 'row_absent' WHEN n > 1 THEN 'row_ambiguous' WHEN 2 * abs(s - r) <= 0.1 THEN 'value_match' ELSE 'value_mismatch' END AS reason
  FROM claims LEFT JOIN places USING (addressed, wanted))
"""


def outcomes_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_counts(_order_decisions(spark, sf_dir))


def assess_policy_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _order_decisions(spark, sf_dir).select(F.col("claim_id").alias("subject"), F.col("outcome").alias("fact"), "confirmatory")
    return assess(facts, policy_rules(spark))


def stricter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that only the strict profile raises over the permissive one."""
    facts = _order_decisions(spark, sf_dir).select(F.col("claim_id").alias("subject"), F.col("outcome").alias("fact"), "confirmatory")
    return only_stricter(violations(facts, policy_rules(spark)), "permissive", "strict")


def _profiles_sql() -> str:
    rows = [line.split() for line in PROFILES.strip().splitlines()[1:]]
    values = ", ".join(f"('{p}', '{f}', {c}, '{s}')" for p, f, a, b in rows for c, s in (("false", a), ("true", b)))
    return f"rules(profile, fact, confirmatory, severity) AS (VALUES {values})"


def verify_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts addressed by their zero-based position in key order; positions past the end are absent."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast(_MONEY).alias("price"))
    rows = numbered(part, [], ["p_partkey"], "row").select("row", F.col("price").cast("string").alias("value"))
    claims = part.select(
        F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") * 2 - 2).alias("wanted"), F.round("price", 0).cast("decimal(18,0)").cast("string").alias("reported")
    )
    return decide(locate_rows(claims, rows, [("wanted", "row")], "value"), "row").select("claim_id", "stored", "reported", "outcome", "reason")


def verify_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended prices against list price times quantity, under absolute and relative tolerances."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.col("l_quantity").cast(_MONEY).alias("q"), F.col("l_extendedprice").cast(_MONEY).alias("stored"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").cast(_MONEY).alias("price"))
    j = line.join(part, "l_partkey").withColumn("reported", (F.col("q") * F.col("price")).cast(_MONEY))
    j = j.withColumn("mode", F.when(F.col("l_linenumber") % 2 == 0, "absolute").otherwise("relative"))
    tolerance = F.when(F.col("mode") == "absolute", F.lit("500.00")).otherwise(F.lit("0.05"))
    ok = within_decimals(F.col("stored"), F.col("reported"), "mode", tolerance)
    return j.withColumn("agrees", ok).groupBy("mode", "agrees").agg(F.count("*").alias("n"), F.sum("stored").alias("stored_sum"))


def verify_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts stored as fractions and printed as whole percentages, every ninth line one too high."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast(_MONEY).alias("d"))
    printed = (F.col("d") * 100).cast("decimal(18,0)") + F.when(F.col("l_orderkey") % 9 == 0, F.lit(1)).otherwise(F.lit(0))
    located = line.withColumn("reported", printed.cast("decimal(18,0)").cast("string")).withColumn("stored", F.col("d").cast("string")).withColumn("resolution", F.lit("resolved"))
    return outcome_counts(decide(located, agree=agrees("stored", "reported", shift_of(F.lit("percent")))), "l_linenumber", "outcome", "reason")


def verify_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals declared as reported to two places, a third of them printed to one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(_MONEY).alias("total"))
    printed = F.when(F.col("o_orderkey") % 3 == 0, F.round("total", 1).cast("decimal(18,1)").cast("string")).otherwise(F.col("total").cast("string"))
    located = o.select("o_orderkey", F.lit(2).alias("places"), F.col("total").cast("string").alias("stored"), printed.alias("reported"), F.lit("resolved").alias("resolution"))
    return misplaced(decide(located)).select("o_orderkey", "stored", "reported", "outcome", "reason")


def verify_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six statistics of extended prices per flag and status, printed to one place, those of returned lines off by one."""
    keys = ["l_returnflag", "l_linestatus"]
    line = table(spark, sf_dir, "lineitem").select(*keys, F.col("l_extendedprice").cast(_MONEY).alias("v"))
    stats = exact_statistics(line, keys, "v").join(exact_median(line, keys, "v"), keys)
    each = stats.withColumn("statistic", F.explode(F.array(*[F.lit(s) for s in STATISTICS])))
    value = (
        F.when(F.col("statistic") == "mean", F.col("sum") / F.col("n"))
        .when(F.col("statistic") == "median", F.col("median2") / 2)
        .when(F.col("statistic") == "count", F.col("n"))
        .when(F.col("statistic") == "sum", F.col("sum"))
        .when(F.col("statistic") == "min", F.col("min"))
        .otherwise(F.col("max"))
    )
    off = F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0))
    reported = F.round(value.cast("decimal(28,6)"), 1).cast("decimal(28,1)") + off
    each = each.withColumn("reported", reported.cast("decimal(28,1)"))
    named = {c: F.col(c) for c in ("sum", "n", "min", "max", "median2")}
    ok = statistic_agrees(F.col("statistic"), named, F.col("reported"))
    return each.withColumn("comparison", F.when(ok, "match").otherwise("mismatch")).select(*keys, "statistic", F.col("reported").cast("string").alias("reported"), "comparison")


def verify_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's total in three places: as stored, printed to one place, printed whole (every eighth off by three)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(_MONEY).alias("total"))
    whole = F.round("total", 0).cast("decimal(18,0)") + F.when(F.col("o_orderkey") % 8 == 0, F.lit(3)).otherwise(F.lit(0))
    side = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("string").alias("raw"))
    sides = o.select(
        F.col("o_orderkey").alias("claim_id"),
        F.array(side("file", F.col("total")), side("text", F.round("total", 1).cast("decimal(18,1)")), side("table", whole.cast("decimal(18,0)"))).alias("sides"),
    )
    return verdicts(side_pairs(sides))


def verify_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of ten to the -12 up to ten to the 30, written plainly or with an exponent, printed to four significant
    digits (a third of them one unit off), compared at printed precision, within an absolute and within a relative tolerance."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    m = 1000000 + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber")) % 9000000
    e = ((F.col("l_orderkey") + F.col("l_partkey")) % 43 - 12).cast("int")
    r = F.floor((m + 500) / 1000) + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)
    n = line.select("l_linenumber", m.cast("long").alias("m"), e.alias("e"), r.cast("long").alias("r"))
    # Seven digits before the point; where the exponent is negative, every other line writes all places out.
    written = lambda c, drop: F.concat(F.col(c).cast("string"), F.lit("e"), (F.col("e") - drop).cast("string"))
    n = n.withColumn("stored", F.when(F.col("l_linenumber") % 2 == 0, rendered(written("m", 6))).otherwise(written("m", 6)))
    n = n.withColumn("reported", F.when(F.col("l_linenumber") % 2 == 0, written("r", 3)).otherwise(F.concat(F.substring(F.col("r").cast("string"), 1, 1), F.lit("."), F.substring(F.col("r").cast("string"), 2, 9), F.lit("e"), (F.col("e") + F.length(F.col("r").cast("string")) - 4).cast("string"))))
    mode = F.when(F.col("l_linenumber") % 3 == 0, "absolute").when(F.col("l_linenumber") % 3 == 1, "relative").otherwise("printed")
    n = n.withColumn("mode", mode)
    tolerance = F.when(F.col("mode") == "absolute", F.concat(F.lit("7e"), (F.col("e") - 4).cast("string"))).otherwise("0.0002")
    n = n.withColumn("tolerance", tolerance).withColumn("agrees", F.when(F.col("mode") == "printed", agrees("stored", "reported")).otherwise(within("stored", "reported", "mode", "tolerance")))
    return n.groupBy("e", "mode").agg(F.count_if("agrees").alias("n_agree"), F.count_if(~F.col("agrees")).alias("n_differ"))


def verify_small_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of values of a few units in the fifteenth place, printed to the thirteenth, every fifth one unit off."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice").cast(_MONEY) * F.lit("0.0000000000001").cast("decimal(13,13)")).cast("decimal(28,15)").alias("v"))
    stats = exact_statistics(line, ["l_suppkey"], "v")
    units = F.floor(F.col("sum") * F.lit(10000000000000).cast("decimal(14,0)") / F.col("n") + F.lit("0.5").cast("decimal(2,1)")).cast("long") + F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)
    each = stats.withColumn("reported", F.concat(units.cast("string"), F.lit("e-13")))
    return each.select("l_suppkey", "n", "reported", mean_agrees(F.col("sum"), F.col("n"), "reported").alias("agrees"))


def pin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with a pinned digest against the bytes at their path: here, documents by path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "doc_path", F.sha2(F.col("text"), 256).alias("actual"))
    declared = docs.select(
        F.col("doc_path").alias("artifact_id"),
        F.when(F.col("doc_id") % 10 == 3, F.concat("doc_path", F.lit(".gone"))).otherwise(F.col("doc_path")).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.sha2(F.col("doc_path"), 256)).otherwise(F.col("actual")).alias("sha256"),
    )
    files = docs.select(F.col("doc_path").alias("path"), "actual")
    return pin_state(declared, files).select("artifact_id", "validity")


def artifact_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_path").alias("artifact_id"), F.sha2(F.col("text"), 256).alias("actual"))
    return aliases(docs)


def artifact_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pin states of the declared artifacts, those that share a digest named."""
    a = table(spark, sf_dir, "artifacts")
    shaped = F.coalesce(F.col("sha256").rlike("^[a-f0-9]{64}$"), F.lit(False))
    return a.groupBy(F.col("media_type"), F.col("basis"), shaped.alias("has_digest"), F.col("reviewed").isNotNull().alias("is_reviewed"), F.col("origin").isNotNull().alias("has_origin")).agg(
        F.count("*").alias("n"), F.countDistinct("sha256").alias("n_digests")
    )


QUERIES = {
    f.__name__: f
    for f in (
        verify_table_cells, outcomes_by_reason, assess_policy_profiles, stricter_violations, verify_positional, verify_tolerance,
        verify_conversion, verify_places, verify_aggregates, verify_correspondence, verify_exponents, verify_small_means, pin_states, artifact_aliases, artifact_pins,
    )
}

ORACLES = {
    "verify_table_cells": f"WITH {_CLAIMS_SQL} SELECT claim_id, resolution, stored, reported, outcome, reason FROM decided",
    "outcomes_by_reason": f"WITH {_CLAIMS_SQL} SELECT outcome, reason, count(*) AS n FROM decided GROUP BY ALL",
    "assess_policy_profiles": f"""
        WITH {_CLAIMS_SQL}, {_profiles_sql()},
        counted AS (SELECT outcome AS fact, confirmatory, count(*) AS n FROM decided GROUP BY ALL),
        graded AS (SELECT profile, CAST(coalesce(sum(CASE WHEN severity = 'error' THEN n END), 0) AS BIGINT) AS n_errors,
                          CAST(coalesce(sum(CASE WHEN severity = 'warning' THEN n END), 0) AS BIGINT) AS n_warnings
                   FROM rules LEFT JOIN counted USING (fact, confirmatory) GROUP BY profile),
        checked AS (SELECT count(*) AS n_checked FROM decided WHERE outcome IN ('verified', 'mismatch'))
        SELECT profile, n_errors, n_warnings, n_checked, n_errors = 0 AND n_checked > 0 AS passed FROM graded, checked""",
    "stricter_violations": f"""
        WITH {_CLAIMS_SQL}, {_profiles_sql()},
        graded AS (SELECT profile, severity, outcome AS fact, claim_id AS subject FROM decided JOIN rules ON outcome = fact AND decided.confirmatory = rules.confirmatory)
        SELECT fact, subject FROM graded WHERE profile = 'strict' AND severity = 'error'
        EXCEPT SELECT fact, subject FROM graded WHERE profile = 'permissive' AND severity = 'error'""",
    "verify_positional": """
        WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
        c AS (SELECT p_partkey AS claim_id, p_partkey * 2 - 2 AS wanted, CAST(round(price, 0) AS DECIMAL(18,0)) AS r FROM p)
        SELECT claim_id, CAST(p.price AS VARCHAR) AS stored, CAST(r AS VARCHAR) AS reported,
               CASE WHEN p.price IS NULL THEN 'not_found' WHEN 2 * abs(p.price - r) <= 1 THEN 'verified' ELSE 'mismatch' END AS outcome,
               CASE WHEN p.price IS NULL THEN 'row_absent' WHEN 2 * abs(p.price - r) <= 1 THEN 'value_match' ELSE 'value_mismatch' END AS reason
        FROM c LEFT JOIN p ON pos = wanted""",
    "verify_tolerance": """
        WITH j AS (SELECT l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS s,
                          CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS r
                   FROM lineitem JOIN part ON l_partkey = p_partkey),
        k AS (SELECT s, CASE WHEN l_linenumber % 2 = 0 THEN 'absolute' ELSE 'relative' END AS mode, r FROM j)
        SELECT mode, CASE WHEN mode = 'absolute' THEN abs(s - r) <= 500 ELSE abs(s - r) <= CAST(0.05 AS DECIMAL(3,2)) * abs(r) END AS agrees,
               count(*) AS n, sum(s) AS stored_sum FROM k GROUP BY ALL""",
    "verify_conversion": """
        WITH k AS (SELECT l_linenumber, CAST(l_discount AS DECIMAL(18,2)) * 100 AS s,
                          CAST(CAST(l_discount AS DECIMAL(18,2)) * 100 AS DECIMAL(18,0)) + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS r FROM lineitem)
        SELECT l_linenumber, CASE WHEN 2 * abs(s - r) <= 1 THEN 'verified' ELSE 'mismatch' END AS outcome,
               CASE WHEN 2 * abs(s - r) <= 1 THEN 'value_match' ELSE 'value_mismatch' END AS reason, count(*) AS n FROM k GROUP BY ALL""",
    "verify_places": """
        SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS stored,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS VARCHAR)
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS reported,
               CASE WHEN o_orderkey % 3 = 0 THEN 'mismatch' ELSE 'verified' END AS outcome,
               CASE WHEN o_orderkey % 3 = 0 THEN 'places_mismatch' ELSE 'value_match' END AS reason FROM orders""",
    "verify_aggregates": """
        WITH v AS (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem),
        s AS (SELECT l_returnflag, l_linestatus, sum(v) AS total, min(v) AS lo, max(v) AS hi, count(v) AS n,
                     quantile_disc(v, 0.5) AS m1, list_sort(list(v)) AS all_v FROM v GROUP BY ALL),
        m AS (SELECT *, (all_v[(n + 1) // 2] + all_v[n // 2 + 1]) AS median2 FROM s),
        e AS (SELECT l_returnflag, l_linestatus, statistic, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS off,
                     CASE statistic WHEN 'sum' THEN CAST(total AS DECIMAL(28,6)) WHEN 'min' THEN CAST(lo AS DECIMAL(28,6)) WHEN 'max' THEN CAST(hi AS DECIMAL(28,6))
                       WHEN 'count' THEN CAST(n AS DECIMAL(28,6)) WHEN 'median' THEN CAST(median2 AS DECIMAL(28,6)) / 2
                       ELSE CAST(CAST(total * 1000000 AS HUGEINT) // (n * 1) AS DECIMAL(38,0)) / 1000000 END AS value
              FROM m, (VALUES ('sum'), ('min'), ('max'), ('count'), ('mean'), ('median')) t(statistic))
        SELECT l_returnflag, l_linestatus, statistic, CAST(CAST(round(CAST(value AS DECIMAL(28,6)), 1) + off AS DECIMAL(28,1)) AS VARCHAR) AS reported,
               CASE WHEN off = 0 THEN 'match' ELSE 'mismatch' END AS comparison FROM e""",
    "verify_correspondence": """
        WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a, round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS b,
                          round(CAST(o_totalprice AS DECIMAL(18,2)), 0) + CASE WHEN o_orderkey % 8 = 0 THEN 3 ELSE 0 END AS c FROM orders),
        p AS (SELECT o_orderkey, (2 * abs(a - b) <= 0.1) AS ab, (2 * abs(a - c) <= 1) AS ac, (2 * abs(b - c) <= 1) AS bc FROM o)
        SELECT o_orderkey AS claim_id, CASE WHEN ab AND ac AND bc THEN 'match' ELSE 'mismatch' END AS comparison, CAST(3 AS BIGINT) AS n_pairs,
               CAST((NOT ab)::INT + (NOT ac)::INT + (NOT bc)::INT AS BIGINT) AS n_differing FROM p""",
    "verify_exponents": """
        WITH k AS (SELECT l_linenumber AS i, 1000000 + (l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 9000000 AS m, CAST((l_orderkey + l_partkey) % 43 - 12 AS INTEGER) AS e, l_partkey FROM lineitem),
        r AS (SELECT i, e, m, (m + 500) // 1000 + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS r, CASE i % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'relative' ELSE 'printed' END AS mode FROM k),
        a AS (SELECT e, mode, CASE mode WHEN 'absolute' THEN abs(m - r * 1000) <= 700 WHEN 'relative' THEN abs(m - r * 1000) * 5 <= r ELSE 2 * abs(m - r * 1000) <= 1000 END AS ok FROM r)
        SELECT e, mode, count(*) FILTER (ok) AS n_agree, count(*) FILTER (NOT ok) AS n_differ FROM a GROUP BY ALL""",
    "verify_small_means": """
        WITH v AS (SELECT l_suppkey, count(*) AS n, sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS cents FROM lineitem GROUP BY 1),
        u AS (SELECT l_suppkey, n, cents, CAST((2 * cents + 100 * n) // (200 * n) AS BIGINT) + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS units FROM v)
        SELECT l_suppkey, n, units || 'e-13' AS reported, 2 * abs(cents - n * units * 100) <= n * 100 AS agrees FROM u""",
    "pin_states": """
        SELECT doc_path AS artifact_id,
               CASE WHEN doc_id % 10 = 3 OR text IS NULL THEN 'artifact_absent' WHEN doc_id % 5 = 0 THEN 'unpinned_artifact'
                    WHEN doc_id % 7 = 0 THEN 'broken_pin' ELSE 'authoritative' END AS validity FROM documents""",
    "artifact_aliases": """
        WITH c AS (SELECT sha256(text) AS d, count(*) AS n_same, min(doc_path) AS class_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        SELECT doc_path AS artifact_id, class_id, n_same FROM documents JOIN c ON sha256(text) = d""",
    "artifact_pins": """
        SELECT media_type, basis, coalesce(regexp_full_match(sha256, '[a-f0-9]{64}'), false) AS has_digest, reviewed IS NOT NULL AS is_reviewed,
               origin IS NOT NULL AS has_origin, count(*) AS n, count(DISTINCT sha256) AS n_digests FROM artifacts GROUP BY ALL""",
}
