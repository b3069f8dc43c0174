"""Queries over ledgers and lineage. The events table is read as one ledger per user, in event order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators import chain
from probatum.operators.lineage import ordering, own_freshness, upstream, weakest_authority, worst_through
from probatum.operators.policy import assess_states, state_rules
from probatum.operators.ranking import numbered
from probatum.session import checkpointed, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ledger, n, event_id, ts, event_type, value, props, raw)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), "event_id", "ts", "event_type", "props")
    raw = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))
    return checkpointed(numbered(e.withColumn("raw", raw), ["ledger"], ["event_id"], "n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained lines, tampered with by rule: every 61st event links to nothing, every 83rd has a wrong number, every 211th cannot be read."""
    e = chain.with_previous(_events(spark, sf_dir), ["ledger"], "n", {"before": F.sha2("raw", 256)})
    i = F.col("event_id")
    return e.select(
        "ledger", "n", "raw",
        F.when(i % 61 == 0, F.lit("f" * 64)).otherwise(F.coalesce("before", F.lit(chain.ZERO))).alias("prev_hash"),
        F.when(i % 83 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("seq"),
        (i % 211 != 0).alias("readable"),
    )


def _heads(lines: DataFrame) -> DataFrame:
    """Heads as anchors would hold them: some ledgers have none, some a count too high or too low, some another digest."""
    h = lines.groupBy("ledger").agg(F.count("*").alias("c"), F.max_by(F.sha2("raw", 256), "n").alias("h")).filter("ledger % 5 <> 0")
    count = F.when(F.col("ledger") % 7 == 0, F.col("c") + 1).when(F.col("ledger") % 11 == 0, F.col("c") - 1).otherwise(F.col("c"))
    return h.select("ledger", count.alias("count"), F.when(F.col("ledger") % 13 == 0, F.lit("e" * 64)).otherwise(F.col("h")).alias("head"), F.lit(1).alias("canon_version"))


def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return chain.verify_chain(lines, _heads(lines)).select("ledger", "status", "n_lines", "n_faults", "first_fault", "last_hash")


_LINES_SQL = """
e AS (SELECT user_id AS ledger, event_id, ts, event_type, concat_ws('|', CAST(event_id AS VARCHAR), event_type, coalesce(props, '')) AS raw,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
l AS (SELECT ledger, n, raw, CASE WHEN event_id % 61 = 0 THEN repeat('f', 64) ELSE coalesce(lag(sha256(raw)) OVER w, repeat('0', 64)) END AS prev_hash,
             CASE WHEN event_id % 83 = 0 THEN n + 1 ELSE n END AS seq, event_id % 211 <> 0 AS readable, coalesce(lag(sha256(raw)) OVER w, repeat('0', 64)) AS expected
      FROM e WINDOW w AS (PARTITION BY ledger ORDER BY n))
"""


def chain_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ledger against a copy that lost its tail and had one event altered."""
    one = _events(spark, sf_dir).select("ledger", "n", "raw", "event_id")
    other = one.filter((F.col("n") < 40) | (F.col("ledger") % 2 == 0)).withColumn("raw", F.when(F.col("event_id") % 97 == 0, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))
    return chain.diverge(one, other)


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props")
    return chain.latest(e, ["user_id", "event_type"], "event_id", ["props"])


def first_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    return chain.earliest(e, ["user_id"], "event_id", ["event_type", "props"])


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a user's event type differs from the one before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return chain.changes(e, ["user_id"], ["event_id"], "event_type")


def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the later half of the events that differ from the latest state of the earlier half."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props")
    old = chain.latest(e.filter("event_id % 10 < 5"), ["user_id", "event_type"], "event_id", ["props"])
    new = chain.latest(e.filter("event_id % 10 >= 5"), ["user_id", "event_type"], "event_id", ["props"])
    return chain.not_recorded(new, old, ["user_id", "event_type"], "props").select("user_id", "event_type", "event_id", "props")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger events: seals, runs and retirements by event_id, each about one of three paths."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 4 == 0, "seal").when(F.col("event_id") % 29 == 1, "retire").otherwise("run")
    return e.select(
        "ledger", F.col("n").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("run_id"), "ts",
        F.concat(F.lit("p"), F.col("event_id") % 3).alias("path"), F.sha2((F.col("event_id") % 5).cast("string"), 256).alias("sha256"), "event_type",
    )


_KINDS_SQL = """
k AS (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, ts, event_type,
             CASE WHEN event_id % 4 = 0 THEN 'seal' WHEN event_id % 29 = 1 THEN 'retire' ELSE 'run' END AS kind, CAST(event_id AS VARCHAR) AS run_id,
             'p' || (event_id % 3) AS path, sha256(CAST(event_id % 5 AS VARCHAR)) AS sha FROM events)
"""


def runs_with_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.runs_after_seal(_kinds(spark, sf_dir))


def rerecorded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = checkpointed(_kinds(spark, sf_dir))
    of = lambda kind: k.filter(F.col("kind") == kind)
    return chain.rerecorded(of("run"), of("seal"), of("retire"))


def superseded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _kinds(spark, sf_dir).select("ledger", "seq", F.concat_ws(" ", "event_type", "path").alias("text"))
    return chain.superseded(k)


def exposure_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs per ledger before and after its outcomes were first seen (here: its first seal of path p0)."""
    k = checkpointed(_kinds(spark, sf_dir))
    runs = chain.seen_before(k.filter("kind = 'run'"), k.filter("kind = 'seal' and path = 'p0'"))
    return runs.groupBy("ledger").agg(F.count_if("exposed").alias("n_after"), F.count_if(~F.col("exposed")).alias("n_not_after"), F.count_if(F.col("exposed").isNull()).alias("n_unknown"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    return (
        n.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("above"))
        .unionByName(c.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("above")))
        .unionByName(s.select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("above")))
        .unionByName(n.filter("n_nationkey % 6 = 0").select(key("r", "n_regionkey").alias("node"), key("n", "n_nationkey").alias("above")))
    )


_EDGES_SQL = """
edges AS (SELECT DISTINCT node, above FROM (
  SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS above FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 0)),
walk AS (SELECT node, above, 1 AS distance FROM edges
         UNION SELECT w.node, e.above, w.distance + 1 FROM walk w JOIN edges e ON w.above = e.node WHERE w.distance < 12),
closure AS (SELECT node, above, min(distance) AS distance FROM walk GROUP BY ALL)
"""


def upstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upstream(_edges(spark, sf_dir))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    nodes = e.select("node").unionByName(e.select(F.col("above").alias("node"))).distinct()
    key = F.regexp_extract("node", r"\d+", 0).cast("int")
    kind = F.substring("node", 1, 1)
    return nodes.withColumn("state", F.when((kind == "n") & (key % 9 == 0), "stale").when((kind == "c") & (key % 10 == 0), "never_rerun").when((kind == "s") & (key % 10 == 1), "undetermined").otherwise("current"))


def staleness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_through(_states(spark, sf_dir), _edges(spark, sf_dir))


def assess_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The freshness of every node, upstream included, against every profile."""
    s = worst_through(_states(spark, sf_dir), _edges(spark, sf_dir))
    return assess_states(s.select(F.lit("staleness").alias("area"), "state"), state_rules(spark))


def kinds_before_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds each ledger held before its last seal of path p1, taken for a restart."""
    k = checkpointed(_kinds(spark, sf_dir))
    restarts = k.filter("kind = 'seal' and path = 'p1'").groupBy("ledger").agg(F.max("seq").alias("at"))
    return chain.kinds_held(k, restarts)


def weakest_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest authority among a customer's orders, priorities standing for authorities."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), (F.col("o_orderkey") % 6).alias("k"))
    names = ["self_recorded", "git_remote", "osf", "zenodo", "trusted_timestamp", "unknown"]
    authority = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") + 1).cast("int"))
    return weakest_authority(o.select("plan_id", authority.alias("authority")))


def freshness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regeneration per order, its customer's balance as input, its lines as recorded re-runs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("regeneration"), F.col("o_custkey").alias("cust"))
    records = o.select("regeneration", F.lit("make").alias("command"), F.array(F.concat(F.lit("cust"), "cust")).alias("inputs"), F.concat(F.lit("out"), "regeneration").alias("output"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("cust"), "c_custkey").alias("artifact"), F.when(F.col("c_custkey") % 17 != 0, (F.col("c_custkey") % 2).cast("string")).alias("sha256"))
    outs = o.select(F.concat(F.lit("out"), "regeneration").alias("artifact"), (F.col("regeneration").cast("long") % 3).cast("string").alias("sha256"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag").join(o.select(F.col("regeneration").cast("long").alias("l_orderkey"), "cust"), "l_orderkey")
    reruns = line.groupBy(F.col("l_orderkey").cast("string").alias("regeneration"), F.col("l_linenumber").alias("seq")).agg(
        F.max("l_shipdate").alias("ran_at"), F.max("cust").alias("cust"), F.max("l_returnflag").alias("flag")
    )
    reruns = reruns.select(
        "regeneration", "seq", "ran_at", F.lit("make").alias("command"),
        F.array(F.concat(F.lit("cust"), "cust", F.lit("="), (F.col("seq") % 2).cast("string"))).alias("read"),
        (F.col("seq") % 3).cast("string").alias("expected"), (F.col("seq") % 3).cast("string").alias("actual"), (F.col("flag") != "A").alias("reproduced"),
    )
    return own_freshness(records, reruns, c.unionByName(outs)).groupBy("state").agg(F.count("*").alias("n"))


def registration_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per customer about its orders' outputs, runs started at order dates, one plan per nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    claims = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.col("c_custkey").alias("claim_id"), (F.col("c_custkey") % 4 != 0).alias("confirmatory"), F.col("o_orderkey").alias("artifact_id")
    )
    outputs = o.join(c, o["o_custkey"] == c["c_custkey"]).filter("o_orderkey % 23 <> 0").select(
        F.col("o_orderkey").alias("artifact_id"), F.col("o_orderkey").alias("run_id"), F.col("c_nationkey").alias("plan_id"), F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderkey") % 19 != 0).alias("linked"), (F.col("o_orderkey") % 31 == 0).alias("changed"),
    )
    plans = table(spark, sf_dir, "nation").filter("n_nationkey % 8 <> 7").select(
        F.col("n_nationkey").alias("plan_id"), F.lit("1993-01-01").cast("timestamp").alias("registered_at"),
        F.when(F.col("n_nationkey") % 6 == 0, "unpinned_artifact").when(F.col("n_nationkey") % 6 == 1, "broken_pin").otherwise("authoritative").alias("validity"),
    )
    return ordering(claims, outputs, plans)


QUERIES = {
    f.__name__: f
    for f in (
        chain_verify, chain_divergence, latest_state, first_pins, state_changes, changed_only, runs_with_seal, rerecorded_paths, assess_freshness, kinds_before_restart, weakest_registrations,
        superseded_claims, exposure_ordering, upstream_closure, staleness_rollup, freshness_states, registration_ordering,
    )
}

ORACLES = {
    "assess_freshness": f"""
        WITH RECURSIVE {_EDGES_SQL},
        nodes AS (SELECT node FROM edges UNION SELECT above FROM edges),
        states AS (SELECT node, CASE WHEN node[1] = 'n' AND CAST(node[2:] AS INT) % 9 = 0 THEN 1 WHEN node[1] = 'c' AND CAST(node[2:] AS INT) % 10 = 0 THEN 2
                                     WHEN node[1] = 's' AND CAST(node[2:] AS INT) % 10 = 1 THEN 0 ELSE 3 END AS r FROM nodes),
        worst AS (SELECT s.node, least(s.r, coalesce(min(u.r), 3)) AS r FROM states s LEFT JOIN closure c ON c.node = s.node LEFT JOIN states u ON u.node = c.above GROUP BY s.node, s.r)
        SELECT profile, 'staleness' AS area,
               CAST(count(*) FILTER (profile = 'strict' AND r < 3) AS BIGINT) AS n_errors,
               CAST(count(*) FILTER ((profile = 'publication' AND r < 3) OR (profile = 'permissive' AND r = 1)) AS BIGINT) AS n_warnings, count(*) AS n_states,
               count(*) FILTER (profile = 'strict' AND r < 3) = 0 AS passed
        FROM worst, (VALUES ('permissive'), ('publication'), ('strict')) p(profile) GROUP BY profile""",
    "kinds_before_restart": f"""
        WITH {_KINDS_SQL}, r AS (SELECT ledger, max(seq) AS upto FROM k WHERE kind = 'seal' AND path = 'p1' GROUP BY ledger)
        SELECT k.ledger, kind, count(*) AS n, min(seq) AS first_seq FROM k JOIN r ON k.ledger = r.ledger AND seq < upto GROUP BY k.ledger, kind""",
    "weakest_registrations": """
        WITH a AS (SELECT o_custkey AS plan_id, o_orderkey % 6 AS k FROM orders), r AS (SELECT plan_id, min(CASE WHEN k = 5 THEN -1 WHEN k = 3 THEN 2.5 ELSE k END) AS m FROM a GROUP BY 1)
        SELECT plan_id, CASE m WHEN -1 THEN 'unknown' WHEN 0 THEN 'self_recorded' WHEN 1 THEN 'git_remote' WHEN 2 THEN 'osf' WHEN 2.5 THEN 'zenodo' ELSE 'trusted_timestamp' END AS authority FROM r""",
    "chain_verify": f"""
        WITH {_LINES_SQL},
        f AS (SELECT ledger, n, raw, CASE WHEN NOT readable THEN 'corrupt' WHEN prev_hash <> expected THEN 'edited' WHEN seq <> n THEN 'reordered' END AS fault FROM l),
        g AS (SELECT ledger, count(*) AS n_lines, count(fault) AS n_faults, min(CASE WHEN fault IS NOT NULL THEN n END) AS first_fault,
                     arg_min(fault, n) FILTER (fault IS NOT NULL) AS first, coalesce(bool_or(fault = 'corrupt'), false) AS bad, arg_max(sha256(raw), n) AS last_hash FROM f GROUP BY ledger)
        SELECT ledger, n_lines, n_faults, first_fault, last_hash,
               CASE WHEN bad THEN 'corrupt' WHEN first IS NOT NULL THEN first WHEN ledger % 5 = 0 THEN 'no_anchor'
                    WHEN ledger % 7 = 0 THEN 'truncated' WHEN ledger % 11 = 0 THEN 'extended' WHEN ledger % 13 = 0 THEN 'edited' ELSE 'intact' END AS status FROM g""",
    "chain_divergence": f"""
        WITH {_LINES_SQL}, d AS (SELECT ledger, n, (n < 40 OR ledger % 2 = 0) AS held, event_id % 97 = 0 AS altered FROM e)
        SELECT ledger, count(*) AS n_one, count(*) FILTER (held) AS n_other, coalesce(min(n) FILTER (NOT held OR altered), count(*)) AS n_common FROM d GROUP BY ledger""",
    "latest_state": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type",
    "first_pins": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(props, event_id) AS props FROM events GROUP BY user_id",
    "state_changes": """
        SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)
        WHERE was IS DISTINCT FROM event_type""",
    "changed_only": """
        WITH o AS (SELECT user_id, event_type, arg_max(props, event_id) AS p FROM events WHERE event_id % 10 < 5 GROUP BY ALL),
        n AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events WHERE event_id % 10 >= 5 GROUP BY user_id, event_type)
        SELECT n.* FROM n LEFT JOIN o USING (user_id, event_type) WHERE o.user_id IS NULL OR p IS DISTINCT FROM props""",
    "runs_with_seal": f"""
        WITH {_KINDS_SQL}, s AS (SELECT ledger, min(seq) AS s FROM k WHERE kind = 'seal' GROUP BY 1)
        SELECT ledger, count(*) AS n_runs, count(*) FILTER (seq > s) AS n_sealed FROM k LEFT JOIN s USING (ledger) WHERE kind = 'run' GROUP BY ledger""",
    "rerecorded_paths": f"""
        WITH {_KINDS_SQL},
        r AS (SELECT ledger, path, seq, run_id, sha, lag(seq) OVER w AS s0, lag(run_id) OVER w AS r0, lag(sha) OVER w AS h0 FROM k WHERE kind = 'run' WINDOW w AS (PARTITION BY ledger, path ORDER BY seq)),
        c AS (SELECT ledger, path, seq, sha, lag(sha) OVER w AS h0, min(seq) OVER (PARTITION BY ledger, path) AS first FROM k WHERE kind = 'seal' WINDOW w AS (PARTITION BY ledger, path ORDER BY seq))
        SELECT ledger, path, arg_max(r0, seq) AS earlier_run, arg_max(run_id, seq) AS later_run FROM r
        WHERE h0 IS NOT NULL AND h0 <> sha
          AND NOT EXISTS (SELECT 1 FROM k t WHERE t.kind = 'retire' AND t.ledger = r.ledger AND t.path = r.path AND t.seq > r.s0 AND t.seq < r.seq)
          AND NOT EXISTS (SELECT 1 FROM c WHERE c.h0 IS NOT NULL AND c.h0 <> c.sha AND c.ledger = r.ledger AND c.path <> r.path AND c.seq > r.s0 AND c.seq < r.seq AND c.first < r.s0)
        GROUP BY ledger, path""",
    "superseded_claims": f"""
        WITH {_KINDS_SQL}, n AS (SELECT ledger, seq, lead(seq) OVER (PARTITION BY ledger, event_type, path ORDER BY seq) AS by_seq FROM k)
        SELECT ledger, seq, by_seq FROM n WHERE by_seq IS NOT NULL""",
    "exposure_ordering": f"""
        WITH {_KINDS_SQL}, s AS (SELECT ledger, min(ts) AS seen FROM k WHERE kind = 'seal' AND path = 'p0' GROUP BY 1)
        SELECT ledger, count(*) FILTER (seen < ts) AS n_after, count(*) FILTER (NOT seen < ts) AS n_not_after, count(*) FILTER (seen IS NULL) AS n_unknown
        FROM k LEFT JOIN s USING (ledger) WHERE kind = 'run' GROUP BY ledger""",
    "upstream_closure": f"WITH RECURSIVE {_EDGES_SQL} SELECT node, above, distance FROM closure",
    "staleness_rollup": f"""
        WITH RECURSIVE {_EDGES_SQL},
        nodes AS (SELECT node FROM edges UNION SELECT above FROM edges),
        st AS (SELECT node, CASE WHEN node LIKE 'n%' AND CAST(node[2:] AS INT) % 9 = 0 THEN 'stale' WHEN node LIKE 'c%' AND CAST(node[2:] AS INT) % 10 = 0 THEN 'never_rerun'
                                 WHEN node LIKE 's%' AND CAST(node[2:] AS INT) % 10 = 1 THEN 'undetermined' ELSE 'current' END AS state FROM nodes),
        rk AS (SELECT node, state, CASE state WHEN 'undetermined' THEN 0 WHEN 'stale' THEN 1 WHEN 'never_rerun' THEN 2 ELSE 3 END AS rank FROM st),
        reach AS (SELECT node, node AS above, 0 AS distance FROM nodes UNION ALL SELECT node, above, distance FROM closure)
        SELECT reach.node, arg_min(rk.state, rk.rank) AS state, (min({{'r': rk.rank, 'd': distance, 'a': above}})).a AS cause FROM reach JOIN rk ON above = rk.node GROUP BY reach.node""",
    "freshness_states": """
        WITH r AS (SELECT l_orderkey, l_linenumber AS seq, max(l_returnflag) <> 'A' AS reproduced FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
        j AS (SELECT o_orderkey, o_custkey % 17 = 0 AS missing, seq, reproduced, seq % 2 = o_custkey % 2 AND o_custkey % 17 <> 0 AS same, seq % 3 = o_orderkey % 3 AS fits
              FROM orders LEFT JOIN r ON l_orderkey = o_orderkey),
        g AS (SELECT o_orderkey, bool_or(missing) AS missing, max(seq) FILTER (reproduced) AS recorded, max(seq) FILTER (same AND reproduced AND fits) AS fit,
                     max(seq) FILTER (same AND NOT reproduced) AS failed FROM j GROUP BY 1)
        SELECT CASE WHEN recorded IS NULL THEN 'never_rerun' WHEN missing THEN 'undetermined' WHEN fit IS NULL THEN 'stale' WHEN failed > fit THEN 'undetermined' ELSE 'current' END AS state,
               count(*) AS n FROM g GROUP BY 1""",
    "registration_ordering": """
        WITH out AS (SELECT o_orderkey AS a, c_nationkey AS plan, o_orderdate AS t, o_orderkey % 19 <> 0 AS linked, o_orderkey % 31 = 0 AS changed FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 23 <> 0),
        p AS (SELECT n_nationkey AS plan, n_nationkey % 6 AS m FROM nation WHERE n_nationkey % 8 <> 7),
        j AS (SELECT c_custkey AS claim_id, CASE
                WHEN c_custkey % 4 = 0 THEN 'a|not_applicable|not_confirmatory' WHEN o_orderkey IS NULL THEN 'b|unchecked|no_evidence_offered'
                WHEN out.a IS NULL THEN 'd|unchecked|no_run_record' WHEN NOT linked THEN 'f|unchecked|run_output_unlinked' WHEN changed THEN 'g|unchecked|run_output_changed'
                WHEN m IS NULL THEN 'h|unchecked|no_registered_plan' WHEN m = 0 THEN 'i|unchecked|registered_plan_unpinned' WHEN m = 1 THEN 'j|unchecked|registered_plan_changed'
                WHEN t < TIMESTAMP '1993-01-01' THEN 'c|violated|run_precedes_registration' ELSE 'l|ordered|run_follows_registration' END AS r
              FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN out ON out.a = o_orderkey LEFT JOIN p ON p.plan = out.plan)
        SELECT claim_id, split_part(min(r), '|', 2) AS ordering, split_part(min(r), '|', 3) AS reason FROM j GROUP BY claim_id""",
}
