"""Queries over manuscripts: coverage of numbers, statements, origins, re-reads, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators import manuscript as ms
from probatum.operators.ranking import numbered
from probatum.operators.survey import collapsed, guarded_best, most_common
from probatum.session import checkpointed, spread, table


def manuscript_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers per artifact: exempt by a rule, bound by a claim, set aside, unbound, and the share bound of those owed."""
    p = table(spark, sf_dir, "printed_numbers").select(
        "artifact_id", F.col("rule").alias("exempt"), (F.col("standing") == "bound").alias("bound"), (F.col("standing") == "set_aside_with_a_reason").alias("attributed")
    )
    return ms.coverage(p, ["artifact_id"])


def stated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the readings that a checked quotation states with the same words beside them, per reading."""
    m = spread(table(spark, sf_dir, "readings").select(F.col("reading_id").alias("text_id"), "text"))
    c = spread(table(spark, sf_dir, "covered").select(F.col("covered_id").alias("claim_id"), F.col("quote").alias("text")))
    return ms.stated(m, c).groupBy("text_id").agg(F.count("*").alias("n_stated"), F.min("claim_id").alias("first_claim"))


def held_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers that some order's total, in thousands, holds."""
    p = table(spark, sf_dir, "printed_numbers").select(F.col("num_value").alias("printed"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("output_id"), (F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.001").cast("decimal(4,3)")).alias("value"))
    return ms.held(p, o)


def exempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers by why they owe no claim, from the text on either side of them."""
    p = table(spark, sf_dir, "printed_numbers").select("reading_id", "char_offset", "text")
    r = table(spark, sf_dir, "readings").select("reading_id", F.col("text").alias("page"))
    j = p.join(r, "reading_id").select("text", F.expr("substring(page, greatest(char_offset - 29, 1), least(char_offset, 30))").alias("before"), F.expr("substring(page, char_offset + length(text) + 1, 30)").alias("after"))
    return j.groupBy(ms.needs_no_claim(F.col("text"), F.col("before"), F.col("after")).alias("exempt")).agg(F.count("*").alias("n"))


def unmentioned_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas that no document of a project names."""
    labels = table(spark, sf_dir, "subject_areas").select(F.col("area").alias("label"))
    return ms.unmentioned(labels, table(spark, sf_dir, "documents").filter("text is not null").select("project", "text"), "project")


def classified_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as outputs by kind."""
    a = table(spark, sf_dir, "artifacts").select(F.col("path").alias("file"), F.concat(F.lit("Table "), F.length("path") % 5, F.when(F.length("path") % 2 == 0, " not in the paper").otherwise("")).alias("comment"))
    return ms.classify_outputs(a).groupBy("kind", F.array_join("tables", ",").alias("tables"), "outside_paper").agg(F.count("*").alias("n"))


def reread_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as stored and as summed anew from their lines: unchanged, changed, unreadable."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    after = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("value"))
    return ms.reread(before, after, "o_orderkey").groupBy("state").agg(F.count("*").alias("n"))


def origin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts against the first digest any artifact declares for their place of origin."""
    a = table(spark, sf_dir, "artifacts")
    snap = a.filter("origin is not null and sha256 is not null").groupBy("origin.repository", "origin.commit", "origin.path").agg(F.min("sha256").alias("sha256"))
    return ms.origin_checks(a, snap)


def oldest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and path of origin, the least commit that holds each content."""
    a = table(spark, sf_dir, "artifacts").filter("origin is not null and sha256 is not null")
    return a.groupBy("origin.repository", "origin.path", "sha256").agg(F.min("origin.commit").alias("first_commit"), F.count("*").alias("n"))


def removed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys entries had by first loading that are gone once re-added duplicates are taken off: the multiset difference."""
    e = table(spark, sf_dir, "bib_entries").select("bib_file", F.lower("cite_key").alias("cite_key"))
    return ms.removed_lines(e, e.distinct(), ["bib_file", "cite_key"]).groupBy("bib_file").agg(F.count("*").alias("n"))


def reported_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations as claims about the first number of the reading they stand on: notes counted."""
    c = spread(table(spark, sf_dir, "covered").select("artifact_id", "page", F.col("quote").alias("text")))
    n = table(spark, sf_dir, "printed_numbers").filter("num_value is not null").groupBy("artifact_id").agg(F.min_by("num_value", "number_id").alias("reported"))
    a = c.join(n, "artifact_id").select(
        "text", "reported", F.col("reported").alias("stored"), F.lit("absolute").alias("mode"), F.lit("5").alias("tolerance"), F.lit(True).alias("matched"), F.array().cast("array<string>").alias("passages")
    )
    return checkpointed(ms.reported_notes(a).select(F.explode("notes").alias("note"))).groupBy("note").agg(F.count("*").alias("n"))


def assertion_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every printed number among those of its reading and form, from 0."""
    p = table(spark, sf_dir, "printed_numbers").select("number_id", "reading_id", "form", "char_offset")
    return numbered(p, ["reading_id", "form"], ["char_offset", "number_id"], "position").select("number_id", "position")


def dominant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest kind of text in each project."""
    return most_common(table(spark, sf_dir, "documents").select("project", "source"), ["project"], "source")


def unique_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand and size the one price of its parts above 1,500, or why there is none."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("label"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return guarded_best(p.withColumn("ok", F.col("price") > 1500), "label", "ok", "price")


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per artifact and printed value, its first occurrence and how many there are."""
    p = table(spark, sf_dir, "printed_numbers").filter("num_value is not null").select("artifact_id", "num_value", "number_id", "line")
    return collapsed(p, ["artifact_id", "num_value"], ["number_id"])


QUERIES = {
    f.__name__: f
    for f in (
        manuscript_coverage, stated_numbers, held_numbers, exempt_numbers, unmentioned_areas, classified_outputs, reread_values, origin_states,
        oldest_commits, removed_entries, reported_notes, assertion_positions, dominant_sources, unique_prices, first_candidates,
    )
}

ORACLES = {
    "manuscript_coverage": """
        WITH c AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (rule IS NOT NULL) AS n_exempt, count(*) FILTER (rule IS NULL AND standing = 'bound') AS n_bound,
                          count(*) FILTER (rule IS NULL AND standing = 'set_aside_with_a_reason') AS n_attributed,
                          count(*) FILTER (rule IS NULL AND standing NOT IN ('bound', 'set_aside_with_a_reason')) AS n_unbound FROM printed_numbers GROUP BY 1)
        SELECT *, CASE WHEN n > n_exempt THEN round(n_bound / (n - n_exempt), 6) END AS share FROM c""",
    "held_numbers": """
        WITH p AS (SELECT DISTINCT num_value AS printed, CAST(num_value AS DECIMAL(38,9)) AS v,
                          CAST('1e-' || CASE WHEN contains(num_value, '.') THEN length(split_part(num_value, '.', 2)) ELSE 0 END AS DECIMAL(18,9)) AS q
                   FROM printed_numbers WHERE num_value IS NOT NULL),
        s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS x FROM orders)
        SELECT printed, min(o_orderkey) AS output_id FROM p, s WHERE abs(x - v) * 2 <= q OR abs(x * 100 - v) * 2 <= q GROUP BY printed""",
    "exempt_numbers": r"""
        WITH j AS (SELECT p.text, substring(r.text, greatest(char_offset - 29, 1), least(char_offset, 30)) AS b, substring(r.text, char_offset + length(p.text) + 1, 30) AS a
                   FROM printed_numbers p JOIN readings r USING (reading_id)),
        w AS (SELECT *, regexp_replace(text, '^[-+]|%$', '', 'g') AS whole FROM j)
        SELECT CASE
          WHEN whole IN ('1.96', '1.645', '2.576', '1.28') OR (whole IN ('0.05', '0.01', '0.001', '95', '99', '90', '0.95', '0.5')
               AND (regexp_matches(b, '(?:[<>=≤≥]|\balpha\b|\blevel\b|\bp\b|α)\s*$') OR regexp_matches(a, '^\s*(?:%\s*)?(?:CI\b|confidence|level|quantile)'))) THEN 'constant'
          WHEN NOT regexp_matches(whole, '[.eE]') AND length(regexp_replace(whole, '^0+|,', '', 'g')) < 2 THEN 'single_digit'
          WHEN regexp_matches(b, '[A-Za-z]\w*[-_]\n?$') OR regexp_matches(a, '^[-_][A-Za-z]') THEN 'name'
          WHEN regexp_matches(b, '(?i)\b(?:table|figure|fig\.|section|sec\.|equation|eq\.|appendix|chapter|page|p\.)\s*\(?\n?$') THEN 'place'
          WHEN regexp_matches(b, '(?i)(?:doi|https?://|arxiv|10\.\d{4})\S*\n?$') THEN 'identifier' END AS exempt, count(*) AS n
        FROM w GROUP BY 1""",
    "stated_numbers": r"""
        WITH texts AS (SELECT 'm' AS side, reading_id AS id, text FROM readings UNION ALL SELECT 'c', covered_id, quote FROM covered),
        lists AS (SELECT side, id, list_transform(regexp_extract_all(text, '[-+]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?(?:[eE][+-]?\p{Nd}+)?|[\p{L}\p{Nl}\p{No}]+'),
                    lambda x: CASE WHEN regexp_matches(x, '^[-+]?\p{Nd}') THEN replace(x, ',', '') ELSE lower(x) END) AS t FROM texts),
        words AS (SELECT side, id, t, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM lists),
        sides AS (SELECT side, id, i, w,
                    CASE WHEN i > 2 AND (regexp_matches(t[i - 2], '^\p{L}') OR regexp_matches(t[i - 1], '^\p{L}')) THEN t[i - 2] || ' ' || t[i - 1] END AS b,
                    CASE WHEN i + 2 <= len(t) AND (regexp_matches(t[i + 1], '^\p{L}') OR regexp_matches(t[i + 2], '^\p{L}')) THEN t[i + 1] || ' ' || t[i + 2] END AS a
                  FROM words WHERE regexp_matches(w, '[\p{Nd}²³¹⁰⁴-⁹₀-₉]')),
        hits AS (SELECT m.id, m.i, c.id AS claim FROM sides m JOIN sides c ON m.side = 'm' AND c.side = 'c' AND m.w = c.w AND m.b = c.b
                 UNION ALL SELECT m.id, m.i, c.id FROM sides m JOIN sides c ON m.side = 'm' AND c.side = 'c' AND m.w = c.w AND m.a = c.a)
        SELECT id AS text_id, count(DISTINCT i) AS n_stated, min(claim) AS first_claim FROM hits GROUP BY id""",
    "unmentioned_areas": """
        WITH w AS (SELECT DISTINCT project, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS label FROM documents)
        SELECT g.project, area AS label FROM (SELECT DISTINCT project FROM documents WHERE text IS NOT NULL) g, subject_areas a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.project IS NOT DISTINCT FROM g.project AND w.label = a.area)""",
    "classified_outputs": """
        SELECT CASE WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('csv', 'tsv', 'json', 'txt', 'xlsx', 'rds', 'dat') THEN 'value'
                    WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('png', 'pdf', 'svg', 'jpg', 'jpeg', 'eps', 'tif', 'tiff') THEN 'figure' ELSE 'other' END AS kind,
               CAST(length(path) % 5 AS VARCHAR) AS tables, length(path) % 2 = 0 AS outside_paper, count(*) AS n FROM artifacts GROUP BY ALL""",
    "reread_values": """
        WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1)
        SELECT CASE WHEN v IS NULL OR o_totalprice IS NULL THEN 'unreadable' WHEN v = CAST(o_totalprice AS DECIMAL(18,2)) THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n
        FROM orders FULL JOIN a ON k = o_orderkey GROUP BY 1""",
    "origin_states": """
        WITH s AS (SELECT origin.repository AS r, origin.commit AS c, origin.path AS p, min(sha256) AS sha FROM artifacts WHERE origin IS NOT NULL AND sha256 IS NOT NULL GROUP BY ALL)
        SELECT artifact_id, CASE WHEN origin IS NULL THEN 'no_origin' WHEN s.sha IS NULL THEN 'not_there' WHEN sha256 IS NULL THEN 'unpinned' WHEN sha256 = s.sha THEN 'matches' ELSE 'differs' END AS origin_state
        FROM artifacts LEFT JOIN s ON r = origin.repository AND c = origin.commit AND p = origin.path""",
    "oldest_commits": """
        SELECT origin.repository AS repository, origin.path AS path, sha256, min(origin.commit) AS first_commit, count(*) AS n FROM artifacts WHERE origin IS NOT NULL AND sha256 IS NOT NULL GROUP BY ALL""",
    "assertion_positions": "SELECT number_id, row_number() OVER (PARTITION BY reading_id, form ORDER BY char_offset, number_id) - 1 AS position FROM printed_numbers",
    "dominant_sources": """
        WITH c AS (SELECT project, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, source) AS k FROM c)
        SELECT project, n, source FROM r WHERE k = 1""",
    "unique_prices": """
        WITH p AS (SELECT p_brand || '/' || p_size AS label, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part),
        g AS (SELECT label, count(DISTINCT price) FILTER (price > 1500) AS n, min(price) FILTER (price > 1500) AS v FROM p GROUP BY label)
        SELECT label, CASE WHEN n = 1 THEN v END AS price, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'several pass' ELSE 'none passes' END AS reason FROM g""",
    "first_candidates": """
        SELECT artifact_id, num_value, min(number_id) AS number_id, arg_min_null(line, number_id) AS line, count(*) AS n_candidates FROM printed_numbers WHERE num_value IS NOT NULL GROUP BY artifact_id, num_value""",
    "removed_entries": """
        WITH e AS (SELECT bib_file, lower(cite_key) AS k FROM bib_entries) SELECT bib_file, count(*) - count(DISTINCT k) AS n FROM e GROUP BY bib_file HAVING count(*) > count(DISTINCT k)""",
}
