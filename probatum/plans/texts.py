"""Queries over texts: numbers they print, passages they hold, values addressed in trees, arrays and prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions.folds import folded, skeleton_udf
from probatum.functions.numerals import inventory_udf, located_udf
from probatum.operators.chain import with_previous
from probatum.operators.decide import decide
from probatum.operators.passages import covered_by, explain_missing, inside, quote_states, triangulate
from probatum.operators.policy import quotation_report
from probatum.operators.ranking import numbered
from probatum.operators.survey import bindings
from probatum.session import checkpointed, spread, table
from probatum.sources.trees import json_leaves


def json_pointer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at /k of every event's properties against a printed one, every tenth off by one."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", "props", (F.col("event_id") % 10 == 0).alias("off"))
    at = F.element_at(F.filter("leaves", lambda x: x["pointer"] == "/k"), 1)
    located = e.withColumn("leaves", json_leaves("props")).withColumn("stored", F.when(F.size(F.filter("leaves", lambda x: x["pointer"] == "/k")) > 0, at["raw"]))
    located = located.withColumn("resolution", F.when(F.col("stored").isNull(), "absent").otherwise("resolved"))
    located = located.withColumn("reported", (F.col("stored").try_cast("int") + F.col("off").cast("int")).cast("string"))
    return decide(located, "pointer").select("event_id", "stored", "outcome", "reason")


def array_element_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element of each embedding at its label's index (from 0) times twenty; indexes past the end are absent."""
    v = table(spark, sf_dir, "embeddings")
    at = F.try_element_at("embedding", (F.col("label") * 20 + 1).cast("int"))
    return v.select("vec_id", F.when(at.isNull(), "absent").otherwise("resolved").alias("resolution"), at.alias("stored"))


def numbers_by_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "printed_numbers").groupBy("standing", "form").agg(F.count("*").alias("n"), F.countDistinct("artifact_id").alias("n_artifacts"), F.count_if("reported_elsewhere").alias("n_elsewhere"))


def numbers_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "printed_numbers").filter("rule is not null").groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


def set_aside_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers each reason given for setting aside accounts for, and on how many pages."""
    p = table(spark, sf_dir, "printed_numbers").filter("standing = 'set_aside_with_a_reason'")
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("reading_id").alias("n_readings"))


def claims_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers bound by each claim."""
    p = table(spark, sf_dir, "printed_numbers").select("number_id", "num_value", F.explode("claims").alias("claim"))
    return p.groupBy("claim").agg(F.count("*").alias("n"), F.countDistinct("num_value").alias("n_values"), F.min("number_id").alias("first_number"))


def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every printed number from its offset, with the characters on either side."""
    p = table(spark, sf_dir, "printed_numbers").select("number_id", "reading_id", "char_offset", F.length("text").alias("len"))
    r = table(spark, sf_dir, "readings").select("reading_id", F.col("text").alias("page_text"))
    j = p.join(r, "reading_id")
    before = F.expr("substring(page_text, 1, char_offset)")
    return j.select(
        "number_id",
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("at_line"),
        F.expr("substring(page_text, char_offset, 1)").alias("char_before"),
        F.expr("substring(page_text, char_offset + len + 1, 1)").alias("char_after"),
    )


def number_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each number with the two printed before it on its reading."""
    p = table(spark, sf_dir, "printed_numbers").select("reading_id", "char_offset", "number_id", "text")
    n = numbered(p, ["reading_id"], ["char_offset", "number_id"], "at")
    one = with_previous(n, ["reading_id"], "at", {"before_1": F.col("text")})
    two = n.select("reading_id", (F.col("at") + 2).alias("at"), F.col("text").alias("before_2"))
    return one.join(two, ["reading_id", "at"], "left").select("number_id", "text", "before_1", "before_2")


def number_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number the readings print, found anew: counts by form and rule."""
    r = spread(table(spark, sf_dir, "readings").select("reading_id", "text")).select("reading_id", F.explode(inventory_udf("text")).alias("n")).select("reading_id", "n.*")
    return r.groupBy("form", "rule").agg(F.count("*").alias("n"), F.count("num_value").alias("n_values"))


def prose_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after 'by hand gave' on each reading: resolved where one value stands there, ambiguous where several."""
    r = spread(table(spark, sf_dir, "readings").filter("text is not null").select("reading_id", "text")).select("reading_id", located_udf("text", F.lit("by hand gave"), F.lit("")).alias("at"))
    values = F.array_distinct(F.transform("at", lambda x: x["printed"]))
    located = r.withColumn("resolution", F.when(F.size("at") == 0, "absent").when(F.size(values) > 1, "ambiguous").otherwise("resolved"))
    located = located.withColumn("stored", F.when(F.col("resolution") == "resolved", F.element_at(values, 1))).withColumn("reported", F.regexp_replace("stored", "%$", ""))
    return decide(located, "prose", stored="reported").select("reading_id", "resolution", "stored", "outcome", "reason")


def bound_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers inside a checked quotation where it stands verbatim on its page: per number, the quotations."""
    c = table(spark, sf_dir, "covered").select("covered_id", "artifact_id", "page", "quote").filter("page is not null and quote <> ''")
    r = table(spark, sf_dir, "readings").select("reading_id", "artifact_id", "page", "text")
    at = c.join(r, ["artifact_id", "page"]).withColumn("lo", F.expr("instr(text, quote)") - 1).filter("lo >= 0")
    at = at.select("covered_id", "reading_id", "lo", (F.col("lo") + F.length("quote")).alias("hi"))
    p = table(spark, sf_dir, "printed_numbers").select("number_id", "reading_id", "char_offset")
    return inside(p, at, ["reading_id"], "char_offset", "lo", "hi").groupBy("number_id").agg(F.count("*").alias("n_quotes"), F.min("covered_id").alias("first_quote"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf_dir, "covered").select(F.col("covered_id").alias("quote_id"), F.col("artifact_id").alias("source"), "quote", "page")
    t = table(spark, sf_dir, "readings").select(F.col("reading_id").alias("text_id"), F.col("artifact_id").alias("source"), "text", "page")
    return q, t


def covered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every checked quotation against the readings of its source: found, ambiguous, wrong_page, not found."""
    return quote_states(*_quotes(spark, sf_dir))


def missing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For quotations not found: how far the page's text keeps them, and what they leave out."""
    q, t = _quotes(spark, sf_dir)
    return explain_missing(checkpointed(quote_states(q, t)), q, t)


def quotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of quotations as fragments, each quotation held against the readings of its page."""
    page = F.concat_ws("/", "artifact_id", F.col("page").cast("string"))
    c = table(spark, sf_dir, "covered").filter("page is not null")
    f = c.select(F.col("covered_id").alias("quotation_id"), page.alias("source"), F.posexplode(F.split("quote", r"(?<=[.!?])\s+")).alias("n", "fragment"))
    s = table(spark, sf_dir, "readings").filter("page is not null").select(F.col("reading_id").alias("span_id"), page.alias("source"), F.col("text").alias("span"))
    return covered_by(f, s)


def reader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which all readers give one text once blanks are left out, and those where they differ."""
    r = spread(table(spark, sf_dir, "readings").filter("text is not null").select("artifact_id", "page", "text"))
    states = r.select(F.concat_ws("/", "artifact_id", F.col("page").cast("string")).alias("quote_id"), F.sha2(skeleton_udf("text"), 256).alias("state"))
    t = triangulate(states)
    return t.groupBy((F.col("state") == "indeterminate").alias("differ"), "n_readers").agg(F.count("*").alias("n_pages"))


def passage_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the digest of their folded text: how many share it, in how many spellings."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(folded("text").alias("f"), "text")
    return d.groupBy(F.sha2("f", 256).alias("form")).agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("text")).alias("n_spellings"))


def survey_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers that a part's price rounds to, as it is or as a percentage."""
    p = table(spark, sf_dir, "printed_numbers").select(F.col("num_value").alias("printed"))
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("value_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("value"))
    return bindings(p, s).groupBy("printed", "conversion").agg(F.count("*").alias("n_values"), F.min("value_id").alias("first_value"))


def quotation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and verdicts of the checked quotations of every artifact."""
    return quotation_report(table(spark, sf_dir, "covered").select("artifact_id", "state"), ["artifact_id"])


QUERIES = {
    f.__name__: f
    for f in (
        json_pointer_lookup, array_element_lookup, numbers_by_standing, numbers_by_rule, set_aside_reasons, claims_numbers, number_lines,
        number_neighbours, number_inventory, prose_locator, bound_numbers, covered_states, missing_quotes, quotation_coverage,
        reader_agreement, quotation_reports, passage_forms, survey_candidates,
    )
}

ORACLES = {
    "quotation_reports": """
        WITH c AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (state = 'found') AS n_found, count(*) FILTER (state = 'corrected') AS n_corrected,
                          count(*) FILTER (state = 'not found') AS n_missing, count(*) FILTER (state IN ('unchecked', 'indeterminate', 'ambiguous')) AS n_unresolved FROM covered GROUP BY 1)
        SELECT *, n_unresolved < n AND n_missing = 0 AS ok, n_unresolved < n AND n_missing = 0 AND n_unresolved = 0 AS strict_ok FROM c""",
    "json_pointer_lookup": """
        WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS stored FROM events)
        SELECT event_id, stored, CASE WHEN stored IS NULL THEN 'not_found' WHEN event_id % 10 = 0 THEN 'mismatch' ELSE 'verified' END AS outcome,
               CASE WHEN stored IS NULL THEN 'pointer_absent' WHEN event_id % 10 = 0 THEN 'value_mismatch' ELSE 'value_match' END AS reason FROM e""",
    "array_element_lookup": """
        SELECT vec_id, CASE WHEN embedding[label * 20 + 1] IS NULL THEN 'absent' ELSE 'resolved' END AS resolution, embedding[label * 20 + 1] AS stored FROM embeddings""",
    "numbers_by_standing": """
        SELECT standing, form, count(*) AS n, count(DISTINCT artifact_id) AS n_artifacts, count(*) FILTER (reported_elsewhere) AS n_elsewhere FROM printed_numbers GROUP BY ALL""",
    "numbers_by_rule": "SELECT rule, count(*) AS n, count(DISTINCT text) AS n_texts FROM printed_numbers WHERE rule IS NOT NULL GROUP BY rule",
    "set_aside_reasons": "SELECT reason, count(*) AS n, count(DISTINCT reading_id) AS n_readings FROM printed_numbers WHERE standing = 'set_aside_with_a_reason' GROUP BY reason",
    "claims_numbers": """
        SELECT claim, count(*) AS n, count(DISTINCT num_value) AS n_values, min(number_id) AS first_number FROM (SELECT number_id, num_value, unnest(claims) AS claim FROM printed_numbers) GROUP BY claim""",
    "number_lines": """
        SELECT number_id, length(r.text[1:char_offset]) - length(replace(r.text[1:char_offset], chr(10), '')) + 1 AS at_line,
               CASE WHEN char_offset = 0 THEN r.text[1:1] ELSE r.text[char_offset:char_offset] END AS char_before,
               r.text[char_offset + length(p.text) + 1:char_offset + length(p.text) + 1] AS char_after
        FROM printed_numbers p JOIN readings r USING (reading_id)""",
    "number_neighbours": """
        SELECT number_id, text, lag(text) OVER w AS before_1, lag(text, 2) OVER w AS before_2 FROM printed_numbers WINDOW w AS (PARTITION BY reading_id ORDER BY char_offset, number_id)""",
    "bound_numbers": """
        WITH q AS (SELECT covered_id, reading_id, strpos(text, quote) - 1 AS lo, length(quote) AS len FROM covered JOIN readings USING (artifact_id, page) WHERE quote <> '' AND strpos(text, quote) > 0)
        SELECT number_id, count(*) AS n_quotes, min(covered_id) AS first_quote FROM printed_numbers JOIN q USING (reading_id) WHERE lo <= char_offset AND char_offset < lo + len GROUP BY number_id""",
    "prose_locator": r"""
        WITH r AS (SELECT reading_id, list_distinct(list_transform(regexp_extract_all(text, 'by hand gave[\s\p{Z}]*([^\s\p{Z}]+)', 1), lambda x: regexp_replace(x, '(\d)\.$', '\1'))) AS v FROM readings WHERE text IS NOT NULL),
        s AS (SELECT reading_id, CASE len(v) WHEN 0 THEN 'absent' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN len(v) = 1 THEN v[1] END AS stored FROM r),
        t AS (SELECT *, regexp_full_match(regexp_replace(stored, '%$', ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,9})?') AS numeric FROM s)
        SELECT reading_id, resolution, stored, CASE WHEN numeric THEN 'verified' ELSE 'not_found' END AS outcome,
               CASE resolution WHEN 'absent' THEN 'passage_absent' WHEN 'ambiguous' THEN 'passage_ambiguous' ELSE CASE WHEN numeric THEN 'value_match' ELSE 'value_not_numeric' END END AS reason FROM t""",
    "survey_candidates": """
        WITH p AS (SELECT DISTINCT num_value AS printed, CAST(num_value AS DECIMAL(38,9)) AS v,
                          CAST('1e-' || CASE WHEN contains(num_value, '.') THEN length(split_part(num_value, '.', 2)) ELSE 0 END AS DECIMAL(18,9)) AS q
                   FROM printed_numbers WHERE num_value IS NOT NULL),
        s AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS x, 'none' AS conversion FROM part UNION ALL SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) * 100, 'percent' FROM part)
        SELECT printed, conversion, count(*) AS n_values, min(p_partkey) AS first_value FROM p, s WHERE abs(x - v) * 2 <= q GROUP BY printed, conversion""",
}
