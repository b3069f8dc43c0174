"""Works of the registries and records of the library that describe the same publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.linkage import same_work
from probatum.session import table


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, record_id, confidence) of every matching pair."""
    matches = same_work(table(spark, sf_dir, "works"), table(spark, sf_dir, "bib_records"), "work_id", "record_id")
    return matches.withColumn("confidence", F.round("confidence", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("work_id", "record_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches}
ORACLES: dict[str, str] = {}
