"""Subject areas of documents, and what they make up of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.subjects import subject_areas
from probatum.session import table


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["area"] for r in table(spark, sf_dir, "subject_areas").collect()]
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), names)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("doc_id", "area").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per area: documents about it, their characters, and the mean share of their sentences."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return (
        _areas(spark, sf_dir)
        .join(documents, "doc_id")
        .groupBy("area")
        .agg(F.count("*").alias("n_documents"), F.sum("size").alias("characters"), F.round(F.avg("share"), 4).alias("mean_share"))
    )


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
ORACLES: dict[str, str] = {}
