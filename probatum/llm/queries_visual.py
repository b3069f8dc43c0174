"""Visually identical text: which rows change, and how the texts group by their one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.visual import changed_rows, with_forms
from probatum.session import table

# Record kind, table, id and text column of every text this problem is about.
TEXTS = (
    ("covered", "covered", "covered_id", "quote"),
    ("printed_number", "printed_numbers", "number_id", "text"),
    ("reading", "readings", "reading_id", "text"),
)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds a character that must change."""
    parts = [
        changed_rows(table(spark, sf_dir, name), text, F.lit(kind).alias("rec_kind"), F.col(key).alias("rec_id"))
        for kind, name, key, text in TEXTS
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and comparison key: rows, spellings and rows that change. Keys stand as digests."""
    parts = [
        with_forms(table(spark, sf_dir, name).select(F.lit(kind).alias("rec_kind"), F.col(text).alias("text")), "text")
        for kind, name, _, text in TEXTS
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .filter(F.col("text").isNotNull())
        .groupBy("rec_kind", F.sha2("match_key", 256).alias("key_sha256"))
        .agg(
            F.count("*").alias("n_rows"),
            F.countDistinct(F.xxhash64("text")).alias("n_spellings"),
            F.count_if("changed").alias("n_changed"),
        )
    )


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
ORACLES: dict[str, str] = {}
