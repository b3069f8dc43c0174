"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators.packed import found_values, packed_values
from probatum.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_values(table(spark, sf_dir, "bib_entries"))


def p4_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field name: values, and the fields they came from."""
    values = packed_values(table(spark, sf_dir, "bib_entries"), keep_single=True)
    return values.groupBy("field_name").agg(
        F.count("*").alias("n_values"),
        F.sum(F.when(F.col("pos") == 1, 1).otherwise(0)).alias("n_fields"),
        F.max("n_values").alias("most_values"),
    )


QUERIES = {"p4_found": p4_found, "p4_value_counts": p4_value_counts}
ORACLES: dict[str, str] = {}
