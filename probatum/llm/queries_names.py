"""Spellings of researchers and institutions in author lists and bibliography blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.names import all_names, entity_pairs, name_entities
from probatum.operators.packed import PERSON_FIELDS, packed_values
from probatum.session import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "works").select(F.explode("authors").alias("name"))
    entries = packed_values(table(spark, sf_dir, "bib_entries"), keep_single=True).filter(F.col("field_name").isin(*PERSON_FIELDS))
    return all_names(works, entries.select(F.col("val").alias("name")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(name_entities(_names(spark, sf_dir)))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity: its number of spellings and the first of them."""
    return name_entities(_names(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("n_spellings"), F.min("name").alias("first_spelling"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
ORACLES: dict[str, str] = {}
