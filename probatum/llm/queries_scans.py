"""Scanned pages: lines and numbers that the page frame and the scan affected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.scans import line_defects, number_defects, paragraphs
from probatum.session import checkpointed, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_kind, rec_id, line, defect) of lines of readings and of printed numbers."""
    defects, digits, _ = line_defects(table(spark, sf_dir, "readings"))
    defects = checkpointed(defects.distinct())
    numbers = number_defects(table(spark, sf_dir, "printed_numbers"), defects, digits)
    # Frame lines have no other defect.
    framed = defects.filter("defect = 'furniture'").select("reading_id", "line")
    lines = defects.filter("defect = 'furniture'").unionByName(
        defects.filter("defect <> 'furniture'").join(framed, ["reading_id", "line"], "left_anti")
    )
    return (
        lines.select(F.lit("reading").alias("rec_kind"), F.col("reading_id").alias("rec_id"), "line", "defect")
        .unionByName(numbers.select(F.lit("printed_number").alias("rec_kind"), F.col("number_id").alias("rec_id"), "line", "defect"))
        .distinct()
    )


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reading_id, pos, paragraph): the readings as continuous paragraphs."""
    readings = table(spark, sf_dir, "readings")
    defects, _, written = line_defects(readings)
    return paragraphs(readings, checkpointed(defects.distinct()), checkpointed(written.distinct()))


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
ORACLES: dict[str, str] = {}
