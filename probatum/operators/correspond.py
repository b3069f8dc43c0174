"""Correspondences: places that must state one value, compared pair by pair of sides.

The sides of an assertion are the few its author declared, so pairs are formed among them and never among
rows that merely share a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.exact import printed_agree


def side_pairs(sides: DataFrame, key: str = "claim_id") -> DataFrame:
    """sides(key, sides array<struct<name, raw>>), one row per assertion, with pairs of different sides.

    (key, left_name, right_name, left_raw, right_raw, agrees); agrees is null where a side states no number.
    """
    pair = F.expr(
        "flatten(transform(sequence(0, greatest(size(sides) - 1, 0)), i -> transform("
        "filter(sequence(0, greatest(size(sides) - 1, 0)), j -> j > i and sides[i].name <> sides[j].name), "
        "j -> struct(sides[i].name as left_name, sides[j].name as right_name, sides[i].raw as left_raw, sides[j].raw as right_raw))))"
    )
    rows = sides.filter(F.size("sides") > 0).select(key, F.explode(pair).alias("p")).select(key, "p.*")
    return rows.withColumn("agrees", printed_agree(F.col("left_raw"), F.col("right_raw")))


def verdicts(pairs: DataFrame, key: str = "claim_id") -> DataFrame:
    """Per assertion: match only where every pair agrees; unread sides leave it not applicable."""
    return pairs.groupBy(key).agg(
        F.when(F.bool_or(F.col("agrees").isNull()), "not_applicable").when(F.bool_and("agrees"), "match").otherwise("mismatch").alias("comparison"),
        F.count("*").alias("n_pairs"),
        F.count_if(~F.col("agrees")).alias("n_differing"),
    )


def one_place(readings: DataFrame, key: str = "claim_id") -> DataFrame:
    """Assertions whose sides read overlapping stretches of one file: (key, side_a, side_b).

    readings(key, side, path, start, end). Sides are few per assertion and file; the join is on both.
    """
    a = readings.select(key, "path", F.col("side").alias("side_a"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = readings.select(key, "path", F.col("side").alias("side_b"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    return a.join(b, [key, "path"]).filter("side_a < side_b and sa < eb and sb < ea").select(key, "side_a", "side_b").distinct()
