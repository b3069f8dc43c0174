"""Exact statistics over declared members, compared once with the printed value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.exact import agrees, mean_agrees
from probatum.operators.ranking import numbered

STATISTICS = ("sum", "min", "max", "count", "mean", "median")


def exact_statistics(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per group: n, n_null, sum, min, max of the decimal values, partial sums combined before the shuffle."""
    v = F.col(value)
    return members.groupBy(*keys).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def exact_median(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Twice the median (an exact decimal) per group, without collecting a group.

    Values are first counted, so equal values travel as one row; running counts over the distinct values
    of a group give those in the middle.
    """
    counts = members.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = numbered(counts, keys, [value], "_before", "_c")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))
    joined = ranked.join(totals, keys)
    return joined.groupBy(*keys).agg((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))).alias("median2"))


def statistic_agrees(statistic: Column, stats: dict[str, Column], reported: Column) -> Column:
    """Whether the statistic agrees with its printed value; a mean by cross-multiplication, a median as half of itself doubled."""
    text = {k: v.cast("string") for k, v in stats.items()}
    # Half of a number is five times it, one place down.
    half = (stats["median2"] * F.lit(5).cast("decimal(1,0)")).cast("string")
    value = F.when(statistic == "count", text["n"]).when(statistic == "sum", text["sum"]).when(statistic == "min", text["min"]).when(statistic == "max", text["max"]).when(statistic == "median", half)
    same = agrees(value, reported, F.when(statistic == "median", -1).otherwise(0))
    mean = mean_agrees(F.when(statistic == "mean", stats["sum"]), stats["n"], reported)
    return F.when(statistic == "mean", mean).otherwise(same)


def members_resolved(members: DataFrame, keys: list[str], position: str, resolution: str, reason: str) -> DataFrame:
    """Per assertion: whether every member resolved, and the reason of the first that did not."""
    bad = F.col(resolution) != "resolved"
    return members.groupBy(*keys).agg(
        F.bool_and(~bad).alias("all_resolved"), F.min_by(reason, F.when(bad, F.col(position))).alias("first_reason"), F.count("*").alias("n_members")
    )
