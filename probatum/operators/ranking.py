"""Row numbers over a whole table or within keys, of any size, without one task holding a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.session import checkpointed


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank", weight: str | None = None) -> DataFrame:
    """df with `name`: the number of the row (from 0) within its keys by order; with weight, the weight before it.

    Rows are range-partitioned by keys and order, so a key of any size spreads over tasks. Each task
    numbers its own rows; per task and key one total comes together, and offsets of the tasks before are
    added. order should be total; ties are numbered in an order that is fixed once the rows are written.
    """
    part = "_part"
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id())
    spread = checkpointed(spread)
    within = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = F.col(weight) if weight else F.lit(1)
    local = spread.withColumn("_upto", F.sum(amount).over(within) - amount)
    totals = spread.groupBy(part, *keys).agg(F.sum(amount).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = offsets.select(F.col(part).alias("_p2"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_off")
    same = F.col(part) == F.col("_p2")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        local.join(renamed, same)
        .withColumn(name, F.col("_upto") + F.col("_off"))
        .drop("_upto", "_off", part, "_p2", *[f"_k_{k}" for k in keys])
    )
