"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): the least node of each connected component.

    Least labels spread along edges and over the roots found so far until nothing changes; nulls and
    loops make no component.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    roots = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        spread = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("via"))
        stepped = roots.join(spread, "node").select("node", F.col("root").alias("old"), F.least("root", "via").alias("root"))
        jumped = checkpointed(
            stepped.join(stepped.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select(
                "node", "old", F.least("root", F.coalesce("up", "root")).alias("root")
            )
        )
        roots = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return roots
