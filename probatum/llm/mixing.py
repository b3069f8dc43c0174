"""Records of several sources mixed to target shares along a time-varying curriculum.

A source's weight runs over the training from below to above its target share (or the reverse), all
weights summing to one at every moment and averaging the targets. Its integral is the source's
cumulative token demand; the documents of a source, in a fixed random order and repeated as often as
needed, meet that demand one after the other, and the inverse of the integral at a document's cumulative
tokens is its training position.

The total is the largest at which every source that has documents reaches its share without using any
document more than the permitted number of times, unless the caller gives one; then a source that cannot
meet its share is used to its limit, and the shares reached tell. A source without documents or tokens
leaves its share to the others in proportion. Documents of other sources, or of none, are used 0 times.
Null and empty texts have no tokens; they follow the order like others. Repeated ids are rows of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.operators.ranking import numbered

#: How far a weight moves from its mean over the training, as a share of it.
SWING = 0.5


def demands(rows: list[dict], total: float | None = None, swing: float = SWING) -> tuple[float, list[dict]]:
    """The total and, per source, tokens demanded and slope of its weight; rows hold source, share, repeat and tokens."""
    able = [r for r in rows if r["tokens"] and r["share"] and r["repeat"]]
    whole = sum(r["share"] for r in able)
    if not able:
        return 0.0, []
    for r in able:
        r["part"] = r["share"] / whole
    reachable = min(r["tokens"] * r["repeat"] / r["part"] for r in able)
    total = reachable if total is None else float(total)
    # Sources repeated more often weigh more towards the end; slopes sum to nothing over the shares.
    mean = sum(r["part"] * r["repeat"] for r in able)
    most = max(abs(r["repeat"] - mean) for r in able) or 1.0
    for r in able:
        r["slope"] = swing * (r["repeat"] - mean) / most
        r["demand"] = min(total * r["part"], float(r["tokens"] * r["repeat"]))
    return total, able


def position(offset: Column, demand: Column, slope: Column) -> Column:
    """The moment in [0, 1] at which the cumulative demand, d * (t + slope * (t * t - t)), comes to offset."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), offset / demand))
    b = 1 - slope
    root = F.sqrt(b * b + 4 * slope * x)
    return F.when(F.abs(slope) < 1e-9, x).otherwise(2 * x / (b + root))


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """documents(doc_id, source, tokens) with `uses`, and what their source demands, all rows kept.

    targets(source, target_share, max_repeat) has a row per source, a number that callers keep small.
    """
    own = documents.select("doc_id", "source", "tokens")
    sums = {r["source"]: r["n"] or 0 for r in targets.select("source").join(own, "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    rows = [
        {"source": r["source"], "share": r["target_share"] or 0.0, "repeat": r["max_repeat"] or 0, "tokens": sums.get(r["source"], 0)}
        for r in targets.filter("source is not null").collect()
    ]
    _, able = demands(rows, total)
    plan = documents.sparkSession.createDataFrame(
        [(r["source"], float(r["demand"]), float(r["slope"]), int(r["tokens"]), int(r["repeat"])) for r in able],
        "source string, demand double, slope double, source_tokens long, max_repeat int",
    )
    listed = own.join(F.broadcast(plan), "source").withColumn("place", F.xxhash64("doc_id", F.lit(seed)))  # a row per target
    ordered = numbered(listed, ["source"], ["place", "doc_id"], "offset", "tokens")
    whole = F.floor(F.col("demand") / F.col("source_tokens"))
    rest = F.col("demand") - whole * F.col("source_tokens")
    used = ordered.withColumn("uses", F.least("max_repeat", whole + (F.col("offset") + F.col("tokens") / 2 <= rest).cast("int")).cast("int"))
    others = own.join(F.broadcast(plan.select("source")), "source", "left_anti")
    return used.select("doc_id", "source", "tokens", "uses", "offset", "demand", "slope", "source_tokens").unionByName(
        others.select("doc_id", "source", "tokens", F.lit(0).alias("uses")), allowMissingColumns=True
    )


def schedule(mixed: DataFrame) -> DataFrame:
    """(position, doc_id, source, use, tokens) of every use, range-sorted by position in [0, 1]."""
    uses = mixed.filter("uses > 0").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    offset = (F.col("use") - 1) * F.col("source_tokens") + F.col("offset") + F.col("tokens") / 2
    at = position(offset, F.col("demand"), F.col("slope"))
    return uses.select(at.alias("position"), "doc_id", "source", "use", "tokens").orderBy("position", "doc_id", "use")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, tokens there and used, most uses of a document, share wanted and reached, and the
    tokens (repeats allowed included) that are left unused because another source ran out first."""
    used = mixed.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("tokens").alias("tokens_there"),
        F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"),
    )
    whole = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))  # over a row per target
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        targets.select("source", "target_share", "max_repeat")
        .join(used, "source", "left")
        .select(
            "source", "target_share", "max_repeat", zero("n_documents"), zero("tokens_there"), zero("tokens_used"), zero("most_uses"),
            F.greatest(F.coalesce("tokens_there", F.lit(0)) * F.col("max_repeat") - F.coalesce("tokens_used", F.lit(0)), F.lit(0)).alias("tokens_unused"),
            F.round(F.coalesce("tokens_used", F.lit(0)) / F.greatest(whole, F.lit(1)), 6).alias("reached_share"),
        )
    )


def expected_moment(share_of_demand: float, slope: float) -> float:
    """position() for one value, in Python."""
    if abs(slope) < 1e-9:
        return share_of_demand
    b = 1 - slope
    return 2 * share_of_demand / (b + math.sqrt(b * b + 4 * slope * share_of_demand))
