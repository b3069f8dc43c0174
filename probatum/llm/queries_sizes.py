"""Documents packed into containers, and mixed to target shares, by their size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.mixing import mix, schedule, shares
from probatum.llm.packing import pack
from probatum.llm.tokens import token_count
from probatum.session import checkpointed, spread, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return checkpointed(spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_count("text").alias("tokens")))


def _specs(spark: SparkSession, sf_dir: str) -> dict[int, list[int]]:
    """The lengths permitted to each pack: its own capacity and the smaller ones, so that none of its containers is larger."""
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_specs").collect()}
    return {p: sorted({c for c in capacities.values() if c <= most}) for p, most in capacities.items()}


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (of every piece of one larger than the capacity), for each capacity: the lengths
    up to it are optimised jointly, containers opened at the least cost and downsized to what they hold."""
    return pack(_sized(spark, sf_dir).select("doc_id", "tokens"), _specs(spark, sf_dir))


def p6_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all capacities permitted together; pack_id is 0."""
    capacities = sorted({c for cs in _specs(spark, sf_dir).values() for c in cs})
    return pack(_sized(spark, sf_dir).select("doc_id", "tokens"), {0: capacities})


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per packing and capacity: containers, tokens in them, share of the space used."""
    specs = _specs(spark, sf_dir)
    packed = pack(_sized(spark, sf_dir).select("doc_id", "tokens"), specs | {0: sorted({c for cs in specs.values() for c in cs})})
    containers = packed.groupBy("pack_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"))
    return containers.groupBy("pack_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("tokens"), F.max("used").alias("most_used"),
        F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("filled"),
    )


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of times each document is used."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")).select("doc_id", "source", "tokens", "uses")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mix(_sized(spark, sf_dir), targets), targets)


def p7_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in order of its training position."""
    return schedule(mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")))


QUERIES = {
    "p6_containers": p6_containers, "p6_joint": p6_joint, "p6_fill": p6_fill,
    "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_schedule": p7_schedule,
}
ORACLES: dict[str, str] = {}
