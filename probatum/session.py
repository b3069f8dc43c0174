"""Session defaults, table access, checkpoints and size-checked joins shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest serialised size, in bytes, of a table that may be broadcast.
BROADCAST_BYTES = 8 << 20


def local_session(cpus: int | str = "*", shuffle: int = 8, name: str = "probatum") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PROBATUM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder so that they outlive a lost executor.

    The folder is the one the cluster names in spark.checkpoint.dir; only where none is named
    (a local session) a folder of this machine is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="probatum-checkpoint-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, width: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (already materialised) with a broadcast hint where its measured size is under limit.

    width is the size of a row in bytes. Beyond the limit the plain frame comes back and the join
    shuffles, AQE splitting skewed partitions.
    """
    total = df.agg(F.sum(width + F.lit(16)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are task slots: rows of few small files are dealt out anew
    before work that is dear per row; an input with partitions enough is left as it lies."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
