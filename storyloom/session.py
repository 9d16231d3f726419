"""Session settings every job relies on, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the results depend on (UTC) or the plans count on (AQE)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder checkpoints go to.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    executors and driver share one disk, gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="storyloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder, on the shared storage checkpoints use."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Iterations use this so a lost executor re-reads one round instead of
    replaying all of them.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, files: int) -> DataFrame:
    """``df`` on every core when it was read from fewer files than there are cores.

    For work that costs far more per row than moving the row does. Tables of
    ordinary size come in many files and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if files < cores else df
