"""What operators ask of the session: the shared folder, and cutting lineage through it."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set by setCheckpointDir.

    With neither, a temporary one is made, but only where driver and executors
    are one process on one machine; a cluster has to name its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder; a frame that `saved` or `kept` gave stays as it is."""
    if df.__dict__.get("_is_saved"):
        return df
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    out.__dict__["_is_saved"] = True
    return out


def dealt(df: DataFrame) -> DataFrame:
    """`saved`, but later plans know how the rows are dealt out and ordered, and join them by that key without a shuffle. An adaptive plan doesn't tell, so this one isn't."""
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return saved(df)
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """The same for frames as long as the data: written as Parquet, which takes a fraction of a checkpoint's bytes and gives back single columns."""
    if df.__dict__.get("_is_saved"):
        return df
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["_is_saved"] = True
    return out


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, which is counted; else as it is, for a shuffled join.

    For frames that are cheap to count, as saved ones are.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
