"""Lineage cut by checkpoints or tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, within the shared one; one of its own where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftworks-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder; one of its own where the session names none."""
    _folder(df.sparkSession)
    return df.checkpoint()


def carried(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: for what a loop carries into its next round.

    A checkpoint keeps the size that Spark estimated for its plan, which for a join is the product of both sides' and
    so doubles its digits with each round: after some 23 rounds one such number fills the driver's heap. A table has the
    size of its files. They are plain, without compression or dictionaries, so that no large table passes for a small
    one, which Spark would broadcast.
    """
    path = f"{_folder(df.sparkSession)}/carried-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str | None) -> None:
    """Deletes a table that carried made, if any."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
