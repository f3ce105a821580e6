"""What the operators of this subpackage share: the shared work folder, written intermediate tables, word rules."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def worker_state(key: str, make: Callable[[], object]) -> object:
    """What make gives, made once in a Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("_siftworks_worker", types.ModuleType("_siftworks_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def split_words(text: Column, parts: str) -> Column:
    """What stands between runs of characters of a class, an expression of one or more of them. Several times quicker than to extract the words."""
    return F.array_remove(F.split(text, parts, -1), "")


def word_count(text: Column, parts: str = SPACE_RUN) -> Column:
    """How many words a text has, a long; none for null."""
    return F.coalesce(F.size(split_words(text.cast("string"), parts)).cast("long"), F.lit(0).cast("long"))


def once(c: Column) -> Column:
    """c, in a form that the optimiser never copies into the expressions that use it, where it would be evaluated for each use, or each element of an array. The test always holds."""
    return F.when(F.spark_partition_id() >= 0, c)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, which only a local master may leave so, a new temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="siftworks-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/siftworks/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Paths of all tables that written made, in order, for drop_written.
PATHS: list[str] = []


def written(df: DataFrame, kind: str = "table") -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path. Cuts the lineage: a lost executor costs no more than its own unread tasks."""
    path = fresh_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables that were written since PATHS had so many, but for those to keep. A DataFrame that reads them can't be used any more."""
    for path in PATHS[since:]:
        if path not in keep:
            drop_path(spark, path)
    PATHS[since:] = [p for p in PATHS[since:] if p in keep]


def path_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of the files under a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose joins are by a shuffle. Spark takes the compressed bytes of a written table for the size of all that is made of its rows, be it 37 rows of each by explode, and would send that through the driver as a broadcast."""
    return df.hint("merge")


def small(df: DataFrame, path: str, most: int = 200_000, most_bytes: int = 16 << 20) -> DataFrame:
    """df, which reads the table written at path, with a broadcast hint if that table's rows and its bytes, compressed, are at most so many; else for a shuffled join."""
    return F.broadcast(df) if path_bytes(df.sparkSession, path) <= most_bytes and df.limit(most + 1).count() <= most else shuffled(df)


def split_join(left: DataFrame, right: DataFrame, on: list[str], times: str, least: int = 100) -> DataFrame:
    """left joined with right, which has one row for each key and, in times, left's rows of that key; times is not in the result.

    Keys with over a 50,000th of left's rows, of which there can't be 50,000, are broadcast, so that their rows stay
    where they are; all others meet by a shuffle, none of them with more than that share. right should be a written
    table, and left cheap to read twice.
    """
    total = right.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) > max(least, total // 50_000)
    often = right.where(hot).drop(times)
    if often.isEmpty():
        return shuffled(left).join(right.drop(times), on)
    rare = shuffled(left.join(F.broadcast(often.select(*on)), on, "left_anti")).join(right.where(~hot).drop(times), on)
    return left.join(F.broadcast(often), on).unionByName(rare)
