"""Keyed tables and logs as Parquet.

A keyed table's rows are dealt into buckets by a hash of their key. A write makes a version, a folder with new files of
the buckets that it touches and, written last, a list of these; a bucket is read from the newest version that lists
it. So a write of few rows leaves most of a large table alone, no write touches what a reader reads, and one that
fails leaves the table as it was. One writer a table is assumed. Logs are appended to.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftworks.schemas import STORE

#: Buckets of a table, and versions from which on a write takes all buckets together.
BUCKETS, MANY = 32, 20
#: The list of a version's buckets, without which it does not count.
DONE = "_buckets"


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> dict[int, list[int]]:
        """The buckets of each complete version."""
        fs = self._fs()
        if not fs.exists(self._path(name)):
            return {}
        found = sorted(s.getPath().getName() for s in fs.listStatus(self._path(name)))
        done = [v for v in found if v.startswith("v") and fs.exists(self._path(name, v, DONE))]
        return {int(v[1:]): [int(b) for b in self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(self._path(name, v, DONE)), "UTF-8").split()] for v in done}

    def _current(self, name: str) -> dict[int, int]:
        """The version of each bucket that has been written."""
        return {b: v for v, buckets in sorted(self._versions(name).items()) for b in buckets}

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], STORE[name][0])

    def columns(self, name: str) -> list[str]:
        return self._empty(name).columns

    def _keys(self, name: str) -> list[str]:
        return [k.strip() for k in STORE[name][1].split(",")]

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self._keys(name)), F.lit(BUCKETS)).cast("int")

    def read(self, name: str) -> DataFrame:
        """The table's rows; filters on them reach the scan."""
        schema, key = STORE[name]
        if key:
            return self._read_buckets(name, list(range(BUCKETS)))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*self.columns(name)) if self._fs().exists(self._path(name)) else self._empty(name)

    def _read_buckets(self, name: str, buckets: list[int]) -> DataFrame:
        fs, now = self._fs(), self._current(name)
        parts = [f"v{now[b]}/__b={b}" for b in buckets if b in now]
        parts = [p for p in parts if fs.exists(self._path(name, p))]  # a bucket without rows has no folder
        return self.spark.read.schema(STORE[name][0]).parquet(*[f"{self.root}/{name}/{p}" for p in parts]) if parts else self._empty(name)

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._empty(name).schema])

    def append(self, name: str, df: DataFrame, once: str | None = None) -> None:
        """Adds rows to a log, as a part of its own. A part of the same once takes the place of an earlier one, so that a step that runs again adds nothing."""
        if STORE[name][1]:
            raise ValueError(f"{name} is keyed; use upsert")
        part = hashlib.sha256(once.encode()).hexdigest()[:32] if once else uuid.uuid4().hex
        self._shaped(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/__part=p{part}")

    def stage(self, run_id: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a run's stage, which make gives if they have not been written as a whole."""
        where = ("_stages", run_id, name)
        if not self._fs().exists(self._path(*where, "_SUCCESS")):
            make().write.mode("overwrite").parquet("/".join((self.root, *where)))
        return self.spark.read.parquet("/".join((self.root, *where)))

    def drop_stages(self, run_id: str) -> None:
        self._fs().delete(self._path("_stages", run_id), True)

    def _write(self, name: str, df: DataFrame, buckets: list[int]) -> None:
        """Writes df as all that these buckets hold, and deletes versions that neither the table as it is now nor as it was before needs; for readers of that may still be at work."""
        fs, before, was = self._fs(), self._versions(name), set(self._current(name).values())
        n = max(before, default=0) + 1
        df.withColumn("__b", self._bucket(name)).repartition("__b").write.mode("overwrite").partitionBy("__b").parquet(f"{self.root}/{name}/v{n}")
        out = fs.create(self._path(name, f"v{n}", DONE + ".new"))
        out.write(bytearray(" ".join(map(str, buckets)), "ascii"))
        out.close()
        fs.rename(self._path(name, f"v{n}", DONE + ".new"), self._path(name, f"v{n}", DONE))
        needed = set(self._current(name).values()) | was
        for v in before:
            if v not in needed:
                fs.delete(self._path(name, f"v{v}"), True)

    def _touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that a write of these keys takes: at most BUCKETS numbers reach the driver."""
        if len(set(self._current(name).values())) >= MANY:
            return list(range(BUCKETS))
        return sorted(r[0] for r in keys.select(self._bucket(name).alias("b")).distinct().collect())

    def upsert(self, name: str, df: DataFrame) -> None:
        """Puts rows by key, new over old. Of new rows with one key the last in the order of their other columns stays, so that reruns agree."""
        keys = self._keys(name)
        shaped = self._shaped(name, df)
        buckets = self._touched(name, shaped)
        new = shaped.withColumn("__new", F.lit(1))
        old = self._read_buckets(name, buckets).withColumn("__new", F.lit(0))
        both = new.unionByName(old)
        rest = [c for c in new.columns if c not in (*keys, "__new")]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", F.to_json(F.struct(*rest)))).alias("r"))
        self._write(name, last.select(*keys, "r.*").select(*self._empty(name).columns), buckets)

    def replace(self, name: str, df: DataFrame) -> None:
        self._write(name, self._shaped(name, df), list(range(BUCKETS)))

    def remove(self, name: str, keys: DataFrame) -> None:
        """Takes out the rows whose key is in keys."""
        on = self._keys(name)
        shaped = keys.select(*[F.col(k).cast(self._empty(name).schema[k].dataType).alias(k) for k in on])
        buckets = self._touched(name, shaped)
        self._write(name, self._read_buckets(name, buckets).join(shaped, on, "left_anti"), buckets)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (U5 with the last winning)."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])))
    return ranked.where("__rn = 1").drop("__rn")
