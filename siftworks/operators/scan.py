"""Scans over the rows of a key in order, where a key may have half of all rows.

A key with many rows is cut into segments at orders that a sample of it gives, every segment is scanned by itself, and
what a segment ends with is carried into the next one by a scan of one row a segment. Segments are so many that tasks
get like shares of them. Keys with few rows are one segment; where there are no others, this is a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from siftworks.operators.cut import cut

#: Rows of a key that are a segment at least, segments of all rows for each shuffle partition, and sampled rows for each segment.
ROWS, SHARE, SAMPLES = 10_000, 16, 8


def _place(bounds: Column, value: Column) -> Column:
    """How many of the sorted bounds, at most 2^17, are less than value: a binary search."""
    step = lambda at, b: F.when((at + b <= F.size(bounds)) & (F.get(bounds, at + b - 1) < value), at + b).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(17, -1, -1)]), F.lit(0), step)


def segmented(rows: DataFrame, key: list[str], order: list[str], size: int | None = None) -> tuple[DataFrame, bool]:
    """rows with __k (the key, a struct), __o (the order, a struct), __seg and __cut (the key is cut), and whether any key is cut.

    Nulls are a key like any other, and the least in an order. Rows alike in all of the order stay in one segment. The
    sample goes by a hash of key and order, so reruns cut alike; it decides only how even segments are.
    """
    marked = rows.withColumns({"__k": F.struct(*[F.col(c) for c in key]), "__o": F.struct(*[F.col(c) for c in order])})
    if size is None:
        size = max(ROWS, rows.count() // (SHARE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = cut(marked.groupBy("__k").agg(F.count("*").alias("__n")).where(F.col("__n") > size).select("__k"))  # at most a key for each segment
    if hot.isEmpty():
        return marked.withColumns({"__seg": F.lit(0), "__cut": F.lit(False)}), False
    some = marked.join(F.broadcast(hot), "__k").where(F.pmod(F.xxhash64(*key, *order), F.lit(max(1, size // SAMPLES))) == 0)
    bounds = cut(some.groupBy("__k").agg(F.array_sort(F.collect_set("__o")).alias("b")).select("__k", F.filter("b", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("__b")))
    j = marked.join(F.broadcast(hot.join(bounds, "__k", "left").withColumn("__cut", F.lit(True))), "__k", "left")
    return j.withColumns({"__seg": F.when(F.col("__b").isNull(), 0).otherwise(_place(F.col("__b"), F.col("__o"))), "__cut": F.coalesce("__cut", F.lit(False))}).drop("__b"), True


def _segment() -> WindowSpec:
    return Window.partitionBy("__k", "__seg").orderBy("__o")


def _before() -> WindowSpec:
    return Window.partitionBy("__k").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)


def _carried(told: DataFrame, ends: DataFrame, carry: Column) -> DataFrame:
    """told with __c, what the segments before a row's give; ends has a row for each segment of a key that is cut."""
    rows = ends.select(F.col("__k").alias("__ck"), F.col("__seg").alias("__cs"), carry.alias("__c"))
    return told.join(F.broadcast(rows), (F.col("__k") == F.col("__ck")) & (F.col("__seg") == F.col("__cs")), "left")


def last_value(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, size: int | None = None) -> DataFrame:
    """rows with the last value that isn't null of the key's rows up to each one."""
    segs, any_cut = segmented(rows, key, order, size)
    v = F.last(value, ignorenulls=True).over(_segment().rowsBetween(Window.unboundedPreceding, 0))
    told = segs.withColumn("__v", v)
    if any_cut:
        ends = segs.where("__cut").groupBy("__k", "__seg").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__o"))).alias("e"))
        told = _carried(told, ends, F.last("e", ignorenulls=True).over(_before())).withColumn("__v", F.coalesce("__v", "__c"))
    return told.select(*rows.columns, F.col("__v").alias(out))


def previous_value(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, size: int | None = None) -> DataFrame:
    """rows with the value, null or not, of the key's row before each one; null for its first row."""
    segs, any_cut = segmented(rows, key, order, size)
    told = segs.withColumn("__v", F.lag(value).over(_segment()))
    if any_cut:
        ends = segs.where("__cut").groupBy("__k", "__seg").agg(F.max_by(F.struct(F.col(value).alias("v")), "__o").alias("e"))
        told = _carried(told.withColumn("__i", F.row_number().over(_segment())), ends, F.last("e").over(_before()))
        told = told.withColumn("__v", F.when(F.col("__i") == 1, F.col("__c.v")).otherwise(F.col("__v")))
    return told.select(*[c for c in rows.columns if c != out], F.col("__v").alias(out))


def row_numbers(rows: DataFrame, key: list[str], order: list[str], out: str, size: int | None = None) -> DataFrame:
    """rows with their number in their key's order, from 1."""
    segs, any_cut = segmented(rows, key, order, size)
    told = segs.withColumn("__v", F.row_number().over(_segment()).cast("long"))
    if any_cut:
        ends = segs.where("__cut").groupBy("__k", "__seg").agg(F.count("*").alias("e"))
        told = _carried(told, ends, F.sum("e").over(_before())).withColumn("__v", F.col("__v") + F.coalesce("__c", F.lit(0)))
    return told.select(*rows.columns, F.col("__v").alias(out))
