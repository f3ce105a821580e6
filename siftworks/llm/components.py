"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, shuffled, written


#: Edges up to which Spark may broadcast what is made of them; beyond, joins are by a shuffle, however small their files.
FEW = 200_000


def stars(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for each node of edges (a, b), roots left out; root is the least node of the component.

    Each round takes minima with map-side aggregation and joins them back to the edges, so that no node's
    neighbours ever meet in one task, and writes its edges to the shared folder. Rows with a null end, loops
    and repeated edges are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        joined = shuffled if (state[0] if state else now.count()) > FEW else lambda df: df
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = joined(both.where("v > u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        then, then_path = written(small, "edges")
        drop_path(spark, path)
        now, path = then, then_path
        found = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if found == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
