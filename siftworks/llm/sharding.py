"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the key's digest that split a shard, so that no sort holds a whole one: 4096 parts.
PART_DIGITS = 3


def record_key(id_col: str, text_col: str) -> Column:
    """The id as text. A row without one takes the digest of its text, so that such rows do not all share a shard."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))


def choose(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the least -ln(u) / weight, where u, in (0, 1), comes from the digest of key and shard.

    A shard's u does not depend on the other shards, so a new shard takes keys only into itself, and a higher weight
    brings a shard keys but takes none away.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights above zero")

    def drawn(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary")), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[drawn(s, w) for s, w in sorted(weights.items())]))["shard"]


def with_shard(docs: DataFrame, weights: Mapping[int, float], id_col: str = "doc_id", text_col: str = "text", to: str = "shard") -> DataFrame:
    """docs with the shard of each row, an int, in column to, which replaces one of that name. A projection: nothing moves.

    Rows that repeat an id share its shard; null ids go by their text, null texts count as empty. An empty table gives an empty one.
    """
    return docs.withColumn(to, choose(record_key(id_col, text_col), weights))


def with_slot(rows: DataFrame, order: list[str], shard: str = "shard", key: Column | None = None) -> DataFrame:
    """rows with slot, from 0 without gaps in each shard.

    A shard is split by digests of key; rows are numbered within each part by order, and the parts of a shard follow
    each other. So the largest sort holds a part of a shard, and one row for each part gives the offsets. Rows alike in
    all of order take their slots in any order. A column of the name slot is replaced.
    """
    part = F.substring(F.md5((key if key is not None else F.coalesce(F.col(order[0]).cast("string"), F.lit(""))).cast("binary")), 1, PART_DIGITS)
    split = rows.withColumn("__sw_part", part)
    sizes = split.groupBy(F.col(shard).alias("__sw_s"), F.col("__sw_part").alias("__sw_p")).agg(F.count("*").alias("__sw_n"))
    before = Window.partitionBy("__sw_s").orderBy("__sw_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__sw_s", "__sw_p", F.coalesce(F.sum("__sw_n").over(before), F.lit(0)).alias("__sw_from"))
    within = F.row_number().over(Window.partitionBy(shard, "__sw_part").orderBy(*order)) - 1
    numbered = split.withColumn("__sw_i", within).join(starts, (F.col(shard) == F.col("__sw_s")) & (F.col("__sw_part") == F.col("__sw_p")))
    return numbered.withColumn("slot", F.col("__sw_from") + F.col("__sw_i")).drop("__sw_part", "__sw_i", "__sw_s", "__sw_p", "__sw_from")


def shard_digest(docs: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row, over n shards of one weight and, for grown_shard, one more.

    size is the text's UTF-8 bytes plus 1; a null text has no bytes, and so checksum 0.
    """
    even = dict.fromkeys(range(n), 1.0)
    both = with_shard(with_shard(docs.select("doc_id", "text"), even), even | {n: 1.0}, to="grown_shard")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = both.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return with_slot(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
