"""Exact dedup by an extendible-hash index of texts in the shared folder.

Texts count as equal when they are identical without their blanks. A text's hash says where it belongs: its first bits
choose a slot of the directory, and so a bucket. A bucket of more distinct hashes than its capacity is split by one bit
more, for which the directory doubles; copies have one hash and never fill a bucket. Only texts whose hash comes up
twice go into the index. There an owner task has a range of buckets, orders each hash's texts, tells those that differ
in any byte apart as links of a chain, and writes them to the files of their buckets. Rows then meet by hash and link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, once, small, split_join, written, PATHS

BLANKS = " \t\n\x0b\x0c\r"
#: Distinct hashes that a bucket holds.
CAPACITY = 1 << 16


def normalised(text: Column) -> Column:
    """text without blanks; an empty text for null."""
    return reduce(lambda c, b: F.replace(c, F.lit(b), F.lit("")), BLANKS, F.coalesce(text.cast("string"), F.lit("")))


def _slot(h: str, depth: str) -> Column:
    """The first bits of a hash, as a number."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftrightunsigned({h}, 64 - {depth}) END")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, str, list[int]]:
    """(depth, prefix) of each bucket that a hash of hashes (h, each once) falls into, the path of that table, and the depths that occur.

    It begins at the depth that the number of hashes asks for at least. A round counts the buckets of its depth, and
    those over capacity go into the next one by a bit more. The slots of a directory of the greatest depth that are one
    bucket are kept as that bucket, so hashes of a long common prefix make no more rows than they have buckets.
    """
    depth = max(0, (hashes.count() // capacity).bit_length() - 1)
    left, full, depths = hashes, [], []
    while True:
        slot = _slot("h", str(depth))
        counted, path = written(left.groupBy(slot.alias("prefix")).agg(F.count("*").alias("n")), "buckets")
        full.append(counted.where(F.col("n") <= capacity).select(F.lit(depth).alias("depth"), "prefix"))
        depths.append(depth)
        over = counted.where(F.col("n") > capacity).select("prefix")
        if depth == 64 or over.isEmpty():
            break
        left = hashes.join(small(over, path), slot == F.col("prefix"), "left_semi")
        depth += 1
    return *written(reduce(DataFrame.union, full), "directory"), depths


def in_buckets(rows: DataFrame, buckets: DataFrame, path: str, depths: list[int]) -> DataFrame:
    """rows (h, ...) with bucket, the first hash of the bucket that h belongs to, by a directory: the one of its prefixes that is there."""
    tried = rows.withColumn("__d", F.explode(F.array(*map(F.lit, depths))))
    told = tried.join(small(buckets, path), (F.col("__d") == F.col("depth")) & (_slot("h", "__d") == F.col("prefix")))
    return told.withColumn("bucket", F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftleft(prefix, 64 - depth) END")).drop("__d", "depth", "prefix")


def build_index(rows: DataFrame, heads: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index of rows (h, norm), of the hashes that heads (h, times, each hash once) counts twice or more: bucket, h, link, members and norm, read from the files of their buckets.

    Members are counted before anything moves by key, and hashes of many rows stay where they are, so an owner gets
    each distinct text once, however often it occurs. link numbers the distinct texts of a hash from 0.
    """
    placed = in_buckets(heads.where("times > 1"), *directory(heads.select("h"), capacity))
    twice, _ = written(placed.select("h", "bucket", "times"), "twice")
    texts = split_join(rows, twice, ["h"], "times").groupBy("bucket", "h", "norm").agg(F.count("*").alias("members"))
    owned = texts.repartitionByRange("bucket", "h")
    chained = owned.withColumn("link", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("norm")) - 1)
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "index")
    chained.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    PATHS.append(path)
    return spark.read.schema("h long, norm string, members long, link int, bucket long").parquet(path)


def with_keeper(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """docs and __sw_keep (the id of the row that stays of its group), __sw_size (rows of the group), __sw_kept and __sw_sha (SHA-256 of the text without blanks, hex).

    The row of the longest text in code points stays, blanks counted, of those the one of the least id, null ids last,
    of rows alike in both the one read first. Null, empty and blank texts are one group. An empty table gives an empty
    one. hash_bits, under 64, is for tests of chains. docs is written once; rows are told by numbers, without texts.
    """
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    row = F.struct((-F.coalesce(F.length(text.cast("string")), F.lit(0))).alias("n"), ident.isNull().alias("none"), ident.alias("id"), F.monotonically_increasing_id().alias("row"))
    mask = F.lit(-1 << (64 - hash_bits) if hash_bits else 0)
    marked = docs.withColumns({"__sw_norm": once(normalised(text)), "__sw_o": row})
    marked = marked.withColumns({"__sw_h": F.xxhash64("__sw_norm").bitwiseAND(mask), "__sw_sha": F.sha2(F.col("__sw_norm").cast("binary"), 256)}).drop("__sw_norm")
    marked, _ = written(marked, "marked")
    heads, _ = written(marked.groupBy(F.col("__sw_h").alias("h")).agg(F.count("*").alias("times")), "heads")
    twice = heads.where("times > 1")
    index = build_index(marked.select(F.col("__sw_h").alias("h"), normalised(text).alias("norm")), heads, capacity)
    chains, path = written(index.groupBy("h").agg(F.max("link").alias("m")).where("m > 0").select("h"), "chains")
    rows = marked.select(F.col("__sw_h").alias("h"), F.col("__sw_o").alias("o"))
    if chains.isEmpty():
        linked = rows.withColumn("link", F.lit(0))
    else:
        links, at = written(index.join(small(chains, path), "h", "left_semi").select("h", "norm", "link"), "links")
        texts = marked.select(F.col("__sw_h").alias("h"), "__sw_o.row", normalised(text).alias("norm")).join(small(chains, path), "h", "left_semi")
        told, at = written(texts.join(small(links, at), ["h", "norm"]).select("row", "link"), "linked")
        linked = rows.join(small(told, at), F.col("o.row") == F.col("row"), "left").select("h", "o", F.coalesce("link", F.lit(0)).alias("link"))
    met, _ = written(split_join(linked, twice, ["h"], "times"), "met")
    groups = met.groupBy("h", "link").agg(F.count("*").alias("size"), F.min("o").alias("f")).where("size > 1")
    groups, _ = written(groups.withColumn("times", F.col("size")), "groups")
    joined = split_join(met, groups, ["h", "link"], "times")
    told, path = written(joined.select(F.col("o.row").alias("__sw_r"), F.col("f.id").alias("__sw_keep"), F.col("size").alias("__sw_size"), (F.col("o.row") == F.col("f.row")).alias("__sw_kept")), "told")
    j = marked.join(small(told, path), F.col("__sw_o.row") == F.col("__sw_r"), "left")
    alone = F.col("__sw_r").isNull()
    return j.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(alone, F.col("__sw_o.id")).otherwise(F.col("__sw_keep")).alias("__sw_keep"), F.coalesce("__sw_size", F.lit(1).cast("long")).alias("__sw_size"), (alone | F.col("__sw_kept")).alias("__sw_kept"), "__sw_sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each group of texts that are equal without blanks; see with_keeper for which, and for nulls. All columns stay."""
    return with_keeper(docs, id_col, text_col, capacity).where("__sw_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_digest(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    return with_keeper(docs.select("doc_id", "text")).select("doc_id", F.col("__sw_keep").alias("keep_id"), F.col("__sw_size").alias("group_size"), F.col("__sw_kept").alias("kept"), F.col("__sw_sha").alias("text_sha256"))
