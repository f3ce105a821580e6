"""Mixing of sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents stand in a seeded order around a ring of its words. Blocks of equal length follow each other
round the ring from a seeded start, so that a source gives as many blocks as its quota asks, at most twice round.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_RUN, word_count, written

#: Parts that a source is split into, so that no sort holds a whole one.
PARTS = 4096
#: The mix is planned on the driver from one row a source; with more sources than this it refuses.
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float = 2.0) -> list[float]:
    """Shares, by weight, of share times all sizes; none above most times its size, the excess going to the others by weight until none is above."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        each = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def apportion(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by the highest quotients w / 1, w / 3, w / 5 and so on, none beyond its cap; the earlier of equal quotients first.

    A common divisor found by bisection gives all seats but a few; a heap of next quotients gives those.
    """
    def at(divisor: float) -> list[int]:
        return [min(c, max(0, int(w / divisor + 0.5))) for w, c in zip(weights, caps, strict=True)]

    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    if seats <= 0:
        return [0] * len(weights)
    low, high = 0.0, 4 * max(weights) + 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if mid == 0 or sum(at(mid)) < seats else (mid, high)
    got = at(high)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps, strict=True)) if g < c and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def block_words(total: float, sources: int, blocks: int = 4096, most: int = 1024) -> int:
    """Words in a block: the largest power of two, at most `most`, that leaves a mean source that many blocks."""
    return max(1, min(most, 1 << max(0, int(total / max(1, sources * blocks)).bit_length() - 1)))


def plan(totals: Sequence[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, shards: int = 8, seed: int = 17) -> list[dict]:
    """A dict for each (source, size): target, first word, block size and, by shard, the blocks that it gives.

    Sources go by code point, null last, and take the weights in turn. The quota of a shard is what one more share of
    the seats adds; highest quotients never take a seat back as seats are added, so it is not negative.
    """
    rows = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share)
    block = block_words(sum(aims), len(rows))
    seats = int(sum(aims) / block + 0.5)
    caps = [-(-2 * s // block) for s in sizes]
    upto = [apportion(aims, seats * j // shards, caps) for j in range(shards + 1)]
    out = []
    for i, ((source, _), size, aim) in enumerate(zip(rows, sizes, aims, strict=True)):
        digest = hashlib.sha256(f"{seed}:{'-' if source is None else '+' + source}".encode("utf-8", "surrogatepass")).digest()
        out.append({"source": source, "source_size": size, "target": float(aim), "start": int.from_bytes(digest[:8], "big") % max(1, size), "block": block, "quotas": [upto[j + 1][i] - upto[j][i] for j in range(shards)]})
    return out


PLAN = T.StructType([T.StructField("__sw_src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__sw_start", T.LongType()), T.StructField("__sw_ends", T.ArrayType(T.LongType()))])


#: What tells one part of one source.
RING = ["__sw_null", "__sw_name", "__sw_part"]


def _named(source: str) -> list[Column]:
    """A source as two columns without nulls, which a plain join can take."""
    return [F.col(source).isNull().alias("__sw_null"), F.coalesce(source, F.lit("")).alias("__sw_name")]


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, shards: int, seed: int) -> DataFrame:
    """docs with size, source_size, target, the word of the source's ring at which the row begins, and the ends of the shards' runs of words."""
    text = F.col(text_col).cast("string")
    spot = F.xxhash64(F.lit(seed), F.col(id_col), text)
    sized = docs.withColumns({"size": word_count(text), "__sw_src": F.col(source_col).cast("string"), "__sw_spot": spot, "__sw_part": F.pmod(F.shiftright(spot, 20), F.lit(PARTS))}).drop(text_col)
    sums = sized.groupBy("__sw_src", "__sw_part").agg(F.sum("size").alias("__sw_n"))
    sums, _ = written(sums, "parts")
    totals = sums.groupBy("__sw_src").agg(F.sum("__sw_n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = []
    for p in plan([(r[0], r[1]) for r in totals], weights, share, shards, seed):
        ends, at = [], 0
        for q in p["quotas"]:
            at += q * p["block"]
            ends.append(min(at, 2 * p["source_size"]))
        rows.append((p["source"], p["source_size"], p["target"], p["start"], ends))
    small = F.broadcast(docs.sparkSession.createDataFrame(rows, PLAN).withColumnRenamed("__sw_src", "__sw_a"))
    before = Window.partitionBy("__sw_src").orderBy("__sw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*_named("__sw_src"), "__sw_part", F.coalesce(F.sum("__sw_n").over(before), F.lit(0)).alias("__sw_from"))
    # the window and the join have the same keys, so that rows with their texts are shuffled once
    inside = Window.partitionBy(*RING).orderBy("__sw_spot", id_col).rowsBetween(Window.unboundedPreceding, -1)
    at = sized.select("*", *_named("__sw_src")).withColumn("__sw_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.join(offsets, RING).drop(*RING)
    at = at.join(small, F.col("__sw_src").eqNullSafe(F.col("__sw_a")))
    return at.withColumn("__sw_at", F.col("__sw_from") + F.col("__sw_in") - F.col("__sw_start"))


def _turn(m: int) -> tuple:
    """The first and the end word of the row that turn m round the ring takes."""
    begin = F.col("__sw_at") + m * F.col("source_size")
    stop = F.coalesce(F.element_at("__sw_ends", -1), F.lit(0))
    return F.greatest(-begin, F.lit(0)), F.least(F.col("size"), stop - begin)


def mix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row; taken counts the words that the mix takes, repeats included.

    A null text has no words and is taken 0 times; null sources are one source, the last. Rows that repeat an id are
    placed by their texts too; whole repeats are alike, and which of them a block's end falls on is left open. A source's taken words are within one
    block of its target, and no row gives more than twice its words. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    placed = _placed(rows, "doc_id", "text", "source", weights, share, shards, seed)
    taken = sum((F.greatest(F.lit(0), _turn(m)[1] - _turn(m)[0]) for m in range(3)), F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, shards: int = 8, seed: int = 17) -> DataFrame:
    """The rows of the mix: docs' columns and shard, one row for each stretch of a document that a shard takes.

    A document taken whole keeps its text; one that a block's end cuts has its taken words, joined by a space.
    Documents without words are in no block and so in no row. A column of the name shard is replaced; other clashing names stay as they are.
    """
    kept = [c for c in docs.columns if c != "shard"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__sw_row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).alias("source"))
    placed = _placed(packed, "doc_id", "text", "source", weights, share, shards, seed)
    turns = placed.withColumn("__sw_turn", F.explode(F.array(*[F.struct((F.col("__sw_at") + m * F.col("source_size")).alias("x"), _turn(m)[0].alias("a"), _turn(m)[1].alias("b")) for m in range(3)]))).where("__sw_turn.b > __sw_turn.a")
    runs = F.transform("__sw_ends", lambda e, j: F.struct(j.alias("shard"), F.greatest(F.col("__sw_turn.a"), F.when(j > 0, F.get("__sw_ends", j - 1)).otherwise(F.lit(0)) - F.col("__sw_turn.x")).alias("a"), F.least(F.col("__sw_turn.b"), e - F.col("__sw_turn.x")).alias("b")))
    cut = turns.withColumn("__sw_cut", F.explode(F.filter(runs, lambda r: r["b"] > r["a"])))
    words = F.array_join(F.slice(F.filter(F.split(F.col("__sw_row")[text_col].cast("string"), SPACE_RUN), lambda w: w != ""), (F.col("__sw_cut.a") + 1).cast("int"), (F.col("__sw_cut.b") - F.col("__sw_cut.a")).cast("int")), " ")
    whole = F.expr("__sw_cut.a = 0 AND __sw_cut.b = size")
    cols = [F.when(whole, F.col("__sw_row")[c]).otherwise(words).alias(c) if c == text_col else F.col("__sw_row")[c].alias(c) for c in kept]
    return cut.select(*cols, F.col("__sw_cut.shard").alias("shard"))
