"""Line dedup by winnowing: window minima of line hashes are fingerprints; runs of lines that repeat an earlier run go.

A window is the least number of lines in a row that hold min_words words, read forwards from a line or backwards from
it. Any repeated run of so many words holds such a window, whose least line hash is the same at both places: that is
its fingerprint. Positions whose fingerprint occurs nowhere else are left out at once. The others are joined with the
first position of the same fingerprint and the same lines around it, as far as each of the position's windows reaches
to both sides, and all later ones are deleted. So a match is extended line by line, forwards and backwards, as the
union of the windows that match: to extend it from the first position alone would miss runs whose rest repeats another,
later position, and to compare all positions with each other would make all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, once, small, split_join, written

MIN_WORDS = 50


def _windows(rows: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """(row, id, lines, w): w has start, lines n, fingerprint m and its place p, and the key of each window, in non-blank lines from 1."""
    line = f"struct(cast(i as int) as l, xxhash64(trim('\\x20\\t\\r\\f', s)) as h, size(array_remove(split(s, r'{SPACE_RUN}'), '')) as c)"
    lines = F.expr(f"filter(transform(split(`{text_col}`, '\\n', -1), (s, i) -> {line}), e -> e.c > 0)".replace("\\x20", " "))
    got = rows.select("__sw_row", "__sw_id", once(F.coalesce(lines, F.expr("cast(array() as array<struct<l:int,h:bigint,c:int>>)"))).alias("x"))
    got = got.select("__sw_row", "__sw_id", once(F.col("x.l")).alias("l"), once(F.col("x.h")).alias("h"), once(F.col("x.c")).alias("c"))
    reach = f"aggregate({{}}, struct(0 as s, 0 as n), (a, v) -> CASE WHEN a.s >= {min_words} THEN a ELSE struct(a.s + v as s, a.n + 1 as n) END, a -> CASE WHEN a.s >= {min_words} THEN a.n ELSE 0 END)"
    ahead = "transform(c, (v, i) -> struct(i + 1 as s, {} as n))".format(reach.format(f"slice(c, i + 1, {min_words})"))
    back = "transform(c, (v, i) -> struct(i + 1 as e, {} as n))".format(reach.format(f"reverse(slice(c, greatest(1, i + 2 - {min_words}), least({min_words}, i + 1)))"))
    both = f"array_distinct(filter(concat({ahead}, transform({back}, b -> struct(b.e - b.n + 1 as s, b.n as n))), w -> w.n > 0))"
    got = got.withColumn("v", once(F.expr(both)))
    part = "slice(h, w.s, w.n)"
    full = f"transform(v, w -> struct(w.s as s, w.n as n, array_min({part}) as m, w.s + cast(array_position({part}, array_min({part})) as int) - 1 as p, xxhash64({part}) as k, hash({part}) as k2))"
    return got.select("__sw_row", "__sw_id", "l", F.expr(full).alias("w"))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, __sw_lines (non-blank lines of the text) and __sw_gone (places, from 0, of the \\n-split lines that repeat an earlier run).

    Earlier is a lesser id (null first), then a lesser text by hash, then a lesser place; only rows alike in both stand
    in the order in which they are read. Lines are equal if they are so without the blanks at their ends. Null and
    empty texts have no lines. In a text whose lines repeat themselves, the first of them stays. An empty table gives
    an empty one. What goes is put to the rows by a broadcast while it is small, so that texts are not shuffled.
    """
    text = F.col(f"`{text_col}`")
    rows, _ = written(docs.withColumns({"__sw_row": F.monotonically_increasing_id(), "__sw_id": F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"))}), "rows")
    found, _ = written(_windows(rows, text_col, min_words), "windows")
    prints = found.select(F.explode(F.expr("array_distinct(transform(w, x -> struct(x.p as p, x.m as m)))")).alias("f"))
    twice, _ = written(prints.groupBy(F.col("f.m").alias("m")).agg(F.count("*").alias("times")).where("times > 1"), "twice")
    every = found.select("__sw_row", "__sw_id", F.explode("w").alias("w")).select("__sw_row", "__sw_id", "w.*")
    maybe, _ = written(split_join(every, twice, ["m"], "times").select(F.struct("__sw_id", "__sw_row", "s").alias("at"), "n", "m", "k", "k2"), "maybe")
    first, _ = written(maybe.groupBy("m", "k", "k2").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1"), "first")
    later = split_join(maybe, first, ["m", "k", "k2"], "times").where("at > first")
    gone = later.groupBy(F.col("at.__sw_row").alias("__sw_row")).agg(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at.s, at.s + n - 1)")))).alias("g"))
    gone = found.select("__sw_row", "l").join(gone, "__sw_row").select(F.col("__sw_row").alias("__sw_r"), F.array_sort(F.expr("transform(g, i -> l[i - 1])")).alias("__sw_gone"))
    gone, path = written(gone, "gone")
    told = rows.join(small(gone, path), F.col("__sw_row") == F.col("__sw_r"), "left")
    lines = F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda s: F.trim(s, F.lit(" \t\x0b\f\r")) != "")), F.lit(0)).alias("__sw_lines")
    return told.select(*[F.col(f"`{c}`") for c in docs.columns], lines, F.coalesce("__sw_gone", F.array().cast("array<int>")).alias("__sw_gone"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines of with_repeats taken out of the texts; all other lines, blank ones too, stay as they are. n_lines and n_removed are added, or replaced."""
    got = with_repeats(docs, id_col, text_col, min_words).withColumns({"n_lines": F.col("__sw_lines").cast("long"), "n_removed": F.size("__sw_gone").cast("long")})
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(F.col(f"`{text_col}`"), "\n", -1)) - 1), F.col("__sw_gone"))
    got = got.withColumns({"__sw_split": once(F.split(F.col(f"`{text_col}`"), "\n", -1)), "__sw_stay": once(F.array_sort(stay))})
    left = F.array_join(F.transform("__sw_stay", lambda i: F.get("__sw_split", i)), "\n")
    return got.withColumn(text_col, F.when(F.size("__sw_gone") > 0, left).otherwise(F.col(text_col))).drop("__sw_lines", "__sw_gone", "__sw_split", "__sw_stay")


def removal_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for each row."""
    return drop_repeated_lines(docs.select("doc_id", "text"), min_words=min_words).select("doc_id", "n_lines", "n_removed", "text")
