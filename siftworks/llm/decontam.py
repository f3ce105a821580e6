"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the windows of training texts.

A text's windows are not all looked up. Any ten words in a row hold six runs of five words, and just one of those
begins at a multiple of six; only the runs there, one word in six, are looked up in the set's hashes of such runs
(anchors). Where one is found, the windows over it are cut from the text and looked up, as whole texts, in the set of
windows. What is found goes by the text's digest, so that copies are one and no row needs a number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, once, small, split_words, word_count, written

#: What parts words in lower case; words, and what parts them, in any case.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the set that may be broadcast, at so many a row of anchors; a larger set is joined by a shuffle instead.
MAX_BROADCAST, ROW_BYTES = 64 << 20, 64


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.coalesce(split_words(ascii_lower(text.cast("string")), PARTS), F.array().cast("array<string>"))


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, gram) of each window of each item: n words in a row, or all words of a shorter item. Items without words have none."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.withColumn("length", F.least(F.lit(n), F.size("w")))
    return w.select("item", "length", F.explode(F.expr("transform(sequence(1, size(w) - length + 1), s -> array_join(slice(w, s, length), ' '))")).alias("gram"))


def _anchor(length: int) -> tuple[int, int]:
    """For windows of a length: the words of an anchor, and the step from one to the next."""
    k = (length + 1) // 2
    return k, length - k + 1


def _cut(n: int) -> str:
    """SQL fields for an anchor at place p of words w: a, the start of the first window of n words over it, and c, the words of all of them."""
    low, high = f"greatest(1, p - {_anchor(n)[1] - 1})", f"least(p, size(w) - {n - 1})"
    return f"{low} AS a, array_join(slice(w, {low}, {high} - {low} + {n}), ' ') AS c"


def _spots(lengths: list[int], more: Callable[[int], str], kind: str) -> str:
    """SQL: for words w, an array of structs of length, h, an anchor's hash, and more, of its place p."""
    none = f"cast(array() as array<struct<length:int,h:bigint,{kind}>>)"
    each = []
    for n in lengths:
        k, step = _anchor(n)
        each.append(f"CASE WHEN size(w) >= {n} THEN transform(sequence({step}, size(w) - {k - 1}, {step}), p -> struct({n} AS length, xxhash64(slice(w, p, {k})) AS h, {more(n)})) ELSE {none} END")
    return f"flatten(array({', '.join(each)}))"


def _over_anchors(texts: DataFrame, windows: DataFrame, lengths: list[int], max_broadcast: int) -> DataFrame:
    """(key, length, a, c) of each anchor of texts (text) that is one of the windows': key is the text's digest, c the words from a on of all windows over it."""
    parts = [f"WHEN length = {n} THEN transform(sequence(1, {_anchor(n)[1]}), p -> xxhash64(slice(split(gram, ' '), p, {_anchor(n)[0]})))" for n in lengths]
    anchors, _ = written(windows.select("length", F.explode(F.expr(f"CASE {' '.join(parts)} END")).alias("h")).distinct(), "anchors")
    w = once(words(F.col("text"))).alias("w")
    key = F.sha2("text", 256).alias("key")
    if ROW_BYTES * anchors.count() <= max_broadcast:
        every = texts.select(key, w).select("key", F.explode(F.expr(_spots(lengths, _cut, "a:int,c:string"))).alias("x")).select("key", "x.*")
        return every.join(F.broadcast(anchors), ["length", "h"], "left_semi").select("key", "length", "a", "c")
    # beyond, hashes and places alone are shuffled, and the texts that have one are asked again
    every = texts.select(F.xxhash64("text").alias("k"), w).select("k", F.explode(F.expr(_spots(lengths, lambda n: "p AS p", "p:int"))).alias("x")).select("k", "x.*")
    met = every.join(anchors, ["length", "h"], "left_semi").groupBy("k").agg(F.collect_set(F.struct("length", "p")).alias("at"))
    met, path = written(met, "met")
    again = texts.withColumn("k", F.xxhash64("text")).join(small(met, path), "k").select(key, w, "at")
    fits = "t.length = {n} AND t.p <= size(w) - {k} AND size(w) >= {n}"
    cut = [f"transform(transform(filter(at, t -> {fits.format(n=n, k=_anchor(n)[0] - 1)}), t -> t.p), p -> struct({n} AS length, {_cut(n)}))" for n in lengths]
    return again.select("key", F.explode(F.expr(f"concat({', '.join(cut)})")).alias("x")).select("key", "x.*")


def _found(texts: DataFrame, windows: DataFrame, lengths: list[int], path: str, max_broadcast: int) -> DataFrame:
    """(key, hit, items) of each text with a window of the set: the places of its hit words, from 1, and the items, both sorted."""
    cut = _over_anchors(texts, windows, lengths, max_broadcast).withColumn("v", once(F.split("c", " ")))
    grams = F.expr("transform(sequence(0, size(v) - length), j -> struct(a + j AS s, array_join(slice(v, j + 1, length), ' ') AS gram))")
    each = cut.select("key", "length", F.explode(grams).alias("g")).select("key", "length", "g.*")
    hits = each.join(small(windows, path, most_bytes=max_broadcast // 4), ["length", "gram"])
    places = F.flatten(F.collect_set(F.expr("sequence(s, s + length - 1)")))
    return hits.groupBy("key").agg(F.array_sort(F.array_distinct(places)).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def with_hits(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with __sw_words (count), __sw_hit (places, from 1, of hit words) and __sw_items (ids, as text and sorted, of items with a window in the row).

    The set is written and measured first. Up to max_broadcast bytes it is broadcast and texts stay where they are;
    beyond, the anchors of texts, as hashes, are joined with the set by a shuffle, with the same result. docs is read
    twice: for the hits, and to put them to the rows by the digest of the text.
    """
    windows, path = written(item_windows(items, n).groupBy("length", "gram").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__sw_c{i}") for i, c in enumerate(docs.columns)], text.alias("__sw_text"))
    none_int, none_text = F.array().cast("array<int>"), F.array().cast("array<string>")
    if lengths:
        found, found_path = written(_found(docs.select(text.alias("text")).where("text IS NOT NULL"), windows, lengths, path, max_broadcast), "hits")
        rows = rows.withColumn("__sw_key", F.sha2("__sw_text", 256)).join(small(found.withColumnsRenamed({"key": "__sw_k", "hit": "__sw_hit", "items": "__sw_items"}), found_path), F.col("__sw_key") == F.col("__sw_k"), "left")
    else:
        rows = rows.withColumns({"__sw_hit": none_int, "__sw_items": none_text})
    count = word_count(F.col("__sw_text"), RAW_PARTS)
    return rows.select(*[F.col(f"__sw_c{i}").alias(c) for i, c in enumerate(docs.columns)], count.alias("__sw_words"), F.coalesce("__sw_hit", none_int).alias("__sw_hit"), F.coalesce("__sw_items", none_text).alias("__sw_items"))


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = 10, text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without the test set's passages, all columns kept.

    mode "documents" drops rows with a hit word; mode "spans" takes the hit words out of their texts, with what stands
    between two hit words, and leaves all else as it is. Null texts have no words and stay; an empty test set or table
    changes nothing; rows that repeat are judged each.
    """
    found = with_hits(docs, items, n, text_col, max_broadcast)
    if mode == "documents":
        return found.where("size(__sw_hit) = 0").select(*docs.columns)
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    text = F.col(f"`{text_col}`")
    found = found.withColumns({"__sw_raw": once(split_words(text, RAW_PARTS)), "__sw_gap": once(F.split(text, RAW_WORD, -1))})
    # what stands after a hit word stays unless the next is hit as well; sorted sets, so that a long text's cost is near its length
    inner = F.array_intersect("__sw_hit", F.transform("__sw_hit", lambda i: i - 1))
    found = found.withColumn("__sw_last", once(F.array_except("__sw_hit", inner)))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("__sw_raw")), F.col("__sw_hit")), lambda i: F.struct(i.alias("i"), F.concat(F.get("__sw_raw", i - 1), F.get("__sw_gap", i)).alias("t")))
    ends = F.transform("__sw_last", lambda i: F.struct(i.alias("i"), F.get("__sw_gap", i).alias("t")))
    left = F.concat(F.get("__sw_gap", F.lit(0)), F.array_join(F.array_sort(F.concat(kept, ends))["t"], ""))
    return found.withColumn(text_col, F.when(F.size("__sw_hit") > 0, left).otherwise(text)).select(*docs.columns)


def hit_digest(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    found = with_hits(docs.select("doc_id", "text"), items, max_broadcast=max_broadcast)
    return found.select(
        "doc_id", F.col("__sw_words").alias("n_words"), F.size("__sw_hit").cast("long").alias("n_hit"), F.size("__sw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__sw_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("__sw_hit") > 0).alias("contaminated"),
    )
