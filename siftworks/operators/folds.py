"""Aggregates and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.operators import scan

CAP = 0.3


#: Whole steps in one: the fold counts in millionths. _FAR is beyond all sums.
_UNIT, _FAR = 1_000_000, 1 << 60


def saturating_fold(events: DataFrame, keys: list[str], order: list[str], delta: str, item: str | None = None, cap: float = CAP) -> DataFrame:
    """keys, cumulative_adjustment and item_ids_contributing: deltas added in order, the sum held within the cap after each one, in whole millionths.

    To add d and then hold the sum is a function x -> max(low, min(high, x + shift)), and so is one such after another.
    So ranges of the order, of which a key of many events has several, are each folded into such a triple and the
    items' list, and a key's triples, one for each range, are put together in their order. A null delta adds nothing.
    Events alike in all of the order go by their delta and item.
    """
    held = F.lit(round(cap * _UNIT))
    d = F.coalesce(F.round(F.col(delta).cast("double") * _UNIT).cast("long"), F.lit(0)).alias("__d")
    names = [f"__o{i}" for i in range(len(order))]
    few = events.select(*keys, *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], d, (F.col(item) if item else F.lit(None)).cast("string").alias("__i"))
    ranged = few.repartitionByRange(*keys, *names, "__d", "__i").withColumn("__part", F.spark_partition_id())
    parts = ranged.groupBy(*keys, "__part").agg(F.array_sort(F.collect_list(F.struct(*names, "__d", "__i"))).alias("e"))  # of one range
    hold = lambda x: F.greatest(-held, F.least(held, x))
    one = F.aggregate("e", F.struct(F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"), F.lit(0).cast("long").alias("shift")), lambda a, x: F.struct(hold(a["low"] + x["__d"]).alias("low"), hold(a["high"] + x["__d"]).alias("high"), (a["shift"] + x["__d"]).alias("shift")))
    folded = parts.select(*keys, F.struct("__part", one.alias("f"), F.transform("e", lambda x: x["__i"]).alias("ids")).alias("p"))
    whole = folded.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))  # one triple a range
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: F.greatest(x["f"]["low"], F.least(x["f"]["high"], a + x["f"]["shift"])))
    return whole.select(*keys, (total / F.lit(float(_UNIT))).alias("cumulative_adjustment"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("item_ids_contributing"))


def cost_by_provider(costs: DataFrame) -> DataFrame:
    """(provider, cost_usd): sums by provider, blank ones as other, and a row total (A2)."""
    named = costs.select(F.coalesce(F.nullif("provider", F.lit("")), F.lit("other")).alias("provider"), "cost_usd")
    return named.rollup("provider").agg(F.sum("cost_usd").alias("cost_usd")).select(F.coalesce("provider", F.lit("total")).alias("provider"), "cost_usd")


def allocate(rows: DataFrame, total: Column, length: Column, group: list[str] | None = None) -> DataFrame:
    """rows with share of total by length, halves to even; a single row takes all, and no length at all counts as one (A4).

    The sums are an aggregate that is joined back, so a group's rows don't meet in one task.
    """
    group = group or []
    sums = rows.groupBy(*group).agg(F.sum(length).alias("__all"), F.count("*").alias("__n"))
    j = rows.join(sums, group) if group else rows.crossJoin(F.broadcast(sums))  # one row
    part = F.bround(total * length / F.greatest("__all", F.lit(1)), 0).cast("long")
    return j.withColumn("share", F.when(F.col("__n") == 1, total.cast("long")).otherwise(part)).drop("__all", "__n")


def median(rows: DataFrame, key: str, value: str, size: int | None = None) -> DataFrame:
    """(key, n, median): the rows of each key, and the median of its values that aren't null. A key of many rows is ranked in segments, and its middle values taken by rank."""
    segs, any_cut = scan.segmented(rows.select(key, F.col(value).alias("__x")), [key], ["__x"], size)
    plain = lambda df: df.groupBy(key).agg(F.count("*").alias("n"), F.median("__x").alias("median"))
    if not any_cut:
        return plain(segs)
    long = segs.where("__cut").select(key, "__x")
    counts = long.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"), F.count("__x").alias("m"))  # some keys
    ranks = scan.row_numbers(long.where("__x IS NOT NULL"), [key], ["__x"], "__r", size)
    middle = (F.col("__r") == F.floor((F.col("m") + 1) / 2)) | (F.col("__r") == F.floor((F.col("m") + 2) / 2))
    mids = ranks.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("__key"))).where(middle).groupBy("__key").agg((F.min("__x") * 0.5 + F.max("__x") * 0.5).alias("median"))
    far = counts.join(mids.withColumnRenamed("__key", "__mid"), F.col("__key").eqNullSafe(F.col("__mid")), "left").select(F.col("__key").alias(key), "n", "median")
    return plain(segs.where("NOT __cut")).unionByName(far)


def cadence(posts: DataFrame, key: str, ts: str, least: int = 3, daily_hours: float = 48.0, size: int | None = None) -> DataFrame:
    """(key, n, median_gap_hours, cadence): daily or sporadic by the median gap between posts, null with fewer posts than least (A5, W2, L21). A key of many posts is cut into segments of about size posts."""
    told = scan.previous_value(posts.select(key, F.col(ts).alias("__ts")), [key], ["__ts"], "__ts", "__before", size)
    gap = (F.unix_micros(F.col("__ts").cast("timestamp")) - F.unix_micros(F.col("__before").cast("timestamp"))) / 3.6e9
    got = median(told.select(key, gap.alias("g")), key, "g", size)
    enough = F.col("n") >= least
    return got.select(key, "n", F.when(enough, F.col("median")).alias("median_gap_hours"), F.when(enough, F.when(F.col("median") <= daily_hours, "daily").otherwise("sporadic")).alias("cadence"))


def drop_counts(drops: DataFrame) -> DataFrame:
    """Rows by run and filter_type, all types."""
    return drops.groupBy("run_id", "filter_type").agg(F.count("*").alias("n"))


def run_counts(items: DataFrame) -> DataFrame:
    """One row of the counts that runs report (A3)."""
    return items.agg(F.count("*").alias("n_items"), F.count_if("keep").alias("n_kept"), F.count_if(F.col("matched_card_id").isNotNull()).alias("n_matched"), F.count_if(F.col("classification") == "project_proposal").alias("n_proposals"), F.count_if(F.col("classification") == "plan_item").alias("n_plan_items"))


def node_summary(run_id: str, node: str, items_in: int, items_out: int, cost_usd: float = 0.0, seconds: float = 0.0, error: str | None = None) -> dict:
    """A row of node_summary, with what was dropped."""
    return {"run_id": run_id, "node_name": node, "items_in": items_in, "items_out": items_out, "dropped": items_in - items_out, "cost_usd": cost_usd, "duration_seconds": seconds, "error_summary": error}


def evaluate(labels: DataFrame, source: DataFrame, predictions: DataFrame) -> DataFrame:
    """n_items, keep_accuracy and mean_tag_overlap of predictions against labels (A9, J17, L20, U4). Raises if a label's item is not in source.

    labels: item_id, correct_decision, correct_tags; predictions: url, keep, tags. Labels without tags have no overlap; without labels both measures are null.
    """
    lost = [r.item_id for r in labels.join(source.select(F.col("url").alias("item_id")), "item_id", "left_anti").limit(20).collect()]
    if lost:
        raise ValueError(f"labels name items that the source has not: {lost}")
    j = labels.join(predictions.select(F.col("url").alias("item_id"), "keep", "tags"), "item_id")
    want = F.array_distinct("correct_tags")
    overlap = F.when(F.size(want) > 0, F.size(F.array_intersect(F.col("tags"), want)) / F.size(want))
    return j.select((F.col("keep") == (F.col("correct_decision") == "keep")).cast("int").alias("hit"), overlap.alias("o")).agg(F.count("*").alias("n_items"), F.avg("hit").alias("keep_accuracy"), F.avg("o").alias("mean_tag_overlap"))


def agreement(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row: items of old, those in which new agrees, and the rate; an item that new lacks does not agree."""
    j = old.select(key, F.col(value).alias("a")).join(new.select(key, F.col(value).alias("b"), F.lit(True).alias("there")), key, "left")
    same = F.coalesce(F.col("there"), F.lit(False)) & F.col("a").eqNullSafe(F.col("b"))
    return j.agg(F.count("*").alias("n"), F.count_if(same).alias("n_agree"), F.avg(same.cast("int")).alias("rate"))


def cost_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_name, old_cost, new_cost, cost_ratio, latency_delta_ms) for each node of both, from cost rows: old over new, infinite where new is free; new less old."""
    total = lambda df, side: df.groupBy("node_name").agg(F.sum("cost_usd").alias(f"{side}_cost"), F.sum("latency_ms").alias(f"{side}_ms"))
    j = total(old, "old").join(total(new, "new"), "node_name")
    ratio = F.when(F.col("new_cost") > 0, F.col("old_cost") / F.col("new_cost")).otherwise(F.lit(float("inf")))
    return j.select("node_name", "old_cost", "new_cost", ratio.alias("cost_ratio"), F.round(F.col("new_ms") - F.col("old_ms"), 1).alias("latency_delta_ms"))


def collect_errors(rows: DataFrame, errors: DataFrame, names: DataFrame) -> DataFrame:
    """(name, n_rows, error) for each configured name, also those that gave nothing, and each that has rows or errors; messages joined by "; " in their order."""
    r = rows.groupBy(F.col("author_name").alias("name")).agg(F.count("*").alias("n"))
    e = errors.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"]), "; ").alias("error"))
    every = names.select("name").union(r.select("name")).union(e.select("name")).distinct()
    return every.join(r, "name", "left").join(e, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_rows"), "error").orderBy("name")
