"""Scans in segments, and the fold by ranges, against plain windows and loops; one key with half of all rows."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftworks.operators import folds, history, scan


def events(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None, *map(str, range(40))]), r.choice([None, *range(n // 2)]), i, r.choice([None, "x", "y", "z"])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, id int, v string"), rows


def sorted_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("size", [None, 1, 20, 100])
def test_segments_give_what_a_window_gives(spark, size):
    df, _ = events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    every = ["k", "t", "id", "v"]
    want = df.select(*every, F.lag("v").over(w).alias("previous"))
    assert sorted_rows(scan.previous_value(df, ["k"], ["t", "id"], "v", "previous", size)) == sorted_rows(want)
    want = df.select(*every, F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("o"))
    assert sorted_rows(scan.last_value(df, ["k"], ["t", "id"], "v", "o", size)) == sorted_rows(want)
    want = df.select(*every, F.row_number().over(w).cast("long").alias("o"))
    assert sorted_rows(scan.row_numbers(df, ["k"], ["t", "id"], "o", size)) == sorted_rows(want)


def test_a_key_with_half_of_all_rows_is_in_no_task_whole(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 4000).cast("string"))).alias("k"), (F.col("id") * 7919 % 40_009).alias("t"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        segs, any_cut = scan.segmented(df, ["k"], ["t"], 40_000 // 128)
        assert any_cut and segs.where("k = 'hot'").select("__seg").distinct().count() > 32
        told = scan.previous_value(df, ["k"], ["t"], "t", "p", 40_000 // 128)
        sizes = sorted(r[1] for r in told.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("p")).collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * statistics.median(sizes)
        # the fold: ranges are tasks
        f = df.select("k", "t", F.lit(0.1).alias("d"))
        sizes = sorted(r[1] for r in f.repartitionByRange("k", "t").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * statistics.median(sizes)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("size", [None, 30])
def test_as_of_with_ties_and_cut_keys(spark, size):
    r = random.Random(2)
    left = [(r.choice("hhhab"), r.randrange(200), i) for i in range(600)]
    right = [(r.choice("hhhac"), r.randrange(200), r.choice([None, *range(50)])) for _ in range(300)]
    got = history.as_of(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, w int"), "k", "t", ["w"], size)
    want = []
    for k, t, i in left:
        before = [(t2, w is not None, w or 0, w) for k2, t2, w in right if k2 == k and t2 <= t]
        want.append((k, t, i, max(before)[3] if before else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [None, 25])
def test_cadence_and_median_of_cut_keys(spark, size):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", "c", None]), 1_700_000_000 + r.randrange(10_000_000)) for _ in range(500)] + [("one", 5), ("two", 5), ("two", 7)]
    got = folds.cadence(spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("t")), "k", "t", size=size).collect()
    assert len(got) == 7
    for g in got:
        times = sorted(s for k, s in rows if k == g.k)
        gaps = [(b - a) / 3600 for a, b in zip(times, times[1:])]
        assert g.n == len(times)
        assert (g.median_gap_hours is None) == (len(times) < 3) and (len(times) < 3 or abs(g.median_gap_hours - statistics.median(gaps)) < 1e-9)


def plain_fold(events, cap=0.3):
    x = 0.0
    for *_, d, _ in sorted(events, key=lambda e: (e[0], e[1])):
        x = round(max(-cap, min(cap, x + d)), 6)
    return x


@pytest.mark.parametrize("parts", ["1", "7"])
def test_the_fold_equals_adding_one_by_one(spark, parts):
    r = random.Random(int(parts))
    rows = [(r.choice(["hot"] * 9 + ["a", "b", None]), r.randrange(200), i, r.choice([-0.2, -0.05, 0.05, 0.1, 0.0, 0.123456]), f"i{i}") for i in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = folds.saturating_fold(spark.createDataFrame(rows, "tag string, at int, n int, d double, item string"), ["tag"], ["at", "n"], "d", "item").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 4
    for g in got:
        mine = [e[1:] for e in rows if e[0] == g.tag]
        assert g.cumulative_adjustment == plain_fold(mine)
        assert g.item_ids_contributing == [e[3] for e in sorted(mine)]


def test_the_fold_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0.1), ("b", 1, None)], "tag string, at int, d double")
    assert sorted((r.tag, r.cumulative_adjustment) for r in folds.saturating_fold(df, ["tag"], ["at"], "d").collect()) == [("a", 0.1), ("b", 0.0)]
    assert folds.saturating_fold(df.limit(0), ["tag"], ["at"], "d").collect() == []
