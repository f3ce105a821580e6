"""Grouping by URL, and the items seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions.dates import iso_timestamp
from siftworks.functions.url import normalize_url


def cluster(items: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """One row for each key: the item with the longest text, then the earliest fetched_at as text, then the first; with duplicate_count and, in pos, the place of the key's first item.

    The choice is an aggregate that is combined before the shuffle, so a key that holds many rows moves one row a task.
    """
    row = F.struct(*[F.col(c) for c in items.columns])
    best = F.min_by(row, F.struct(-F.length(F.coalesce("text", F.lit(""))), F.col("fetched_at"), F.col(pos)))
    grouped = items.groupBy(key.alias("__key")).agg(best.alias("r"), F.count("*").cast("int").alias("duplicate_count"), F.min(pos).alias("__first"))
    return grouped.select(*[F.col("r")[c].alias(c) for c in items.columns if c != pos], "duplicate_count", F.col("__first").alias(pos))


def cluster_by_url(items: DataFrame) -> DataFrame:
    """cluster by normalised URL; items without a URL are one group."""
    return cluster(items, normalize_url(F.col("url")))


def alive(seen: DataFrame, run_ts: Column, days: int = 35) -> DataFrame:
    """The seen rows that have not expired; a null seen_at never does (T1s, K2). Expiry is a filter, so nothing need be deleted first."""
    return seen.where(F.col("seen_at").isNull() | (iso_timestamp(F.col("seen_at")) >= run_ts - F.expr(f"INTERVAL {days} DAYS")))


def unseen(items: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Items whose raw key was not seen (J1, anti). Order is in pos."""
    return items.join(seen.select(key).distinct(), key, "left_anti")


def seen_again(items: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Items whose raw key was seen (J1, semi)."""
    return items.join(seen.select(key).distinct(), key, "left_semi")


def marks(items: DataFrame, seen: DataFrame, run_iso: str) -> DataFrame:
    """The rows to upsert for items seen now: first sights only, as a second sight does not renew the time (K1)."""
    return unseen(items.select("url").distinct(), seen).select("url", F.lit(run_iso).alias("seen_at"))


def backfilled(seen: DataFrame, run_iso: str) -> DataFrame:
    """seen with the run's time for rows that have none."""
    return seen.fillna({"seen_at": run_iso})
