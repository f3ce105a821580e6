"""Small files and outside tables that runs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.sources.store import TableStore


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """The labelled set of an evaluation: item_id, correct_decision, correct_tags, notes."""
    return spark.read.schema("item_id string, correct_decision string, correct_tags array<string>, notes string").json(path, multiLine=True)


def completions(spark: SparkSession, urls: DataFrame, most: int = 1000, **jdbc: str) -> DataFrame:
    """(url, checked) of an outside table for the urls at hand (S24). jdbc: url, dbtable and what else the reader needs.

    Only two columns are read. Up to so many distinct urls, as a weekly run has, go to the database as a condition;
    with more the table is read and joined.
    """
    table = spark.read.format("jdbc").options(**jdbc).load().select("url", "checked")
    wanted = urls.select("url").distinct()
    some = [r.url for r in wanted.limit(most + 1).collect()]
    return asked(table, some) if len(some) <= most else table.join(wanted, "url", "left_semi")


def asked(table: DataFrame, urls: list[str]) -> DataFrame:
    """The rows of these urls, by a condition that a scan takes over."""
    return table.where(F.col("url").isin(urls)) if urls else table.limit(0)


def stage_rows(store: TableStore, name: str, run_id: str) -> DataFrame:
    """What an earlier run left in a table; the filter reaches the scan."""
    return store.read(name).where(f"run_id = '{run_id}'")


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files, each with one header."""
    rows.write.mode("append").option("header", True).csv(path)


def dump_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there."""
    rows.write.mode("overwrite").json(path)
