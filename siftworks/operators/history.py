"""Lookups of what came before: prior entries, movement, carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.operators import scan


def latest_prior(entries: DataFrame, order: str, current: str | None = None, key: str = "run_id") -> DataFrame:
    """The one entry with the greatest order whose key is not the current one; of equal ones the greatest key (J11, O4). One row or none."""
    rest = entries.where(F.col(key).isNotNull() & (F.lit(True) if current is None else F.col(key) != current))
    return rest.agg(F.max_by(F.struct(*entries.columns), F.struct(F.coalesce(order, F.lit("")), key)).alias("r")).where("r IS NOT NULL").select("r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], size: int | None = None) -> DataFrame:
    """left with values of the last row of right, by key, at or before its time; of rows of one time the one of the greatest values (J11 in general, W6).

    Both tables go through one sort by key and time, so there is no range join; a key of many rows goes through it in
    segments of about size rows (operators.scan).
    """
    a = left.withColumn("__side", F.lit(1)).withColumn("__row", F.struct(*left.columns))
    b = right.select(key, ts, F.struct(*values).alias("__v0")).withColumn("__side", F.lit(0))
    both = a.select(key, ts, "__side", "__row", F.lit(None).cast(b.schema["__v0"].dataType).alias("__v0")).unionByName(b, allowMissingColumns=True)
    told = scan.last_value(both, [key], [ts, "__side", "__v0"], "__v0", "__told", size).where("__side = 1")
    return told.select("__row.*", *[F.col("__told")[v].alias(f"prior_{v}") for v in values])


def previous(rows: DataFrame, key: str, order: list[str], value: str, out: str = "previous", size: int | None = None) -> DataFrame:
    """rows with the value of the key's row before, by order, or null for its first (W6). A key of many rows is cut into segments of about size rows."""
    return scan.previous_value(rows, [key], order, value, out, size)


def movement(prior: DataFrame, snapshot: DataFrame, lists: DataFrame, done: str = "Done") -> DataFrame:
    """Where the cards of an earlier plan stand now (J10, L18). prior: card_id, list_name; snapshot: card_id, closed, list_id; lists: list_id, list_name.

    A card that is gone is not_found; archived goes before completed, completed before moved and unchanged.
    """
    now = snapshot.select("card_id", "closed", "list_id", F.lit(True).alias("there")).join(lists.select("list_id", F.col("list_name").alias("now_name")), "list_id", "left")
    j = prior.select("card_id", F.col("list_name").alias("previous_list_name")).join(now, "card_id", "left")
    name = F.coalesce("now_name", F.lit("Unknown"))
    status = F.when(F.col("there").isNull(), "not_found").when(F.col("closed"), "archived").when(name == done, "completed").when(name != F.coalesce("previous_list_name", F.lit("")), "moved").otherwise("unchanged")
    current = F.when(F.col("there").isNull(), F.lit(None)).when(F.col("closed"), F.col("now_name")).otherwise(name)
    return j.select("card_id", "previous_list_name", current.alias("current_list_name"), status.alias("status"))


def prior_run(runs: DataFrame, current: str, path: str = "weekly") -> DataFrame:
    """The last successful run of a path before the current one, by finished_at; paused and failed runs don't count."""
    return latest_prior(runs.where((F.col("path") == path) & (F.col("status") == "success")), "finished_at", current)


def carry_forward(runs: DataFrame, item_map: DataFrame, completions: DataFrame, carried: DataFrame, current: str) -> DataFrame:
    """Reading and course items of the last weekly plan that were neither checked nor carried before, as plan items (J12, J13, P17, T7s, L17)."""
    last = prior_run(runs, current).select("run_id")
    items = item_map.join(F.broadcast(last), "run_id", "left_semi").where(F.col("section").isin("reading", "courses"))
    done = completions.where("checked").select("url")
    left = items.join(done, "url", "left_anti").join(carried.select("url"), "url", "left_anti")
    return left.select(
        "url", "title", "text", "reasoning", F.lit("plan_item").alias("classification"), F.lit(None).cast("string").alias("proposal_type"),
        F.lit("carried forward, unfinished last week").alias("classification_reasoning"), F.lit(None).cast("string").alias("matched_card_id"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("item_number").cast("long").alias("pos"),
    )


def recent(events: DataFrame, ts: str, run_ts: Column, days: int = 7) -> DataFrame:
    """Rows not older than so many days; rows without a time go (P15, T2s)."""
    at = F.try_to_timestamp(F.col(ts)) if dict(events.dtypes)[ts] == "string" else F.col(ts)
    return events.where(at >= run_ts - F.expr(f"INTERVAL {days} DAYS"))
