"""Replies: where they go, and the feedback in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.functions.rules import decision


def route(updates: DataFrame, pending: DataFrame) -> DataFrame:
    """updates with route, decision and the pending row's ids (P20, P21, J14). Works on a stream, with pending static.

    A reply to a pending proposal is approval, or unclear if its words decide nothing; another reply is feedback; a
    message that isn't blank is queued; the rest is ignored. updates: update_id, message_id, text, reply_to.
    """
    p = pending.select(F.col("message_id").alias("__m"), "thread_id", "proposal_id", "run_id")
    text = F.trim(F.coalesce("text", F.lit("")))
    j = updates.join(p, F.col("reply_to") == F.col("__m"), "left").withColumns({"text": text, "decision": decision(text)})
    go = (
        F.when(F.col("__m").isNotNull(), F.when(F.col("decision").isNull(), "unclear").otherwise("approval"))
        .when(F.col("reply_to").isNotNull(), "feedback").when(F.col("text") != "", "queue").otherwise("ignore")
    )
    return j.withColumn("route", go).withColumn("decision", F.when(F.col("route") == "approval", F.col("decision"))).drop("__m")


def feedback_entries(parsed: DataFrame, item_map: DataFrame) -> DataFrame:
    """Parsed entries with a real sentiment and number, joined with their items (P13, J15). parsed: message_id, item_number, feedback_text, sentiment."""
    good = parsed.where(F.col("sentiment").isin("positive", "negative") & F.col("item_number").isNotNull())
    return good.join(item_map, ["message_id", "item_number"])


def feedback_rows(entries: DataFrame, replied_at: str) -> DataFrame:
    """The rows of feedback_events for joined entries; texts cut to 300 characters."""
    return entries.select(F.col("url").alias("item_id"), "feedback_text", F.lit(replied_at).alias("replied_at"), "run_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("content_summary"), "sentiment")


def queue_rows(messages: DataFrame, queued_at: str) -> DataFrame:
    """The rows of adhoc_queue for queued messages, keyed by update so that a replay adds none twice (T4s, T5s)."""
    return messages.where("route = 'queue'").select(F.concat(F.lit("u"), F.col("update_id").cast("string")).alias("key"), "text", F.lit(queued_at).alias("queued_at"))


def queue_items(queue: DataFrame) -> DataFrame:
    """Queued texts as items; blank ones are no items and stay in the queue."""
    some = queue.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    empty = F.array().cast("array<string>")
    return some.select(F.lit("adhoc").alias("source"), F.concat(F.lit("adhoc:"), "key").alias("url"), F.substring("text", 1, 80).alias("title"), "text", F.col("queued_at").alias("fetched_at"), F.lit("").alias("author_name"), F.lit("").alias("author_handle"), F.lit(False).alias("is_thread"), F.lit(None).cast("string").alias("thread_contents"), empty.alias("expanded_urls"), F.lit(False).alias("has_video"), F.lit(None).cast("string").alias("video_url"))
