"""Newsletter mails: what becomes of each, by one decision table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.functions.rules import is_welcome, sender_address
from siftworks.functions.text import html_text, visible_length
from siftworks.functions.url import article_url, hrefs, redirect_target

#: Mails that are read at a time, and the length from which a body without a link is worth a look.
LIMIT, SUBSTANTIAL = 20, 2000
#: A mail as a transport gives it.
MAIL = "message_id string, subject string, from_ string, timestamp string, html string, extracted_html string, text string, extracted_text string, unread boolean"


def _resolve(mails: DataFrame, resolver: Callable[[str], str | None]) -> DataFrame:
    """(message_id, resolved, failed): tier 3 of F12. The resolver gives a link's end, or None if the request failed; it is called in link order until a post is found."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, links in zip(batch["message_id"], batch["links"], strict=True):
                hit, failed = None, False
                for link in links:
                    end = resolver(link)
                    failed |= end is None
                    if end and re.search(r"/p/[\w-]", end):
                        hit = end
                        break
                rows.append((key, hit, failed))
            yield pd.DataFrame(rows, columns=["message_id", "resolved", "failed"])

    return mails.select("message_id", "links").mapInPandas(run, "message_id string, resolved string, failed boolean")


def decide(mails: DataFrame, senders: DataFrame, resolver: Callable[[str], str | None] = lambda link: None, limit: int = LIMIT) -> DataFrame:
    """The unread mails with name, url, tier, action (read or leave), item (whether one comes of it), error and warn.

    Unknown senders are read with an error; welcome mails are read; with no link found, a mail is left for another try
    if a request failed, else read; the others give an item. senders: address, name; addresses are matched as they stand.
    """
    first = mails.where("unread").orderBy("timestamp", "message_id").limit(limit)
    body = F.coalesce("extracted_html", "html", F.lit(""))
    j = first.withColumns({"body": body, "address": sender_address(F.col("from_")), "label": F.coalesce(F.nullif("subject", F.lit("")), "message_id")})
    j = j.join(F.broadcast(senders.select("address", "name")), "address", "left").withColumns({"welcome": is_welcome(F.col("subject")), "near": article_url(F.col("body")), "links": hrefs(F.col("body"))})
    far = j.where("name IS NOT NULL AND NOT welcome AND near IS NULL")
    j = j.join(_resolve(far, resolver), "message_id", "left")
    url = F.coalesce("near", "resolved")
    error = (
        F.when(F.col("name").isNull(), F.concat("label", F.lit(": unrecognized sender")))
        .when(F.col("welcome"), F.concat("label", F.lit(": welcome mail, skipped")))
        .when(url.isNull() & F.coalesce("failed", F.lit(False)), F.concat("label", F.lit(": no link resolved, left unread")))
        .when(url.isNull(), F.concat("label", F.lit(": no link in the mail")))
    )
    leave = F.col("name").isNotNull() & ~F.col("welcome") & url.isNull() & F.coalesce("failed", F.lit(False))
    item = F.col("name").isNotNull() & ~F.col("welcome") & url.isNotNull()
    tier = F.when(F.col("near").isNotNull(), F.when(F.array_contains("links", F.col("near")), 1).otherwise(2)).when(F.col("resolved").isNotNull(), 3)
    warn = F.col("name").isNotNull() & ~item & ~leave & (visible_length(F.col("body")) > SUBSTANTIAL)
    return j.withColumns({"url": url, "tier": tier, "action": F.when(leave, "leave").otherwise("read"), "item": item, "error": error, "warn": warn})


def diagnose(mails: DataFrame, senders: DataFrame, resolver: Callable[[str], str | None] = lambda link: None, subjects: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """What each tier makes of each link of the unread mails (L23): message_id, subject, name, place, href, tier, target. Reads only.

    tier is 1 for a link to a post as it stands, 2 for one that decodes to it, 3 for one that the resolver ends at any
    page, and null for one that fails. subjects: only mails with one of these.
    """
    post = r"/p/[\w-]"
    first = mails.where("unread").orderBy("timestamp", "message_id").limit(limit)
    if subjects is not None:
        first = first.where(F.col("subject").isin(subjects))
    named = first.withColumn("address", sender_address(F.col("from_"))).join(F.broadcast(senders.select("address", "name")), "address", "left")
    each = named.select("message_id", "subject", "name", F.posexplode(hrefs(F.coalesce("extracted_html", "html", F.lit("")))).alias("place", "href"))
    each = each.withColumn("decoded", redirect_target(F.col("href")))
    near = F.when(F.rlike("href", F.lit(post)), 1).when(F.rlike(F.coalesce("decoded", F.lit("")), F.lit(post)), 2)
    each = each.withColumn("near", near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(end=[None if known == known and known is not None else resolver(h) for h, known in zip(batch["href"], batch["near"], strict=True)])

    told = each.mapInPandas(run, "message_id string, subject string, name string, place int, href string, decoded string, near int, end string")
    tier = F.coalesce("near", F.when(F.col("end").isNotNull(), 3))
    return told.select("message_id", "subject", "name", "place", "href", tier.alias("tier"), F.when(F.col("near") == 1, F.col("href")).when(F.col("near") == 2, F.col("decoded")).otherwise(F.col("end")).alias("target"))


def items(decided: DataFrame) -> DataFrame:
    """The items of decided mails."""
    raw = F.coalesce("extracted_html", "html", "extracted_text", "text", F.lit(""))
    text = F.when(F.contains(raw, F.lit("<")), html_text(raw)).otherwise(raw)
    return decided.where("item").select(F.lit("blog_scrape").alias("source"), "url", F.coalesce(F.nullif("subject", F.lit("")), "url").alias("title"), text.alias("text"), F.col("timestamp").alias("fetched_at"), F.col("name").alias("author_name"), F.lit("").alias("author_handle"), F.lit(False).alias("is_thread"), F.lit(None).cast("string").alias("thread_contents"), F.array().cast("array<string>").alias("expanded_urls"), F.lit(False).alias("has_video"), F.lit(None).cast("string").alias("video_url"))
