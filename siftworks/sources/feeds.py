"""RSS feeds, roundup pages, listing pages and bookmark exports."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.context import RunContext
from siftworks.functions.dates import fresh, listing_date, rfc2822
from siftworks.functions.rules import is_case_study
from siftworks.functions.text import file_name, is_challenge, make_title, strip_illegal_xml, video_url
from siftworks.schemas import ITEM
from siftworks.sources.pages import FOUND, POST_CLASS, post, rows_of, story

#: Hours after which a post is too old, by source bucket; posts that are read of a source that sets no limit.
MAX_AGE = {"daily": 48, "weekly": 216}
LIMIT = 30
CONFIG = "name string, bucket string, kind string, url string, fetch_limit int, drop_case_studies boolean"
#: A fetched body: the transport's job, and in tests a file's.
BODY = "name string, url string, content_type string, body string"


def sources(spark: SparkSession, entries: list[dict], ctx: RunContext) -> DataFrame:
    """The sources of a run's buckets (S16, P2). entries: name, bucket, kind (feed, roundup or listing), url, fetch_limit?, drop_case_studies?."""
    rows = [(e["name"], e["bucket"], e.get("kind", "feed"), e["url"], e.get("fetch_limit", LIMIT), bool(e.get("drop_case_studies"))) for e in entries]
    for r in rows:
        if r[1] not in MAX_AGE:
            raise ValueError(f"source {r[0]} has the unknown bucket {r[1]}")
    return spark.createDataFrame(rows, CONFIG).where(F.col("bucket").isin(*ctx.buckets))


def _entries(root: ET.Element) -> list[ET.Element]:
    channel = root.find("channel")
    return root.findall(".//item") if channel is None else channel.findall("item")


def _feed_rows(body: str) -> list[tuple]:
    def read(text: str) -> ET.Element:
        return ET.fromstring(text.encode("utf-8"))

    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", body)
    try:
        root = read(text)
    except ET.ParseError:
        root = read(re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;", text))
    space = {"c": "http://purl.org/rss/1.0/modules/content/", "d": "http://purl.org/dc/elements/1.1/"}
    paths = ("link", "title", "pubDate", "c:encoded", "description", "d:creator", "author")
    return [(n, *((e.findtext(p, namespaces=space) or "").strip() for p in paths)) for n, e in enumerate(_entries(root))]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["name", "place", "link", "title", "date", "encoded", "description", "creator", "author", "error"]
    for batch in batches:
        rows = []
        for name, body in zip(batch["name"], batch["body"], strict=True):
            try:
                rows += [(name, *r, None) for r in _feed_rows(body or "")]
            except ET.ParseError as e:
                rows.append((name, None, *[None] * 7, str(e)))
        yield pd.DataFrame(rows, columns=names).astype({"place": "Int64"})


def _item(**given: Column) -> list[Column]:
    """An item's columns, those not given at their defaults."""
    base = {
        "source": F.lit("blog_scrape"), "text": F.lit(""), "author_name": F.lit(""), "author_handle": F.lit(""), "is_thread": F.lit(False), "thread_contents": F.lit(None).cast("string"),
        "expanded_urls": F.array().cast("array<string>"), "has_video": F.lit(False), "video_url": F.lit(None).cast("string"),
    } | given
    return [base[p.split(" ")[0]].alias(p.split(" ")[0]) for p in ITEM.split(", ")]


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_feeds(bodies: DataFrame, config: DataFrame, ctx: RunContext) -> tuple[DataFrame, DataFrame]:
    """Items and errors (name, message) of fetched RSS bodies.

    A body that is a bot challenge or does not parse, even with its bare ampersands escaped, gives one error; its text
    can be put in quarantine from the bodies by name. The first fetch_limit entries count, then links, then ages.
    """
    told = bodies.withColumn("blocked", is_challenge(F.col("content_type"), F.col("body")))
    good = told.where("NOT blocked").select("name", strip_illegal_xml(F.col("body")).alias("body"))
    parsed = good.mapInPandas(_parse, "name string, place long, link string, title string, date string, encoded string, description string, creator string, author string, error string")
    errors = told.where("blocked").select("name", F.lit("blocked by a bot challenge").alias("message")).unionByName(parsed.where("error IS NOT NULL").select("name", F.col("error").alias("message")))
    rows = parsed.where("error IS NULL").join(F.broadcast(config), "name").where("place < fetch_limit AND link <> ''")
    ts = rfc2822(F.col("date"), ctx.now())
    real = F.col("date") != ""
    young = F.lit(False)
    for bucket, hours in MAX_AGE.items():
        young |= (F.col("bucket") == bucket) & fresh(ts, real, ctx.now(), hours)
    text = F.when(F.col("encoded") != "", F.col("encoded")).otherwise(F.col("description"))
    rows = rows.withColumns({"ts": ts, "text": text, "title": F.coalesce(F.nullif("title", F.lit("")), "link")}).where(young & (F.col("title") != ""))
    rows = rows.where(~F.col("drop_case_studies") | ~is_case_study(F.col("title"), F.col("text")))
    v = video_url(F.col("text"))
    items = rows.select(*_item(url=F.col("link"), title=F.col("title"), text=F.col("text"), fetched_at=_iso(F.col("ts")), author_name=F.coalesce(F.nullif("creator", F.lit("")), "author"), has_video=v["has_video"], video_url=v["video_url"]), F.col("name").alias("origin"), "place")
    return items, errors


def quarantine(bodies: DataFrame, errors: DataFrame) -> DataFrame:
    """The bodies that gave errors, with a file name each."""
    return bodies.join(errors.select("name").distinct(), "name", "left_semi").withColumn("file", F.concat(file_name(F.col("name")), F.lit(".bin")))


def parse_roundups(pages: DataFrame) -> DataFrame:
    """The stories of fetched roundup pages: name, fetched_at, body (S7, S8, P5). Sponsored ones go, reading times leave the titles; hrefs stay as written."""
    each = pages.select("name", "fetched_at", "body").mapInPandas(rows_of(story), FOUND).where("title <> ''")
    return each.select(*_item(url=F.col("href"), title=F.col("title"), text=F.col("more"), fetched_at=F.col("fetched_at"), author_name=F.col("name")), F.col("name").alias("origin"), "place")


def parse_listings(pages: DataFrame, config: DataFrame, ctx: RunContext, base: str, prefix: str = "/engineering/") -> DataFrame:
    """The posts of a listing page (S9): articles with a link under prefix and a title, joined to base; the age filter counts only where a date was read."""
    found = pages.select("name", F.lit(None).cast("string").alias("fetched_at"), "body").mapInPandas(rows_of(lambda a: post(a, prefix), lambda a: a.kind.endswith(POST_CLASS)), FOUND)
    each = found.join(F.broadcast(config.select("name", "bucket", "fetch_limit")), "name").where("place < fetch_limit")
    ts = F.coalesce(listing_date(F.col("more")), ctx.now())
    young = F.lit(False)
    for bucket, hours in MAX_AGE.items():
        young |= (F.col("bucket") == bucket) & fresh(ts, F.col("more") != "", ctx.now(), hours)
    return each.where(young).select(*_item(url=F.concat(F.lit(base), F.col("href")), title=F.col("title"), fetched_at=_iso(ts), author_name=F.col("name")), F.col("name").alias("origin"), "place")


def fetch_sources(bodies: DataFrame, config: DataFrame, ctx: RunContext, base: str = "", prefix: str = "/engineering/") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, errors (name, message) and a cost row for each source of config, by its kind: feed, roundup or listing.

    bodies may have fetched_at, of a roundup's issue, latency_ms of the fetch, and failed, its message. A source that
    failed, or gave nothing that parses, leaves the others as they are. Kinds that no reader knows raise.
    """
    kinds = [r.kind for r in config.select("kind").distinct().collect()]  # three at most
    if unknown := set(kinds) - {"feed", "roundup", "listing"}:
        raise ValueError(f"unknown kinds of source {sorted(unknown)}")
    for column, value in (("fetched_at", F.lit(ctx.now_iso())), ("latency_ms", F.lit(0.0)), ("failed", F.lit(None).cast("string"))):
        bodies = bodies if column in bodies.columns else bodies.withColumn(column, value)
    told = bodies.join(F.broadcast(config.select("name", "kind")), "name")
    got = told.where("failed IS NULL")
    items, errors = parse_feeds(got.where("kind = 'feed'").select("name", "url", "content_type", "body"), config, ctx)
    stories = parse_roundups(got.where("kind = 'roundup'"))
    posts = parse_listings(got.where("kind = 'listing'"), config, ctx, base, prefix)
    every = union_items([items.withColumn("place", F.col("place").cast("long")), stories.withColumn("place", F.col("place").cast("long")), posts.withColumn("place", F.col("place").cast("long"))])
    errors = errors.unionByName(told.where("failed IS NOT NULL").select("name", F.col("failed").alias("message")))
    said = errors.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("message")), "; ").alias("said"))
    took = bodies.groupBy("name").agg(F.sum("latency_ms").alias("latency_ms"))
    costs = config.select("name").join(took, "name", "left").join(said, "name", "left").select(
        F.lit("fetch").alias("node_name"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), F.lit(0.0).alias("cost_usd"),
        F.when(F.col("said").isNotNull(), F.concat("name", F.lit(": "), "said")).alias("error"), F.lit(None).cast("string").alias("provider"), F.lit(ctx.run_id).alias("run_id"), F.col("name").alias("source_name"),
    )
    return every, errors, costs


BOOKMARK = "id string, date string, text string, url string, user struct<name:string,handle:string>, links array<struct<shortUrl:string,expandedUrl:string>>, quote_status struct<text:string>"


def read_bookmarks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and row errors (place, message) of a bookmark export (S10, S11). A file without a list named data raises; a row of another shape is an error, and the others stay."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "data array<string>", {"mode": "PERMISSIVE"}).alias("f"), F.get_json_object("value", "$.data").alias("d"))
    if raw.where("d IS NULL OR NOT startswith(ltrim(d), '[')").limit(1).count() or not raw.limit(1).count():
        raise ValueError(f"{path} has no list named data")
    each = raw.select(F.posexplode("f.data").alias("place", "j"))
    each = each.withColumns({"r": F.from_json("j", BOOKMARK, {"mode": "PERMISSIVE"}), "u": F.substring(F.ltrim(F.coalesce(F.get_json_object("j", "$.user"), F.lit("{"))), 1, 1), "o": F.substring(F.ltrim("j"), 1, 1)})
    good = (F.col("o") == "{") & (F.col("u") == "{")
    text = F.coalesce("r.text", F.lit(""))
    urls = F.filter(F.transform(F.coalesce("r.links", F.expr("cast(array() as array<struct<shortUrl:string,expandedUrl:string>>)")), lambda x: x["expandedUrl"]), lambda x: x.isNotNull())
    quoted = F.get_json_object("j", "$.quote_status").isNotNull()
    items = each.where(good).select(*_item(source=F.lit("bookmarks"), url=F.coalesce("r.url", F.lit("")), title=make_title(text), text=text, fetched_at=F.coalesce("r.date", F.lit("")), author_name=F.coalesce("r.user.name", F.lit("")), author_handle=F.coalesce("r.user.handle", F.lit("")), is_thread=quoted, thread_contents=F.when(quoted, F.col("r.quote_status.text")), expanded_urls=urls), "place")
    return items, each.where(~good).select("place", F.lit("not the shape of a bookmark").alias("message"))


def union_items(parts: list[DataFrame]) -> DataFrame:
    """All items, UNION ALL, with pos in the order of parts and then places."""
    shaped = [p.select("*", F.struct(F.lit(i).alias("a"), F.col("place").cast("long").alias("b"), F.col("url").alias("c")).alias("__o")) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shaped)
    return every.withColumn("pos", F.col("__o.a") * F.lit(1 << 40) + F.coalesce("__o.b", F.lit(0))).drop("__o", "place")
