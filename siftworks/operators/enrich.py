"""Joins of items with what models and boards say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.rules import valid_classification, valid_tags
from siftworks.operators.cut import cut


def first_by(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("r")).select(key, "r.*")


def last_by(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("r")).select(key, "r.*")


def batched(items: DataFrame, size: int = 50, pos: str = "pos") -> DataFrame:
    """items with batch and index, both from 0, in the order of pos.

    Rows are ranged by pos into partitions of about one size, whatever gaps pos has, sorted there and cut; a row's place
    in its partition is then given, and the partitions' counts, a row each, give where they start. So no task sorts all rows.
    """
    ranged = cut(items.repartitionByRange(pos).sortWithinPartitions(pos).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ranged.groupBy(part.alias("__p")).count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
    at = ranged.join(F.broadcast(starts), part == F.col("__p")).withColumn("__at", F.col("__from") + F.col("__id").bitwiseAND((1 << 33) - 1))
    return at.select(*items.columns, F.expr(f"cast(__at div {size} as int)").alias("batch"), F.pmod("__at", F.lit(size)).cast("int").alias("index"))


def join_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Batched items with their scores by batch and index: inner, so an item without a score is lost and one scored twice comes twice (J5). Tags are cut to those allowed."""
    told = scores.select("batch", "index", "keep", "reasoning", F.col("tags").alias("__tags"))
    return items.join(told, ["batch", "index"]).withColumn("tags", valid_tags(F.col("__tags"))["kept"]).drop("__tags")


def rejected_tags(items: DataFrame, scores: DataFrame) -> DataFrame:
    """(item_id, tag) of tags that are not allowed."""
    told = items.select("batch", "index", F.col("url").alias("item_id")).join(scores.select("batch", "index", "tags"), ["batch", "index"])
    return told.select("item_id", F.explode(valid_tags(F.col("tags"))["rejected"]).alias("tag"))


def with_matches(kept: DataFrame, matches: DataFrame) -> DataFrame:
    """Items with matched_card_id: left, the last answer for an item winning (J6). matches has item_id, matched_card_id and pos."""
    one = last_by(matches, "item_id").select(F.col("item_id").alias("url"), "matched_card_id")
    return kept.join(one, "url", "left")


def with_classes(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Items with classification, proposal_type and classification_reasoning: left, the last answer winning, faults put right."""
    one = last_by(classes, "item_id").select(F.col("item_id").alias("url"), F.struct("classification", "proposal_type", "classification_reasoning").alias("c"))
    put = valid_classification(F.col("c.classification"), F.col("c.proposal_type"), F.when(F.col("c").isNull(), F.lit("fallback: not classified")).otherwise(F.col("c.classification_reasoning")))
    return items.join(one, "url", "left").withColumn("k", put).select(*items.columns, "k.*")


def matched_candidates(items: DataFrame) -> DataFrame:
    """Plan items with a card and without the course tag."""
    return items.where((F.col("classification") == "plan_item") & ~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "course") & F.col("matched_card_id").isNotNull())


def valid_selection(chosen: DataFrame, cards: DataFrame, items: DataFrame, most: int = 5) -> DataFrame:
    """The chosen entries that point at a known card and, if new items, at a known item; at most so many, in the order of pos, which becomes rank."""
    source = F.when(F.col("source").isin("new_item", "stale_nudge"), F.col("source")).otherwise(F.lit("stale_nudge"))
    known = chosen.withColumn("source", source).join(cards.select(F.col("card_id").alias("matched_card_id")).distinct(), "matched_card_id", "left_semi")
    urls = items.select(F.col("url").alias("item_url")).distinct()
    fresh = known.where("source = 'new_item'").join(urls, "item_url", "left_semi").select(*known.columns)
    idle = known.where("source = 'stale_nudge'").withColumn("item_url", F.lit(None).cast("string")).select(*known.columns)
    first = fresh.unionByName(idle).orderBy("pos").limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("pos"))).withColumn("priority_reasoning", F.coalesce("priority_reasoning", F.lit("")))


def project_entries(selection: DataFrame, cards: DataFrame, items: DataFrame) -> DataFrame:
    """The rendered form of each selected entry, by rank: from its item, or, for an idle card or an unknown item, from the card."""
    c = cards.select(F.col("card_id").alias("matched_card_id"), F.col("name").alias("c_name"), F.col("url").alias("c_url"))
    i = items.select(F.col("url").alias("i_url"), F.col("title").alias("i_title"), F.col("text").alias("i_text"), F.col("tags").alias("i_tags"))
    on = (F.col("item_url") == F.col("i_url")) & (F.col("source") == "new_item")
    j = selection.join(c, "matched_card_id", "left").join(i, on, "left")
    found = F.col("i_url").isNotNull()
    card_name = F.coalesce("c_name", "matched_card_id")
    title = F.when(found, F.coalesce(F.nullif("i_title", F.lit("")), "i_text")).otherwise(card_name)
    why = F.when(F.coalesce("movement_note", F.lit("")) != "", F.concat("priority_reasoning", F.lit(" — "), "movement_note")).otherwise(F.col("priority_reasoning"))
    return j.select("rank", F.substring(title, 1, 80).alias("title"), F.when(found, F.col("i_url")).otherwise(F.coalesce("c_url", F.lit(""))).alias("url"), F.when(found, F.col("i_text")).otherwise(F.lit("")).alias("text"), F.when(found, F.col("i_tags")).otherwise(F.array().cast("array<string>")).alias("tags"), why.alias("reasoning"), card_name.alias("card_name"), "source")


def surfaced_cards(selection: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_id, list_name) of the cards that a plan shows, each once with its first list, by card_id; "Unknown" for cards that the board has not."""
    one = first_by(selection.select(F.col("matched_card_id").alias("card_id"), F.col("rank").alias("pos")), "card_id")
    return one.join(cards.select("card_id", "list_name"), "card_id", "left").select("card_id", F.coalesce("list_name", F.lit("Unknown")).alias("list_name")).orderBy("card_id")


def board_cards(lists: DataFrame, cards: DataFrame, wanted: tuple[str, ...] = ("Dump", "In Progress")) -> DataFrame:
    """Cards of the wanted open lists, checklist items flattened."""
    open_ = lists.where(F.col("name").isin(*wanted)).select(F.col("id").alias("list_id"), F.col("name").alias("list_name"))
    flat = F.flatten(F.transform(F.coalesce("checklists", F.expr("cast(array() as array<struct<checkItems:array<struct<name:string>>>>)")), lambda x: x["checkItems"]["name"]))
    return cards.join(open_, cards.idList == open_.list_id).select(F.col("id").alias("card_id"), "name", "desc", "list_id", "list_name", F.col("shortUrl").alias("url"), flat.alias("checklist_items"), F.col("dateLastActivity").alias("last_activity"))
