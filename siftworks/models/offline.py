"""Deterministic answers without a network, by built-in functions; the defaults of all runs and tests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.functions.rules import TAGS


class HashEmbedder:
    """Counts of hashed words as vectors."""

    def __init__(self, size: int = 256) -> None:
        self.size = size

    def embed(self, rows: DataFrame, text: str, out: str = "embedding_vector") -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        at = F.transform("__w", lambda w: F.pmod(F.xxhash64(w), F.lit(self.size)).cast("int"))
        # sorted buckets and their counts, without a pass over the words for each bucket
        counted = F.aggregate(F.array_sort(at), F.array_repeat(F.lit(0.0), self.size), lambda a, b: F.concat(F.slice(a, F.lit(1), b), F.array(F.get(a, b) + 1.0), F.slice(a, b + 2, F.lit(self.size))))
        return rows.withColumn("__w", words).withColumns({"n_tokens": F.size("__w").cast("long"), out: counted}).drop("__w")


class KeywordScorer:
    """Keeps items whose words name a tag; tags are those named, at most three."""

    def score(self, batches: DataFrame) -> DataFrame:
        hay = F.lower(F.concat_ws(" ", "title", "text"))
        named = F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(t.split("-")[0])), F.lit(t)) for t in TAGS]))
        keep = (F.size(named) > 0) & ~F.array_contains(named, "noise")
        return batches.select("batch", "index", keep.alias("keep"), F.concat(F.lit("names "), F.array_join(F.slice(named, 1, 3), ", ")).alias("reasoning"), F.slice(named, 1, 3).alias("tags"))


class NameMatcher:
    """Matches an item to the first card, by id, whose name its title holds."""

    def __init__(self, most_broadcast: int = 10_000, prefix: int = 8) -> None:
        self.most_broadcast, self.prefix = most_broadcast, prefix

    def match(self, items: DataFrame, cards: DataFrame) -> DataFrame:
        names = cards.groupBy(F.lower("name").alias("n")).agg(F.min("card_id").alias("card_id")).where("n <> ''")
        rows = items.select("url", "pos", F.lower("title").alias("t"))
        if names.limit(self.most_broadcast + 1).count() <= self.most_broadcast:
            j = rows.join(F.broadcast(names), F.contains(F.col("t"), F.col("n")), "left")
        else:
            # beyond, names meet the parts of titles that are their first letters; short names are parts as a whole
            part = F.substring("n", 1, self.prefix)
            keyed = names.withColumn("part", part)
            starts = F.sequence(F.lit(1), F.length("t"))
            every = lambda n: F.transform(starts, lambda s: F.substring(F.col("t"), s, F.lit(n)))
            parts = F.array_distinct(F.flatten(F.array(*[every(n) for n in range(1, self.prefix + 1)])))
            titles = rows.where("t <> ''").select("t").distinct().withColumn("part", F.explode(parts))
            hits = titles.join(keyed, "part").where(F.contains(F.col("t"), F.col("n"))).groupBy("t").agg(F.min("card_id").alias("card_id"))
            j = rows.join(hits, "t", "left")
        return j.groupBy(F.col("url").alias("item_id")).agg(F.min("card_id").alias("matched_card_id"), F.min("pos").alias("pos"))


class RuleClassifier:
    """Items without a card that are tools are proposals; the rest are plan items."""

    def classify(self, items: DataFrame) -> DataFrame:
        new = F.col("matched_card_id").isNull() & F.array_contains("tags", "new-tool-launch")
        return items.select(F.col("url").alias("item_id"), F.when(new, "project_proposal").otherwise("plan_item").alias("classification"), F.when(new, "new").alias("proposal_type"), F.lit("by rule").alias("classification_reasoning"), "pos")


class FirstPrioritizer:
    """The matched items in their order."""

    def select(self, items: DataFrame, cards: DataFrame, movements: DataFrame) -> DataFrame:
        m = movements.select(F.col("card_id").alias("__c"), "status")
        note = F.when(F.col("status").isin("moved", "completed"), F.concat(F.lit("card "), "status"))
        return items.join(m, F.col("matched_card_id") == F.col("__c"), "left").select("matched_card_id", F.lit("new_item").alias("source"), F.col("url").alias("item_url"), F.col("reasoning").alias("priority_reasoning"), note.alias("movement_note"), "pos")


class WordSentiment:
    def classify(self, feedback: DataFrame) -> DataFrame:
        t = F.lower("feedback_text")
        up, down = F.rlike(t, F.lit("great|good|love|more|useful")), F.rlike(t, F.lit("bad|boring|less|reject|useless"))
        strong = F.rlike(t, F.lit("very|love|!"))
        return feedback.withColumns({"direction": F.when(up & ~down, "up").when(down & ~up, "down").otherwise("neutral"), "magnitude": F.when(strong, "strong").otherwise("moderate")})


class NumberParser:
    """Replies as "3 good" or "2: bad", one a line."""

    def parse(self, replies: DataFrame, item_map: DataFrame) -> DataFrame:
        line = replies.select("message_id", F.explode(F.split("text", "\n")).alias("l"))
        rest = F.trim(F.regexp_extract("l", r"^\s*\d+[.:)]?\s*(.*)$", 1))
        bad = F.rlike(F.lower(rest), F.lit("bad|boring|less|no"))
        return line.select("message_id", F.expr(r"try_cast(nullif(regexp_extract(l, '^\\s*(\\d+)', 1), '') as int)").alias("item_number"), rest.alias("feedback_text"), F.when(bad, "negative").otherwise("positive").alias("sentiment")).where("item_number IS NOT NULL")


class AppendRewriter:
    def rewrite(self, profile: str, feedback: DataFrame) -> str:
        counts = feedback.select(F.explode("tags").alias("t"), "sentiment").groupBy("t", "sentiment").count().orderBy("t", "sentiment").collect()  # a row a tag and sentiment
        return profile.rstrip() + "".join(f"\n# {r.t}: {r.sentiment} x{r['count']}" for r in counts) + "\n"


class Outbox:
    """Keeps what would be sent. A key, or else a text, has one id, so a resend is seen as such."""

    def __init__(self) -> None:
        self.sent: dict[str, str] = {}
        self.calls = 0

    def send(self, text: str, markup: str | None = "HTML", key: str | None = None) -> str:
        ident = hashlib.sha256((key or text).encode()).hexdigest()[:12]
        self.sent[ident] = text
        self.calls += 1
        return ident

    def find(self, key: str) -> str | None:
        ident = hashlib.sha256(key.encode()).hexdigest()[:12]
        return ident if ident in self.sent else None


class MemoryBoard:
    def __init__(self) -> None:
        self.cards: dict[str, dict] = {}

    def create(self, title: str, list_id: str, description: str, key: str | None = None) -> dict:
        card = {"id": f"card{len(self.cards) + 1}", "name": title, "url": f"https://board.invalid/{len(self.cards) + 1}", "idList": list_id, "desc": description, "key": key}
        self.cards[card["id"]] = card
        return card

    def update(self, card_id: str, description: str) -> dict:
        card = self.cards.setdefault(card_id, {"id": card_id, "name": card_id, "url": "", "idList": ""})
        card["desc"] = description
        return card

    def find(self, key: str) -> dict | None:
        return next((c for c in self.cards.values() if c.get("key") == key), None)
