"""Renderers, whole runs, polling and streams."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siftworks.context import RunContext
from siftworks.models.offline import HashEmbedder, MemoryBoard, Outbox
from siftworks.plans import render, runs
from siftworks.schemas import CARD, ITEM
from siftworks.sources.store import TableStore
from siftworks.streaming import stateful, updates

T0 = datetime(2026, 7, 20, 8, tzinfo=timezone.utc)
ENTRY = "url string, title string, text string, tags array<string>, reasoning string, keep boolean, pos long"
OFF = ENTRY + ", best_tag string, similarity_score double"


def ctx(n, context="daily", **more):
    return RunContext(context=context, run_id=f"run{n}", run_ts=T0 + timedelta(days=n), **more)


def item(url, title, text="text", source="blog_scrape", at="2026-07-20"):
    return (source, url, title, text, at, "a", "", False, None, [], False, None)


def items(spark, *rows):
    df = spark.createDataFrame(list(rows), ITEM)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(df.collect())], ITEM + ", pos long")


def entries(spark, *rows):
    return spark.createDataFrame([(u, t, x, g, r, k, i) for i, (u, t, x, g, r, k) in enumerate(rows)], ENTRY)


def test_digest(spark):
    scored = entries(spark, *[(f"http://u/{i}?a&b", f"T<{i}>", "x", ["evals"], "r&r", True) for i in range(17)], ("d", "D", "", [], "", False))
    off = spark.createDataFrame([("http://o", "", "raw text", [], "", True, 0, "evals", 0.1234)], OFF)
    text, shown = render.digest(scored, off, "abcdefghij", {"total": 1.5, "anthropic": 1.0})
    lines = text.split("\n")
    assert lines[0] == "🤖 <b>Daily Digest</b>"
    assert lines[2:5] == ['1. <a href="http://u/0?a&amp;b">T&lt;0&gt;</a>', "   Tags: <code>evals</code>", "   <i>r&amp;r</i>"]
    assert "<b>1 item(s) didn't match any existing topic</b>" in lines and '16. <a href="http://o">raw text</a>' in lines
    assert lines[-2:] == ["<i>18 scored · 15/17 shown · 1 uncategorized · run: abcdefgh</i>", "<i>Cost: $1.5000 (Anthropic: $1.0000, NVIDIA embeddings: $0.0000)</i>"]
    assert [s["item_number"] for s in shown] == list(range(1, 17)) and shown[-1]["tags"] == ["uncategorized"] and shown[0]["title"] == "T<0>"
    assert render.digest(scored.limit(0), off.limit(0), "r") == ("🤖 <b>Daily Digest</b>\n\n<i>Nothing new today.</i>", [])


def plan_rows(spark, n, reason):
    rows = [(f"u{i}", f"T{i}", "x", ["course"] if i % 2 else ["evals"], reason, "plan_item", "c1" if i in (1, 2) else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "url string, title string, text string, tags array<string>, reasoning string, classification string, matched_card_id string, pos long")


def test_plan_sections_and_budget(spark):
    work = spark.createDataFrame([(1, "Card", "http://c", "", [], "why", "Card", "stale_nudge"), (2, "New", "u2", "x", ["evals"], "why", "Name", "new_item")], "rank int, title string, url string, text string, tags array<string>, reasoning string, card_name string, source string")
    off = spark.createDataFrame([], OFF)
    text, shown = render.plan(plan_rows(spark, 5, "short"), work, off, 2, "run12345678")
    assert [(s["item_number"], s["url"], s["section"]) for s in shown] == [(1, "u0", "reading"), (2, "u4", "reading"), (3, "u1", "courses"), (4, "u3", "courses"), (5, "http://c", "existing_project_work"), (6, "u2", "existing_project_work")]
    assert "⏳ idle board item" in text and 'continues card: "Name"' in text and text.endswith("<i>6 plan items · 2 proposals pending approval · run: run12345</i>")
    long, kept = render.plan(plan_rows(spark, 30, "r " * 200), work.limit(0), off, 0, "run")
    assert len(long) <= render.SOFT_LIMIT and "…" in long and len(kept[0]["reasoning"]) == 400
    assert render.plan(plan_rows(spark, 0, ""), work.limit(0), off, 1, "r")[0].endswith("1 proposals pending approval — check Telegram.</i>")


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def test_daily_run(spark, store):
    runs.topic_vectors(store, spark.createDataFrame([("evals", "evals of language models and agents"), ("noise", "x")], "tag string, text string"), ctx=ctx(0))
    rows = items(spark, item("http://a/1?utm_source=q", "evals of models", "language models and evals"), item("http://a/1", "evals of models", "language models and evals, longer"), item("http://a/2", "evals of models", "language models and evals, longer too"), item("http://a/3", "cooking", "soup recipes for winter"), item("adhoc:1", "evals note", "note", "adhoc"))
    out = Outbox()
    text, shown = runs.daily_run(rows, store, ctx(1), notifier=out)
    urls = {s["url"] for s in shown}
    assert "adhoc:1" in urls and len([u for u in urls if u.startswith("http://a/")]) == 2
    assert {s["url"] for s in shown if s["tags"] == ["uncategorized"]} == {"http://a/3"}
    assert store.read("run_history").first().status == "success"
    assert {r.filter_type for r in store.read("prefilter_drops").collect()} >= {"taste"}
    assert store.read("item_map").count() == len(shown) and list(out.sent.values()) == [text]
    text, shown = runs.daily_run(rows, store, ctx(2), notifier=out)
    assert {s["url"] for s in shown} <= {"http://a/2", "http://a/1?utm_source=q"}  # the raw URL counts as seen, a variant does not
    parts = {(r.part, r.name) for r in runs.trace(store, "run1").collect()}
    assert ("run", "success") in parts and ("drop", "taste") in parts


def test_dry_run_marks_nothing_seen(spark, store):
    runs.daily_run(items(spark, item("http://a/1", "evals", "x")), store, ctx(1, dry_run=True))
    assert store.read("seen_items").count() == 0


def test_failed_embedding_and_failed_run(spark, store):
    class Broken:
        def embed(self, *a, **k):
            raise RuntimeError("down")

    rows = items(spark, item("http://a/1", "evals", "x"))
    text, shown = runs.daily_run(rows, store, ctx(1), embedder=Broken())
    assert shown[0]["tags"] == ["uncategorized"] and "embed_failed" in shown[0]["reasoning"]
    assert store.read("embedding_failures").first().error == "down"

    class Bad:
        def score(self, batches):
            raise RuntimeError("no scores")

    with pytest.raises(RuntimeError, match="no scores"):
        runs.daily_run(items(spark, item("adhoc:9", "x", "y", "adhoc")), store, ctx(2), scorer=Bad())
    assert {r.run_id: r.status for r in store.read("run_history").collect()} == {"run1": "success", "run2": "failed"}


def test_weekly_run_poll_and_feedback(spark, store):
    cards = spark.createDataFrame([("c1", "evals board", "", "l1", "Dump", "http://card/1", [], None)], CARD)
    snapshot = spark.createDataFrame([("c1", False, "l2")], "card_id string, closed boolean, list_id string")
    lists = spark.createDataFrame([("l1", "Dump"), ("l2", "In Progress")], "list_id string, list_name string")
    done = spark.createDataFrame([], "url string, checked boolean")
    rows = items(spark, item("http://w/1", "evals board news", "alpha beta"), item("http://w/2", "memory systems", "gamma delta"), item("http://w/3", "new launch of llm", "epsilon zeta"), item("http://w/4", "course on evals", "eta theta"))
    out = Outbox()
    text, shown = runs.weekly_run(rows, store, ctx(3, "weekly"), cards, snapshot, lists, done, notifier=out)
    by = {s["url"]: s["section"] for s in shown}
    assert by["http://w/1"] == "existing_project_work" and by["http://w/2"] == "reading" and by["http://w/4"] == "courses" and "http://w/3" not in by
    pending = store.read("pending_resume").collect()
    assert len(pending) == 1 and store.read("run_history").first().status == "paused"
    assert store.read("plan_history").first().cards[0].card_id == "c1"

    message = next(k for k, v in out.sent.items() if v == text)
    n = next(s["item_number"] for s in shown if s["url"] == "http://w/2")
    batch = spark.createDataFrame([(1, "10", "approve", pending[0].message_id), (2, "11", f"{n} very good!", message), (3, "12", "look at this evals idea", None)], updates.SCHEMA)
    board = MemoryBoard()
    assert runs.poll(batch, store, ctx(4), notifier=out, board=board) == {"approval": 1, "feedback": 1, "queue": 1}
    assert runs.poll(batch, store, ctx(4), notifier=out, board=board) == {}  # nothing beyond the offset
    assert len(board.cards) == 1 and store.read("pending_resume").count() == 0
    assert store.read("approval_log").first().outcome == "approved"
    assert store.read("feedback_events").first().item_id == "http://w/2"
    adjusted = store.read("same_day_adjustments").collect()
    assert adjusted and all(a.cumulative_adjustment == 0.2 for a in adjusted)

    store.upsert("run_history", store.read("run_history").withColumn("status", F.lit("success")))
    text, shown = runs.weekly_run(items(spark, item("http://w/9", "evals again", "iota kappa")), store, ctx(10, "weekly"), cards, snapshot, lists, spark.createDataFrame([("http://w/4", True)], "url string, checked boolean"), notifier=out)
    urls = {s["url"] for s in shown}
    assert "http://w/2" in urls and "http://w/4" not in urls and "adhoc:u3" in urls
    assert store.read("adhoc_queue").count() == 0 and store.read("same_day_adjustments").count() == 0
    assert "positive" in store.read("profile").first().content
    assert {r.url for r in store.read("carry_forward_log").collect()} == {"http://w/2"}


EVENT = "event_id string, item_id string, feedback_text string, replied_at string, run_id string, tags array<string>, title string, content_summary string, sentiment string"


def test_nudges_hold_at_the_cap(spark, store):
    for i, words in enumerate(["love it!", "love it!", "boring"]):
        f = spark.createDataFrame([(f"e{i}", "u", words, "r", "run", ["evals"], "", "", "positive")], EVENT)
        for _ in range(2):  # an event that comes again counts once
            runs.nudge(f, store, ctx(0))
    r = store.read("same_day_adjustments").first()
    assert (r.cumulative_adjustment, r.item_ids_contributing, r.week_of) == (0.2, ["u", "u", "u"], "2026-W30")


def weekly(spark, store, out, **models):
    cards = spark.createDataFrame([("c1", "evals board", "", "l1", "Dump", "http://card/1", [], None)], CARD)
    snapshot = spark.createDataFrame([("c1", False, "l2")], "card_id string, closed boolean, list_id string")
    lists = spark.createDataFrame([("l1", "Dump"), ("l2", "In Progress")], "list_id string, list_name string")
    done = spark.createDataFrame([], "url string, checked boolean")
    words = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta", "iota kappa", "lambda mu", "nu xi"]
    rows = items(spark, *[item(f"http://w/{i}", f"evals board {w}", f"{w} {w}") for i, w in enumerate(words)], item("http://w/9", "new launch of llm", "sigma tau"))
    return runs.weekly_run(rows, store, ctx(3, "weekly"), cards, snapshot, lists, done, notifier=out, **models)


class Failing:
    def __init__(self):
        self.asked = 0

    def match(self, *a):
        raise RuntimeError("no matches")

    def classify(self, *a):
        raise RuntimeError("no classes")

    def select(self, *a):
        self.asked += 1
        raise ValueError("no JSON")


def test_models_that_fail_leave_their_fallbacks(spark, store):
    model = Failing()
    text, shown = weekly(spark, store, Outbox(), classifier=model, prioritizer=model)
    assert model.asked == 2  # one retry
    assert {r.decision for r in store.read("classification_log").collect()} == {"plan_item"} and store.read("pending_resume").count() == 0
    work = [s for s in shown if s["section"] == "existing_project_work"]
    assert [s["url"] for s in work] == [f"http://w/{i}" for i in range(5)] and all("unprioritized" in s["reasoning"] for s in work)
    nodes = {r.node_name: r for r in store.read("node_summary").collect()}
    assert set(nodes) == {"discover", "score", "match", "classify", "prioritize"}
    assert nodes["classify"].error_summary == "no classes" and nodes["prioritize"].error_summary == "no JSON" and nodes["match"].error_summary is None
    assert nodes["prioritize"].items_out == 5 and nodes["prioritize"].dropped == nodes["prioritize"].items_in - 5 and nodes["score"].duration_seconds > 0
    got = runs.trace(store, "run3").where("part = 'node'").orderBy("name").collect()
    assert [r.name.split(" ")[1] for r in got] == ["discover", "score", "match", "classify", "prioritize"]


def test_a_matcher_that_fails_leaves_items_without_cards(spark, store):
    text, shown = weekly(spark, store, Outbox(), matcher=Failing())
    assert {s["section"] for s in shown} == {"reading"}
    assert store.read("node_summary").where("node_name = 'match'").first().error_summary == "no matches"
    assert store.read("run_history").first().duration_seconds > 0


def test_a_batch_that_runs_again_adds_nothing(spark, store):
    out = Outbox()
    text, shown = weekly(spark, store, out)
    message, n = next(k for k, v in out.sent.items() if v == text), shown[0]["item_number"]
    batch = spark.createDataFrame([(1, "11", f"{n} very good!", message), (2, "12", f"{n} very good!", message)], updates.SCHEMA)
    runs.poll(batch, store, ctx(4))
    once = sorted(map(str, store.read("same_day_adjustments").collect()))
    store.replace("polling_state", store.read("polling_state").limit(0))  # the run broke off before the offset was stored
    runs.poll(batch, store, ctx(4))
    assert store.read("feedback_events").count() == 2
    assert sorted(map(str, store.read("same_day_adjustments").collect())) == once

    class Mute:
        def parse(self, *a):
            raise ValueError("no JSON")

    assert runs.poll(spark.createDataFrame([(9, "13", "1 good", message)], updates.SCHEMA), store, ctx(4), parser=Mute()) == {"feedback": 1}
    assert store.read("feedback_events").count() == 2


def test_topic_vectors_fail_by_tag(spark, store):
    class Half(HashEmbedder):
        def embed(self, rows, text, out="embedding_vector"):
            if rows.first().tag == "evals":
                raise RuntimeError("down")
            return super().embed(rows, text, out)

    topics = spark.createDataFrame([("evals", "e"), ("llm-tooling", "tools"), ("learning-resource", None), ("noise", "x")], "tag string, text string")
    runs.topic_vectors(store, topics, Half(), ctx(0))
    assert [r.tag for r in store.read("topic_vectors").collect()] == ["llm-tooling"]
    costs = [r.error for r in store.read("costs").orderBy("error").collect()]
    assert len(costs) == 4 and sum(c is not None for c in costs) == 3 and any("down" in (c or "") for c in costs)


def test_hash_embedder(spark):
    df = HashEmbedder(8).embed(spark.createDataFrame([("a b a",), (None,)], "t string"), "t")
    got = df.collect()
    assert len(got[0].embedding_vector) == 8 and sum(got[0].embedding_vector) == 3.0 and max(got[0].embedding_vector) >= 2.0 and got[1].n_tokens == 0


def run_stream(spark, stream, name, mode, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def test_streams(spark, tmp_path, store):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a",), ("b",), ("a",)], "url string").coalesce(1).write.parquet(src)
    first = stateful.first_sights(spark.readStream.schema("url string").parquet(src))
    got = run_stream(spark, first, "sights", "append", f"{tmp_path}/c1")
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 1)]
    src = f"{tmp_path}/nudge"
    spark.createDataFrame([("t", i, d) for i, d in enumerate([0.2, 0.2, 0.2, -0.1])], "tag string, at long, d double").coalesce(1).write.parquet(src)
    totals = stateful.saturating_totals(spark.readStream.schema("tag string, at long, d double").parquet(src), ["tag"], "at", "d")
    assert [tuple(r) for r in run_stream(spark, totals, "totals", "update", f"{tmp_path}/c2").collect()] == [("t", 0.2)]
    src = f"{tmp_path}/queue"
    spark.createDataFrame([(1, "9", "idea", None), (2, "9", " ", None)], updates.SCHEMA).coalesce(1).write.parquet(src)
    for n in range(2):
        stateful.queue_stream(spark.readStream.schema(updates.SCHEMA).parquet(src), store, f"{tmp_path}/c3{n}", "now").awaitTermination(120)
    assert [r.key for r in store.read("adhoc_queue").collect()] == ["u1"]


def test_update_rows():
    raw = [{"update_id": 1, "message": {"message_id": 5, "text": "x", "reply_to_message": {"message_id": 4}}}, {"update_id": 2}, {"update_id": 3, "channel_post": {"message_id": 6}}]
    assert updates.rows_of(raw) == [(1, "5", "x", "4"), (3, "6", None, None)]
    r = updates.UpdateReader({"url": "http://x"})
    r._fetch = lambda offset: [u for u in raw if u["update_id"] >= offset]
    got, end = r.read({"offset": 2})
    assert list(got) == [(3, "6", None, None)] and end == {"offset": 4}
    assert list(r.readBetweenOffsets({"offset": 1}, {"offset": 2})) == [(1, "5", "x", "4")]


def test_entry_and_oracle_keys(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
