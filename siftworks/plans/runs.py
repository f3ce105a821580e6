"""The daily and the weekly run, polling, and the reports on runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from siftworks.context import RunContext
from siftworks.functions.rules import cost_embedding, is_roundup, nudge_delta
from siftworks.functions.dates import iso_week
from siftworks.functions.text import embedding_text, proposal_id
from siftworks.models import offline
from siftworks.models.interfaces import Board, Classifier, Embedder, Matcher, Notifier, Prioritizer, ReplyParser, Rewriter, Scorer, Sentiment
from siftworks.operators.cut import cut
from siftworks.operators import dedup, enrich, folds, history, routing, similarity
from siftworks.plans import render
from siftworks.plans.stages import Stages, StepLimit
from siftworks.schemas import COST, STORE
from siftworks.sources import outbox
from siftworks.sources.ledger import Ledger, digest
from siftworks.sources.store import TableStore


def _name(model: object) -> str:
    """What the ledger calls a model: its name, or that of its kind."""
    return getattr(model, "name", type(model).__name__)


def _ask(what: Callable[[], DataFrame], other: Callable[[], DataFrame], tries: int = 1) -> tuple[DataFrame, str | None]:
    """What a model says, a table that is written, asked for up to so many times; after that the fallback, and the last failure's message."""
    error = None
    for _ in range(tries):
        try:
            return what(), None
        except StepLimit:
            raise
        except Exception as e:  # the service's failure, or an answer that does not parse, is data here
            error = str(e)[:500]
    return other(), error


def _noted(ctx: RunContext, node: str, n_in: int, n_out: int, since: float, cost: float = 0.0, error: str | None = None) -> None:
    """Keeps a node's summary until the run's end."""
    ctx.nodes.append(folds.node_summary(ctx.run_id, node, n_in, n_out, cost, round(time.perf_counter() - since, 3), error))


def topic_vectors(store: TableStore, topics: DataFrame, embedder: Embedder | None = None, ctx: RunContext | None = None) -> None:
    """Writes a vector for each (tag, text) of topics, and a cost row for each tag.

    noise and course, and tags without a text, have no vector, which their row says. A tag whose embedding fails keeps
    the vector that it had, and the others get theirs. topics is a configuration of some ten rows.
    """
    ctx, spark = ctx or RunContext(), store.spark
    asked = embedder or offline.HashEmbedder()
    told, costs = [], []
    for tag, text in topics.select("tag", "text").orderBy("tag").collect():
        cost = {"node_name": "recompute_topic_vectors", "input_tokens": 0, "output_tokens": 0, "latency_ms": 0.0, "cost_usd": 0.0, "error": None, "provider": "nvidia", "run_id": ctx.run_id}
        if text is None or tag in ("noise", "course"):
            costs.append(cost | {"error": f"tag {tag} has no text, no vector computed", "provider": None})
            continue
        try:
            got = asked.embed(spark.createDataFrame([(tag, text)], "tag string, text string"), "text").withColumn("cost_usd", cost_embedding(F.col("n_tokens"))).first()
        except Exception as e:  # one tag's failure leaves the others
            costs.append(cost | {"error": f"tag {tag} failed: {e}"[:500]})
            continue
        told.append((tag, list(got.embedding_vector), ctx.now_iso()))
        costs.append(cost | {"input_tokens": got.n_tokens, "cost_usd": float(got.cost_usd)})
    if told:
        store.upsert("topic_vectors", spark.createDataFrame(told, "tag string, embedding_vector array<double>, updated_at string"))
    if costs:
        store.append("costs", spark.createDataFrame(costs, COST + ", run_id string"))


def discover(items: DataFrame, store: TableStore, ctx: RunContext, embedder: Embedder | None = None, verbatim: float = similarity.VERBATIM, overlap: float = similarity.OVERLAP, least: float = similarity.TOPIC, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """New items on a topic, and items without one (L10-L12, P7): URL groups, seen before, ad-hoc bypass, same in meaning, topics.

    items has the columns of an item and pos. If embedding fails as a whole, items pass the dedup, and all of them are
    without a topic. A run that is repeated takes up what its stages had; logs have a part for each of its steps.
    """
    spark, since = items.sparkSession, time.perf_counter()
    stages = stages or Stages(store, ctx, items)
    new = stages.keep("new", lambda: dedup.unseen(dedup.cluster_by_url(items), dedup.alive(store.read("seen_items"), ctx.now())))
    _noted(ctx, "discover", items.count(), new.count(), since)
    adhoc = new.where(F.col("source") == "adhoc")
    rest = new.where(F.col("source") != "adhoc")
    none = rest.limit(0).select("*", F.lit("").alias("best_tag"), F.lit(0.0).alias("similarity_score"))
    if rest.isEmpty():
        return adhoc, none
    asked = embedder or offline.HashEmbedder()
    told = rest.withColumn("__text", embedding_text(F.col("title"), F.col("text")))

    def embed() -> DataFrame:
        said = Ledger(store, ctx).ask(_name(asked), told, ["pos"], [F.col("__text")], "embedding_vector array<double>, n_tokens long", lambda rows: asked.embed(rows, "__text").select("pos", "embedding_vector", "n_tokens"))
        return told.drop("__text").join(said.drop("__error"), "pos").withColumn("is_roundup", is_roundup(F.col("source"), F.col("title")))

    try:
        embedded = stages.keep("embedded", embed)
    except StepLimit:
        raise
    except Exception as e:  # the service's failure is data here
        store.append("embedding_failures", spark.createDataFrame([("discover", ctx.run_id, rest.count(), str(e)[:500], ctx.now_iso())], "module string, run_id string, item_count long, error string, occurred_at string"), once=f"{ctx.run_id}/embed")
        return adhoc, rest.select("*", F.lit("embed_failed").alias("best_tag"), F.lit(0.0).alias("similarity_score"))
    window = history.recent(store.read("recent_item_embeddings"), "scored_at", ctx.now())
    hits = stages.keep("hits", lambda: similarity.window_match(embedded, window, verbatim, overlap), verbatim, overlap)
    left = embedded.join(hits.select("url"), "url", "left_anti")
    judged = stages.keep("judged", lambda: similarity.greedy_dedup(left, verbatim, overlap), verbatim, overlap)
    drop = judged.where("NOT kept").select(F.col("url").alias("item_id"), "filter_type", F.col("sim").alias("similarity_score"), F.col("matched").alias("compared_against_item_id"))
    drop = drop.unionByName(hits.select(F.col("url").alias("item_id"), "filter_type", F.col("sim").alias("similarity_score"), F.col("matched").alias("compared_against_item_id")))
    store.append("prefilter_drops", drop.withColumn("run_id", F.lit(ctx.run_id)), once=f"{ctx.run_id}/same")
    kept = judged.where("kept").withColumn("pos", F.col("slot"))
    store.upsert("recent_item_embeddings", kept.select(F.col("url").alias("item_id"), "url", "embedding_vector", "fetched_at", F.lit(ctx.now_iso()).alias("scored_at"), "is_roundup"))
    paid = F.when(F.col("__known"), F.lit(0)).otherwise(F.col("n_tokens")).cast("long")
    costs = embedded.select(F.lit("semantic_dedup").alias("node_name"), paid.alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("latency_ms"), cost_embedding(paid).alias("cost_usd"), F.lit("nvidia").alias("provider"), F.lit(ctx.run_id).alias("run_id"))
    store.append("costs", costs, once=f"{ctx.run_id}/semantic_dedup")
    cols = new.columns
    topics = store.read("topic_vectors")
    if topics.isEmpty():
        return kept.select(*cols).unionByName(adhoc), none
    near = kept.join(similarity.nearest_topic(kept, topics), "url")
    topical = stages.keep("topics", lambda: near.select(*cols, "best_tag", "similarity_score"))
    off = topical.where(F.col("similarity_score") < least)
    store.append("prefilter_drops", off.select(F.col("url").alias("item_id"), F.lit("taste").alias("filter_type"), "similarity_score", F.col("best_tag").alias("compared_against_tag"), F.lit(ctx.run_id).alias("run_id")), once=f"{ctx.run_id}/taste")
    if not ctx.dry_run:
        store.upsert("seen_items", dedup.marks(off, dedup.alive(store.read("seen_items"), ctx.now()), ctx.now_iso()))
    on = topical.where(F.col("similarity_score") >= least).select(*cols)
    return on.unionByName(adhoc), off.select(*cols, "best_tag", F.round("similarity_score", 3).alias("similarity_score"))


def _scores(asked: Scorer, fresh: DataFrame) -> DataFrame:
    """batch, index, keep, reasoning, tags and error of rows that have not been asked about, put into batches of their own; a failed batch is an error of each of its rows."""
    again = cut(enrich.batched(fresh.withColumnsRenamed({"batch": "__b", "index": "__i"})))
    got = cut(asked.score(again))
    if "error" not in got.columns:
        got = got.withColumn("error", F.lit(None).cast("string"))
    places = again.select("batch", "index", "__b", "__i")
    good = got.where("error IS NULL").join(places, ["batch", "index"])
    bad = got.where("error IS NOT NULL").groupBy("batch").agg(F.min("error").alias("error")).join(places, "batch")
    names = [F.col("__b").alias("batch"), F.col("__i").alias("index")]
    return good.select(*names, "keep", "reasoning", "tags", "error").unionByName(bad.select(*names, "error"), allowMissingColumns=True)


def score(items: DataFrame, store: TableStore, ctx: RunContext, scorer: Scorer | None = None, stages: Stages | None = None) -> DataFrame:
    """Items with keep, reasoning and valid tags; marked as seen and logged (L3, K1, K6, K7).

    Items of a batch that failed have no score: they are not in the result and not marked, so the next run has them
    again, and the node's summary has the error. A scorer that fails as a whole fails the run.
    """
    since = time.perf_counter()
    stages, asked = stages or Stages(store, ctx, items), scorer or offline.KeywordScorer()
    lots = stages.keep("lots", lambda: enrich.batched(items))
    question = [F.col("url"), F.col("title"), F.substring("text", 1, 500)]
    said = stages.keep("said", lambda: Ledger(store, ctx).ask(_name(asked), lots, ["batch", "index"], question, "keep boolean, reasoning string, tags array<string>", lambda fresh: _scores(asked, fresh)))
    told = said.where("__error IS NULL").drop("__error", "__known")
    scored = stages.keep("scored", lambda: enrich.join_scores(lots, told))
    failed = said.where("__error IS NOT NULL").agg(F.count("*").alias("n"), F.min("__error").alias("e")).first()
    store.append("dropped_tags", enrich.rejected_tags(lots, told).withColumn("run_id", F.lit(ctx.run_id)), once=f"{ctx.run_id}/tags")
    store.append("scored_items_log", scored.withColumns({"run_id": F.lit(ctx.run_id), "logged_at": F.lit(ctx.now_iso())}), once=f"{ctx.run_id}/scored")
    if not ctx.dry_run:
        store.upsert("seen_items", dedup.marks(scored, dedup.alive(store.read("seen_items"), ctx.now()), ctx.now_iso()))
    _noted(ctx, "score", lots.count(), scored.where("keep").count(), since, error=f"{failed.n} items without a score: {failed.e}" if failed.n else None)
    return scored


def _started(store: TableStore, ctx: RunContext, path: str) -> None:
    store.upsert("run_history", store.spark.createDataFrame([(ctx.run_id, path, "in_progress", ctx.now_iso())], "run_id string, path string, status string, started_at string"))


def _finished(store: TableStore, ctx: RunContext, path: str, status: str, n_in: int, n_out: int, since: float, error: str | None = None) -> None:
    if ctx.nodes:
        store.upsert("node_summary", store.spark.createDataFrame(ctx.nodes, STORE["node_summary"][0]))
    total = store.read("costs").where(F.col("run_id") == ctx.run_id).agg(F.sum("cost_usd")).first()[0] or 0.0
    row = (ctx.run_id, path, status, ctx.now_iso(), ctx.now_iso(), total, n_in, n_out, round(time.perf_counter() - since, 3), error)
    store.upsert("run_history", store.spark.createDataFrame([row], STORE["run_history"][0]))


def _tracked(run: Callable) -> Callable:
    """Marks a run as begun and, however it ends, as ended, with its nodes' summaries (K9, T8s). Its stages stay until it has ended well."""

    def wrapped(items: DataFrame, store: TableStore, ctx: RunContext, *args, **more):  # noqa: ANN002, ANN003, ANN202
        path, since = run.__name__.removesuffix("_run"), time.perf_counter()
        ctx.nodes.clear()
        ctx.steps.clear()
        _started(store, ctx, path)
        try:
            text, shown, status, n_in = run(items, store, ctx, *args, **more)
        except Exception as e:
            _finished(store, ctx, path, "failed", 0, 0, since, str(e)[:500])
            raise
        _finished(store, ctx, path, status, n_in, len(shown), since)
        store.drop_stages(ctx.run_id)
        return text, shown

    return wrapped


def _deliver(store: TableStore, ctx: RunContext, name: str, text: str, shown: list[dict], notifier: Notifier, board: Board) -> None:
    """Sends a text through the outbox, with its map by message and the text as the latest document to follow (K12, K13, K15). Raises if it could not be sent; it then still waits there."""
    follow = [("item_map", {"message_id": "$id", "run_id": ctx.run_id} | {c: r[c] for c in ("item_number", "url", "title", "text", "tags", "reasoning", "section")}) for r in shown]
    follow.append(("documents_out", {"name": name, "run_id": ctx.run_id, "text": text, "generated_at": ctx.now_iso()}))
    follow.append(("event_log", {"ts": ctx.now_iso(), "agent": name, "event_type": "sent", "summary": f"{len(shown)} items"}))
    e = outbox.effect(ctx.run_id, name, "chat", "send", {"text": text, "markup": "HTML"}, follow)
    outbox.put(store, [e], ctx.now_iso())
    errors = outbox.send_waiting(store, notifier, board, ctx.now_iso())
    if e["effect_id"] in errors:
        raise RuntimeError(f"{name} was not sent: {errors[e['effect_id']]}")


def _costs(store: TableStore, ctx: RunContext) -> dict[str, float]:
    return {r.provider: r.cost_usd or 0.0 for r in folds.cost_by_provider(store.read("costs").where(F.col("run_id") == ctx.run_id)).collect()}


@_tracked
def daily_run(items: DataFrame, store: TableStore, ctx: RunContext, embedder: Embedder | None = None, scorer: Scorer | None = None, notifier: Notifier | None = None) -> tuple:
    """Discovery, scores, digest, delivery. Gives the text and the item map. Called again with the context of a run that failed, it goes on where that broke off."""
    stages = Stages(store, ctx, items)
    new, off = discover(items, store, ctx, embedder, stages=stages)
    scored = score(new, store, ctx, scorer, stages)
    text, shown = render.digest(scored, off, ctx.run_id, _costs(store, ctx))
    _deliver(store, ctx, "daily_digest", text, shown, notifier or offline.Outbox(), offline.MemoryBoard())
    return text, shown, "success", items.count()


def _propose(store: TableStore, ctx: RunContext, classed: DataFrame) -> int:
    """Puts a message for each proposal into the outbox, with its row of pending_resume to follow; gives their number (L15, T6s)."""
    p = classed.where("classification = 'project_proposal'").withColumn("proposal_id", proposal_id(F.col("url")))
    pending = F.struct(
        F.lit("$id").alias("message_id"), F.col("proposal_id").alias("thread_id"), "proposal_id", F.lit(ctx.run_id).alias("run_id"), "url", "title", "text", "reasoning", "tags", "proposal_type", "matched_card_id",
    )
    text = F.concat_ws("\n", F.concat(F.lit("Proposal: "), F.coalesce("title", F.lit(""))), F.coalesce("url", F.lit("")), F.coalesce("reasoning", F.lit("")))
    rows = cut(p.select(
        F.sha2(F.concat_ws("\x1f", F.lit(ctx.run_id), F.lit("proposal"), "proposal_id"), 256).alias("effect_id"), F.lit(ctx.run_id).alias("run_id"), F.lit("proposal").alias("node"), F.col("proposal_id").alias("target"),
        F.lit("send").alias("kind"), F.to_json(F.struct(text.alias("text"), F.lit(None).cast("string").alias("markup")), {"ignoreNullFields": "false"}).alias("payload"),
        F.concat(F.lit('[["pending_resume", '), F.to_json(pending), F.lit("]]")).alias("follow"), F.lit("waiting").alias("status"), F.lit(0).alias("tries"),
    ))
    outbox.put_rows(store, rows, ctx.now_iso())
    return rows.count()


@_tracked
def weekly_run(items: DataFrame, store: TableStore, ctx: RunContext, cards: DataFrame, snapshot: DataFrame, lists: DataFrame, completions: DataFrame, embedder: Embedder | None = None, scorer: Scorer | None = None, matcher: Matcher | None = None, classifier: Classifier | None = None, prioritizer: Prioritizer | None = None, notifier: Notifier | None = None, board: Board | None = None) -> tuple:
    """Discovery, scores, cards, classes, proposals, project work, carried items, plan, delivery, and the profile's update (3.2, T9s, T18).

    Proposals wait in pending_resume; the run does not wait for them, and its status is paused while there are any.
    A matcher that fails leaves all items without a card (L4), a classifier all as plan items (L5), and a prioritiser
    that fails twice the first five candidates in their order (L6). Called again with the context of a run that failed,
    it goes on at the first stage that was not done, asks no model twice and sends nothing twice.
    """
    spark = items.sparkSession
    notifier, board, ledger = notifier or offline.Outbox(), board or offline.MemoryBoard(), Ledger(store, ctx)
    matcher, classifier, prioritizer = matcher or offline.NameMatcher(), classifier or offline.RuleClassifier(), prioritizer or offline.FirstPrioritizer()
    stages = Stages(store, ctx, items, cards, snapshot, lists, completions)
    queue = stages.keep("queue", lambda: store.read("adhoc_queue").where("trim(coalesce(text, '')) <> ''"))
    queued = routing.queue_items(queue).withColumn("pos", F.lit(1 << 50) + F.monotonically_increasing_id())
    new, off = discover(items.unionByName(queued.select(*items.columns)), store, ctx, embedder, stages=stages)
    scored = score(new, store, ctx, scorer, stages)
    store.remove("adhoc_queue", queue)
    prior = history.latest_prior(store.read("plan_history"), "generated_at", ctx.run_id).select(F.explode("cards").alias("c")).select("c.*")
    moves = stages.keep("moves", lambda: history.movement(prior, snapshot, lists))
    kept = scored.where("keep")
    since, board_now = time.perf_counter(), digest(cards)

    def match() -> DataFrame:
        call = lambda rows: matcher.match(rows, cards).withColumnRenamed("item_id", "url")
        return ledger.ask(_name(matcher), kept, ["url"], [F.col("url"), F.col("title"), F.col("text"), F.lit(board_now)], "matched_card_id string, pos long", call).select(F.col("url").alias("item_id"), "matched_card_id", "pos")

    said, error = _ask(lambda: stages.keep("matches", match), lambda: spark.createDataFrame([], "item_id string, matched_card_id string, pos long"))
    matched = stages.keep("matched", lambda: enrich.with_matches(kept, said), error)
    _noted(ctx, "match", kept.count(), matched.where("matched_card_id IS NOT NULL").count(), since, error=error)
    since = time.perf_counter()

    def classes() -> DataFrame:
        call = lambda rows: classifier.classify(rows).withColumnRenamed("item_id", "url")
        question = [F.col(c) for c in ("url", "title", "text", "reasoning", "tags", "matched_card_id")]
        return ledger.ask(_name(classifier), matched, ["url"], question, "classification string, proposal_type string, classification_reasoning string, pos long", call).drop("__known", "__error").withColumnRenamed("url", "item_id")

    plain = matched.select(F.col("url").alias("item_id"), F.lit("plan_item").alias("classification"), F.lit(None).cast("string").alias("proposal_type"), F.lit("fallback: the classifier failed").alias("classification_reasoning"), "pos")
    said, error = _ask(lambda: stages.keep("classes", classes), lambda: plain)
    classed = stages.keep("classed", lambda: enrich.with_classes(matched, said), error)
    _noted(ctx, "classify", matched.count(), classed.where("classification = 'project_proposal'").count(), since, error=error)
    store.append("classification_log", classed.select(F.col("url").alias("item_id"), F.col("classification").alias("decision"), "proposal_type", F.lit(ctx.run_id).alias("run_id")), once=f"{ctx.run_id}/classes")
    proposals = _propose(store, ctx, classed)
    candidates = enrich.matched_candidates(classed)
    since = time.perf_counter()
    choice = "matched_card_id string, source string, item_url string, priority_reasoning string, movement_note string, pos long"
    first = candidates.orderBy("pos").limit(5).select("matched_card_id", F.lit("new_item").alias("source"), F.col("url").alias("item_url"), F.lit("fallback: JSON parse failed, unprioritized").alias("priority_reasoning"), F.lit(None).cast("string").alias("movement_note"), "pos")

    def choose() -> DataFrame:
        return ledger.ask_whole(_name(prioritizer), [candidates, cards, moves], choice, lambda: prioritizer.select(candidates, cards, moves))

    chosen, error = _ask(lambda: stages.keep("chosen", choose), lambda: first, tries=2) if not candidates.isEmpty() else (spark.createDataFrame([], choice), None)
    picked = stages.keep("picked", lambda: enrich.valid_selection(chosen, cards, candidates), error)
    _noted(ctx, "prioritize", candidates.count(), picked.count(), since, error=error)
    carried = stages.keep("carried", lambda: history.carry_forward(store.read("run_history"), store.read("item_map"), completions, store.read("carry_forward_log"), ctx.run_id))
    store.upsert("carry_forward_log", carried.select("url", F.lit(ctx.run_id).alias("carried_in_run_id"), F.lit(ctx.now_iso()).alias("carried_at")))
    plan_items = classed.unionByName(carried.withColumn("pos", F.col("pos") + F.lit(1 << 60)), allowMissingColumns=True)
    entries = enrich.project_entries(picked, cards, classed)
    text, shown = render.plan(plan_items, entries, off, proposals, ctx.run_id, _costs(store, ctx))
    surfaced = enrich.surfaced_cards(picked, cards)
    store.upsert("plan_history", surfaced.agg(F.array_sort(F.collect_list(F.struct("card_id", "list_name"))).alias("cards")).select(F.lit(ctx.run_id).alias("run_id"), "cards", F.lit(ctx.now_iso()).alias("generated_at")))
    _deliver(store, ctx, "weekly_plan", text, shown, notifier, board)
    update_profile(store, ctx)
    return text, shown, "paused" if proposals else "success", items.count()


def update_profile(store: TableStore, ctx: RunContext, rewriter: Rewriter | None = None) -> None:
    """Rewrites the profile by the week's feedback and clears the nudges (L9, T9s, K17, P15). Run again by the same run it changes nothing."""
    spark = store.spark
    old = store.read("profile").where("name = 'current'").first()
    if old is not None and old.updated_at == ctx.now_iso():
        return
    week = history.recent(store.read("feedback_events"), "replied_at", ctx.now())
    if not week.isEmpty():
        asked, now = rewriter or offline.AppendRewriter(), old.content if old else ""
        said = Ledger(store, ctx).ask_whole(_name(asked), [week, spark.createDataFrame([(now,)], "now string")], "content string", lambda: spark.createDataFrame([(asked.rewrite(now, week),)], "content string"))
        store.upsert("profile", cut(said.select(F.lit("current").alias("name"), "content", F.lit(ctx.now_iso()).alias("updated_at"))))
    store.upsert("polling_state", spark.createDataFrame([("nudges_cleared", int(ctx.run_ts.timestamp() * 1e6))], "name string, value long"))
    store.replace("same_day_adjustments", store.read("same_day_adjustments").limit(0))


def _events(rows: DataFrame, batch: int) -> DataFrame:
    """rows with event_id, the same when the batch that begins at this offset runs again; repeats within it are told apart."""
    what = F.to_json(F.struct(F.lit(batch).alias("batch"), "item_id", "feedback_text", "sentiment", "run_id"))
    again = F.row_number().over(Window.partitionBy("__what").orderBy("replied_at"))
    return rows.withColumn("__what", what).withColumn("event_id", F.sha2(F.concat_ws("#", "__what", again), 256)).drop("__what")


#: Fixed value: the answer to a reply that decides nothing.
UNCLEAR = "Didn't catch that — reply \"approve\" or \"reject\" to this proposal."


def _approved(d: Row) -> list[dict]:
    """What an approved proposal does: an extension of a card writes to that card, any other makes one; then a message names it."""
    if d.proposal_type == "extend" and d.matched_card_id:
        card = outbox.effect(d.run_id, "approval", d.proposal_id, "update", {"card_id": d.matched_card_id, "description": d.reasoning})
        said = "✅ Updated card: $name\n$url"
    else:
        card = outbox.effect(d.run_id, "approval", d.proposal_id, "create", {"title": d.title or (d.text or "")[:80], "list_id": "dump", "description": d.reasoning})
        said = "✅ Created new card: $name\n$url"
    return [card, outbox.effect(d.run_id, "approval_note", d.proposal_id, "send", {"text": said, "markup": None}, after=card["effect_id"])]


def poll(updates: DataFrame, store: TableStore, ctx: RunContext, parser: ReplyParser | None = None, sentiment: Sentiment | None = None, notifier: Notifier | None = None, board: Board | None = None) -> dict[str, int]:
    """Routes a batch of updates and acts on them (3.3, L8, L15, L16, C5, T4s, T6s).

    The offset is stored last. A batch that runs again changes nothing that was done: queued texts go by update,
    feedback and nudges by event, a decided proposal waits no more, and what is to be sent or made goes through the
    outbox under its proposal's key. Of several decisions on a proposal the first counts. A parser that fails twice
    gives no feedback. What other runs left waiting in the outbox is sent too.
    updates: update_id, message_id, text, reply_to. Gives the number of updates by route.
    """
    spark = store.spark
    notifier, board = notifier or offline.Outbox(), board or offline.MemoryBoard()
    offset = store.read("polling_state").where("name = 'update_offset'").first()
    start = offset.value if offset else 0
    new = updates.where(F.col("update_id") >= start)
    routed = cut(routing.route(new, store.read("pending_resume")))
    counts = {r.route: r["count"] for r in routed.groupBy("route").count().collect()}
    if not counts:
        outbox.send_waiting(store, notifier, board, ctx.now_iso())
        return {}
    store.upsert("adhoc_queue", routing.queue_rows(routed, ctx.now_iso()))
    replies = routed.where("route = 'feedback'").select(F.col("reply_to").alias("message_id"), "text")
    entry = "message_id string, item_number int, feedback_text string, sentiment string"
    asked = parser or offline.NumberParser()
    parsed, _ = _ask(lambda: cut(Ledger(store, ctx).ask_whole(_name(asked), [replies], entry, lambda: asked.parse(replies, store.read("item_map")))), lambda: spark.createDataFrame([], entry), tries=2)
    entries = cut(routing.feedback_entries(parsed, store.read("item_map")))
    rows = routing.feedback_rows(entries, ctx.now_iso())
    pending = store.read("pending_resume").select(F.col("message_id").alias("reply_to"), "url", "title", "text", "reasoning", "tags", "proposal_type", "matched_card_id")
    decisions = routed.where("route = 'approval'").select("update_id", "reply_to", "proposal_id", "run_id", "decision")
    decided = enrich.first_by(decisions, "reply_to", "update_id").join(pending, "reply_to").orderBy("update_id").collect()  # at most the proposals of some runs
    effects = [e for d in decided if d.decision == "approve" for e in _approved(d)]
    unclear = routed.where("route = 'unclear'").select("update_id").orderBy("update_id").collect()  # replies to proposals in one batch
    outbox.put(store, effects + [outbox.effect("poll", "unclear", str(u.update_id), "send", {"text": UNCLEAR, "markup": "HTML"}) for u in unclear], ctx.now_iso())
    no = [(d.url, "rejected proposal", ctx.now_iso(), d.run_id, d.tags or [], d.title or "", (d.text or "")[:300], "negative") for d in decided if d.decision == "reject"]
    if no:
        rows = rows.unionByName(spark.createDataFrame(no, rows.schema))
    rows = cut(_events(rows, start).join(store.read("feedback_events").select("event_id"), "event_id", "left_anti"))
    store.append("feedback_events", rows)
    if decided:
        out = [(d.url or d.proposal_id, d.decision + ("d" if d.decision == "approve" else "ed"), d.run_id) for d in decided]
        logged = store.read("approval_log").select("item_id", "outcome", "run_id")
        store.append("approval_log", cut(spark.createDataFrame(out, "item_id string, outcome string, run_id string").join(logged, ["item_id", "outcome", "run_id"], "left_anti")))
        store.remove("pending_resume", spark.createDataFrame([(d.reply_to,) for d in decided], "message_id string"))
    # events of an earlier try that were not yet nudged are among the week's
    nudge(history.recent(store.read("feedback_events"), "replied_at", ctx.now()), store, ctx, sentiment)
    last = routed.agg(F.max("update_id")).first()[0]
    store.upsert("polling_state", spark.createDataFrame([("update_offset", last + 1)], "name string, value long"))
    outbox.send_waiting(store, notifier, board, ctx.now_iso())
    return counts


def nudge(feedback: DataFrame, store: TableStore, ctx: RunContext, sentiment: Sentiment | None = None) -> None:
    """Adds feedback events to the week's adjustments by tag, held within the cap after each one.

    Events that nudge_events has are not asked about again. The adjustments are folded anew from the week's events since
    they were last cleared, in the order of time, item and event, so that a repeat changes nothing.
    """
    fresh = cut(feedback.join(store.read("nudge_events").select("event_id"), "event_id", "left_anti"))
    asked = sentiment or offline.WordSentiment()
    said = Ledger(store, ctx).ask(_name(asked), fresh, ["event_id"], [F.col("event_id"), F.col("feedback_text")], "direction string, magnitude string", lambda rows: asked.classify(rows).select("event_id", "direction", "magnitude"))
    told = fresh.join(said, "event_id")
    delta = nudge_delta(F.col("direction"), F.col("magnitude"))
    store.append("nudge_events", cut(told.select("event_id", iso_week(ctx.now()).alias("week_of"), "item_id", "replied_at", "tags", delta.alias("delta"), F.lit(int(ctx.run_ts.timestamp() * 1e6)).alias("at"))))
    cleared = store.read("polling_state").where("name = 'nudges_cleared'").first()
    week = store.read("nudge_events").where((F.col("week_of") == iso_week(ctx.now())) & (F.col("at") > (cleared.value if cleared else -1)) & F.col("delta").isNotNull())
    each = week.select("week_of", F.explode("tags").alias("tag"), "item_id", "delta", F.struct("at", "replied_at", "item_id", "event_id").alias("o"))
    now = folds.saturating_fold(each, ["week_of", "tag"], ["o"], "delta", "item_id")
    store.upsert("same_day_adjustments", cut(now.select("week_of", "tag", "cumulative_adjustment", "item_ids_contributing")))


def trace(store: TableStore, run_id: str, order: tuple[str, ...] = ("scrape", "discover", "score", "match", "classify", "prioritize")) -> DataFrame:
    """A run's facts as rows of part, name, value, n: its history, nodes in order, classes, outcomes and drops of each type."""
    mine = lambda name: store.read(name).where(F.col("run_id") == run_id)
    row = lambda df, part, name, value, n: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"), F.col(n).cast("long").alias("n"))
    nodes = mine("node_summary").withColumn("name", F.concat_ws(" ", F.lpad(F.array_position(F.array(*map(F.lit, order)), F.col("node_name")).cast("string"), 2, "0"), "node_name"))
    parts = [
        row(mine("run_history"), "run", "status", "path", "items_out"),
        row(nodes, "node", "name", "cost_usd", "dropped"),
        row(mine("classification_log").groupBy("decision", "proposal_type").count(), "class", "decision", "proposal_type", "count"),
        row(mine("approval_log").groupBy("outcome").count(), "outcome", "outcome", "outcome", "count"),
        row(folds.drop_counts(mine("prefilter_drops")), "drop", "filter_type", "filter_type", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
