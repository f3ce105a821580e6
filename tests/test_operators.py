"""Operators on small tables, many against a plain restatement."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftworks.operators import dedup, enrich, folds, history, routing, similarity

NOW = datetime(2026, 7, 26, 12, tzinfo=timezone.utc)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_cluster_picks_longest_then_earliest_then_first(spark):
    items = spark.createDataFrame(
        [("http://a.b/x/", "aa", "2", 0), ("http://A.b/x?utm_id=1", "bbb", "9", 1), ("http://a.b/x#z", "ccc", "3", 2), ("http://a.b/y", "d", "1", 3), ("http://a.b/x?ref=q", "ddd", "3", 4)],
        "url string, text string, fetched_at string, pos long",
    )
    got = rows(dedup.cluster_by_url(items).orderBy("pos"), "text", "duplicate_count", "pos")
    assert got == [("ccc", 4, 0), ("d", 1, 3)]


def test_empty_urls_are_one_group(spark):
    items = spark.createDataFrame([("", "a", "1", 0), (None, "b", "1", 1)], "url string, text string, fetched_at string, pos long")
    assert dedup.cluster_by_url(items).count() == 1


def test_seen_expires_but_never_without_a_time(spark):
    old, new = (NOW - timedelta(days=36)).isoformat(), (NOW - timedelta(days=34)).isoformat().replace("+00:00", "Z")
    seen = spark.createDataFrame([("a", old), ("b", new), ("c", None)], "url string, seen_at string")
    live = dedup.alive(seen, F.lit(NOW))
    assert sorted(r.url for r in live.collect()) == ["b", "c"]
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    assert sorted(r.url for r in dedup.unseen(items, live).collect()) == ["a", "d"]
    assert sorted(r.url for r in dedup.seen_again(items, live).collect()) == ["b", "c"]
    assert sorted(r.url for r in dedup.marks(items, live, "t").collect()) == ["a", "d"]
    assert {r.seen_at for r in dedup.backfilled(seen, "t").collect()} == {old, new, "t"}


def vec(c):
    return [c, math.sqrt(1 - c * c)]


def test_window_match_tiers(spark):
    items = spark.createDataFrame([("n1", vec(0.95), False), ("n2", vec(0.7), False), ("n3", vec(0.7), True), ("n4", vec(0.5), False), ("n5", [0.0, 0.0], False)], "url string, embedding_vector array<double>, is_roundup boolean")
    window = spark.createDataFrame([("w", [1.0, 0.0], False)], "url string, embedding_vector array<double>, is_roundup boolean")
    got = {r.url: (r.filter_type, round(r.sim, 4)) for r in similarity.window_match(items, window).collect()}
    assert got == {"n1": ("dedup", 0.95), "n2": ("content_overlap", 0.7)}


def greedy(items, verbatim, overlap):
    """The sequential pass over (url, fetched_at, roundup, vector)."""
    def cos(a, b):
        d = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / d if d else 0.0

    slots = []
    for it in items:
        best = None
        for i, s in enumerate(slots):
            c = cos(it[3], s[3])
            if c >= verbatim or (c >= overlap and not it[2] and not s[2]):
                if best is None or c > best[1]:
                    best = (i, c)
        if best is None:
            slots.append(it)
        elif it[1] < slots[best[0]][1]:
            slots[best[0]] = it
    return [s[0] for s in slots]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_dedup_equals_the_sequential_pass(spark, seed):
    r = random.Random(seed)
    items = [(f"u{i:03d}", f"{r.randint(0, 40):03d}", r.random() < 0.2, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([(u, f, p, v, i) for i, (u, f, p, v) in enumerate(items)], "url string, fetched_at string, is_roundup boolean, embedding_vector array<double>, pos long")
    got = similarity.greedy_dedup(df, 0.95, 0.8)
    kept = [x.url for x in got.where("kept").orderBy("slot").collect()]
    assert kept == greedy(items, 0.95, 0.8)
    assert got.count() == 60


@pytest.mark.parametrize(("seed", "width", "most", "rounds"), [(4, 2, 0, 64), (5, 2, 0, 2), (6, 4, 5, 64)])
def test_greedy_rounds_equal_the_sequential_pass(spark, monkeypatch, seed, width, most, rounds):
    """In rounds to the end, in two rounds and a fold, and with components on both sides of the bound; two dimensions make one component of all rows."""
    monkeypatch.setattr(similarity, "ROUNDS", rounds)
    r = random.Random(seed)
    items = [(f"u{i:03d}", f"{r.randint(0, 40):03d}", r.random() < 0.2, [r.gauss(0, 1) for _ in range(width)]) for i in range(32)]
    df = spark.createDataFrame([(u, f, p, v, i) for i, (u, f, p, v) in enumerate(items)], "url string, fetched_at string, is_roundup boolean, embedding_vector array<double>, pos long")
    got = similarity.greedy_dedup(df, 0.95, 0.8, most).collect()
    assert [x.url for x in sorted((x for x in got if x.kept), key=lambda x: x.slot)] == greedy(items, 0.95, 0.8)
    plain = {x.url: x for x in similarity.greedy_dedup(df, 0.95, 0.8).collect()}
    assert len(got) == 32 and all((x.slot, x.kept, x.matched, x.filter_type) == (plain[x.url].slot, plain[x.url].kept, plain[x.url].matched, plain[x.url].filter_type) for x in got)


def test_greedy_dedup_without_pairs(spark):
    df = spark.createDataFrame([("a", "1", False, [1.0, 0.0], 0), ("b", "1", False, [0.0, 1.0], 1)], "url string, fetched_at string, is_roundup boolean, embedding_vector array<double>, pos long")
    assert rows(similarity.greedy_dedup(df).orderBy("pos"), "kept", "slot") == [(True, 0), (True, 1)]


def test_nearest_topic_is_the_max_and_ties_go_to_the_least_tag(spark):
    topics = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "tag string, embedding_vector array<double>")
    items = spark.createDataFrame([("x", [1.0, 0.0]), ("y", vec(0.2))], "url string, embedding_vector array<double>")
    assert sorted((r.url, r.best_tag) for r in similarity.nearest_topic(items, topics).collect()) == [("x", "a"), ("y", "c")]


def test_batches(spark):
    items = spark.range(0, 130).select((F.col("id") * 7).alias("pos"))
    got = enrich.batched(items, 50).orderBy("pos").collect()
    assert [(r.batch, r["index"]) for r in got] == [(i // 50, i % 50) for i in range(130)]
    assert enrich.batched(items.limit(0)).count() == 0


def test_scores_join_loses_and_doubles(spark):
    items = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 0, 2)], "url string, batch int, index int")
    said = spark.createDataFrame([(0, 0, True, "r", ["evals", "zzz"]), (0, 1, False, "r", []), (0, 1, True, "s", ["noise"])], "batch int, index int, keep boolean, reasoning string, tags array<string>")
    got = sorted(rows(enrich.join_scores(items, said), "url", "keep", "tags"))
    assert got == [("a", True, ["evals"]), ("b", False, []), ("b", True, ["noise"])]
    assert rows(enrich.rejected_tags(items, said), "item_id", "tag") == [("a", "zzz")]


def test_left_joins_take_the_last_answer(spark):
    items = spark.createDataFrame([("a",), ("b",)], "url string")
    said = spark.createDataFrame([("a", "c1", 0), ("a", "c2", 1), ("z", "c3", 2)], "item_id string, matched_card_id string, pos long")
    assert sorted(rows(enrich.with_matches(items, said), "url", "matched_card_id")) == [("a", "c2"), ("b", None)]
    classes = spark.createDataFrame([("a", "project_proposal", "extend", "x", 0), ("a", "project_proposal", None, None, 1)], "item_id string, classification string, proposal_type string, classification_reasoning string, pos long")
    assert sorted(rows(enrich.with_classes(items, classes), "url", "classification", "proposal_type")) == [("a", "project_proposal", "new"), ("b", "plan_item", None)]


def selection(spark, *given):
    return spark.createDataFrame([(*g, i) for i, g in enumerate(given)], "matched_card_id string, source string, item_url string, priority_reasoning string, movement_note string, pos long")


def test_selection(spark):
    cards = spark.createDataFrame([(f"c{i}", f"Card {i}", f"http://card/{i}", "Dump") for i in range(8)], "card_id string, name string, url string, list_name string")
    items = spark.createDataFrame([("u1", "T", "text", ["evals"])], "url string, title string, text string, tags array<string>")
    chosen = selection(spark, ("c0", "new_item", "u1", "why", "moved"), ("zz", "new_item", "u1", "", None), ("c1", "new_item", "nope", "", None), ("c2", "odd", "u1", None, None), *[(f"c{i}", "stale_nudge", None, "r", None) for i in range(3, 8)])
    got = enrich.valid_selection(chosen, cards, items)
    assert rows(got.orderBy("rank"), "rank", "matched_card_id", "source", "item_url") == [(1, "c0", "new_item", "u1"), (2, "c2", "stale_nudge", None), (3, "c3", "stale_nudge", None), (4, "c4", "stale_nudge", None), (5, "c5", "stale_nudge", None)]
    e = enrich.project_entries(got, cards, items).orderBy("rank").collect()
    assert (e[0].title, e[0].url, e[0].reasoning, e[0].tags) == ("T", "u1", "why — moved", ["evals"])
    assert (e[1].title, e[1].url, e[1].text, e[1].tags) == ("Card 2", "http://card/2", "", [])
    assert rows(enrich.surfaced_cards(got, cards.where("card_id <> 'c2'")), "card_id", "list_name")[:2] == [("c0", "Dump"), ("c2", "Unknown")]


def test_movement(spark):
    prior = spark.createDataFrame([("a", "Dump"), ("b", "Dump"), ("c", "Dump"), ("d", "Dump"), ("e", "Dump"), ("f", "Dump")], "card_id string, list_name string")
    now = spark.createDataFrame([("a", False, "l1"), ("b", True, "l1"), ("c", False, "l2"), ("d", False, "l3"), ("e", False, "l9")], "card_id string, closed boolean, list_id string")
    lists = spark.createDataFrame([("l1", "Dump"), ("l2", "In Progress"), ("l3", "Done")], "list_id string, list_name string")
    got = dict((r.card_id, (r.current_list_name, r.status)) for r in history.movement(prior, now, lists).collect())
    assert got == {"a": ("Dump", "unchanged"), "b": ("Dump", "archived"), "c": ("In Progress", "moved"), "d": ("Done", "completed"), "e": ("Unknown", "moved"), "f": (None, "not_found")}


def test_latest_prior_and_carry_forward(spark):
    runs = spark.createDataFrame([("r1", "weekly", "success", "1"), ("r2", "weekly", "success", "3"), ("r3", "weekly", "paused", "5"), ("r4", "daily", "success", "6"), ("now", "weekly", "success", "9")], "run_id string, path string, status string, finished_at string")
    assert rows(history.prior_run(runs, "now"), "run_id") == [("r2",)]
    assert history.latest_prior(runs.limit(0), "finished_at").count() == 0
    m = [("m", "r2", i, f"u{i}", "t", "x", ["evals"], "r", s) for i, s in enumerate(["reading", "courses", "existing_project_work", "reading", "reading"])]
    items = spark.createDataFrame(m, "message_id string, run_id string, item_number int, url string, title string, text string, tags array<string>, reasoning string, section string")
    done = spark.createDataFrame([("u1", False), ("u3", True)], "url string, checked boolean")
    carried = spark.createDataFrame([("u4",)], "url string")
    got = history.carry_forward(runs, items, done, carried, "now")
    assert sorted(rows(got, "url", "classification")) == [("u0", "plan_item"), ("u1", "plan_item")]


def test_as_of(spark):
    a = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("j", 3, "z")], "k string, t int, v string")
    b = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 6, 60)], "k string, t int, w int")
    assert sorted(rows(history.as_of(a, b, "k", "t", ["w"]), "v", "prior_w"), key=str) == [("x", 50), ("y", None), ("z", None)]


def test_saturating_fold_clamps_after_each_event(spark):
    e = spark.createDataFrame([("t", i, d, f"i{i}") for i, d in enumerate([0.2, 0.2, 0.2, -0.1])], "tag string, at int, d double, item string")
    got = folds.saturating_fold(e, ["tag"], ["at"], "d", "item").first()
    assert (got.cumulative_adjustment, got.item_ids_contributing) == (0.2, ["i0", "i1", "i2", "i3"])


def test_costs(spark):
    c = spark.createDataFrame([("anthropic", 1.0), ("", 0.5), (None, 0.25), ("nvidia", 2.0)], "provider string, cost_usd double")
    assert {r.provider: r.cost_usd for r in folds.cost_by_provider(c).collect()} == {"anthropic": 1.0, "other": 0.75, "nvidia": 2.0, "total": 3.75}


def test_allocate(spark):
    r = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "i int, n int")
    assert [x.share for x in folds.allocate(r, F.lit(5), F.col("n")).orderBy("i").collect()] == [2, 2, 0]
    assert folds.allocate(r.limit(1), F.lit(7), F.lit(0)).first().share == 7
    assert {x.share for x in folds.allocate(r, F.lit(9), F.lit(0)).collect()} == {0}


def test_cadence(spark):
    day = lambda n: NOW + timedelta(days=n)
    p = spark.createDataFrame([("a", day(0)), ("a", day(1)), ("a", day(3)), ("b", day(0)), ("b", day(5)), ("b", day(10)), ("c", day(0)), ("c", day(1))], "k string, t timestamp")
    assert {r.k: r.cadence for r in folds.cadence(p, "k", "t").collect()} == {"a": "daily", "b": "sporadic", "c": None}


def test_evaluate(spark):
    labels = spark.createDataFrame([("u1", "keep", ["a", "b"]), ("u2", "drop", []), ("u3", "keep", ["c"])], "item_id string, correct_decision string, correct_tags array<string>")
    said = spark.createDataFrame([("u1", True, ["a"]), ("u2", True, []), ("u3", True, ["x"])], "url string, keep boolean, tags array<string>")
    got = folds.evaluate(labels, said, said).first()
    assert (got.n_items, round(got.keep_accuracy, 6), got.mean_tag_overlap) == (3, 0.666667, 0.25)
    assert tuple(folds.evaluate(labels.limit(0), said, said).first()) == (0, None, None)
    with pytest.raises(ValueError, match="u2"):
        folds.evaluate(labels, said.where("url <> 'u2'"), said)


def test_errors_by_name(spark):
    r = spark.createDataFrame([("a",), ("a",)], "author_name string")
    e = spark.createDataFrame([("b", 1, "y"), ("b", 0, "x")], "name string, pos int, message string")
    n = spark.createDataFrame([("c",), ("a",)], "name string")
    assert rows(folds.collect_errors(r, e, n), "name", "n_rows", "error") == [("a", 2, None), ("b", 0, "x; y"), ("c", 0, None)]


def test_routing(spark):
    u = spark.createDataFrame([(1, "10", "yes", "p1"), (2, "11", "hmm", "p1"), (3, "12", "1 good", "d1"), (4, "13", " idea ", None), (5, "14", "  ", None), (6, "15", None, None)], "update_id long, message_id string, text string, reply_to string")
    p = spark.createDataFrame([("p1", "t", "q", "r")], "message_id string, thread_id string, proposal_id string, run_id string")
    got = routing.route(u, p).orderBy("update_id")
    assert rows(got, "route", "decision") == [("approval", "approve"), ("unclear", None), ("feedback", None), ("queue", None), ("ignore", None), ("ignore", None)]
    assert rows(routing.queue_rows(got, "now"), "key", "text") == [("u4", "idea")]
    q = spark.createDataFrame([("k", "x" * 100), ("l", " ")], "key string, text string").withColumn("queued_at", F.lit("t"))
    assert rows(routing.queue_items(q), "url", "source", F.length("title")) == [("adhoc:k", "adhoc", 80)]


def test_feedback_entries(spark):
    parsed = spark.createDataFrame([("m", 1, "great", "positive"), ("m", 2, "x", "meh"), ("m", 9, "x", "negative"), ("m", None, "x", "negative")], "message_id string, item_number int, feedback_text string, sentiment string")
    m = spark.createDataFrame([("m", 1, "r", "u1", "T", "y" * 400, ["evals"])], "message_id string, item_number int, run_id string, url string, title string, text string, tags array<string>")
    got = routing.feedback_rows(routing.feedback_entries(parsed, m), "now").collect()
    assert [(g.item_id, g.sentiment, len(g.content_summary)) for g in got] == [("u1", "positive", 300)]


def clustered(spark, seed, groups, each, width):
    """Vectors of groups far from each other, with zero, null and shorter ones among them."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    rows = [(f"{g}/{i}", [float(x) for x in centres[g] + r.normal(size=width) * 0.05]) for g in range(groups) for i in range(each)]
    rows += [("zero", [0.0] * width), ("null", None), ("empty", []), ("short", [1.0, 2.0]), ("short2", [2.0, 4.0])]
    return spark.createDataFrame(rows, "url string, embedding_vector array<double>"), rows


def pairs_of(rows, threshold):
    vectors = {k: np.array(v) for k, v in rows if v and any(v)}
    return {(a, b) for a, x in vectors.items() for b, y in vectors.items() if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold}


def test_blocks_that_cannot_reach_the_threshold_never_meet(spark):
    df, rows_ = clustered(spark, 1, 24, 20, 32)
    one, two, met = similarity.near_blocks(df, df, 0.8, "url", "url", block=10)
    total = one.count() * two.count()
    assert two is one and max(len(r.vs) for r in one.select("vs").collect()) <= 10
    assert met.count() < 0.1 * total  # over 90 % of the products are left out
    got = similarity.similar_pairs(df, df, 0.8, "url", "url", block=10)
    assert {(r.a, r.b) for r in got.collect()} == pairs_of(rows_, 0.8)
    assert ("short", "short2") in pairs_of(rows_, 0.8) and len(pairs_of(rows_, 0.8)) == 24 * 400 + 4


def test_pruned_pairs_of_scattered_vectors_are_all_there(spark):
    r = np.random.default_rng(2)
    rows_ = [(i, [float(x) for x in r.normal(size=4)]) for i in range(150)]
    df = spark.createDataFrame(rows_, "id long, embedding_vector array<double>")
    for threshold in (0.3, 0.9, 1.0 - 1e-12):
        got = similarity.similar_pairs(df, df.where("id % 2 = 0"), threshold, "id", "id", block=8)
        assert {(x.a, x.b) for x in got.collect()} == {(a, b) for a, b in pairs_of(rows_, threshold) if b % 2 == 0}


@pytest.mark.parametrize(("seed", "width", "few"), [(7, 3, 0), (8, 2, 0), (9, 4, 1000)])
def test_greedy_dedup_in_parts_equals_the_sequential_pass(spark, monkeypatch, seed, width, few):
    """Of one slice each, and of twice as many slices each time."""
    monkeypatch.setattr(similarity, "FEW", few)
    r = random.Random(seed)
    items = [(f"u{r.randint(0, 10**6):07d}", f"{r.randint(0, 40):03d}", r.random() < 0.2, [r.gauss(0, 1) for _ in range(width)]) for i in range(80)]
    df = spark.createDataFrame([(u, f, p, v, i) for i, (u, f, p, v) in enumerate(items)], "url string, fetched_at string, is_roundup boolean, embedding_vector array<double>, pos long")
    got = similarity.greedy_dedup(df, 0.95, 0.8, size=25).collect()
    assert [x.url for x in sorted((x for x in got if x.kept), key=lambda x: x.slot)] == greedy(items, 0.95, 0.8)
    whole = {x.url: x for x in similarity.greedy_dedup(df, 0.95, 0.8).collect()}
    assert len(got) == 80 and all((x.slot, x.kept, x.matched, x.filter_type) == (whole[x.url].slot, whole[x.url].kept, whole[x.url].matched, whole[x.url].filter_type) for x in got)


def test_greedy_pass_makes_pairs_of_a_part_only(spark, monkeypatch):
    """Items near to each other by half: pairs of all of them would grow with the square of the run."""
    made = []
    cut = similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(similarity, "FEW", 0)
    r = random.Random(10)
    df = spark.createDataFrame([(f"u{i:03d}", "0", False, [r.random() - 0.2 for _ in range(3)], i) for i in range(200)], "url string, fetched_at string, is_roundup boolean, embedding_vector array<double>, pos long")
    similarity.greedy_dedup(df, 0.9, 0.6, size=20).count()
    pairs = [x.count() for x in made if x.columns == ["a", "b", "sim", "filter_type"]]
    assert len(pairs) == 10 and max(pairs) < 600 and sum(pairs) < 4000  # of 19,900


def _digits(df):
    """Binary digits of the size that Spark estimates for df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_estimates_do_not_grow_with_the_parts_of_a_run(spark, monkeypatch):
    """A checkpoint keeps its plan's estimate, and a join's is a product: carried from part to part, it doubled its digits each time."""
    sizes, passed = [], similarity._passed
    monkeypatch.setattr(similarity, "_passed", lambda bare, own, most: sizes.append(_digits(bare)) or passed(bare, own, most))
    monkeypatch.setattr(similarity, "FEW", 0)
    r = random.Random(12)
    items = [(f"u{i:03d}", f"{r.randint(0, 40):03d}", r.random() < 0.2, [r.gauss(0, 1) for _ in range(3)]) for i in range(72)]
    df = spark.createDataFrame([(u, f, p, v, i) for i, (u, f, p, v) in enumerate(items)], "url string, fetched_at string, is_roundup boolean, embedding_vector array<double>, pos long")
    got = similarity.greedy_dedup(df, 0.95, 0.8, size=12).collect()
    assert [x.url for x in sorted((x for x in got if x.kept), key=lambda x: x.slot)] == greedy(items, 0.95, 0.8)
    assert len(sizes) == 6 and max(sizes) <= sizes[0] + 4
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir() + "/carried-*")
    before = set(map(str, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)))
    similarity.greedy_dedup(df, 0.95, 0.8, size=30).count()
    assert set(map(str, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder))) <= before  # survivors of a part go when the next ones are there


def test_estimates_do_not_grow_with_rounds(spark):
    path = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(40)], "a string, b string")
    roots = similarity.components(path)
    assert _digits(roots) < 64 and {x.root for x in roots.collect()} == {"00"}
    none = F.lit(None)
    rows_ = spark.range(12).select(F.format_string("%02d", "id").alias("url"), F.col("id").alias("pos"), F.lit("0").alias("fetched_at"), none.cast("string").alias("state"), none.cast("long").alias("slot"), none.cast("long").alias("death"))
    own = spark.createDataFrame([(f"{i + 1:02d}", f"{i:02d}", 0.9, "dedup") for i in range(11)], "a string, b string, sim double, filter_type string")
    done = similarity._rounds(rows_, own, 0)
    assert _digits(done) < 64 and [x.state for x in done.orderBy("pos").collect()] == ["H", "N"] * 6


def _shuffled(df):
    """Whether df's plan shuffles arrays."""
    return any("Exchange" in x and "RoundRobin" in x for x in df._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_blocks_meet_without_a_shuffle_and_leave_a_row_an_item(spark):
    r = random.Random(11)
    df = spark.createDataFrame([(f"{i:03d}", i % 7 == 0, [r.random() - 0.2 for _ in range(3)], i) for i in range(90)], "url string, is_roundup boolean, embedding_vector array<double>, pos long")
    pairs = similarity._pairs(df, df, 0.5, "url", "url", "embedding_vector", 10)
    assert not _shuffled(pairs) and not _shuffled(similarity.similar_pairs(df, df, -1.0, "url", "url", block=10))
    met = similarity._tiers(df, df.where("pos < 40"), 0.9, 0.5, True, block=10)
    assert met.count() <= 4 * 90 + 90 and met.groupBy("a").count().agg(F.max("count")).first()[0] <= 5


def test_window_match_gives_like_vectors_the_least_url(spark):
    r = random.Random(12)
    vectors = [[r.gauss(0, 1) for _ in range(37)] for _ in range(20)]
    items = spark.createDataFrame([(f"i{i:04d}", False, [x + 0.01 * r.random() for x in vectors[i % 20]]) for i in range(300)], "url string, is_roundup boolean, embedding_vector array<double>")
    window = spark.createDataFrame([(f"w{i:04d}", False, vectors[i % 20]) for i in range(2900)], "url string, is_roundup boolean, embedding_vector array<double>")
    got = similarity.window_match(items, window).collect()
    assert len(got) == 300 and all(x.matched == f"w{int(x.url[1:]) % 20:04d}" for x in got)


def test_best_match_at_single_precision_first_equals_brute_force(spark, monkeypatch):
    """Vectors that single precision can't tell apart, copies, other sizes, nulls and flags; a row an item and part of the window leaves the products."""
    r = random.Random(21)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    near = lambda v, e: [x + e * r.gauss(0, 1) for x in v]
    items = [(f"i{i:03d}", i % 9 == 0, near(base[i % 8], 0.5)) for i in range(50)] + [("n1", False, None), ("n2", False, [0.0] * 6), ("n3", True, [1.0, 2.0]), ("n4", None, near(base[0], 0.1))]
    window = [(f"w{i:03d}", i % 5 == 0, near(base[i % 8], 1e-7 if i % 2 else 0.4)) for i in range(60)]
    window += [(f"c{i:03d}", i % 3 == 0, window[i][2]) for i in range(20)] + [("m1", False, None), ("m2", False, [0.0] * 6), ("m3", False, [2.0, 1.0])]

    def unit(v):
        a = np.array(v or [], dtype=float)
        return a / np.sqrt((a * a).sum()) if a.any() else a

    want = {}
    for url, f, v in items:
        for b, g, w in window:
            x = float((unit(v) * unit(w)).sum()) if v and w and len(v) == len(w) else 0.0
            if x >= (0.9 if f or g else 0.3):
                want[url] = min(want.get(url, (9, "")), (-x, b))
    schema = "url string, is_roundup boolean, embedding_vector array<double>"
    left, right = spark.createDataFrame(items, schema), spark.createDataFrame(window, schema)
    monkeypatch.setattr(similarity, "PARTS", 3)
    for block in (None, 10, 1):
        met = similarity._tiers(left, right, 0.9, 0.3, True, block=block).collect()
        assert max(Counter(x.a for x in met).values()) <= 3
        got = {}
        for x in met:
            got[x.a] = min(got.get(x.a, (9, "")), (-x.sim, x.b))
            assert x.filter_type == ("dedup" if x.sim >= 0.9 else "content_overlap")
        assert {k: b for k, (_, b) in got.items()} == {k: b for k, (_, b) in want.items()}
        assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_equal_vectors_of_a_window_meet_once(spark, monkeypatch):
    """However common a vector of the window is, its rows are packed, shuffled and multiplied as one for each flag, under their least url."""
    made = []
    packed = similarity._packed
    monkeypatch.setattr(similarity, "_packed", lambda *a: made.append(packed(*a)) or made[-1])
    schema = "url string, is_roundup boolean, embedding_vector array<double>"
    window = spark.createDataFrame([(f"w{i:04d}", i % 2 == 0, [1.0, 0.5] if i > 7 else [0.0, float(i)]) for i in range(600)], schema)
    got = similarity.window_match(spark.createDataFrame([("a", False, [1.0, 0.5]), ("b", True, [2.0, 1.0])], schema), window).collect()
    assert {(x.url, x.matched, x.filter_type) for x in got} == {("a", "w0008", "dedup"), ("b", "w0008", "dedup")}
    assert made[1].agg(F.sum(F.size("ru"))).first()[0] == 10


def test_vectors_of_a_window_match_are_shuffled_once_a_side(spark, monkeypatch):
    """However many blocks there are: what is shuffled grows with the vectors alone. Once more where equal ones of the window meet."""
    plans = []
    cut = similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    r = random.Random(31)
    schema = "url string, is_roundup boolean, embedding_vector array<double>"
    some = lambda name, n: [(f"{name}{i:03d}", i % 7 == 0, [r.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    items, window = (spark.createDataFrame(some(*x), schema) for x in (("i", 70), ("w", 50)))
    shuffles, got = [], []
    for block in (None, 10, 1):  # the last has over 1,024 pairs of blocks
        plans.clear()
        met = similarity._tiers(items, window, 0.9, 0.5, True, block=block)
        shuffles.append(sum(p.count("Exchange ") for p in plans))
        got.append({(x.a, x.b, x.filter_type) for x in met.groupBy("a").agg(F.min_by(F.struct("b", "filter_type"), F.struct(-F.col("sim"), F.col("b"))).alias("m")).select("a", "m.*").collect()})
    assert shuffles == [3, 3, 3] and got[0] == got[1] == got[2] and len(got[0]) > 50
