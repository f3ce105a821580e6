"""Runs that break off: effects happen once, stages and answers are not made twice."""

import pytest
from pyspark.sql import functions as F
from test_runs import ctx, item, items, weekly

from siftworks.models.batches import BatchScorer
from siftworks.models.offline import HashEmbedder, KeywordScorer, MemoryBoard, Outbox, RuleClassifier
from siftworks.plans import runs
from siftworks.plans.stages import Stages, StepLimit
from siftworks.schemas import STORE
from siftworks.sources import outbox
from siftworks.sources.ledger import Ledger
from siftworks.sources.store import TableStore
from siftworks.streaming import updates


class Killed(BaseException):
    """Like the end of the process: nothing catches it."""


class BreakingStore(TableStore):
    """Ends the process after so many writes."""

    left = None

    def _count(self):
        if self.left is not None:
            self.left -= 1
            if self.left < 0:
                raise Killed

    def upsert(self, *a, **k):
        self._count()
        super().upsert(*a, **k)

    def append(self, *a, **k):
        self._count()
        super().append(*a, **k)

    def remove(self, *a, **k):
        self._count()
        super().remove(*a, **k)


class Service(Outbox):
    """Sends, and ends the process before the sender hears of it, once."""

    kill = None

    def send(self, text, markup="HTML", key=None):
        got = super().send(text, markup, key)
        if self.kill is not None and self.calls > self.kill:
            self.kill = None
            raise Killed
        return got


class Desk(MemoryBoard):
    calls = 0
    kill = False

    def create(self, *a, **k):
        self.calls += 1
        got = super().create(*a, **k)
        if self.kill:
            self.kill = False
            raise Killed
        return got


@pytest.fixture
def store(spark, tmp_path):
    return BreakingStore(spark, f"file://{tmp_path}/store")


def queued():
    row = {c: None for c in ("url", "title", "text", "reasoning")} | {"message_id": "$id", "proposal_id": "p", "tags": ["evals"]}
    card = outbox.effect("r", "approval", "p", "create", {"title": "T $url", "list_id": "dump", "description": "why"})
    return [
        outbox.effect("r", "proposal", "p", "send", {"text": "a $name stays", "markup": None}, [("pending_resume", row), ("event_log", {"ts": "t", "agent": "$id"})]),
        card,
        outbox.effect("r", "note", "p", "send", {"text": "made $name at $url", "markup": None}, after=card["effect_id"]),
    ]


@pytest.mark.parametrize("broken", [0, 2, 3, 4, 5, "send", "send again", "create"])
def test_an_effect_happens_once_wherever_a_pass_breaks(store, broken):
    out, desk = Service(), Desk()
    outbox.put(store, queued(), "t0")
    outbox.put(store, queued(), "t1")  # a repeated run
    if isinstance(broken, int):
        store.left = broken
    out.kill, desk.kill = {"send": 0, "send again": 1}.get(broken), broken == "create"
    try:
        outbox.send_waiting(store, out, desk, "t2")
    except Killed:
        pass
    store.left = None
    assert outbox.send_waiting(store, out, desk, "t3") == {} and outbox.send_waiting(store, out, desk, "t4") == {}
    assert out.calls == 2 and desk.calls == 1
    assert sorted(out.sent.values()) == ["a $name stays", "made T $url at https://board.invalid/1"]
    assert {r.status for r in store.read("outbox").collect()} == {"settled"}
    pending = store.read("pending_resume").collect()
    assert [(r.message_id in out.sent, r.proposal_id, r.tags) for r in pending] == [(True, "p", ["evals"])]
    assert [r.agent for r in store.read("event_log").collect()] == [pending[0].message_id]


def test_an_effect_that_fails_waits_with_its_error(store):
    class Down(Outbox):
        def send(self, *a, **k):
            raise RuntimeError("400 bad markup")

    outbox.put(store, queued(), "t0")
    desk = Desk()
    errors = outbox.send_waiting(store, Down(), desk, "t1")
    assert set(errors.values()) == {"400 bad markup"} and desk.calls == 1
    rows = {r.node: r for r in store.read("outbox").collect()}
    assert (rows["proposal"].status, rows["proposal"].tries, rows["proposal"].error) == ("waiting", 1, "400 bad markup") and rows["approval"].status == "settled"
    out = Outbox()
    assert outbox.send_waiting(store, out, desk, "t2") == {} and out.calls == 2 and desk.calls == 1


PENDING = STORE["pending_resume"][0]


def waiting(spark, store):
    rows = [("m1", "p1", "p1", "run1", "http://p/1", None, "x" * 100, "why new", ["evals"], "new", "c7"), ("m2", "p2", "p2", "run1", "http://p/2", "Second", "t", "why more", ["evals"], "extend", "c7"), ("m3", "p3", "p3", "run1", "http://p/3", "Third", "t", "no", ["noise"], "extend", None)]
    store.upsert("pending_resume", spark.createDataFrame(rows, PENDING))
    return spark.createDataFrame([(1, "10", "approve", "m1"), (2, "11", "yes", "m2"), (3, "12", "reject", "m3"), (4, "13", "reject", "m1"), (5, "14", "hm", "m2")], updates.SCHEMA)


@pytest.mark.parametrize("broken", [None, 2, 7, 11, "create"])
def test_approvals_act_once_wherever_a_poll_breaks(spark, store, broken):
    batch, out, desk = waiting(spark, store), Service(), Desk()
    desk.cards["c7"] = {"id": "c7", "name": "Seven", "url": "http://c7", "desc": ""}
    store.left, desk.kill = (broken if isinstance(broken, int) else None), broken == "create"
    try:
        runs.poll(batch, store, ctx(4), notifier=out, board=desk)
    except Killed:
        pass
    store.left = None
    runs.poll(batch, store, ctx(4), notifier=out, board=desk)
    assert runs.poll(batch, store, ctx(4), notifier=out, board=desk) == {}
    made = [c for c in desk.cards.values() if c["id"] != "c7"]
    assert desk.calls == 1 and [(c["name"], c["desc"], c["idList"]) for c in made] == [("x" * 80, "why new", "dump")]
    assert desk.cards["c7"]["desc"] == "why more"
    assert sorted(out.sent.values()) == sorted([runs.UNCLEAR, f"✅ Created new card: {'x' * 80}\n{made[0]['url']}", "✅ Updated card: Seven\nhttp://c7"]) and out.calls == 3
    assert sorted((r.item_id, r.outcome) for r in store.read("approval_log").collect()) == [("http://p/1", "approved"), ("http://p/2", "approved"), ("http://p/3", "rejected")]
    assert [r.item_id for r in store.read("feedback_events").collect()] == ["http://p/3"] and store.read("pending_resume").count() == 0


class Counting(KeywordScorer):
    asked = 0

    def score(self, batches):
        self.asked += batches.count()
        return super().score(batches)


class CountingEmbedder(HashEmbedder):
    asked = 0

    def embed(self, rows, text, out="embedding_vector"):
        self.asked += rows.count()
        return super().embed(rows, text, out)


class CountingClassifier(RuleClassifier):
    asked = 0

    def classify(self, items):
        self.asked += items.count()
        return super().classify(items)


class Dead(Outbox):
    def send(self, *a, **k):
        raise RuntimeError("no network")


def test_a_run_that_failed_goes_on_and_asks_nothing_twice(spark, store):
    scorer, embedder, classifier = Counting(), CountingEmbedder(), CountingClassifier()
    store.upsert("adhoc_queue", spark.createDataFrame([("k1", "evals idea", "2026")], "key string, text string, queued_at string"))
    with pytest.raises(RuntimeError, match="no network"):
        weekly(spark, store, Dead(), scorer=scorer, embedder=embedder, classifier=classifier)
    asked = scorer.asked, embedder.asked, classifier.asked
    assert all(asked) and store.read("run_history").first().status == "failed"
    drops, logged = store.read("prefilter_drops").count(), store.read("scored_items_log").count()
    out = Outbox()
    text, shown = weekly(spark, store, out, scorer=scorer, embedder=embedder, classifier=classifier)
    assert (scorer.asked, embedder.asked, classifier.asked) == asked
    assert len(shown) == 6 and "adhoc:k1" in {s["url"] for s in shown}  # though they were marked as seen, and the queue was emptied
    assert out.calls == len(out.sent) == 2 and store.read("pending_resume").count() == 1  # the proposal of the first try, and the plan
    assert (store.read("prefilter_drops").count(), store.read("scored_items_log").count()) == (drops, logged)
    assert store.read("run_history").first().status == "paused"
    assert not store._fs().exists(store._path("_stages", "run3"))


def test_stages_depend_on_what_came_before(spark, store):
    c, made = ctx(1), []

    def make(n):
        made.append(n)
        return spark.range(n).toDF("a")

    one = spark.range(3)
    for table, third in ((one, 7), (one.repartition(2), 7), (one, 8), (spark.range(4), 7)):
        s = Stages(store, c, table)
        assert s.keep("x", lambda: make(1)).count() == 1
        assert s.keep("y", lambda: make(third), third).count() == third
    assert made == [1, 7, 8, 1, 7]
    c = ctx(2, max_steps=2)
    s = Stages(store, c, one)
    for name in "ab":
        s.keep(name, lambda: make(1))
    with pytest.raises(StepLimit):
        s.keep("c", lambda: make(1))
    with pytest.raises(StepLimit):
        runs.daily_run(items(spark, item("http://a/1", "evals", "x")), store, ctx(3, max_steps=2))
    assert store.read("run_history").where("run_id = 'run3'").first().status == "failed"


def test_a_failing_batch_loses_that_batch_alone(spark, store):
    rows = items(spark, *[item(f"http://b/{i}", "bad" if i == 60 else f"evals {i}", "x") for i in range(120)])

    def ask(batch):
        if any(r["title"] == "bad" for r in batch):
            raise ValueError("no JSON")
        return [{"index": r["index"], "keep": True, "reasoning": r["url"], "tags": ["evals"]} for r in batch]

    def later(batch):
        return [{"index": r["index"], "keep": False, "reasoning": f"asked {len(batch)}", "tags": ["evals"]} for r in batch]

    c, model = ctx(1), BatchScorer(ask)
    scored = runs.score(rows, store, c, model)
    assert sorted(r.pos for r in scored.collect()) == [*range(50), *range(100, 120)] and all(r.reasoning == r.url for r in scored.collect())
    assert store.read("seen_items").count() == 70
    assert c.nodes[-1]["error_summary"] == "50 items without a score: no JSON"
    again = runs.score(rows, store, ctx(2), BatchScorer(later)).collect()
    assert len(again) == 120 and {r.reasoning for r in again if 50 <= r.pos < 100} == {"asked 50"} and all(r.keep == (not 50 <= r.pos < 100) for r in again)


def test_a_batch_with_answers_of_another_shape_fails(spark):
    lots = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "batch int, index int, url string")
    said = BatchScorer(lambda rows: [{"index": len(rows) - 1, "keep": "yes" if len(rows) == 1 else True, "reasoning": "", "tags": []}]).score(lots).collect()
    assert sorted((r.batch, r["index"], r.keep, r.error is None) for r in said if r.batch == 0) == [(0, 1, True, True)]
    assert [(r["index"], r.error is None) for r in said if r.batch == 1] == [(None, False)]


def test_the_ledger_keeps_many_answers_and_asks_again_where_there_is_none(spark, store):
    asked = []

    def call(rows):
        asked.append(sorted(r.q for r in rows.collect()))
        return rows.where("q <> 'none'").select("id", F.explode(F.array(F.lit(1.5), F.lit(None))).alias("x"), F.array("q").alias("l"))

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none"), (4, None)], "id int, q string")
    rows = rows.na.fill({"q": "null"})
    for n in range(2):
        got = Ledger(store, ctx(n)).ask("m", rows, ["id"], [F.col("q")], "x double, l array<string>", call).collect()
        assert sorted((r.id, r.x or 0, r.l[0], r["__known"]) for r in got) == sorted((i, x, q, n == 1) for i, q in ((1, "a"), (2, "a"), (4, "null")) for x in (0, 1.5))
    assert asked == [["a", "none", "null"], ["none"]]
    assert Ledger(store, ctx(2)).ask("other", rows.limit(1), ["id"], [F.col("q")], "x double, l array<string>", call).count() == 2
