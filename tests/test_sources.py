"""Readers on small local files and rows."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftworks.context import RunContext
from siftworks.operators.enrich import board_cards
from siftworks.sources import feeds, mailbox
from siftworks.sources.store import TableStore, latest

CTX = RunContext(context="daily", run_id="r", run_ts=datetime(2026, 7, 22, 12, tzinfo=timezone.utc))


def feed(*items):
    return "<rss xmlns:content='http://purl.org/rss/1.0/modules/content/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel>" + "".join(f"<item>{i}</item>" for i in items) + "</channel></rss>"


def post(title, link, date="", more=""):
    return f"<title>{title}</title><link>{link}</link>" + (f"<pubDate>{date}</pubDate>" if date else "") + more


def config(spark, *entries):
    return feeds.sources(spark, [{"name": n, "bucket": b, "url": "u", **more} for n, b, more in entries], CTX)


def bodies(spark, *rows):
    return spark.createDataFrame([(n, "u", k, b) for n, k, b in rows], feeds.BODY)


def test_contexts():
    assert RunContext(context="weekly").buckets == ("daily", "weekly")
    with pytest.raises(ValueError, match="unknown context"):
        RunContext(context="monthly")


def test_feed_limit_then_age(spark):
    fresh, old = "Wed, 22 Jul 2026 06:00:00 +0000", "Wed, 15 Jul 2026 06:00:00 +0000"
    body = feed(post("Old", "http://o", old), post("New", "http://n", fresh, "<description>d</description><content:encoded> full </content:encoded>"), post("NoDate", "http://x"), post("", "http://t", fresh), post("NoLink", "", fresh), post("Beyond", "http://b", fresh))
    items, errors = feeds.parse_feeds(bodies(spark, ("f", "application/xml", body)), config(spark, ("f", "daily", {"fetch_limit": 5})), CTX)
    got = {r.url: r for r in items.collect()}
    assert set(got) == {"http://n", "http://x", "http://t"}
    assert (got["http://n"].text, got["http://n"].source, got["http://t"].title) == ("full", "blog_scrape", "http://t")
    assert got["http://n"].fetched_at.startswith("2026-07-22T06:00:00") and got["http://x"].fetched_at.startswith("2026-07-22T12:00:00")
    assert errors.count() == 0


def test_feed_faults(spark):
    amp = feed(post("A & B", "http://a"))
    rows = bodies(spark, ("amp", "text/xml", amp), ("bad", "text/xml", "<rss><"), ("blocked", "text/html", "<html>cf-chl</html>"), ("bare", "text/xml", "<feed>" + "<item>" + post("T\x07", "http://i") + "</item></feed>"))
    items, errors = feeds.parse_feeds(rows, config(spark, *[(n, "daily", {}) for n in ("amp", "bad", "blocked", "bare")]), CTX)
    assert sorted((r.origin, r.title) for r in items.collect()) == [("amp", "A & B"), ("bare", "T")]
    assert sorted(r.name for r in errors.collect()) == ["bad", "blocked"]
    assert sorted(r.file for r in feeds.quarantine(rows, errors).collect()) == ["bad.bin", "blocked.bin"]


def test_case_studies_go_for_their_feed_alone(spark):
    b = feed(post("A case study", "http://c"))
    items, _ = feeds.parse_feeds(bodies(spark, ("x", "text/xml", b), ("y", "text/xml", b)), config(spark, ("x", "daily", {"drop_case_studies": True}), ("y", "daily", {})), CTX)
    assert [r.origin for r in items.collect()] == ["y"]


def test_buckets(spark):
    entries = [{"name": "d", "bucket": "daily", "url": "u"}, {"name": "w", "bucket": "weekly", "url": "u"}]
    assert feeds.sources(spark, entries, CTX).count() == 1
    assert feeds.sources(spark, entries, RunContext(context="weekly")).count() == 2
    with pytest.raises(ValueError, match="unknown bucket"):
        feeds.sources(spark, [{"name": "z", "bucket": "yearly", "url": "u"}], CTX)


def test_roundup(spark):
    def article(href, title, snippet):
        return f'<article class="m"><a class="l" href="{href}"><h3>{title}</h3></a><div class="newsletter-html x">{snippet}</div></article>'

    page = "<main>" + article("http://a?x=1&amp;utm_source=t", "One &amp; two (4 minute read)", "S <b>n</b>") + article("http://b", "Buy (Sponsor)", "x") + article("http://c", "Tool (Website)", "") + "<article>none</article></main>"
    got = feeds.parse_roundups(spark.createDataFrame([("Round", "t", page)], "name string, fetched_at string, body string")).orderBy("place").collect()
    assert [(r.url, r.title, r.text) for r in got] == [("http://a?x=1&amp;utm_source=t", "One & two", "S n"), ("http://c", "Tool (Website)", "")]


def test_listing(spark):
    def article(slug, title, date):
        return f'<article class="x__article"><a href="/engineering/{slug}"><h3>{title}</h3></a><div class="x__date">{date}</div></article>'

    page = article("new", "New <i>one</i>", "Jul 22, 2026") + article("old", "Old", "Jan 1, 2026") + article("odd", "Odd", "soon") + '<article class="x__article">no link</article>'
    pages = spark.createDataFrame([("L", page)], "name string, body string")
    got = feeds.parse_listings(pages, config(spark, ("L", "daily", {})), CTX, "https://h.example").collect()
    assert sorted((r.url, r.title, r.text) for r in got) == [("https://h.example/engineering/new", "New one", ""), ("https://h.example/engineering/odd", "Odd", "")]


def test_pages_with_odd_markup(spark):
    from siftworks.sources.pages import Articles, post, story, without_reading_time

    page = '<article><a href="/p?a=1&amp;b=2"><h3>A <b>bold</b> &lt;one&gt;</h3></a><div class="x newsletter-html">first<div>inner</div>never</div></article><article><h3>no link</h3></article><article class="k__article"><a href="/other">x</a><a href="/engineering/y">y</a><h3 class="t"> T &amp; U </h3><div class="k__date">Jul 1, 2026</div>'
    found = Articles(page + "</article>").found
    assert story(found[0]) == ("/p?a=1&amp;b=2", "A bold <one>", "firstinner") and story(found[1]) is None
    assert post(found[2], "/engineering/") == ("/engineering/y", "T &amp; U", "Jul 1, 2026")
    assert [without_reading_time(t) for t in ("A (3 minute read)", "A (x minute read)", "minute read)", "B (4 MINUTE READ)")] == ["A", "A (x minute read)", "minute read)", "B"]
    assert Articles("").found == [] and Articles("<article><h3>open").found == []


def test_sources_by_kind(spark):
    fresh = "Wed, 22 Jul 2026 06:00:00 +0000"
    rows = [("f", "u", "text/xml", feed(post("A", "http://a", fresh)), None), ("bad", "u", "text/xml", "<rss><", None), ("down", "u", None, None, "timed out"), ("r", "u", "text/html", '<article><a href="http://s"><h3>S</h3></a></article>', None), ("l", "u", "text/html", '<article class="x__article"><a href="/engineering/n"><h3>N</h3></a></article>', None)]
    told = spark.createDataFrame(rows, feeds.BODY + ", failed string").withColumn("latency_ms", F.lit(2.5))
    items, errors, costs = feeds.fetch_sources(told, config(spark, ("f", "daily", {}), ("bad", "daily", {}), ("down", "daily", {}), ("r", "daily", {"kind": "roundup"}), ("l", "daily", {"kind": "listing"}), ("mute", "daily", {})), CTX, "https://h.example")
    assert sorted(r.url for r in items.collect()) == ["http://a", "http://s", "https://h.example/engineering/n"]
    assert sorted(r.name for r in errors.collect()) == ["bad", "down"]
    got = {r.source_name: (r.latency_ms, r.error) for r in costs.collect()}
    assert got["f"] == (2.5, None) and got["down"] == (2.5, "down: timed out") and got["bad"][1].startswith("bad: ") and got["mute"] == (0.0, None) and len(got) == 6
    with pytest.raises(ValueError, match="unknown kinds"):
        feeds.fetch_sources(told, config(spark, ("f", "daily", {"kind": "podcast"})), CTX)


def test_mail_diagnosis(spark):
    senders = spark.createDataFrame([("j@n.example", "N")], "address string, name string")
    mails = spark.createDataFrame([mail(0, "A", "j@n.example", '<a href="https://n.example/p/x">a</a><a href="https://t.example/ok">b</a><a href="https://t.example/down">c</a>')], mailbox.MAIL)
    got = mailbox.diagnose(mails, senders, {"https://t.example/ok": "https://end.example"}.get).orderBy("place").collect()
    assert [(r.tier, r.target) for r in got] == [(1, "https://n.example/p/x"), (3, "https://end.example"), (None, None)]
    assert mailbox.diagnose(mails, senders, subjects=["B"]).count() == 0


def test_bookmarks(spark, tmp_path):
    data = [
        {"id": "1", "date": "2026-01-01T00:00:00Z", "text": "word " * 40, "url": "http://x/1", "user": {"name": "N", "handle": "h"}, "links": [{"shortUrl": "s", "expandedUrl": "http://e"}, {"shortUrl": "t"}], "quote_status": {"text": "q"}},
        {"id": "2", "text": "bad", "user": "a string"}, {"id": "3", "text": "", "url": "http://x/3"}, "no object",
    ]
    (tmp_path / "a.json").write_text(json.dumps({"data": data}))
    items, errors = feeds.read_bookmarks(spark, str(tmp_path / "a.json"))
    got = {r.url: r for r in items.collect()}
    assert (got["http://x/1"].is_thread, got["http://x/1"].thread_contents, got["http://x/1"].expanded_urls, got["http://x/1"].author_handle) == (True, "q", ["http://e"], "h")
    assert got["http://x/3"].title == "(no text)" and not got["http://x/3"].is_thread
    assert sorted(r.place for r in errors.collect()) == [1, 3]
    (tmp_path / "b.json").write_text(json.dumps({"bookmarks": []}))
    with pytest.raises(ValueError, match="no list named data"):
        feeds.read_bookmarks(spark, str(tmp_path / "b.json"))


def test_union_keeps_order(spark):
    a = spark.createDataFrame([("u1", 1), ("u0", 0)], "url string, place long")
    b = spark.createDataFrame([("v0", 0)], "url string, place long")
    assert [r.url for r in feeds.union_items([a, b]).orderBy("pos").collect()] == ["u0", "u1", "v0"]


def mail(i, subject, sender, html="", text=None, unread=True):
    return (f"m{i}", subject, sender, f"2026-07-2{i}T00:00:00+00:00", html, None, text, None, unread)


def test_mail_decisions(spark):
    link = '<a href="https://n.example/p/x">read</a>'
    rows = [
        mail(0, "A post", "Jane <j@n.example>", link + "<p>Body &amp; more</p>"), mail(1, "Hi", "who@else.example", link), mail(2, "Welcome to N", "j@n.example", link), mail(3, "Nothing", "j@n.example", "<p>" + "x" * 2100 + "</p>"),
        mail(4, "Far", "j@n.example", '<a href="https://t.example/ok">x</a>'), mail(5, "Down", "j@n.example", '<a href="https://t.example/down">x</a>'), mail(6, "Seen", "j@n.example", link, unread=False),
    ]
    ends = {"https://t.example/ok": "https://n.example/p/far"}
    senders = spark.createDataFrame([("j@n.example", "N")], "address string, name string")
    d = mailbox.decide(spark.createDataFrame(rows, mailbox.MAIL), senders, ends.get)
    got = {r.message_id: (r.action, r.item, r.tier, r.warn) for r in d.collect()}
    assert got == {"m0": ("read", True, 1, False), "m1": ("read", False, 1, False), "m2": ("read", False, 1, False), "m3": ("read", False, None, True), "m4": ("read", True, 3, False), "m5": ("leave", False, None, False)}
    items = {r.url: r for r in mailbox.items(d).collect()}
    assert set(items) == {"https://n.example/p/x", "https://n.example/p/far"} and items["https://n.example/p/x"].author_name == "N"


def test_board(spark):
    lists = spark.createDataFrame([("l1", "Dump"), ("l2", "Done")], "id string, name string")
    cards = spark.createDataFrame([("c1", "A", "", "l1", "u", [([("x",), ("y",)],), ([("z",)],)], None), ("c2", "B", "", "l2", "u", None, None), ("c3", "C", "", "l1", "u", None, "t")], "id string, name string, desc string, idList string, shortUrl string, checklists array<struct<checkItems:array<struct<name:string>>>>, dateLastActivity string")
    got = {r.card_id: r.checklist_items for r in board_cards(lists, cards).collect()}
    assert got == {"c1": ["x", "y", "z"], "c3": []}


def test_store_writes_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    from siftworks.sources import store

    monkeypatch.setattr(store, "MANY", 4)
    s = TableStore(spark, f"file://{tmp_path}/store")
    want = {f"u{i}": "0" for i in range(300)}
    s.upsert("seen_items", spark.createDataFrame(list(want.items()), "url string, seen_at string"))
    for turn in range(1, 7):
        few = {f"u{turn}": str(turn), f"n{turn}": str(turn)}
        s.upsert("seen_items", spark.createDataFrame(list(few.items()), "url string, seen_at string"))
        want |= few
        s.remove("seen_items", spark.createDataFrame([(f"u{100 + turn}",)], "url string"))
        del want[f"u{100 + turn}"]
        assert {r.url: r.seen_at for r in s.read("seen_items").collect()} == want
        versions = s._versions("seen_items")
        assert len(versions) <= 8 and (turn == 6 or min(map(len, versions.values())) <= 2 or len(versions) <= 4)
    assert max(versions) == 13
    (tmp_path / "store" / "seen_items" / "v99").mkdir()  # a write that broke off does not count
    assert s.read("seen_items").count() == len(want)
    s.replace("seen_items", s.read("seen_items").limit(0))
    assert s.read("seen_items").count() == 0


def test_store(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/store")
    assert s.read("seen_items").count() == 0 and s.read("costs").count() == 0
    s.upsert("seen_items", spark.createDataFrame([("a", "1"), ("b", "1")], "url string, seen_at string"))
    s.upsert("seen_items", spark.createDataFrame([("b", "2"), ("c", "2"), ("c", "3")], "url string, seen_at string"))
    assert sorted(map(tuple, s.read("seen_items").collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    s.remove("seen_items", spark.createDataFrame([("a",)], "url string"))
    assert s.read("seen_items").count() == 2
    for _ in range(2):
        s.append("costs", spark.createDataFrame([("n", 1.5)], "node_name string, cost_usd double"))
    assert s.read("costs").agg(F.sum("cost_usd")).first()[0] == 3.0
    with pytest.raises(ValueError, match="keyed"):
        s.append("seen_items", s.read("seen_items"))
    e = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, t int, v string")
    assert latest(e, ["k"], ["t"]).first().v == "y"
