"""Column functions against plain Python."""

import base64
import json
import urllib.parse as up
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftworks.functions import dates, rules, text, url, vector


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def normal(u):
    if not u:
        return ""
    p = up.urlparse(u.strip().lower())
    kept = {k: v for k, v in up.parse_qs(p.query, keep_blank_values=True).items() if k not in url.TRACKING and not k.startswith("utm_")}
    return up.urlunparse((p.scheme, p.netloc, p.path.rstrip("/"), p.params, up.urlencode(sorted(kept.items()), doseq=True), ""))


def test_normalize_url(spark):
    rows = [
        "https://Example.COM/Path/", " http://a.b/c?utm_source=x&B=2&a=1#frag ", "http://a.b/?q=a+b%20c&q=~*&empty=", "http://a.b/x?ref=1", "", None,
        "http://a.b/x;p=1?z=%C3%A9&y=a%26b", "http://a.b//", "http://a.b?z=1&a=2&z=0", "http://a.b/x?s=1&hs_email=2&keep=3",
    ]
    assert values(spark, rows, url.normalize_url(F.col("x"))) == [normal(r) for r in rows]


def test_normalize_url_keeps_scheme_and_www(spark):
    got = values(spark, ["http://www.a.b/x", "https://www.a.b/x", "https://a.b/x"], url.normalize_url(F.col("x")))
    assert len(set(got)) == 3


def test_article_url_tiers(spark):
    token = base64.urlsafe_b64encode(json.dumps({"e": "https://n.example/p/real-post"}).encode()).decode().rstrip("=")
    raw = '<a href="https://n.example/about"></a><a href="https://n.example/p/slug"></a>'
    coded = f'<a href="https://substack.com/redirect/2/{token}?j=1"></a>'
    broken = '<a href="https://substack.com/redirect/2/%%%"></a><a href="https://x.example/track/1"></a>'
    late = "".join(f'<a href="https://x.example/{i}"></a>' for i in range(15)) + '<a href="https://n.example/p/late"></a>'
    assert values(spark, [raw, coded, broken, late, None], url.article_url(F.col("x"))) == ["https://n.example/p/slug", "https://n.example/p/real-post", None, None, None]


def test_escapes(spark):
    assert values(spark, ['<a href="x">&amp;</a>'], text.escape_html(F.col("x"))) == ['&lt;a href="x"&gt;&amp;amp;&lt;/a&gt;']
    special = "_*[]()~`>#+-=|{}.!"
    assert values(spark, [f"a{special}b\\"], text.escape_markdown(F.col("x"))) == ["a" + "".join("\\" + c for c in special) + "b\\"]


def test_titles_and_cuts(spark):
    long = "word " * 30
    assert values(spark, ["", None, "short", long, "x" * 90], text.make_title(F.col("x"))) == ["(no text)", "(no text)", "short", long[:80].rsplit(" ", 1)[0] + "…", "x" * 80 + "…"]
    assert values(spark, ["abc", "abcd  ef", "é" * 6], text.truncate(F.col("x"), 5)) == ["abc", "abcd…", "é" * 5 + "…"]


def test_html(spark):
    page = "<style>p{x:1}</style><p>One &amp;  two<br>three</p><script>var a='<b>'</script>"
    assert values(spark, [page], text.visible_length(F.col("x"))) == [len("One &amp; two three")]
    assert values(spark, ["<b>A &lt;B&gt; &eacute;</b> ", None], text.clean_inline(F.col("x"))) == ["A <B> é", ""]


def test_xml_repair(spark):
    assert values(spark, ["a & b &amp; &#12; &nbsp; &x"], text.repair_ampersands(F.col("x"))) == ["a &amp; b &amp; &#12; &amp;nbsp; &amp;x"]
    assert values(spark, ["a\x00b\x0bc\td\n"], text.strip_illegal_xml(F.col("x"))) == ["abc\td\n"]


def test_challenge(spark):
    df = spark.createDataFrame([("text/html", "<p>Just a moment...</p>"), ("application/rss+xml", "sgcaptcha"), (None, "x" * 2000 + "sgcaptcha"), (None, "SGCAPTCHA")], "k string, b string")
    assert [r[0] for r in df.select(text.is_challenge(F.col("k"), F.col("b"))).collect()] == [True, False, False, True]


def test_video(spark):
    rows = ['see <a href="https://www.youtube.com/watch?v=1">', "youtu.be/zz only", "http://a.b and https://youtu.be/q) x", "nothing"]
    got = values(spark, rows, text.video_url(F.col("x")))
    assert [(g.has_video, g.video_url) for g in got] == [(True, "https://www.youtube.com/watch?v=1"), (True, None), (True, "https://youtu.be/q"), (False, None)]


def test_fenced_json(spark):
    rows = ['```json\n{"k": 1}\n```', '{"k": 2}', "no json"]
    assert values(spark, rows, text.fenced_json(F.col("x"), "k int")["k"]) == [1, 2, None]


def test_dates(spark):
    now = datetime(2026, 7, 1, tzinfo=timezone.utc)
    rows = ["Tue, 21 Jul 2026 06:00:00 +0200", "21 Jul 2026 06:00:00 GMT", "rubbish", ""]
    got = values(spark, rows, dates.rfc2822(F.col("x"), F.lit(now)).cast("string"))
    assert got == ["2026-07-21 04:00:00", "2026-07-21 06:00:00", "2026-07-01 00:00:00", "2026-07-01 00:00:00"]
    assert values(spark, ["2027-01-01", "2026-12-28", "2024-01-01"], dates.iso_week(F.col("x").cast("timestamp"))) == ["2026-W53", "2026-W53", "2024-W01"]
    assert values(spark, ["Mar 4, 2026", "x"], dates.listing_date(F.col("x")).cast("string")) == ["2026-03-04 00:00:00", None]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [0.6, 0.8], 0.6), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_rules(spark):
    v = values(spark, [["evals", "odd", "course", "odd"]], rules.valid_tags(F.col("x")), "x array<string>")[0]
    assert (v.kept, v.rejected) == (["evals", "course"], ["odd"])
    rows = [("plan_item", "new", "r"), ("project_proposal", "zzz", None), ("junk", "new", None), (None, None, None), ("project_proposal", "extend", "r")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [tuple(r[0]) for r in df.select(rules.valid_classification(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [("plan_item", None, "r"), ("project_proposal", "new", ""), ("plan_item", None, "fallback: invalid classification"), ("plan_item", None, "fallback: invalid classification"), ("project_proposal", "extend", "r")]
    assert values(spark, [" YES ", "don't", "maybe", "do it"], rules.decision(F.col("x"))) == ["approve", "reject", None, "approve"]
    assert values(spark, ["Jane <Jane.Doe+x@Pub.example>", "none", None], rules.sender_address(F.col("x"))) == ["jane.doe+x@pub.example", "", ""]
    assert values(spark, ["Welcome to x", "welcomed", "Thanks for subscribing!", "Re: welcome"], rules.is_welcome(F.col("x"))) == [True, False, True, False]
    df = spark.createDataFrame([("A", "how [company] did"), ("Case STUDY", ""), ("x", "how company")], "a string, b string")
    assert [r[0] for r in df.select(rules.is_case_study(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    df = spark.createDataFrame([("up", "mild"), ("down", "strong"), ("neutral", "mild"), ("up", "huge"), (None, "mild")], "a string, b string")
    assert [r[0] for r in df.select(rules.nudge_delta(F.col("a"), F.col("b"))).collect()] == [0.05, -0.2, 0.0, None, None]
