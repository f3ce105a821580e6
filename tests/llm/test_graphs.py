"""Contextual patterns, secret verdicts and their joins against brute force; planted contexts; dominant keys; clashing columns."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siftworks.llm import components, pii, secrets, simhash
from siftworks.llm.common import split_join


def brute_discovered(edges):
    by_pattern, by_token = defaultdict(dict), defaultdict(dict)
    for p, t, seed, _ in edges:
        by_pattern[p][t] = by_token[t][p] = seed
    seeds = {t: max(x.values()) for t, x in by_token.items()}
    score = dict(seeds)
    for _ in range(pii.ROUNDS):
        trust = {}
        for p, x in by_pattern.items():
            held = sum(score[t] for t in x)
            if held >= pii.LEAST_KNOWN and sum(x.values()) >= 1:
                trust[p] = held / len(x)
        score = {t: max([seeds[t], *(trust[p] for p in x if p in trust)]) for t, x in by_token.items()}
    strong = {p for p, x in by_pattern.items() if (held := sum(score[t] for t in x)) >= pii.LEAST_KNOWN and held / len(x) >= pii.LEAST_SCORE}
    return {(p, t, n) for p, t, _, n in edges if p in strong}


def test_rounds_of_the_graph_equal_brute_force(spark):
    r = random.Random(4)
    pairs = {(f"p{r.randrange(25)}", f"t{r.randrange(400)}") for _ in range(500)} | {("p0", f"t{i}") for i in range(120)}
    edges = [(p, t, float(p in ("p3", "p4", "p5") or r.random() < 0.05), r.randrange(1, 4)) for p, t in sorted(pairs)]
    got = {(x.pattern, x.token, x.times) for x in pii.discovered(spark.createDataFrame(edges, "pattern string, token string, seed double, times long")).collect()}
    want = brute_discovered(edges)
    assert got == want and 0 < len(want) < len(edges)


def test_planted_contexts_recall_and_precision(spark):
    r = random.Random(9)
    prose = [f"{a}{b}{c}" for a in "bdfglmnr" for b in ("a", "ei", "o", "u", "ie") for c in ("ll", "n", "st", "rk", "m", "tte", "s")]
    words = lambda n: " ".join(r.choice(prose) for _ in range(n))
    rows, planted = [], set()
    lead = ["your member number is", "mail the claimant at", "charge my card", "reach support under"]
    for i in range(240):
        kind = i % 4
        known = [f"user{i}@mail.example", f"10.{i % 250}.3.9", "4111111111111111" if i < 4 else f"user{i}@pay.example", f"+49301{r.randrange(10**6, 10**7)}"][kind]
        rows.append((i, f"{words(9)} {lead[kind]} {known} {words(r.randrange(3, 9))}", False))
    for i in range(240, 280):  # identifiers that no base pattern has, in the same contexts
        rows.append((i, f"{words(9)} {lead[i % 4]} KX-{r.randrange(1000, 9999)}-{i} {words(r.randrange(3, 9))}", True))
    for i in range(280, 520):  # numbers elsewhere
        rows.append((i, f"{words(9)} in {r.randrange(10**5, 10**6)} {words(6)} {r.randrange(10**6, 10**7)} {words(4)}", False))
    planted = {i for i, _, p in rows if p}
    got = {x.doc_id: x.n_found for x in pii.pii_digest(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    found = {i for i, n in got.items() if n}
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found - planted) <= 0.05 * len(found)


def test_long_text_of_many_matches(spark):
    text = " ".join(f"word{chr(97 + i % 26)} user{i}@mail.example and 10.1.{i % 200}.7" for i in range(6000))
    got = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_email, got.n_ip, got.n_found) == (6000, 6000, 0)


def test_secret_verdicts_equal_brute_force(spark):
    r = random.Random(2)
    each = [(f"h{int(r.paretovariate(0.5)) % 40}", f"o{r.randrange(5)}", f"r{r.randrange(40)}") for _ in range(900)] + [("common", f"o{i % 9}", f"r{i}") for i in range(2000)]
    each += [(f"solo{i}", "o1", f"r{j}") for i in range(6) for j in range(1 + 7 * i)]
    each = [(h, o, p, sum(map(ord, h)) % 2 == 0) for h, o, p in each]
    got = {tuple(x) for x in secrets.verdicts(spark.createDataFrame(each, "h string, owner string, repo string, random boolean")).collect()}
    want = set()
    for h in {x[0] for x in each}:
        mine = [x for x in each if x[0] == h]
        repos, owners = len({x[1:3] for x in mine}), len({x[1] for x in mine})
        verdict = "copied" if owners >= secrets.COPIED_OWNERS or repos >= secrets.COPIED_REPOS else "live" if owners == 1 and mine[0][3] else "unsure"
        want.add((h, repos, owners, verdict, len(mine)))
    assert got == want and {x[3] for x in want} == {"copied", "live", "unsure"}


def test_key_like_tokens_are_found_and_copied_ones_not(spark):
    r = random.Random(3)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    key = lambda: "".join(r.choice(letters) for _ in range(32))
    shared = key()
    rows = [(i, f"s{i % 7}", f"connect with {key()} today") for i in range(60)] + [(100 + i, f"s{i % 7}", f"example {shared} here") for i in range(30)] + [(200 + i, "s1", "internationalisation-of-lowercase-words and 12345678901234567890123") for i in range(30)]
    got = {x.doc_id: x for x in secrets.secret_digest(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    live = {i for i, x in got.items() if x.n_live}
    assert len(live & set(range(60))) >= 54 and live <= set(range(60))
    assert all(got[100 + i].n_copied == 1 and got[100 + i].spans == "" for i in range(30))
    assert all(got[i].spans.startswith("key:13:") for i in live)


def test_split_join_gives_what_a_join_gives(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("k <> 3")
    got = Counter(map(tuple, split_join(left, right, ["k"], "n").collect()))
    assert got == Counter(map(tuple, left.join(right.drop("n"), ["k"]).collect())) and len(got) == 2980
    assert split_join(left, right.limit(0), ["k"], "n").count() == 0


def test_clashing_columns(spark):
    names = [*pii.BASE, *secrets.BASE, "r", "c", "t", "x", "s", "e", "key", "found", "seen", "live", "owner", "repo", "h", "random", "pattern", "token", "known", "times"]
    docs = spark.createDataFrame([(1, "mail a@b.example or password=hunter2hunter2", "o"), (2, None, None)], "doc_id long, text string, source string").withColumns({n: F.lit(7) for n in names})
    left = pii.redact(docs)
    assert left.columns == docs.columns
    first = left.orderBy("doc_id").first()
    assert first.text == "mail [email] or password=hunter2hunter2" and all(first[n] == 7 for n in names)
    got = pii.find_pii(docs, docs.columns).orderBy("doc_id").first()
    assert [x.m for x in got.email] == ["a@b.example"] and got.r == got.t == got.token == 7
    got = secrets.find_secrets(docs, docs.columns).orderBy("doc_id").first()
    assert len(got.assign) == 1 and got.seen[0].verdict == "unsure" and got.c == got.owner == got.h == 7
    assert docs.count() == pii.find_pii(docs, ["doc_id"]).count() == secrets.find_secrets(docs, ["doc_id"]).count()


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    """Spark takes a join's sides to be as small as the files of fingerprints that their keys are made of."""
    plans = []

    def kept(df, kind, of=components.written):
        plans.append((kind, df._jdf.queryExecution().executedPlan().toString()))
        return of(df, kind)

    monkeypatch.setattr(components, "written", kept)
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(150)]
    fps = spark.createDataFrame([(x,) for b in base for x in (b, b ^ 1, b ^ (1 << r.randrange(63)) ^ (1 << r.randrange(62)))], "fp long").distinct()
    fps, _ = simhash.written(fps, "fps")
    assert simhash.links(fps).count() > 100
    made = [p for kind, p in plans if "Generate" in p]
    assert len(made) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in made)
