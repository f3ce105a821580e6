"""Near-dedup by exact similarity against brute force."""

import numpy as np

import corpus_pipeline
from siftworks.llm import similar

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return a == b or (len(a & b) >= 0.8 * len(a | b) if a or b else True)


def corpus(seed):
    """Texts with copies of one to fifteen changed words, and a dense group."""
    r = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    out = []
    for n in (4, 6, 30, 120, 300, 900):
        for _ in range(6):
            base = [words[i] for i in r.integers(0, 400, n)]
            out.append(" ".join(base).upper())
            for c in (1, 2, 5, 9, 15):
                w = list(base)
                for i in r.choice(n, min(c, n), replace=False):
                    w[i] = words[int(r.integers(0, 400))]
                out.append("  ".join(w))
    base = [words[i] for i in r.integers(0, 400, 200)]
    for _ in range(60):
        w = list(base)
        for i in r.choice(200, 4, replace=False):
            w[i] = words[int(r.integers(0, 400))]
        out.append(" ".join(w))
    return out


def test_near_dedup_stage_equals_brute_force(spark, tmp_path):
    texts = corpus(1)
    sets = [shingled(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOC)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.select("doc_id").collect()) == sorted(set(root))


def test_near_dedup_stage_of_odd_rows(spark, tmp_path):
    none = spark.createDataFrame([], DOC)
    assert corpus_pipeline.near_dedup(spark, none, str(tmp_path)).count() == 0
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, " \t", None, None, None), (3, "A b", "en", "a", 0), (4, "a  B", "en", "a", 0)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOC).withColumn("node", similar.F.lit(1)), str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == [1, 3]


def test_near_dedup_stage_tells_rows_apart_by_text(spark, tmp_path):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcd")
    rows = [(None, a, "en", "s", 0), (None, b, "en", "s", 0), (7, c, "en", "s", 0), (7, d, "en", "s", 0), (7, d, "en", "s", 0), (None, d + " d40", "en", "s", 0)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOC), str(tmp_path)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, a), (0, b), (7, c), (7, d)]


def test_both_estimates_keep_pairs_that_link(spark):
    texts = corpus(2)
    sets = [similar.shingles(t) for t in texts]
    signed = lambda s: [int(x) for x in similar.sketch(s).view("<i8")]
    rows = [(i, [int(x) for x in s.view("<i8")], signed(s), signed(np.sort(s * similar.OTHER))) for i, s in enumerate(sets)]
    of = spark.createDataFrame(rows, "node int, hs array<long>, sk array<long>, sl array<long>")
    pairs = of.join(of.selectExpr("node n2", "hs hs2", "sk sk2", "sl sl2"), similar.F.expr("node < n2"))
    one, two = similar.estimated("sk", "sk2", similar.LEAST - similar.BELOW), similar.estimated("concat(sk, sl)", "concat(sk2, sl2)", similar.LEAST - similar.BELOW_BOTH)
    got = pairs.select("node", "n2", one.alias("one"), two.alias("two"), similar.F.expr("size(array_intersect(hs, hs2)) / size(array_union(hs, hs2))").alias("s")).collect()
    linked = [x for x in got if x.s >= 0.8 and min(len(sets[x.node]), len(sets[x.n2])) > similar.FEW]
    assert len(linked) > 100 and all(x.one and x.two for x in linked)
    apart = [x for x in got if x.s < 0.6]
    assert sum(x.one and x.two for x in apart) < 0.001 * len(apart)


def test_near_dedup_goes_through_fingerprints(spark, tmp_path, monkeypatch):
    """Where no MinHash key is shared, what op1's method links is still found, and held against the exact similarity."""
    texts = corpus(3)
    fps = [int(x) for x in similar.fingerprints(texts)]
    sets = [shingled(t) for t in texts]
    met = {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 4 and alike(sets[i], sets[j]) and texts[i].lower().split() != texts[j].lower().split()}
    assert met
    plain = similar.sketches
    monkeypatch.setattr(similar, "sketches", lambda t, k: plain(t, k).withColumn("keys", similar.F.expr("CAST(array() AS array<bigint>)")))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOC), str(tmp_path)).select("doc_id").collect()}
    gone = set(range(len(texts))) - got
    assert {j for _, j in met} & gone
    assert all(any(alike(sets[i], sets[j]) for i in range(j)) for j in gone)


def test_near_dedup_leaves_only_what_its_result_reads(spark, tmp_path):
    since = len(similar.PATHS)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(corpus(4))]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOC), str(tmp_path))
    assert len(similar.PATHS) - since == 2 and 0 < got.count() < len(rows)
