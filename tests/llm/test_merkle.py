"""Merkle manifests against a plain construction of the tree."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, LONG, ODD, clash

from siftworks.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, at, arity):
    """The siblings by level of one node, and the root."""
    steps = []
    while len(nodes) > 1:
        run = at - at % arity
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
        nodes, at = [H(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], at // arity
    return steps, nodes[0]


def expected(rows, arity=3):
    """rows: doc_id, text, lang, source, n_chars."""
    trees = {}
    for d, text, lang, source, n in rows:
        fields = (d, source, lang, n, text)
        odd = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        told = leaf((*fields[:4], None if text is None else text.replace("\n", ""))) if odd else leaf(fields)
        trees.setdefault(source, []).append((d is not None, d or 0, leaf(fields), told, d))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort()
    roots = [climb([x[2] for x in trees[s]], 0, arity)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        up, root = climb(roots, k, arity)
        for i, (_, _, lf, told, d) in enumerate(trees[s]):
            steps = climb([x[2] for x in trees[s]], i, arity)[0] + up
            h = told
            for a, b in steps:
                h = H(a, h, b)
            out.append((d, lf, roots[k], root, H(*[a + b for a, b in steps]), h, h == root))
    return sorted(map(repr, out))


def corpus(seed, n=500):
    r = np.random.default_rng(seed)
    sources = ["hot"] * 8 + ["a", "é", "Z", None, "", "b"] + [f"s{i}" for i in range(40)]
    rows = [(int(d), f"text {d}" + "\n" * int(r.integers(0, 3)), "en", sources[r.integers(0, len(sources))], int(r.integers(0, 9))) for d in r.permutation(n)]
    return rows + [(3, "other text of an id", "de", "hot", None), (3, "other text of an id", "de", "hot", None), (None, LONG + "\n", None, None, None), (None, None, None, "hot", None)]


@pytest.mark.parametrize("part_rows", [7, 1 << 16])
def test_digest_equals_the_plain_tree(spark, monkeypatch, part_rows):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    rows = corpus(part_rows)
    got = merkle.manifest_digest(spark.createDataFrame(rows, DOC))
    assert sorted(map(repr, map(tuple, got.collect()))) == expected(rows)


def test_manifest_of_other_arity_tells_what_was_tampered_with(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 20)
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(100)]
    docs = spark.createDataFrame(rows, DOC)
    got = merkle.manifest(docs, arity=2)
    assert {r.root for r in got.collect()} == {climb([climb([leaf((d, s, lang, n, t)) for d, t, lang, s, n in rows if s == f"s{k}"], 0, 2)[1] for k in range(3)], 0, 2)[1]}
    assert all(r.height == (6 if r.tree == "s0" else 6) and len(r.proof) == r.height + 2 for r in got.collect())
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 41, "T41").otherwise(F.col("text"))).select("doc_id", merkle.leaf(merkle.FIELDS).alias("now"))
    bad = got.join(changed, got.id == changed.doc_id).where(merkle.folded(F.col("now"), F.col("proof")) != F.col("root")).collect()
    assert [r.id for r in bad] == [41]


def test_forests_merge_in_any_order(spark):
    r = np.random.default_rng(1)
    totals = {0: 1, 1: 40, 2: 3, 3: 9}
    leaves = [(k, n, 0, i, H(f"{k}/{i}")) for k, n in totals.items() for i in range(n)]

    def built(parts):
        forests = []
        for p in parts:
            f = merkle.Forest(len(totals), 3)
            for x in p:
                f.add(*x)
            forests.append(f)
        while len(forests) > 1:  # in any grouping
            i, j = sorted(r.choice(len(forests), 2, replace=False))
            forests[i] = forests[i].merge(forests.pop(j))
        return forests[0].open

    whole = built([leaves])
    assert len(whole) == 1 and next(iter(whole)) == (merkle.TOP, 2, 0)
    for _ in range(20):
        order = [leaves[i] for i in r.permutation(len(leaves))]
        cuts = sorted(r.integers(0, len(order), 6))
        assert built([order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])]) == whole


def test_odd_rows_other_columns_and_empty_tables(spark):
    odd = clash(spark.createDataFrame(ODD, DOC)).withColumns({"tree": F.lit(1), "part": F.lit(2), "leaf": F.lit(3), "a.b": F.lit(4), "told": F.lit(5)})
    assert sorted(map(repr, map(tuple, merkle.manifest_digest(odd).collect()))) == expected(ODD)
    none = spark.createDataFrame([], DOC)
    assert merkle.manifest_digest(none).collect() == [] and merkle.manifest(none).collect() == []
    assert sorted(map(repr, map(tuple, merkle.manifest_digest(spark.createDataFrame(ODD[:1], DOC)).collect()))) == expected(ODD[:1])
    with pytest.raises(ValueError):
        merkle.manifest(none, arity=1)
