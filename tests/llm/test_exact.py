"""Exact dedup against brute force, with chains of unlike texts of one hash."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, LONG, ODD, clash

from siftworks.llm import exactdedup

GAPS = [" ", "\t", "\n\n", "\x0b", "\x0c \r", ""]


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        key = (text or "").translate(dict.fromkeys(map(ord, exactdedup.BLANKS)))
        groups.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for key, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), i == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed, n=400):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = ["ab", "cd", "é😀", f"w{r.integers(0, 60)}"]
        rows.append((i, GAPS[r.integers(0, 6)].join(base)))
    rows += [(1000 + i, "hot  text" if i % 2 else "hottext") for i in range(300)]  # a third of all rows
    return rows + [(None, "hot text"), (None, None), (7, ""), (8, " \n"), (9, " "), (9, LONG), (9, LONG + " "), (9, LONG)]


@pytest.mark.parametrize(("bits", "capacity"), [(64, 1 << 16), (64, 4), (3, 1), (0, 1)])
def test_groups_equal_brute_force(spark, bits, capacity):
    rows = corpus(bits + capacity)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exactdedup.with_keeper(docs, capacity=capacity, hash_bits=bits).select("doc_id", "__sw_keep", "__sw_size", "__sw_kept", "__sw_sha").collect()
    assert sorted(map(repr, map(tuple, got))) == expected(rows)


def test_directory_splits_what_is_over_capacity(spark):
    h = [int(x) for x in np.random.default_rng(3).integers(-(1 << 63), 1 << 63 - 1, 500)] + [x << 48 for x in range(40)]  # many of a long common prefix
    rows = spark.createDataFrame([(x,) for x in h], "h long")
    buckets, path, depths = exactdedup.directory(rows, 16)
    want, left, depth = [], [x % (1 << 64) for x in h], 5  # splitting one bit at a time
    while left:
        counts = Counter(x >> (64 - depth) for x in left)
        want += [(depth, p) for p, n in counts.items() if n <= 16]
        left, depth = [x for x in left if counts[x >> (64 - depth)] > 16], depth + 1
    assert sorted(map(tuple, buckets.select("depth", "prefix").collect())) == sorted(want) and depths == list(range(5, depth))
    got = exactdedup.in_buckets(rows, buckets, path, depths).collect()
    sizes = Counter(r.bucket for r in got)
    assert sorted(r.h for r in got) == sorted(h) and max(sizes.values()) <= 16
    starts = sorted(x % (1 << 64) for x in sizes)
    for r in got:  # a bucket is a range of hashes
        assert max(s for s in starts if s <= r.h % (1 << 64)) == r.bucket % (1 << 64)


def test_index_has_the_texts_of_repeated_hashes_in_their_buckets(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (-5, "d"), (-5, "d")], "h long, norm string")
    heads = rows.groupBy("h").agg(F.count("*").alias("times"))
    index = exactdedup.build_index(rows, heads, capacity=1).collect()
    assert sorted((r.h, r.link, r.members, r.norm) for r in index) == [(-5, 0, 2, "d"), (1, 0, 2, "a"), (1, 1, 1, "b")]
    assert len({r.bucket for r in index}) == 2


def test_odd_rows_other_columns_and_empty_tables(spark):
    odd = clash(spark.createDataFrame(ODD, DOC)).withColumns({"bucket": F.lit(1), "norm": F.lit(2), "a.b": F.lit(3), "link": F.lit(4), "times": F.lit(5)})
    got = exactdedup.drop_exact_copies(odd)
    assert got.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted((d is None, d or 0) for d in [3, 4, 4, None, 5, 6])
    assert sorted(map(repr, map(tuple, exactdedup.exact_digest(odd).collect()))) == expected([r[:2] for r in ODD])
    none = spark.createDataFrame([], DOC)
    assert exactdedup.exact_digest(none).collect() == [] and exactdedup.drop_exact_copies(none).columns == none.columns
