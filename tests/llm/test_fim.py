"""Fill-in-middle against brute force and an exact round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_llm import DOC, LONG, ODD, clash

from siftworks.llm import fim

TEXTS = [None, "", " ", "a", "abc", "ab cd-ef\n12", "é😀日本 x", "a<P>b", "<", "<<<", "tail <", "S>M>P>", LONG, "one two three four five six seven" * 20]


def expected(doc_id, text, plain=10, suffix_first=20):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < suffix_first
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_outputs_equal_brute_force_and_are_restored(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(None, "no id at all"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [expected(*r) for r in rows]
    got = fim.fim_digest(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*w[:5], sha(w[5]), sha(t or ""))) for w, (_, t) in zip(want, rows))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    whole = fim.fill_in_middle(docs).select("doc_id", "text", "fim", fim.restored(F.col("fim")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in whole)
    assert sorted(r.fim.output for r in whole) == sorted(w[5] for w in want)


def test_shares_and_sentinels_are_parameters(spark):
    docs = spark.createDataFrame([(i, f"text number {i} <P> <S>") for i in range(100)], "doc_id long, text string")
    marks = ("[pre]", "{suf}", "|mid")
    got = fim.fill_in_middle(docs, sentinels=marks, plain=0, suffix_first=100).select("text", "fim.*", fim.restored(F.col("fim"), marks).alias("back")).collect()
    assert {r.form for r in got} == {"spm"} and all(r.back == r.text and r.output.startswith("{suf}") for r in got)
    assert {r.fim.form for r in fim.fill_in_middle(docs, plain=100).collect()} == {"plain"}
    one, two = ([r.fim.output for r in fim.fill_in_middle(docs, sentinels=marks, plain=0, seed=s).collect()] for s in (1, 2))
    assert one != two
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>>", "M"), ("", "a", "b"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)


def test_odd_rows_other_columns_and_empty_tables(spark):
    odd = clash(spark.createDataFrame(ODD, DOC)).withColumns({"FIM": F.lit(1), "a.b": F.lit(2), "output": F.lit(3), "form": F.lit(4)})
    got = fim.fill_in_middle(odd)
    assert got.columns == [c for c in odd.columns if c != "FIM"] + ["fim"] and got.count() == len(ODD)
    assert sorted(map(repr, (tuple(r)[:-1] for r in got.collect()))) == sorted(repr(tuple(r)) for r in odd.drop("FIM").collect())
    assert fim.fim_digest(odd).count() == len(ODD)
    none = spark.createDataFrame([], DOC)
    assert fim.fim_digest(none).collect() == [] and fim.fill_in_middle(none).columns == [*none.columns, "fim"]
    by_text = fim.fill_in_middle(spark.createDataFrame([("k", 12345)], "`the id` string, `the.text` int"), "the id", "the.text").first()
    assert by_text.fim.n == 5
