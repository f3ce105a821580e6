"""Scripts over whole texts, and bands for every row."""

import numpy as np

from siftworks.llm import fertility


def test_script_counts_all_words():
    assert fertility.script("header in latin " * 30 + "слово " * 200) == "cyrillic"
    assert fertility.script("слово " * 70 + "word " * 69) == "cyrillic"
    assert fertility.script("1 2 !") == "none"


def test_rows_of_rare_groups_are_judged(spark):
    r = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    say = lambda n: " ".join(words[i] for i in r.integers(0, 200, n))
    junk = lambda n: " ".join("q" + chr(0x13000 + i) + chr(0x13100 + i) for i in r.integers(0, 200, n))
    rows = [(i, say(int(r.integers(60, 300))), "xx") for i in range(300)]
    # one class beyond the rest, two beyond, far beyond; a rare language; no language
    rows += [(1000, say(700), "xx"), (1001, say(1500), "xx"), (1002, say(9000), "xx"), (1003, say(9000), "yy"), (1004, say(100), None), (1005, say(9000), None)]
    rows += [(2000, junk(900), "xx"), (2001, junk(9000), "xx"), (2002, junk(9000), "yy"), (2003, junk(9000), None)]
    got = {x.doc_id: x.kept for x in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i in got if i < 2000 and not got[i]] == []
    assert [i for i in got if i >= 2000 and got[i]] == []
    few = {x.doc_id: x.kept for x in fertility.judge(spark.createDataFrame([(i, say(30 + 400 * i), "xx") for i in range(5)], "doc_id long, text string, lang string")).collect()}
    assert all(few.values())
