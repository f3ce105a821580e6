"""Patterns of personal data from the whole text before a token."""

from siftworks.llm import pii


def spans(spark, texts):
    return [x.spans for x in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_words_before_a_token_may_hold_digits_or_be_far(spark):
    texts = [f"see order {i} ref user{i}@mail.example now" for i in range(9)] + ["see order 17 ref KX-4471-88 now"]
    texts += [f"the file of{' ' * 120}customer{' ' * 100}user{i}@post.example" for i in range(9)] + [f"the file of{' ' * 120}customer{' ' * 100}AB-1234-99"]
    texts += [f"pair 1 {i}x user{i}@host.example" for i in range(9)] + ["pair 1 3x ZZ-8765-43", "one CC-1111-22", "DD-1111-22"]
    got = spans(spark, texts)
    for i, t in ((9, "KX-4471-88"), (19, "AB-1234-99"), (29, "ZZ-8765-43")):
        at = texts[i].index(t)
        assert got[i] == f"context:{at}:{at + 10}"
    assert got[30] == got[31] == ""


def test_token_known_elsewhere_is_found(spark):
    texts = [f"please call me +49301234{i}00 today" for i in range(9)] + ["please call me 49301234500 today"]
    assert spans(spark, texts)[9] == "context:15:26"


def test_what_a_check_rejects_is_not_found(spark):
    """Contexts of cards, ips and phones hold identifiers, and decoys that have a base form and fail its check: only the first are found."""
    card = lambda i: next(t for d in range(10) if not _luhn(t := f"4000{i:011d}{d}") % 10)
    texts = [f"paid with card {card(i)} on file" for i in range(40)]
    texts += [f"paid with card {str(int(card(i)) + 1)} on file" for i in range(40, 46)]
    texts += [f"paid with card TK-{i}77-{i}99 on file" for i in range(6)]
    texts += [f"came from host 10.0.{i}.7 this morning" for i in range(40)]
    texts += [f"came from host 10.0.{i}.777 this morning" for i in range(6)]
    texts += [f"came from host node-{i}00-{i}1 this morning" for i in range(6)]
    got = spans(spark, texts)
    found = [t for t, x in zip(texts, got, strict=True) if "context" in x]
    assert found == [t for t in texts if "TK-" in t or "node-" in t]


def test_rejected_tokens_count_against_their_patterns(spark):
    edges = [("p", f"k{i}", 1.0, 1) for i in range(8)] + [("p", "new", 0.0, 1)] + [("p", f"no{i}", None, 1) for i in range(3)]
    run = lambda rows: {x.token for x in pii.discovered(spark.createDataFrame(rows, "pattern string, token string, seed double, times long")).collect()}
    assert "new" in run(edges[:9])
    assert run(edges) == set()
    assert run(edges[:10]) == {x[1] for x in edges[:9]}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(digits)))
