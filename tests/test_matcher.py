"""Names of cards in titles, with more cards than are broadcast."""

from siftworks.models.offline import NameMatcher

ITEMS = [("a", 2, "New card name 10499 is out"), ("a", 1, "x"), ("b", 3, "a zq b"), ("c", 4, None), (None, 5, "ÉTUDE n\u00ba"), ("d", 6, ""), ("e", 7, "recard name 00007")]


def test_all_cards_are_matched(spark):
    items = spark.createDataFrame(ITEMS, "url string, pos int, title string")
    cards = [(f"{i:06}", f"Card Name {i:05}") for i in range(10_500)] + [("900001", "ZQ"), ("900002", "étude"), ("900003", ""), ("900004", None), ("900005", "zq")]
    want = {"a": ("010499", 1), "b": ("900001", 3), "c": (None, 4), None: ("900002", 5), "d": (None, 6), "e": ("000007", 7)}
    for matcher in (NameMatcher(), NameMatcher(most_broadcast=20_000)):
        got = matcher.match(items, spark.createDataFrame(cards, "card_id string, name string"))
        assert {x.item_id: (x.matched_card_id, x.pos) for x in got.collect()} == want
