"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

What the base patterns match seeds the search. Each token with a digit or @ has up to four lexical patterns: the two
words before it; the word before it and the one after; the word before it and the token's shape; and the two words
after it. A word with a digit or @ is a placeholder in them. Patterns and tokens form a graph. A pattern's score is the share of
its distinct tokens that are known, a token's that of its best pattern; a few rounds of both let patterns with high
scores find identifiers that no base pattern has. A token that has the form of a card, ip or phone and fails its check
is no identifier: it counts against its patterns and is never known nor found. All is DataFrame operations; texts are
read once and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, split_join, written
from .spans import NONE, before, listed, matches, places

#: The base kinds. Possessive forms of the stated patterns, which match the same and never try a run twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "t": "[0-9@]"}
TOKEN = r"(?<!\S)(?=\S*?[0-9@])\S++"
#: Stands in a pattern for a word with a digit or @.
HELD = "#"
#: Rounds of scores; known tokens that a pattern needs, and their share of its distinct tokens.
ROUNDS, LEAST_KNOWN, LEAST_SCORE = 3, 3, 0.8


def _holds(kind: str, m: str) -> str:
    """SQL: whether a match of a base kind stands."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({m}, '[.]'), d -> length(ltrim('0', d)) <= 3 AND coalesce(cast(nullif(ltrim('0', d), '') as int), 0) <= 255)".replace("cast(nullif(ltrim('0', d), '') as int)", "try_cast(nullif(ltrim('0', d), '') as int)")
    if kind == "card":
        luhn = f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN cast(c as int) WHEN c < '5' THEN 2 * cast(c as int) ELSE 2 * cast(c as int) - 9 END), 0, (a, v) -> a + v) % 10 = 0"
        return f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    return "true"


def _rejected(kind: str, m: str) -> str:
    """SQL: whether a match of a base kind has the kind's form and fails its check. A run of digits has the form of a card only with a card's number of them."""
    card = f"length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 13 AND 19 AND " if kind == "card" else ""
    return f"{card}NOT coalesce({_holds(kind, m)}, false)"


def _clean(word: str) -> str:
    """SQL: a word in lower case, without what is no letter or digit at its ends."""
    return f"regexp_replace(lower({word}), r'^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '')"


def _patterns(i: str, token: str) -> str:
    """SQL: the patterns of the token of place i, from __sw_gaps, the first and last two words of what stands before each token and after the last."""
    none = "cast(array() as array<string>)"
    left = f"concat(CASE WHEN {i} > 1 THEN array('{HELD}') ELSE {none} END, CASE WHEN {i} > 0 THEN concat(__sw_gaps[{i} - 1].z, array('{HELD}')) ELSE {none} END, __sw_gaps[{i}].z)"
    right = f"concat(__sw_gaps[{i} + 1].a, CASE WHEN {i} + 2 < size(__sw_gaps) THEN concat(array('{HELD}'), __sw_gaps[{i} + 2].a) ELSE {none} END, CASE WHEN {i} + 3 < size(__sw_gaps) THEN array('{HELD}') ELSE {none} END)"
    shape = f"regexp_replace(regexp_replace(regexp_replace({token}, r'\\p{{Lu}}+', 'A'), r'\\p{{Ll}}+', 'a'), '[0-9]', '0')"
    kinds = (
        "CASE WHEN size(c.l) > 1 THEN concat('two before: ', c.l[size(c.l) - 2], ' ', c.l[size(c.l) - 1]) END",
        "CASE WHEN size(c.l) > 0 AND size(c.r) > 0 THEN concat('both sides: ', c.l[size(c.l) - 1], ' ', c.r[0]) END",
        f"CASE WHEN size(c.l) > 0 THEN concat('shape after: ', c.l[size(c.l) - 1], ' ', {shape}) END",
        "CASE WHEN size(c.r) > 1 THEN concat('two after: ', c.r[0], ' ', c.r[1]) END",
    )
    # a pattern has a word or a placeholder at least: words of signs, which are empty, say nothing
    return f"transform(array(struct({left} AS l, {right} AS r)), c -> filter(array({', '.join(kinds)}), q -> rlike(substring_index(q, ': ', -1), r'^[\\p{{L}}#]| [\\p{{L}}#]')))[0]"


def _rows(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """carry, a column of places for each base kind, and __sw_t: the tokens with a digit or @ outside them and those that begin one, with their patterns."""
    out = docs.select(*[F.col(f"`{c}`") for c in carry], once(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("__sw_text"))
    nothing = F.expr("named_struct('found', cast(array() as array<struct<m:string,p:string>>), 'rest', '')")
    found = {k: once(F.when(F.rlike("__sw_text", F.lit(NEEDS[k])), matches("__sw_text", p)).otherwise(nothing)) for k, p in (BASE | {"t": TOKEN}).items()}
    out = out.withColumns({f"__sw_r_{k}": c for k, c in found.items()}).drop("__sw_text")
    out = out.withColumns({f"__sw_f_{k}": once(places(f"__sw_r_{k}.found")) for k in found})
    out = out.withColumns({f"__sw_{k}": once(F.expr(f"filter(__sw_f_{k}, x -> {_holds(k, 'x.m')})")) for k in BASE})
    ends = f"transform(array(filter(split(p, r'[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')), a -> struct(transform(slice(a, 1, 2), w -> {_clean('w')}) AS a, transform(slice(a, greatest(size(a) - 1, 1), 2), w -> {_clean('w')}) AS z))[0]"
    out = out.withColumn("__sw_gaps", once(F.expr(f"transform(concat(__sw_r_t.found.p, array(__sw_r_t.rest)), p -> {ends})")))
    spans = F.array_sort(F.concat(*[F.expr(f"transform(__sw_{k}, x -> struct(x.s as s, x.e as e))") for k in BASE]))
    out = out.withColumn("__sw_spans", once(spans))
    out = out.withColumn("__sw_bad", once(F.array_sort(F.concat(*[F.expr(f"transform(filter(__sw_f_{k}, x -> {_rejected(k, 'x.m')}), x -> struct(x.s as s, x.e as e))") for k in ("card", "ip", "phone")]))))
    out = out.withColumns({
        "__sw_begun": once(F.expr(before("__sw_f_t.s", "__sw_spans.s", False))),
        "__sw_met": once(F.expr(before("__sw_f_t.e", "__sw_spans.s", False))),
        "__sw_past": once(F.expr(before("__sw_f_t.s", "array_sort(__sw_spans.e)", True))),
        "__sw_bad_met": once(F.expr(before("__sw_f_t.e", "__sw_bad.s", False))),
        "__sw_bad_past": once(F.expr(before("__sw_f_t.s", "array_sort(__sw_bad.e)", True))),
    })
    each = f"transform(__sw_f_t, (y, i) -> struct(y.s AS s, y.e AS e, {_clean('y.m')} AS token, {_patterns('i', 'y.m')} AS patterns, __sw_met[i] > __sw_begun[i] AS known, __sw_met[i] > __sw_past[i] AS taken, __sw_bad_met[i] > __sw_bad_past[i] AND __sw_met[i] <= __sw_begun[i] AS bad))"
    tokens = F.expr(f"filter({each}, x -> size(x.patterns) > 0 AND (x.known OR NOT x.taken AND length(x.token) >= 5 AND rlike(x.token, '[0-9].*[0-9].*[0-9]')))")
    return out.select(*[F.col(f"`{c}`") for c in carry], *[f"__sw_{k}" for k in BASE], tokens.alias("__sw_t"))


def discovered(edges: DataFrame) -> DataFrame:
    """(pattern, token, times) of what patterns of high score find, tokens that are base matches elsewhere included.

    edges has pattern, token, seed (1 if the token is a base match in that pattern, null if a base kind's check rejects
    it, else 0) and times, one row for each pair; it should be a written table. Every join is of edges with a table of one row a key, so that no two edges of
    a pattern or token meet, and keys with many edges are split from the others.
    """
    tokens, _ = written(edges.groupBy("token").agg(F.max("seed").alias("score"), F.count("*").alias("of")), "tokens")
    known, held = tokens, None
    for turn in range(ROUNDS + 1):
        by_pattern = split_join(edges, known, ["token"], "of").groupBy("pattern").agg(F.sum("score").alias("held"), F.count("*").alias("of"), F.sum("seed").alias("seeds"))
        held, _ = written(by_pattern.where(f"held >= {LEAST_KNOWN}"), "patterns")
        if turn < ROUNDS:
            good = held.where("seeds >= 1").select("pattern", (F.col("held") / F.col("of")).alias("score"), "of")
            told = split_join(edges, good, ["pattern"], "of").where("seed IS NOT NULL").select("token", "score", F.lit(0).cast("long").alias("of"))
            known, _ = written(tokens.unionByName(told).groupBy("token").agg(F.max("score").alias("score"), F.max("of").alias("of")), "tokens")
    strong = held.where(f"held / of >= {LEAST_SCORE}").select("pattern", "of")
    return split_join(edges, strong, ["pattern"], "of").where("seed IS NOT NULL").select("pattern", "token", "times")


def find_pii(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry, and for each row the places s, e and texts m of each base kind and of found, the identifiers that context gave.

    Places are in code points, ends exclusive. Null and empty texts have none, rows that repeat are searched each, and
    an empty table gives an empty one. Base places never depend on what else is found. A carried column of the name of
    a kind, or found, is replaced; others may have any names.
    """
    held = [c for c in carry if c not in (*BASE, "found")]
    named = docs.select(*[F.col(f"`{c}`").alias(f"__sw_c{i}") for i, c in enumerate(held)], F.col(f"`{text_col}`").alias("__sw_in"))
    rows, _ = written(_rows(named, named.columns[:-1], "__sw_in").withColumn("__sw_row", F.monotonically_increasing_id()), "pii")
    each = rows.select("__sw_row", F.explode("__sw_t").alias("x")).select("__sw_row", "x.s", "x.e", "x.token", "x.known", "x.bad", F.explode("x.patterns").alias("pattern"))
    edges, _ = written(each.groupBy("pattern", "token").agg(F.max(F.when(~F.col("bad"), F.col("known").cast("double"))).alias("seed"), F.count("*").alias("times")), "edges")
    found, _ = written(discovered(edges), "found")
    hits = split_join(each, found, ["pattern", "token"], "times").where("NOT known AND NOT bad")
    by_row = hits.groupBy("__sw_row").agg(F.array_sort(F.collect_set(F.struct("s", "e", F.col("token").alias("m")))).alias("found"))
    out = rows.join(by_row, "__sw_row", "left")
    return out.select(*[F.col(f"__sw_c{i}").alias(c) for i, c in enumerate(held)], *[F.col(f"__sw_{k}").alias(k) for k in BASE], F.coalesce("found", F.expr(NONE)).alias("found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each base match in its text replaced by its kind in brackets; all columns stay, whatever their names. A projection, without the method's finds, for streams and other inputs that pass once."""
    cols = docs.columns
    text = F.col(f"`{text_col}`")
    for kind, pattern in BASE.items():
        kept = f"transform(__sw_r.found, x -> concat(x.p, CASE WHEN {_holds(kind, 'x.m')} THEN '[{kind}]' ELSE x.m END))"
        docs = docs.withColumn("__sw_in", once(text.cast("string"))).withColumn("__sw_r", once(matches("__sw_in", pattern)))
        docs = docs.withColumn(text_col, once(F.concat(F.array_join(F.expr(kept), ""), F.col("__sw_r.rest")))).select(*[F.col(f"`{c}`") for c in cols])
    return docs


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found of each row; found spans have the kind "context", after the base kinds."""
    got = find_pii(docs.select("doc_id", "text"), ["doc_id"])
    base = listed({k: k for k in BASE})
    every = listed({k: k for k in BASE} | {"context": "found"})
    return got.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("found").cast("long").alias("n_found"))
