"""Secret scans: base patterns, key-like tokens, and how many repositories and owners hold each.

A credential that many owners hold is an example that was copied; one that a single owner holds, and that looks drawn
at random, is likely live. Candidates are hashed and counted over the whole corpus, first by owner and repository, so
that a widely copied one is counted before it is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, split_join, written
from .spans import before, listed, matches, places

#: The base kinds, and the part of a match that is the credential.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Further tokens that may be credentials: runs of 20 or more characters that base64 or key formats use.
KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
COPIED_OWNERS, COPIED_REPOS, LEAST_BITS, LEAST_KINDS = 3, 20, 3.5, 3


def bits(c: str) -> str:
    """SQL: the entropy of a string's characters, in bits a character. A character's count is the length that its removal takes off."""
    return f"aggregate(array_distinct(split({c}, '')), 0D, (a, ch) -> a - (length({c}) - length(replace({c}, ch, ''))) / length({c}) * log2((length({c}) - length(replace({c}, ch, ''))) / length({c})))"


#: What a text must hold to have a match, where that is quicker to tell.
NEEDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}", "key": r"[A-Za-z0-9+/_-]{20}"}
SEEN = "array<struct<s:bigint,e:bigint,k:string,sha256:string,repos:bigint,owners:bigint,verdict:string>>"


def _rows(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """carry, a column of places for each base kind, and __sw_found: kind, place and value of each candidate."""
    out = docs.select(*[F.col(f"`{c}`") for c in carry], once(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("__sw_text"))
    nothing = F.expr("named_struct('found', cast(array() as array<struct<m:string,p:string>>), 'rest', '')")
    kinds = BASE | {"key": KEY}
    out = out.withColumns({f"__sw_r_{k}": once(F.when(F.rlike("__sw_text", F.lit(NEEDS[k])), matches("__sw_text", p)).otherwise(nothing)) for k, p in kinds.items()})
    out = out.drop("__sw_text").withColumns({f"__sw_{k}": once(places(f"__sw_r_{k}.found")) for k in kinds})
    value = "regexp_extract(x.m, __sw_rx, 1)"
    out = out.withColumn("__sw_rx", F.lit(ASSIGNED))
    out = out.withColumn("__sw_assign", once(F.expr(f"filter(__sw_assign, x -> length({value}) >= 6)")))
    spans = F.array_sort(F.concat(*[F.expr(f"transform(__sw_{k}, x -> struct(x.s AS s, x.e AS e))") for k in BASE]))
    out = out.withColumn("__sw_spans", once(spans))
    out = out.withColumns({"__sw_met": once(F.expr(before("__sw_key.e", "__sw_spans.s", False))), "__sw_past": once(F.expr(before("__sw_key.s", "array_sort(__sw_spans.e)", True)))})
    mixed = " + ".join(f"cast(rlike(x.m, '{c}') as int)" for c in ("[a-z]", "[A-Z]", "[0-9]"))
    out = out.withColumn("__sw_key", once(F.expr(f"filter(__sw_key, (x, i) -> __sw_met[i] <= __sw_past[i] AND {mixed} >= {LEAST_KINDS} AND {bits('x.m')} >= {LEAST_BITS})")))
    found = F.concat(F.expr(f"transform(__sw_assign, x -> struct('assign' as k, x.s as s, x.e as e, {value} as v))"), *[F.expr(f"transform(__sw_{k}, x -> struct('{k}' as k, x.s as s, x.e as e, x.m as v))") for k in ("access", "hex", "key")])
    return out.select(*[F.col(f"`{c}`") for c in carry], *[f"__sw_{k}" for k in BASE], found.alias("__sw_found"))


def verdicts(each: DataFrame) -> DataFrame:
    """(h, repos, owners, told, times) of candidates (h, owner, repo, random), told their verdict. Counted by owner and repository first, so that no candidate's occurrences meet."""
    by_repo = each.groupBy("h", "owner", "repo").agg(F.max("random").alias("random"), F.count("*").alias("times"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("*").alias("n"), F.max("random").alias("random"), F.sum("times").alias("times"))
    held = by_owner.groupBy("h").agg(F.sum("n").alias("repos"), F.count("*").alias("owners"), F.max("random").alias("random"), F.sum("times").alias("times"))
    verdict = F.when((F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS), "copied").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("unsure")
    return held.select("h", "repos", "owners", verdict.alias("verdict"), "times")


def find_secrets(docs: DataFrame, carry: list[str], owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """carry, and for each row the places of the base kinds, of live (key-like tokens that one owner holds) and the array seen.

    seen has for each candidate its kind k, place s and e, sha256 digest, and the distinct repos and owners that hold
    it, and verdict: copied (COPIED_OWNERS owners or COPIED_REPOS repositories at least), live (one owner, random-looking)
    or unsure. Places are in code points, ends exclusive. A null owner or repository counts as one of its own kind; null
    and empty texts hold nothing; rows that repeat are one repository; an empty table gives an empty one. A carried
    column of the name of a kind, seen or live is replaced; others may have any names.
    """
    held = [c for c in carry if c not in (*BASE, "seen", "live")]
    key = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in (owner_col, repo_col)]
    named = docs.select(*[F.col(f"`{c}`").alias(f"__sw_c{i}") for i, c in enumerate(held)], key[0].alias("__sw_owner"), key[1].alias("__sw_repo"), F.col(f"`{text_col}`").alias("__sw_in"))
    hashed = F.expr(f"transform(__sw_found, x -> struct(x.k as k, x.s as s, x.e as e, sha2(cast(x.v as binary), 256) as h, length(x.v) >= 12 AND {bits('x.v')} >= 3D as random))")
    rows = _rows(named, named.columns[:-1], "__sw_in").withColumn("__sw_cand", hashed).drop("__sw_found")
    rows, _ = written(rows.withColumn("__sw_row", F.monotonically_increasing_id()), "secrets")
    each = rows.select("__sw_row", F.col("__sw_owner").alias("owner"), F.col("__sw_repo").alias("repo"), F.explode("__sw_cand").alias("c")).select("__sw_row", "owner", "repo", "c.*")
    told, _ = written(verdicts(each), "verdicts")
    by_row = split_join(each, told, ["h"], "times").groupBy("__sw_row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "k", F.col("h").alias("sha256"), "repos", "owners", "verdict"))).alias("seen"))
    got = rows.join(by_row, "__sw_row", "left").withColumn("seen", F.coalesce("seen", F.expr(f"cast(array() as {SEEN})")))
    return got.select(*[F.col(f"__sw_c{i}").alias(c) for i, c in enumerate(held)], *[F.col(f"__sw_{k}").alias(k) for k in BASE], "seen", F.expr("filter(seen, x -> x.k = 'key' AND x.verdict = 'live')").alias("live"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["k"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_copied of each row. Key-like tokens that one owner holds are spans of the kind "key"."""
    got = find_secrets(docs.select("doc_id", "source", "text"), ["doc_id"])
    count = lambda v: F.size(F.expr(f"filter(seen, x -> x.verdict = '{v}')")).cast("long").alias(f"n_{v}")
    return got.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(listed({k: k for k in BASE})).cast("binary"), 256).alias("base_sha256"), _joined(listed({k: k for k in BASE} | {"key": "live"})).alias("spans"), count("live"), count("copied"))
