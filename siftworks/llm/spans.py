"""Places of regular-expression matches, in code points, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<struct<s:bigint,e:bigint,m:string>>)"
BLOCK = 256


def matches(text: str, pattern: str) -> Column:
    """For a string column: found, structs of m, a match, and p, what stands between the one before and it, leftmost and non-overlapping; and rest, what stands after the last."""
    both = F.array(F.struct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("m"), F.split(F.col(text), pattern, -1).alias("p")))
    return F.transform(both, lambda c: F.struct(F.arrays_zip(c["m"].alias("m"), F.slice(c["p"], F.lit(1), F.size(c["m"])).alias("p")).alias("found"), F.element_at(c["p"], -1).alias("rest")))[0]


def before(points: str, marks: str, equal: bool) -> str:
    """SQL: for each number of a sorted array, how many of marks are less, or with equal as great at most. By one sort, and not by a look at each mark for each point."""
    both = f"array_sort(concat(transform({marks}, v -> struct(v AS v, {0 if equal else 2} AS k)), transform({points}, v -> struct(v AS v, 1 AS k))))"
    return f"transform(filter(transform({both}, (x, i) -> struct(x.k AS k, i AS i)), x -> x.k = 1), (x, j) -> x.i - j)"


def places(found: str) -> Column:
    """For a column as of matches: structs of s, e and m. Places are added up within blocks and then over blocks, so that a text's cost is in proportion to its matches."""
    zero = "struct(0L as at, {} as out)"
    step = f"aggregate(slice({found}, b * {BLOCK} + 1, {BLOCK}), {zero.format(NONE)}, (a, x) -> struct(a.at + length(x.p) + length(x.m) as at, concat(a.out, array(struct(a.at + length(x.p) as s, a.at + length(x.p) + length(x.m) as e, x.m as m))) as out))"
    blocks = f"transform(sequence(0, (size({found}) - 1) div {BLOCK}), b -> {step})"
    moved = (
        "aggregate({}, struct(0L as at, cast(array() as array<array<struct<s:bigint,e:bigint,m:string>>>) as out),"
        " (a, b) -> struct(a.at + b.at as at, concat(a.out, array(transform(b.out, x -> struct(x.s + a.at as s, x.e + a.at as e, x.m as m)))) as out), a -> flatten(a.out))"
    ).format(blocks)
    return F.expr(f"CASE WHEN size({found}) > 0 THEN {moved} ELSE {NONE} END")


def listed(kinds: dict[str, str]) -> Column:
    """kind:start:end of the structs in columns, in the order of kinds, as one array of structs of s, e, k and order."""
    return F.concat(*[F.expr(f"transform({c}, x -> struct({i} as o, x.s as s, x.e as e, '{k}' as k))") for i, (k, c) in enumerate(kinds.items())])
