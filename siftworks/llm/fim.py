"""Fill-in-middle: texts cut at two drawn token boundaries and put in another order, between sentinels.

A token is a run of letters A-Z, a-z or any other code point. A text is decoded to an array of code points; where not
both neighbours are letters there is a boundary, and the drawn ranks index the array of these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many stay plain, and of 100 others, how many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SLICE = 256
FIM = "form string, n long, prefix_chars long, middle_chars long, output string"
_KIND = pa.struct([("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where the tokens of an array of code points begin, and its length: n + 1 places for n tokens."""
    low = points | 32
    letter = (low >= 97) & (low <= 122)
    inside = letter[1:] & letter[:-1]
    return np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(points)]]) if len(points) else np.zeros(1, dtype=np.int64)


def draws(ident: int | str | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 by the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(text: str, drawn: tuple[int, int, int, int], sentinels: tuple[str, str, str], plain: int, suffix_first: int) -> tuple:
    """form, n, prefix_chars, middle_chars and output of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = boundaries(points)
    n = len(at) - 1
    if not text or drawn[2] % 100 >= 100 - plain or any(s in text for s in sentinels):
        return "plain", n, None, None, text
    a, b = (int(at[k]) for k in sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
    p, s, m = sentinels
    if drawn[3] % 100 < suffix_first:
        return "spm", n, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", n, a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _told(sentinels: tuple[str, str, str]) -> None:
    """Raises where a sentinel and what stands beside it could be read as another one."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(s.count(t[0]) != (s[0] == t[0]) for s in sentinels for t in sentinels) or any(s != t and s.startswith(t) for s in sentinels for t in sentinels):
        raise ValueError("sentinels must be three different texts, none beginning another, whose first characters stand nowhere else in them")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, to: str = "fim") -> DataFrame:
    """docs with column to, a struct of form (plain, psm or spm), n (tokens), prefix_chars, middle_chars and output; it replaces a column of that name.

    The cuts depend on the seed and the id, so reruns agree and rows that repeat an id and a text have one result; a
    null id counts as an empty one. Null and empty texts, and those that hold a sentinel, are plain, as is a share of
    all; plain rows have the text as output and null lengths. Lengths are in code points. Texts of any length are cut
    whole, one at a time. An empty table gives an empty one. Nothing is shuffled.
    """
    _told(sentinels)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            for i in range(0, len(ids), SLICE):
                pairs = zip(ids.slice(i, SLICE).to_pylist(), texts.slice(i, SLICE).to_pylist(), strict=True)
                rows = [rearranged(t or "", draws(d, seed), sentinels, plain, suffix_first) for d, t in pairs]
                yield pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _KIND, strict=True)], fields=list(_KIND))

    # a name that can't clash keeps the column's own name, dots and all, out of the expression
    cut = F.arrow_udf(run, FIM)(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    same = lambda c: c.lower() == to.lower()
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if not same(c)], cut.alias(to))


def restored(fim: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a struct of fill_in_middle was made of, from its output and form; no piece holds a sentinel, so these part the output."""
    _told(sentinels)
    parts = F.split(fim["output"], "|".join(re.escape(s) for s in sentinels), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(fim["form"] == "psm", F.concat(one, three, two)).when(fim["form"] == "spm", F.concat(two, three, one)).otherwise(fim["output"])


def fim_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row."""
    f = F.col("fim")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs.select("doc_id", "text")).select("doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"), digest(f["output"]).alias("output_sha256"), digest(restored(f)).alias("restored_sha256"))
