"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits in five segments that form a ring. If two fingerprints differ in at most four bits, then
some segment starts a chain around the ring whose first l segments differ in at most 4 l / 5 bits, for each l from 1
to 5: budgets of 0, 1, 2, 3 and 4. The budgets of the first two, no bit and then one bit of the next segment, make
the join key: 26 bits, given as they are on one side and with one bit raised on the other. What meets on a key must
keep the budgets of the rest of the chain, and then the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PATHS, UPPER, shuffled, small, split_join, written
from .components import stars

#: Fingerprints that share a key, from which on a longer chain is the key.
DENSE = 1000
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: For a byte, a number whose eight bytes are the byte's bits.
LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype="<u8")


def _hashes(text: str | None, k: int, seed: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), seed)] if words else []
    form = b" ".join([b"%b"] * k)
    return [h(form % x, seed) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def fingerprints(texts: list[str | None], k: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprints of texts, as unsigned 64-bit numbers: bit b is 1 if it is in over half the hashes of the k-word shingles."""
    lists = [_hashes(t, k, seed) for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    out = np.zeros(len(lists), dtype="<u8")
    if not n.sum():
        return out
    flat = np.fromiter((h for x in lists for h in x), dtype="<u8", count=int(n.sum()))
    lanes = LANES[flat.view(np.uint8).reshape(-1, 8)]
    full = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[full]
    blocks = -(-n[full] // 255)  # a byte counts to 255
    begin = np.cumsum(blocks) - blocks
    at = np.repeat(first - 255 * begin, blocks) + 255 * np.arange(blocks.sum())
    part = np.add.reduceat(lanes, at, axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
    count = np.add.reduceat(part.astype(np.int64), begin, axis=0)
    out[full] = np.packbits(2 * count > n[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint's bits as a signed long. A null, empty or blank text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            got = [fingerprints(texts.slice(i, 128).to_pylist(), k, seed) for i in range(0, len(texts), 128)]
            fps = np.concatenate(got) if got else np.zeros(0, dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["id", "fp"])

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, fp long")


def _mask(i: int) -> int:
    at, width = SEGMENTS[i % 5]
    return ((1 << width) - 1) << at


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys() -> list[tuple[int, int]]:
    return [(i, _signed(_mask(i) | _mask(i + 1))) for i in range(5)]


def _raised() -> list[tuple[int, int, int]]:
    """Segment, mask of it and the next, and a bit of the next to raise, or 0."""
    out = []
    for i, mask in _keys():
        at, width = SEGMENTS[(i + 1) % 5]
        out += [(i, mask, 0)] + [(i, mask, _signed(1 << b)) for b in range(at, at + width)]
    return out


def _literal(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast("int" if n == "i" else "long").alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])


def _chain(x: str, i: str) -> Column:
    """Whether the chain from segment i keeps its budgets: l segments differ in at most 4 l / 5 bits."""
    tests = [
        " AND ".join(f"bit_count({x} & {_signed(sum(_mask(s + j) for j in range(n)))}L) <= {4 * n // 5}" for n in range(2, 6))
        for s in range(5)
    ]
    return F.expr("CASE " + " ".join(f"WHEN {i} = {s} THEN {t}" for s, t in enumerate(tests)) + " END")


def _thirds() -> Column:
    """For 2 i + d: what to flip in the third segment of the chain from i, whose second has d bits that differ, so that no more than two do in all."""
    lists = []
    for i in range(5):
        at, width = SEGMENTS[(i + 2) % 5]
        bits = [1 << b for b in range(at, at + width)]
        one = [0, *bits]
        lists += [one + [x | y for k, x in enumerate(bits) for y in bits[:k]], one]
    return F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in xs]) for xs in lists])


def _met_dense(probe: DataFrame, index: DataFrame, dense: DataFrame) -> DataFrame:
    """(g, g2) of the pairs that meet on the keys of dense, a small table: by the chain's third segment too, and only where there is more than one g."""
    dense = F.broadcast(dense.select("i", "key"))
    triple = [_signed(_mask(i) | _mask(i + 1) | _mask(i + 2)) for i in range(5)]
    mask = F.get(F.array(*[F.lit(m).cast("long") for m in triple]), F.col("i"))
    two = F.get(F.array(*[F.lit(m).cast("long") for _, m in _keys()]), F.col("i"))
    d = F.when(F.col("key") == F.col("fp").bitwiseAND(two), 0).otherwise(1)
    asked = probe.join(dense, ["i", "key"]).select("fp", "g", "i", "key", F.explode(F.get(_thirds(), 2 * F.col("i") + d)).alias("x"))
    asked = asked.select("fp", "g", "i", (F.col("key").bitwiseOR(F.col("fp").bitwiseAND(mask).bitwiseAND(F.bitwise_not(two)))).bitwiseXOR(F.col("x")).alias("key3"))
    held = index.join(dense, ["i", "key"]).select("fp2", "g2", "i", F.col("fp2").bitwiseAND(mask).alias("key3"))
    both = asked.select("i", "key3", "g", F.lit(0).alias("n")).unionByName(held.select("i", "key3", F.col("g2").alias("g"), F.lit(1).alias("n")))
    mixed = both.groupBy("i", "key3").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.sum("n").alias("n")).where("low < high AND n > 0").select("i", "key3")
    held = held.join(shuffled(mixed), ["i", "key3"], "left_semi")
    met = shuffled(asked).alias("p").join(held.alias("q"), F.expr("p.i = q.i AND p.key3 = q.key3 AND g <> g2 AND bit_count(fp ^ fp2) <= 4") & _chain("(fp ^ fp2)", "p.i"))
    return met.select("g", "g2")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(fp, root) for each of the distinct fps that links with others, roots left out: root is the least fp, as a signed long, of its component.

    First each key's fingerprints are tried against the least of them, one row each. Then the keys are joined, and
    what the first step has united already gives no more rows, so that a dense group makes no pairs of its members.
    Keys of more than `dense` fingerprints, and more than a 50,000th of all, are joined by a longer chain.
    """
    keyed = fps.select("fp", F.explode(_literal(_keys(), ("i", "mask"))).alias("t")).select("fp", "t.i", F.expr("fp & t.mask").alias("key"))
    least, _ = written(keyed.groupBy("i", "key").agg(F.min("fp").alias("p"), F.count("*").alias("n")).where("n > 1"), "least")
    near = split_join(keyed, least, ["i", "key"], "n").where("fp <> p AND bit_count(fp ^ p) <= 4")
    first, _ = written(stars(near.select(F.col("fp").alias("a"), F.col("p").alias("b"))), "first")
    known = fps.join(first.withColumnsRenamed({"node": "fp", "root": "g"}), "fp", "left").select("fp", F.coalesce("g", "fp").alias("g"))
    known, _ = written(known, "known")
    index = known.select("fp", "g", F.explode(_literal(_keys(), ("i", "mask"))).alias("t")).select(F.col("fp").alias("fp2"), F.col("g").alias("g2"), "t.i", F.expr("fp & t.mask").alias("key"))
    raised = F.filter(_literal(_raised(), ("i", "mask", "flip")), lambda t: F.col("fp").bitwiseAND(t["flip"]) == 0)
    probe = known.select("fp", "g", F.explode(raised).alias("t")).select("fp", "g", "t.i", F.expr("(fp & t.mask) | t.flip").alias("key"))
    often = least.where(F.col("n") > max(dense, known.count() // 10_000))
    more = None
    if not often.isEmpty():
        more = _met_dense(probe, index, often)
        keys = F.broadcast(often.select("i", "key"))
        probe, index = probe.join(keys, ["i", "key"], "left_anti"), index.join(keys, ["i", "key"], "left_anti")
    met = shuffled(probe).alias("p").join(
        index.alias("q"),
        F.expr("p.i = q.i AND p.key = q.key AND g <> g2 AND bit_count(fp ^ fp2) <= 4") & _chain("(fp ^ fp2)", "p.i"),
    ).select("g", "g2")
    over = stars((met if more is None else met.unionByName(more)).select(F.col("g").alias("a"), F.col("g2").alias("b")))
    over, _ = written(over.withColumnsRenamed({"node": "g", "root": "r"}), "over")
    joined = known.join(small(over, PATHS[-1]), "g", "left")
    return joined.select("fp", F.coalesce("r", "g").alias("root")).where("fp <> root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    Fingerprints link at four or fewer differing bits; component_id is the least id in the connected component, the
    row's own included. Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat
    an id count each; null ids are never the least, and a component of null ids alone has null. An empty table gives
    an empty one. Other columns are not looked at. Only distinct fingerprints are linked, so exact copies, however many, cost
    one row.
    """
    marked, _ = written(with_fingerprint(docs, id_col, text_col, k, seed), "fp")
    fps, _ = written(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "fps")
    linked, path = written(links(fps.select("fp")), "roots")
    joined = fps.join(small(linked, path), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    joined, _ = written(joined, "joined")
    lows, _ = written(joined.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")), "lows")
    of_fp, _ = written(split_join(joined.select("root", "fp", "n"), lows, ["root"], "members").select("fp", "n", "component_id"), "components")
    return split_join(marked, of_fp, ["fp"], "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
