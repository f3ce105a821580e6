"""Near-dedup by SimHash with pigeonring filtering and by MinHash keys, verified on whole shingle sets.

The first candidates are what op1's method (simhash.py) links, each against one of its component. Of texts whose sets of
five-word shingles have a Jaccard similarity of 0.8, few have fingerprints within its four bits; the others meet on
MinHash keys: 32 keys of four minima each. Two sets of similarity s meet on some key with
probability 1 - (1 - s^4)^32, so a pair at 0.8 is missed with 5e-8. What meets, and is not united otherwise, has its
similarity estimated where it meets, from the least hash of each of 255 classes of hashes, of which four bits are kept,
and then from 255 classes of another hash besides. Only what is not far below comes out of the join, once a pair at the
least of the keys that it shares, and is held against the exact similarity. Of the classes that two sets have, a share s
has the same least hash, and 1/15 of the others the same bits, with a standard deviation of 0.025 at most at 0.8, and
0.0175 over both: under 0.12, or 0.085, below it a pair lies with a chance of about 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PATHS, SPACE_RUN, ascii_lower, drop_written, shuffled, small, split_join, written
from .components import stars
from .simhash import _hashes, fingerprints, links

KEYS, MINIMA = 32, 4
WORDS, LEAST = 5, 0.8
_R = np.random.default_rng(20)
#: Odd multipliers and offsets, one of each a minimum.
TIMES = _R.integers(0, 1 << 63, KEYS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _R.integers(0, 1 << 63, KEYS * MINIMA, dtype=np.uint64)
#: Classes of a sketch in one number and numbers of one; the shares of like classes, below similarity, from which on pairs are verified, in one sketch and in both.
LANES, LONGS, BELOW, BELOW_BOTH = 15, 17, 0.12, 0.085
#: Sets of so few shingles are verified without an estimate, which two classes that coincide could spoil.
FEW = 24
MIX = _R.integers(0, 1 << 63, (1, KEYS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Gives the hashes of the second sketch.
OTHER = _R.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of a text, letters A-Z lowered; of all words where it has no more than k."""
    return np.unique(np.array(_hashes(text, k, 42), dtype="<u8"))


def node(text: Column) -> Column:
    """A hash of the words of a text: rows of one node are exact copies but for case and spaces. Null and blank texts have one node."""
    return F.xxhash64(F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE_RUN, " ")))


def keys(hashes: np.ndarray) -> np.ndarray:
    """The KEYS keys of a set of hashes; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype="<u8")
    low = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 512):
        x = hashes[i : i + 512, None] * TIMES + PLUS
        low = np.minimum(low, x.min(axis=0))
    mixed = (low.reshape(1, KEYS, MINIMA) * MIX).sum(axis=2, dtype=np.uint64)[0]
    return mixed ^ (mixed >> np.uint64(29)) ^ np.arange(KEYS, dtype=np.uint64)


def _lists(x: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in x])]).astype(np.int32)
    flat = np.concatenate(x).view("<i8") if x else np.zeros(0, dtype="<i8")
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def sketches(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """node, n (the size of its shingle set), keys and fp, op1's fingerprint, for each row of texts (text, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = part.column(0).to_pylist()
                sets = [shingles(t, k) for t in found]
                fps = np.concatenate([fingerprints(found[j : j + 128]) for j in range(0, len(found), 128)])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([len(s) for s in sets], pa.int64()), _lists([keys(s) for s in sets]), pa.array(fps.view("<i8"))], names=["node", "n", "keys", "fp"])

    return texts.mapInArrow(run, "node long, n long, keys array<long>, fp long")


def ringed(prints: DataFrame) -> DataFrame:
    """(a, n, b, n2): each node of prints (node, n, fp), a written table, whose fingerprint op1's method links with others', and the least node of its component."""
    fps, _ = written(prints.select("fp").distinct(), "fps")
    linked, path = written(links(fps), "linked")
    ring, _ = written(prints.join(small(linked, path), "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("ring")), "ring")
    heads, _ = written(ring.groupBy("ring").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("times")).where("times > 1").select("ring", F.col("c.node").alias("b"), F.col("c.n").alias("n2"), "times"), "heads")
    return split_join(ring, heads, ["ring"], "times").where("node <> b").select(F.col("node").alias("a"), "n", "b", "n2")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of hashes: for each class, by remainder, 1 to 15 by its least hash, or 0 without one; four bits each."""
    classes, first = np.unique(hashes % np.uint64(LANES * LONGS), return_index=True)
    bits = np.zeros(LANES * LONGS, dtype=np.uint64)
    bits[classes.astype(np.int64)] = (hashes[first] >> np.uint64(17)) % np.uint64(15) + np.uint64(1)
    return np.bitwise_or.reduce(bits.reshape(LONGS, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(4)), axis=1)


def estimated(a: str, b: str, least: float) -> Column:
    """Whether two sketches, columns of arrays, have that share, in thousandths, of like classes among those that either has. Higher-order functions, as one expression over all numbers is a method too long for the JVM to compile."""
    low, high = f"{sum(7 << 4 * i for i in range(LANES))}L", f"{sum(8 << 4 * i for i in range(LANES))}L"
    some = lambda x: f"bit_count((((({x}) & {low}) + {low}) | ({x})) & {high})"
    apart = round(1000 * (1 - least))
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> 1000 * {some('x ^ y')} - {apart} * {some('x | y')}), 0, (s, d) -> s + d) <= 0")


def sets(nodes: DataFrame, k: int = WORDS) -> DataFrame:
    """node, hs, the shingle set, sk, its sketch, and sl, that of its hashes times OTHER, for each row of nodes (text, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingles(t, k) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), _lists(found), _lists([sketch(s) for s in found]), _lists([sketch(np.sort(s * OTHER)) for s in found])], names=["node", "hs", "sk", "sl"])

    return nodes.mapInArrow(run, "node long, hs array<long>, sk array<long>, sl array<long>")


def _verified(pairs: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """The rows of pairs (a, b, ...) whose sets have the similarity."""
    one = of.select(F.col("node").alias("a"), F.col("hs").alias("ha"))
    two = of.select(F.col("node").alias("b"), F.col("hs").alias("hb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("both") >= F.lit(least) * (F.size("ha") + F.size("hb") - F.col("both"))).select(*pairs.columns)


def roots(texts: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """(node, root) of the nodes of texts (text, node) that link with others, roots left out. Nodes link at a Jaccard similarity of least or more.

    First what op1's method links is tried against one of its component, and each key's nodes against the one of them that meets most others, then the pairs that this has not
    united and that their sketches don't rule out, so that a dense group makes no pairs of its members, and a group of
    less similar texts next to none. texts is read twice and should be a written table.
    """
    marked, _ = written(sketches(texts.select("text", "node"), k), "sketches")
    near = F.expr(f"least(n, n2) >= {least} * greatest(n, n2)")
    prints, _ = written(marked.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp")), "prints")
    chained, _ = written(ringed(prints).where(near).select("a", "b"), "chained")
    keyed, _ = written(marked.dropDuplicates(["node"]).select("node", "n", F.explode("keys").alias("key")), "keyed")
    shared, _ = written(keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), "shared")
    multi, _ = written(split_join(keyed, shared.withColumn("times", F.col("met")), ["key"], "times"), "multi")
    score, _ = written(multi.groupBy("node").agg(F.sum("met").alias("score"), F.count("*").alias("of")), "score")
    wanted, path = written(score.select("node").union(chained.select("a")).union(chained.select("b")).distinct(), "wanted")
    some = texts.select("text", "node").join(small(wanted, path), "node", "left_semi")
    of, _ = written(sets(some.groupBy("node").agg(F.min("text").alias("text")).select("text", "node"), k), "sets")

    best = split_join(multi, score, ["node"], "of").groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("score", "node")).alias("c"), F.count("*").alias("times"))
    centre, _ = written(best.select("key", F.col("c.node").alias("node2"), F.col("c.n").alias("n2"), "times"), "centre")
    first = split_join(multi, centre, ["key"], "times").where("node <> node2").where(near).select(F.col("node").alias("a"), F.col("node2").alias("b")).union(chained).distinct()
    united, path = written(stars(_verified(first, of, least)), "united")
    known, _ = written(multi.join(small(united.withColumnRenamed("root", "g"), path), "node", "left").select("node", "n", "key", F.coalesce("g", "node").alias("g")), "known")
    # keys whose nodes are all united have nothing more to tell
    mixed, _ = written(known.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("times")).where("low < high").select("key", "times"), "mixed")
    open_, _ = written(split_join(known, mixed, ["key"], "times"), "open")
    told = open_.groupBy("node").agg(F.collect_list("key").alias("ks")).join(of.select("node", "sk", "sl"), "node")  # KEYS keys a node at most
    left, _ = written(shuffled(open_).join(told, "node"), "left")
    other = left.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "g", "ks", "sk", "sl")])
    like = (F.least("n", "n2") <= FEW) | (estimated("sk", "sk2", least - BELOW) & estimated("concat(sk, sl)", "concat(sk2, sl2)", least - BELOW_BOTH))
    rest, _ = written(shuffled(left).join(other, "key").where(F.col("g") < F.col("g2")).where(near).where(like).where("array_min(array_intersect(ks, ks2)) = key").select(F.col("node").alias("a"), F.col("node2").alias("b"), "g", "g2"), "rest")
    over, path = written(stars(_verified(rest, of, least).select(F.col("g").alias("a"), F.col("g2").alias("b"))).withColumnsRenamed({"node": "g", "root": "r"}), "over")
    all_ = known.select("node", "g").union(united.select("node", F.col("root").alias("g"))).distinct()
    return all_.join(small(over, path), "g", "left").select("node", F.coalesce("r", "g").alias("root")).where("node <> root")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs with one row of each component of texts that link at a Jaccard similarity of least or more over k-word shingles.

    It is the row of the least id, null ids last, of those the one with the shortest text, then the least hash of it,
    and of rows alike in all that the one read first. Rows are told apart by their texts, never by id: rows that repeat
    an id or have none are each in the component of their text. Null, empty and blank texts are copies of each other.
    All columns stay; an empty table gives an empty one. docs is written once; rows are chosen without their texts, by
    aggregates of one row a component, and those that go are taken out, by a broadcast while they are few. Of what is
    written on the way only docs and the rows that go stay, which the result reads.
    """
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.length(text.cast("string")).alias("n"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    marked, _ = written(docs.withColumns({"__sw_node": node(text), "__sw_order": order}), "marked")
    since = len(PATHS)
    linked, path = written(roots(marked.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col("__sw_node").alias("node")), k, least), "roots")
    drop_written(docs.sparkSession, since, keep=(path,))
    light = marked.select("__sw_node", "__sw_order").join(small(linked, path), F.col("__sw_node") == F.col("node"), "left").select(F.coalesce("root", "__sw_node").alias("group"), F.col("__sw_order").alias("o"))
    first, _ = written(light.groupBy("group").agg(F.min("o").alias("f"), F.count("*").alias("times")).where("times > 1"), "groups")
    gone, path = written(split_join(light, first, ["group"], "times").where("o.row <> f.row").select(F.col("o.row").alias("__sw_gone")), "gone")
    drop_written(docs.sparkSession, since, keep=(path,))
    return marked.join(small(gone, path), F.col("__sw_order.row") == F.col("__sw_gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
