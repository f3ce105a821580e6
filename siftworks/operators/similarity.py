"""Similarity joins: best match in a window, nearest topic, and the greedy dedup of a run.

Two vector tables are packed into blocks, and each pair of blocks is one matrix product in an Arrow batch; only pairs
over the threshold come out. Blocks are written once and read where they meet, so that no vector is shuffled for each
pair of blocks; a task has the pairs of one part of either side, of which there are SIDE at most. Blocks have
vectors that are near each other, and know the least and the greatest angle of theirs to each of some pivots. Angles
obey the triangle inequality, so where two blocks' angles to a pivot lie further apart than the threshold's angle, no
pair of theirs can reach it: such blocks never meet, and only their angles are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.operators.cut import carried, cut, drop

BLOCK = 1024
#: Vectors to which angles are taken; what rounding may add to an angle; pairs of blocks up to which all are multiplied.
PIVOTS, SLACK, PLAIN = 64, 1e-6, 16
#: Parts of either side, and of the side of which each part gives an item's best.
SIDE, PARTS = 44, 12
#: Bytes and vectors of a block of packed vectors; rows of a product.
BYTES, WIDEST, ROWS = 2 << 20, 4096, 512
FOLDED = pa.schema([("url", pa.string()), ("slot", pa.int64()), ("kept", pa.bool_()), ("matched", pa.string()), ("sim", pa.float64()), ("filter_type", pa.string())])
VERBATIM, OVERLAP, TOPIC = 0.90, 0.60, 0.30


def _blocks(df: DataFrame, key: str, vector: str, side: str, block: int) -> tuple[DataFrame, int]:
    """df as rows of about block vectors, in the order of their keys, written in SIDE parts at most, and how many such rows there are at most."""
    n = _count(df, block)
    one = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("b"))
    return cut(one.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias(side)).drop("b").repartition(min(SIDE, n))), n


def _count(df: DataFrame, block: int) -> int:
    return max(1, -(-df.count() // block))


def _met(a: DataFrame, b: DataFrame, on: Column | None = None) -> DataFrame:
    """Each row of a with each of b, both written, of which on holds: parts are read for each part of the other side, and nothing is shuffled."""
    b = b.hint("shuffle_replicate_nl")
    return a.crossJoin(b) if on is None else a.join(b, on)


def _unit(keys_and_vectors: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's keys, its vectors as rows of length 1 or 0, filled up with zeros, and their sizes."""
    keys, vectors = keys_and_vectors.values.flatten()
    return keys, *_units(vectors)


def _units(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    m, size = _matrix(vectors)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), size


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    m = np.zeros((len(vectors), max(1, size.max(initial=1))))
    m[np.arange(m.shape[1])[None, :] < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return m, size


def _products(pairs: DataFrame, threshold: float, kinds: tuple[str, str], best: bool = False) -> DataFrame:
    """(a, b, sim) of the pairs of blocks l and r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left_cell, right_cell in zip(batch.column("l"), batch.column("r"), strict=True):
                ka, ma, sa = _unit(left_cell)
                kb, mb, sb = _unit(right_cell)
                width = max(ma.shape[1], mb.shape[1])
                ma, mb = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (ma, mb))
                sim = np.where(sa[:, None] == sb[None, :], ma @ mb.T, 0.0)
                if best:
                    i = np.arange(len(ka))
                    j = sim.argmax(axis=1)
                    i, j = i[sim[i, j] >= threshold], j[sim[i, j] >= threshold]
                else:
                    i, j = np.nonzero(sim >= threshold)
                yield pa.RecordBatch.from_arrays([ka.take(pa.array(i)), kb.take(pa.array(j)), pa.array(sim[i, j])], names=["a", "b", "sim"])

    return pairs.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, sim double")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, key_l: str, key_r: str, vector: str = "embedding_vector", block: int = BLOCK, best: bool = False) -> DataFrame:
    """(a, b, sim) of the pairs of left and right whose cosine is threshold at least; with best, for each a only the one of a block of right that has the greatest, of equal ones the least b. Zero vectors and vectors of other sizes have cosine 0.

    Above zero and with more than a few blocks, blocks that can't reach the threshold are left out (near_blocks); the
    pairs are the same.
    """
    kinds = left.schema[key_l].dataType.simpleString(), right.schema[key_r].dataType.simpleString()
    return _products(_pairs(left, right, threshold, key_l, key_r, vector, block, best=best), threshold, kinds, best)


def _pairs(left: DataFrame, right: DataFrame, threshold: float, key_l: str, key_r: str, vector: str, block: int, plain: int = PLAIN, best: bool = False) -> DataFrame:
    """(l, r): the pairs of blocks that may reach the threshold; all of them where they are no more than plain."""
    if best or threshold <= 0 or _count(left, block) * _count(right, block) <= plain:
        return _met(_blocks(left, key_l, vector, "l", block)[0], _blocks(right, key_r, vector, "r", block)[0])
    one, two, far = _near(left, right, threshold, key_l, key_r, vector, block)
    name = lambda df, x, side: df.select(F.col("w").alias(f"w{x}"), F.col("vs").alias(side), F.col("low").alias(f"l{x}"), F.col("high").alias(f"h{x}"))
    return _met(name(one, "a", "l"), name(two, "b", "r"), (F.col("wa") == F.col("wb")) & ~_apart(far)).select("l", "r")


def _apart(far: float, la: str = "la", ha: str = "ha", lb: str = "lb", hb: str = "hb") -> Column:
    """Whether blocks' angles (la, ha) and (lb, hb) to some pivot are too far apart."""
    return F.exists(F.arrays_zip(la, ha, lb, hb), lambda z: (z[la] - z[hb] > far) | (z[lb] - z[ha] > far))


def near_blocks(left: DataFrame, right: DataFrame, threshold: float, key_l: str, key_r: str, vector: str = "embedding_vector", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks of left and of right (id, vs, low and high: their angles to the pivots), and the pairs (ia, ib) of them that may reach a threshold above zero.

    A block has vectors of one size whose nearest pivot is the same, in the order of their angle to it, at most block of
    them. Zero vectors are in none. Pivots are the PIVOTS vectors of the least hashes of their keys.
    """
    a, b, far = _near(left, right, threshold, key_l, key_r, vector, block)
    side = lambda df, x: df.select(F.col("id").alias(f"i{x}"), F.col("w").alias(f"w{x}"), F.col("low").alias(f"l{x}"), F.col("high").alias(f"h{x}"))
    met = _met(side(a, "a"), side(b, "b"), (F.col("wa") == F.col("wb")) & ~_apart(far))  # angles, not vectors
    return a, b, cut(met.select("ia", "ib"))


def _near(left: DataFrame, right: DataFrame, threshold: float, key_l: str, key_r: str, vector: str, block: int) -> tuple[DataFrame, DataFrame, float]:
    """The blocks of left and right as near_blocks has them, and the angle beyond which they can't reach the threshold."""
    one, two, angles = _celled(left, right, key_l, key_r, vector)

    def packed(near: DataFrame, n: int) -> DataFrame:
        kind = near.schema["k"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for i, rows in enumerate(_runs(batches, ["w", "cell"], block)):
                k, v = rows.column("k"), rows.column("v")
                vs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays([k, v], ["k", "v"]))
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}/{i}"]), rows.column("w").slice(0, 1), vs, *_ends(angles(_matrix(v)[0]))], names=["id", "w", "vs", "low", "high"])

        return cut(_dealt(near, min(SIDE, n)).mapInArrow(run, f"id string, w int, vs array<struct<k:{kind},v:array<double>>>, low array<double>, high array<double>"))

    a = packed(one, _count(left, block))
    b = a if two is one else packed(two, _count(right, block))
    return a, b, _far(threshold)


def _far(threshold: float) -> float:
    return float(np.arccos(min(1.0, threshold))) + SLACK


def _celled(left: DataFrame, right: DataFrame, key_l: str, key_r: str, vector: str) -> tuple[DataFrame, DataFrame, Callable[[np.ndarray], np.ndarray]]:
    """The vectors of left and right that aren't zero, written, as (k, v, w, cell, at): key, vector, size, the nearest pivot and the angle to it; and what gives the angles of vectors of one size to the pivots."""
    some = lambda df, key: df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0))
    both = some(left, key_l).select(F.xxhash64("k").alias("h"), "v").union(some(right, key_r).select(F.xxhash64("k").alias("h"), "v"))
    chosen: dict[int, np.ndarray] = {}
    for r in both.orderBy("h").limit(PIVOTS).collect():
        v = np.array(r.v) / np.linalg.norm(r.v)
        chosen[len(v)] = np.vstack([chosen[len(v)], v]) if len(v) in chosen else v[None, :]

    def angles(m: np.ndarray) -> np.ndarray:
        """Of vectors of one size to the pivots of that size; none, where there is no such pivot."""
        p = chosen.get(m.shape[1])
        if p is None:
            return np.zeros((len(m), 0))
        return np.arccos(np.clip(m / np.linalg.norm(m, axis=1, keepdims=True) @ p.T, -1.0, 1.0))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, size = _matrix(batch.column("v"))
            cell, at = np.full(len(m), -1, dtype=np.int32), np.zeros(len(m))
            for w in np.unique(size):
                mine = np.flatnonzero(size == w)
                x = angles(m[mine, :w])
                if x.shape[1]:
                    cell[mine], at[mine] = x.argmin(axis=1), x.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), pa.array(size, pa.int32()), pa.array(cell), pa.array(at)], names=["k", "v", "w", "cell", "at"])

    near = lambda df, key: cut(some(df, key).mapInArrow(celled, f"k {df.schema[key].dataType.simpleString()}, v array<double>, w int, cell int, at double"))
    a = near(left, key_l)
    return a, a if left is right and key_l == key_r else near(right, key_r), angles


def _dealt(near: DataFrame, parts: int) -> DataFrame:
    """What _celled gives, in order: vectors are shuffled this once, and tasks make blocks of those that follow each other. Keys come last, so that no angle that many vectors have is in one task. Never more than parts, whatever a session makes of the number."""
    by = ["w", "cell", "at", "k"]
    return near.repartitionByRange(parts, *by).coalesce(parts).sortWithinPartitions(*by)


def _runs(batches: Iterator[pa.RecordBatch], of: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other and are alike in the numbers of, block of them at most."""
    held, n, last = [], 0, None
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(c).to_numpy() for c in of]
        starts = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in values], axis=0)) + 1).tolist() if of else []
        for i, end in zip([0, *starts], [*starts, len(batch)], strict=True):
            this = [x[i] for x in values]
            if held and this != last:
                yield whole()
                held, n = [], 0
            last = this
            while i < end:
                more = min(end - i, block - n)
                held.append(batch.slice(i, more))
                i, n = i + more, n + more
                if n == block:
                    yield whole()
                    held, n = [], 0
    if held:
        yield whole()


def _ends(x: np.ndarray) -> list[pa.Array]:
    """The least and the greatest of each column, as arrays of one list."""
    return [pa.array([e.tolist()], pa.list_(pa.float64())) for e in (x.min(axis=0), x.max(axis=0))]


def _tiers(left: DataFrame, right: DataFrame, verbatim: float, overlap: float, best: bool, block: int | None = None) -> DataFrame:
    """(a, b, sim, filter_type) of the pairs of unlike urls whose cosine reaches verbatim (dedup), or overlap where neither side is a roundup (content_overlap).

    With best, for each a only its greatest in a part of right, of equal ones the least b; else only those b whose pos is
    not above a's. Both rules hold where the products are made, so that of vectors of which each has a share of all near
    it, no more than that comes out.
    """
    if best:
        return _best(left, right, verbatim, overlap, block)
    kind = left.schema["url"].dataType.simpleString()
    place = F.coalesce(F.col("pos").cast("long"), F.lit(-(1 << 62)))
    keyed = lambda df: df.where("url IS NOT NULL").select(F.struct(F.col("url").alias("u"), F.coalesce("is_roundup", F.lit(False)).alias("f"), place.alias("p")).alias("key"), "embedding_vector")
    pairs = _pairs(keyed(left), keyed(right), min(verbatim, overlap), "key", "key", "embedding_vector", block or BLOCK, 1024)

    def opened(cell: pa.ListScalar) -> tuple:
        keys, m, size = _unit(cell)
        u, f, p = keys.flatten()
        return u, m, size, f.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False)

    def reached(a: tuple, b: tuple) -> np.ndarray:
        """The products of a's and b's rows, -inf where no rule takes the pair."""
        (_, ma, sa, fa, pa_), (_, mb, sb, fb, pb) = a, b
        width = max(ma.shape[1], mb.shape[1])
        sim = np.pad(ma, ((0, 0), (0, width - ma.shape[1]))) @ np.pad(mb, ((0, 0), (0, width - mb.shape[1]))).T
        if sa.min() != sb.max() or sa.max() != sb.min():
            sim = np.where(sa[:, None] == sb[None, :], sim, 0.0)
        least = np.where(fa[:, None] | fb[None, :], verbatim, min(verbatim, overlap)) if fa.any() or fb.any() else min(verbatim, overlap)
        sim[sim < least] = -np.inf
        sim[pb[None, :] > pa_[:, None]] = -np.inf
        return sim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, ()
        for batch in batches:
            for left_cell, right_cell in zip(batch.column("l"), batch.column("r"), strict=True):
                first = left_cell.values[0]["k"]["u"].as_py()
                if first != last:
                    last, a = first, opened(left_cell)
                b = opened(right_cell)
                sim = reached(a, b)
                i, j = np.nonzero(sim > -np.inf)
                if len(i):
                    unlike = pc.not_equal(a[0].take(pa.array(i)), b[0].take(pa.array(j))).to_numpy(zero_copy_only=False)
                    i, j = i[unlike], j[unlike]
                    yield _told(a[0].take(pa.array(i)), b[0].take(pa.array(j)), sim[i, j], verbatim)

    return pairs.mapInArrow(run, f"a {kind}, b {kind}, sim double, filter_type string")


def _told(a: pa.Array, b: pa.Array, sim: np.ndarray, verbatim: float) -> pa.RecordBatch:
    kinds = pa.DictionaryArray.from_arrays(pa.array((sim < verbatim).astype(np.int32)), ["dedup", "content_overlap"]).cast(pa.string())
    return pa.RecordBatch.from_arrays([a, b, pa.array(sim), kinds], names=["a", "b", "sim", "filter_type"])


def _packed(rows: DataFrame, kind: str, block: int, side: str, angles: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The rows of each part, of keys k (f, u) and vectors v, in blocks, written: id, arrays u, f and w (sizes) in the order of w, f and u, and the vectors at length 1 as bytes m. With angles, rows are as _dealt gives them, and blocks have those of one size n, with low and high, their angles to the pivots. All columns get side before their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, got in enumerate(_runs(batches, ["w", "cell"] if angles else [], block)):
            (f, u), (m, size) = got.column("k").flatten(), _units(got.column("v"))
            at = pc.array_sort_indices(u).to_numpy()
            at = at[np.lexsort((f.to_numpy(zero_copy_only=False)[at], size[at]))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), x) for x in (u.take(pa.array(at)), f.take(pa.array(at)), pa.array(size[at], pa.int32()))]
            vectors = m[at][np.arange(m.shape[1])[None, :] < size[at][:, None]].tobytes()
            ends = _ends(angles(m)) if angles else [pa.array([[]], pa.list_(pa.float64()))] * 2
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}/{i}"]), pa.array([m.shape[1]], pa.int32()), *ends, *lists, pa.array([vectors], pa.binary())], names=["id", "n", "low", "high", "u", "f", "w", "m"])

    got = cut(rows.mapInArrow(run, f"id string, n int, low array<double>, high array<double>, u array<{kind}>, f array<boolean>, w array<int>, m binary"))
    return got.select(*[F.col(c).alias(side + c) for c in got.columns])


def _best(left: DataFrame, right: DataFrame, verbatim: float, overlap: float, block: int | None) -> DataFrame:
    """What _tiers gives with best. A row an item and part of right leaves a task.

    Vectors of right that are the same meet once, under the least url. Else vectors are shuffled once a side, into parts
    whose tasks make the blocks. Blocks hold vectors as bytes, at most BYTES of them. Products are taken at single precision first: what may be a row's greatest so far, by the most that rounding
    can add, has its product taken again at double precision, which alone is compared and given.
    """
    kind = left.schema["url"].dataType.simpleString()
    floor = min(verbatim, overlap)
    flag = F.coalesce("is_roundup", F.lit(False)).alias("f")
    vector = F.col("embedding_vector").cast("array<double>").alias("v")
    one = left.where("url IS NOT NULL").select(F.struct(flag, F.col("url").alias("u")).alias("key"), vector)
    two = right.where("url IS NOT NULL").groupBy(vector, flag).agg(F.min("url").alias("u")).select(F.struct("f", "u").alias("key"), "v")
    two = cut(two)
    (n, wide), (m, wide2) = (df.agg(F.count("*"), F.max(F.size("v"))).first() for df in (one, two))
    block = block or min(WIDEST, max(64, BYTES // 8 // max(1, wide or 0, wide2 or 0)))
    n, m = (max(1, -(-x // block)) for x in (n, m))
    if floor <= 0 or n * m <= 1024:
        one, two = (df.select(F.col("key").alias("k"), "v").repartition(parts) for df, parts in ((one, min(SIDE, n)), (two, min(PARTS, m))))
        pairs = _met(_packed(one, kind, block, "l"), _packed(two, kind, block, "r"))
    else:
        one, two, angles = _celled(one, two, "key", "key", "v")
        a, b = _packed(_dealt(one, min(SIDE, n)), kind, block, "l", angles), _packed(_dealt(two, min(PARTS, m)), kind, block, "r", angles)
        pairs = _met(a, b, (F.col("ln") == F.col("rn")) & ~_apart(_far(floor), "llow", "lhigh", "rlow", "rhigh"))

    def runs(u: pa.Array, f: pa.Array, w: pa.Array, m: pa.Buffer) -> list[tuple]:
        """The rows of a block by size and flag: the first of them, urls, vectors at double and at single precision, flag."""
        f, w, m = f.to_numpy(zero_copy_only=False), w.to_numpy(), np.frombuffer(m)
        at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (f[1:] != f[:-1])])) if len(w) else []
        out, begin = [], 0
        for i, j in zip(at, [*at[1:], len(w)], strict=True):
            x = m[begin : begin + (j - i) * w[i]].reshape(j - i, w[i])
            begin += x.size
            out.append((i, u.slice(i, j - i), x, x.astype(np.float32), f[i]))
        return out

    def greatest(a: np.ndarray, a32: np.ndarray, b: np.ndarray, b32: np.ndarray, held: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, x): for rows of a whose greatest product with b is least and held at least, the first row of b that has it, and it."""
        if a.shape[1] != b.shape[1] or not a.shape[1]:
            i = np.flatnonzero(held <= 0.0) if least <= 0 else np.zeros(0, dtype=np.int64)
            return i, np.zeros_like(i), np.zeros(len(i))
        slack = (a.shape[1] + 8) * 1.2e-7
        sim = a32 @ b32.T
        top = sim.max(axis=1)
        low = np.maximum(np.maximum(held, least) - slack, top - 2 * slack).astype(np.float32)
        some = np.flatnonzero(top >= low)
        i, j = np.nonzero(sim[some] >= low[some, None])
        i = some[i]
        x = np.concatenate([np.zeros(0), *[(a[i[c : c + 65536]] * b[j[c : c + 65536]]).sum(axis=1) for c in range(0, len(i), 65536)]])
        at = np.flatnonzero(x >= least)
        at = at[np.lexsort((j[at], -x[at], i[at]))]
        at = at[np.unique(i[at], return_index=True)[1]]
        return i[at], j[at], x[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a, urls, x, b = None, [], pa.array([]), np.zeros(0), np.zeros(0, dtype=object)

        def done() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(x > -np.inf)
            if len(some):
                yield _told(urls.take(pa.array(some)), pa.array(b[some].tolist(), urls.type), x[some], verbatim)

        for batch in batches:
            for k in range(len(batch)):
                of = lambda side, c: batch.column(side + c)[k].as_buffer() if c == "m" else batch.column(side + c)[k].values  # noqa: B023, E731
                block_id = batch.column("lid")[k].as_py()
                if block_id != last:
                    yield from done()
                    last, urls = block_id, of("l", "u")
                    a, x, b = runs(urls, *[of("l", c) for c in "fwm"]), np.full(len(urls), -np.inf), np.full(len(urls), None, dtype=object)
                for _, theirs, mb, mb32, fb in runs(*[of("r", c) for c in "ufwm"]):
                    for begin, _, ma, ma32, fa in a:
                        for t in range(0, len(ma), ROWS):
                            at = slice(begin + t, begin + min(t + ROWS, len(ma)))
                            i, j, sim = greatest(ma[t : t + ROWS], ma32[t : t + ROWS], mb, mb32, x[at], verbatim if fa or fb else floor)
                            if not len(i):
                                continue
                            i, u = i + at.start, np.array([*theirs.take(pa.array(j)).to_pylist(), None], dtype=object)[:-1]
                            same = np.flatnonzero(sim == x[i])
                            new = sim > x[i]
                            new[same] = u[same] < b[i[same]]
                            x[i[new]], b[i[new]] = sim[new], u[new]
        yield from done()

    columns = ["lid", *[side + c for side in "lr" for c in "ufwm"]]
    return pairs.select(*columns).mapInArrow(run, f"a {kind}, b {kind}, sim double, filter_type string")


def window_match(items: DataFrame, window: DataFrame, verbatim: float = VERBATIM, overlap: float = OVERLAP) -> DataFrame:
    """(url, matched, sim, filter_type): for each item with a match, its best in the window (J2, O4). Of equal ones the least url, which is this engine's rule. A row an item and pair of blocks leaves the products at most."""
    best = _tiers(items, window, verbatim, overlap, True).groupBy("a").agg(F.min_by(F.struct("b", "sim", "filter_type"), F.struct(-F.col("sim"), F.col("b"))).alias("m"))
    return best.select(F.col("a").alias("url"), F.col("m.b").alias("matched"), "m.sim", "m.filter_type")


def nearest_topic(items: DataFrame, topics: DataFrame, key: str = "url", vector: str = "embedding_vector") -> DataFrame:
    """(key, best_tag, similarity_score) of each item: its nearest topic, of equal ones the least tag (J4). One row an item and block of topics leaves the product."""
    pairs = similar_pairs(items, topics, -2.0, key, "tag", vector, best=True)
    best = pairs.groupBy("a").agg(F.min_by(F.struct("b", "sim"), F.struct(-F.col("sim"), F.col("b"))).alias("m"))
    return best.select(F.col("a").alias(key), F.col("m.b").alias("best_tag"), F.col("m.sim").alias("similarity_score"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) by least labels that are passed along edges (a, b) and then along the labels' own labels, until none changes."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, path = carried(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label.node == near.a).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        up = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        after, new = carried(step.join(up, step.root == up.n2).select("node", F.least("root", "r2").alias("root"), "was"))
        drop(edges.sparkSession, path)
        path = new
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        label = after.select("node", "root")
    raise RuntimeError("labels did not settle")


#: Rows of a component up to which one task folds it, and rounds before the fold in any case.
MOST, ROUNDS = 20_000, 64
#: Rows of a slice of a run, and pairs up to which the next part of the run has twice as many slices.
SLICE, FEW = 8192, 250_000


def _fold(group: pa.Table) -> pa.Table:
    """The sequential pass over the rows of a component that have no state yet, by pos; gives them, and holders that they take over. Those with a state are holders (H) up to their death, or never were (N)."""
    holders: dict[str, dict] = {}
    out = []
    for r in sorted(group.to_pylist(), key=lambda r: r["pos"]):
        if r["state"] == "N":
            continue
        if r["state"] == "H":
            holders[r["url"]] = r
            continue
        alive = [(-n["sim"], holders[n["b"]]["slot"], n["b"], n) for n in r["near"] or () if n["b"] in holders and (holders[n["b"]]["death"] is None or holders[n["b"]]["death"] > r["pos"])]
        if not alive:
            holders[r["url"]] = r | {"slot": r["pos"]}
            continue
        _, slot, b, n = min(alive, key=lambda h: h[:2])
        takes = r["fetched_at"] < holders[b]["fetched_at"]
        gone, stays = (b, r["url"]) if takes else (r["url"], b)
        if takes:
            del holders[b]
            holders[r["url"]] = r | {"slot": slot}
        out.append({"url": gone, "kept": False, "matched": stays, "sim": n["sim"], "filter_type": n["filter_type"]})
    out += [{"url": u, "slot": h["slot"], "kept": True} for u, h in holders.items() if h["state"] is None]
    return pa.Table.from_pylist(out, schema=FOLDED)


def _folded(rows: DataFrame, own: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (url, pos, fetched_at, state, slot, death) after the pass, by component."""
    near = own.groupBy("a").agg(F.collect_list(F.struct("b", "sim", "filter_type")).alias("near"))
    j = rows.join(roots, F.col("url") == F.col("node")).drop("node").join(near, F.col("url") == F.col("a"), "left").drop("a")
    return j.groupBy("root").applyInArrow(_fold, "url string, slot long, kept boolean, matched string, sim double, filter_type string")


def _rounds(rows: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """rows (url, pos, fetched_at, state, slot, death) with state (H, N, or null where the rounds end before), slot, death, matched, sim and filter_type.

    A round decides, at once, every item of which what came before it says enough: all its earlier neighbours are gone,
    or the best of those that may still hold a slot is known to, and none that is not decided and stands between the two
    could take that slot over. The first item without a state always is such a one. A holder's death is the pos of the
    item that took its slot, so items before that still meet it.
    """
    place = rows.select("url", "pos", "fetched_at")
    earlier = own.join(place.select(F.col("url").alias("a"), F.col("pos").alias("pa"), F.col("fetched_at").alias("fa")), "a").join(place.select(F.col("url").alias("b"), F.col("pos").alias("pb"), F.col("fetched_at").alias("fb")), "b")
    earlier = cut(earlier.where("pb < pa").withColumn("takes", F.coalesce(F.col("fa") < F.col("fb"), F.lit(False))))
    none = F.lit(None)
    now, path = carried(rows.select("url", "pos", "fetched_at", "state", "slot", "death", none.cast("string").alias("matched"), none.cast("double").alias("sim"), none.cast("string").alias("filter_type")))
    for _ in range(ROUNDS):
        left = now.where("state IS NULL").select(F.col("url").alias("a"))
        if left.limit(most + 1).count() <= most:
            break
        asked = earlier.join(left, "a", "left_semi")
        taker = asked.where("takes").groupBy("b").agg(F.min("pa").alias("taker"))
        known = now.select(F.col("url").alias("b"), F.col("state").alias("sb"), F.col("slot").alias("slot_b"), F.col("death").alias("db"))
        alive = asked.join(known, "b").join(taker, "b", "left").where("sb IS NULL OR (sb = 'H' AND (db IS NULL OR db > pa))")
        best = alive.groupBy("a").agg(F.min_by(F.struct("b", "sb", "slot_b", "taker", "takes", "sim", "filter_type", "pa"), F.struct(-F.col("sim"), F.col("sb").isNotNull(), F.col("slot_b"))).alias("m"))
        told = left.join(best, "a", "left")
        sure = F.col("m.sb").isNotNull() & (F.col("m.taker").isNull() | (F.col("m.taker") >= F.col("m.pa")))
        told = cut(told.where(F.col("m").isNull() | sure))
        born = told.select(F.col("a").alias("u"), F.when(F.col("m").isNull() | F.col("m.takes"), "H").otherwise("N").alias("s"), F.col("m.takes").alias("t"), "m")
        dead = told.where("m.takes").select(F.col("m.b").alias("d"), F.struct("a", "m.pa", "m.sim", "m.filter_type").alias("by"))
        j = now.join(born, F.col("url") == F.col("u"), "left").join(dead, F.col("url") == F.col("d"), "left")
        new, lost, by = F.col("u").isNotNull(), F.col("s") == "N", F.col("by")
        pick = lambda name, mine: F.when(by.isNotNull(), by[mine]).when(lost, F.col("m")[name]).otherwise(F.col(name if name != "b" else "matched"))
        now, after = carried(j.select(
            "url", "pos", "fetched_at", F.when(new, F.col("s")).otherwise(F.col("state")).alias("state"),
            F.when(new, F.when(F.col("s") == "H", F.coalesce(F.when(F.col("t"), F.col("m.slot_b")), F.col("pos")))).otherwise(F.col("slot")).alias("slot"),
            F.when(by.isNotNull(), by["pa"]).otherwise(F.col("death")).alias("death"), pick("b", "a").alias("matched"), pick("sim", "sim").alias("sim"), pick("filter_type", "filter_type").alias("filter_type"),
        ))
        drop(rows.sparkSession, path)
        path = after
    return now


def _passed(bare: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """(url, slot, kept, matched, sim, filter_type) of the rows of bare (url, pos, fetched_at, state, slot, death) that the pass over those without a state decides or takes over. own: their pairs with those before them."""
    nodes = own.select(F.col("a").alias("node")).union(own.select(F.col("b").alias("node"))).distinct()
    if nodes.limit(most + 1).count() <= most:
        return _folded(bare, own, nodes.withColumn("root", F.lit(0)))
    roots = components(own)
    large = cut(roots.groupBy("root").count().where(F.col("count") > most).select("root"))
    if large.isEmpty():
        return _folded(bare, own, roots)
    far = roots.join(large, "root", "left_semi")
    in_far = cut(own.join(far.select(F.col("node").alias("a")), "a", "left_semi").select(*own.columns))
    done = _rounds(bare.join(far.select(F.col("node").alias("url")), "url", "left_semi"), in_far, most)
    open_ = done.where("state IS NULL").select(F.col("url").alias("a"))
    told = _folded(bare, own, roots.join(large, "root", "left_anti").select("node", "root"))
    final = done.where("state IS NOT NULL").select("url", F.when((F.col("state") == "H") & F.col("death").isNull(), F.col("slot")).alias("slot"), ((F.col("state") == "H") & F.col("death").isNull()).alias("kept"), "matched", "sim", "filter_type")
    if not open_.isEmpty():
        # what is left meets its decided neighbours once more; a holder that it takes over is one of theirs
        touched = cut(in_far.join(open_, "a", "left_semi").select("a", "b", "sim", "filter_type"))
        rest = cut(_folded(done.select("url", "pos", "fetched_at", "state", "slot", "death"), touched, components(touched)))
        final = rest.unionByName(final.join(rest.select("url"), "url", "left_anti"))
    return told.unionByName(final)


def greedy_dedup(items: DataFrame, verbatim: float = VERBATIM, overlap: float = OVERLAP, most: int = MOST, size: int = SLICE) -> DataFrame:
    """The items of a run with slot, kept, matched, sim and filter_type, as a sequential greedy pass over pos gives them.

    Each item in turn is compared with the survivors; the best match keeps its slot, but for an earlier fetched_at, when
    the item takes the slot over. A run of more than size items is taken in parts, in the order of pos, and a part's
    items meet each other and those that hold a slot when it begins, and not those that are gone by then: so the pairs
    grow with the items and not with their square, where each item is near to a share of all. A part has size items, or
    twice as many as the last one where that had few pairs. Only items that some pair joins can act on each other, so a
    part of over most such rows goes by connected component, in parallel; all other items survive as they are. A
    component of more than most rows is first decided in parallel rounds, until most of its rows at most are left, or
    for ROUNDS rounds, which only long chains of items that wait for each other outlast. items has url, pos,
    fetched_at, is_roundup and embedding_vector.
    """
    slices = -(-items.count() // size)
    ends = sorted(set(items.stat.approxQuantile("pos", [i / slices for i in range(1, slices)], 0.1 / slices))) if slices > 1 else []
    light = items.select("url", "pos", "fetched_at", "is_roundup", "embedding_vector")
    none = F.lit(None)
    open_ = light.withColumns({"state": none.cast("string"), "slot": none.cast("long")})
    held, path, told, at, step = open_.limit(0), None, [], 0, 1
    while at <= len(ends):
        then = min(at + step, len(ends) + 1)
        part = open_
        if at:
            part = part.where(F.col("pos") > ends[at - 1])
        if then <= len(ends):
            part = part.where((F.col("pos") <= ends[then - 1]) | (F.col("pos").isNull() if not at else F.lit(False)))
        whole = part.unionByName(held) if at else part
        own = cut(_tiers(part, whole, verbatim, overlap, False))
        told.append(cut(_passed(whole.select("url", "pos", "fetched_at", "state", "slot", none.cast("long").alias("death")), own, most).withColumn("at", F.lit(at))))
        old, path = path, None
        if then <= len(ends):
            new = told[-1].select(F.col("url").alias("u"), F.col("kept").alias("k"), F.col("slot").alias("s"))
            held, path = carried(whole.join(new, F.col("url") == F.col("u"), "left").where("k IS NULL OR k").select(*light.columns, F.lit("H").alias("state"), F.coalesce("s", "slot", F.col("pos").cast("long")).alias("slot")))
            step = 2 * step if own.count() <= FEW else max(1, step // 2)
        drop(items.sparkSession, old)
        at = then
    last = told[0]
    for x in told[1:]:
        last = last.unionByName(x)
    fields = ["slot", "kept", "matched", "sim", "filter_type"]
    last = last.groupBy(F.col("url").alias("u")).agg(F.max_by(F.struct(*fields), "at").alias("m")).select("u", *[F.col("m")[c].alias(c) for c in fields])
    joined = items.join(last, F.col("url") == F.col("u"), "left").drop("u")
    return joined.withColumns({"kept": F.coalesce("kept", F.lit(True)), "slot": F.when(F.coalesce("kept", F.lit(True)), F.coalesce("slot", F.col("pos")))})
