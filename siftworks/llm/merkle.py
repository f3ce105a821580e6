"""Merkle manifest of a dataset: a tree of leaf hashes for each source, a tree of their roots, and a proof for each row.

A forest is a set of nodes, keyed by tree, level and index, whose run of siblings is not complete. Two forests unite by
their nodes, and as soon as a run is complete, which is known as trees' sizes are, its hash takes its place, a level up.
That is associative and has the empty forest as identity, so partitions of rows, each a stretch of the order, are turned
into forests, of some nodes a level, and these are merged by a treeReduce. A proof needs the siblings along a row's path:
those that a partition doesn't have come to it by a join with the nodes that others left open and that merging made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Rows of a partition, about. The driver gets a node or less for each partition and level.
PART_ROWS = 1 << 16
#: The tree of the sources' roots.
TOP = -1
NODES = "tree long, total long, level int, at long, digest string"


def leaf(fields: Mapping[str, Column] | Sequence[str]) -> Column:
    """The hash of a row: of all fields in turn, each as its UTF-8 byte count, a colon and its text, or - for null."""
    cols = list(fields.values()) if isinstance(fields, Mapping) else [F.col(f"`{f}`") for f in fields]
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf hash and a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def _hash(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Unresolved nodes by (tree, level, index), with their trees' leaf counts; made are the nodes that completed runs have given."""

    def __init__(self, trees: int, arity: int) -> None:
        self.trees, self.arity = trees, arity
        self.open: dict[tuple[int, int, int], tuple[int, str]] = {}
        self.made: list[tuple[int, int, int, int, str]] = []

    def width(self, total: int, level: int) -> int:
        return -(-total // self.arity**level)

    def run(self, total: int, level: int, at: int) -> range:
        """The indices of a node's run of siblings, itself included."""
        first = at - at % self.arity
        return range(first, min(first + self.arity, self.width(total, level)))

    def add(self, tree: int, total: int, level: int, at: int, digest: str) -> None:
        while True:
            if tree != TOP and self.width(total, level) == 1:
                tree, total, level, at = TOP, self.trees, 0, tree
                self.made.append((tree, total, level, at, digest))
                continue
            self.open[tree, level, at] = (total, digest)
            run = self.run(total, level, at)
            if self.width(total, level) == 1 or any((tree, level, i) not in self.open for i in run):
                return
            digest = _hash([self.open.pop((tree, level, i))[1] for i in run])
            level, at = level + 1, at // self.arity
            self.made.append((tree, total, level, at, digest))

    def merge(self, other: Forest) -> Forest:
        a, b = (self, other) if len(self.open) >= len(other.open) else (other, self)
        a.made += b.made
        for (tree, level, at), (total, digest) in b.open.items():
            a.add(tree, total, level, at, digest)
        return a

    def up(self, tree: int, total: int, level: int, at: int) -> tuple[int, int, int, int] | None:
        """The node above one, where a source's root is the same as its leaf of the top tree; none above the root."""
        if self.width(total, level) > 1:
            tree, total, level, at = tree, total, level + 1, at // self.arity
        elif tree == TOP:
            return None
        if tree != TOP and self.width(total, level) == 1:
            return TOP, self.trees, 0, tree
        return tree, total, level, at


def _nodes(rows: pa.Table, trees: int, arity: int) -> tuple[Forest, dict[tuple[int, int, int], str]]:
    """The forest of a partition's rows, and all nodes that they give, leaves included."""
    forest = Forest(trees, arity)
    have = {}
    for k, total, i, d in zip(*(rows.column(c).to_pylist() for c in ("k", "total", "i", "leaf")), strict=True):
        have[k, 0, i] = d
        forest.add(k, total, 0, i, d)
    have.update({(t, lv, at): d for t, _, lv, at, d in forest.made})
    return forest, have


def _start(forest: Forest, k: int, total: int, i: int) -> tuple[int, int, int, int]:
    """A leaf as a node; the leaf of a source of one row is its root."""
    return (TOP, forest.trees, 0, k) if total == 1 else (k, total, 0, i)


_FRAGMENT = pa.schema([("part", pa.int32()), ("open", pa.bool_()), ("tree", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())])


def _fragment(rows: pa.Table, trees: int, arity: int) -> pa.Table:
    """A partition's open nodes, and the siblings on its rows' paths that it doesn't have."""
    forest, have = _nodes(rows, trees, arity)
    part = rows.column("part")[0].as_py()
    out = [(part, True, t, total, lv, at, d) for (t, lv, at), (total, d) in forest.open.items()]
    path = {_start(forest, *r) for r in zip(*(rows.column(c).to_pylist() for c in ("k", "total", "i")), strict=True)}
    needs = set()
    while path:
        needs.update((t, total, lv, i) for t, total, lv, at in path for i in forest.run(total, lv, at) if i != at and (t, lv, i) not in have)
        path = {u for n in path if (u := forest.up(*n))}
    out += [(part, False, *n, None) for n in sorted(needs)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FRAGMENT.types, strict=True)], schema=_FRAGMENT)


_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def _proofs(rows: pa.Table, outer: pa.Table, kept: list[str], trees: int, arity: int) -> pa.Table:
    """kept, leaf, height, subroot and proof of a partition's rows. Steps above a node are worked out once for rows that share it and follow each other."""
    rows = rows.sort_by([("k", "ascending"), ("i", "ascending")])
    forest, have = _nodes(rows, trees, arity)
    have.update({(t, lv, at): d for t, lv, at, d in zip(*(outer.column(c).to_pylist() for c in ("tree", "level", "at", "digest")), strict=True)})
    steps: dict[tuple[int, int], tuple[int, tuple[str, str]]] = {}
    left, right, ends, heights, roots, at_tree, root = [], [], [0], [], [], None, ""
    for k, total, i, d in zip(*(rows.column(c).to_pylist() for c in ("k", "total", "i", "leaf")), strict=True):
        node, height = _start(forest, k, total, i), 0
        begin = len(left)
        while node:
            t, size, lv, at = node
            if forest.width(size, lv) > 1:
                kept_at, step = steps.get((t, lv), (None, None))
                if kept_at != at:
                    run = forest.run(size, lv, at)
                    step = "".join([have[t, lv, x] for x in run if x < at]), "".join([have[t, lv, x] for x in run if x > at])
                    steps[t, lv] = at, step
                left.append(step[0])
                right.append(step[1])
                height += t != TOP
            node = forest.up(*node)
        if k != at_tree:
            at_tree, root = k, d
            for x in range(begin, begin + height):
                root = _hash((left[x], root, right[x]))
            steps = {key: v for key, v in steps.items() if key[0] in (TOP, k)}
        ends.append(len(left))
        heights.append(height)
        roots.append(root)
    proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_STEP)))
    names = [*kept, "leaf", "height", "subroot", "proof"]
    return pa.Table.from_arrays([*[rows.column(c) for c in kept], rows.column("leaf"), pa.array(heights, pa.int32()), pa.array(roots, pa.string()), proof], names=names)


def _ordered(docs: DataFrame, fields: Sequence[str], tree_col: str, id_col: str, carry: Mapping[str, Column]) -> tuple[DataFrame, int]:
    """(part, k, total, i, id, tree, leaf and carry) of each row, and the number of trees: tree k, in the order of trees, has total leaves, and the row is leaf i.

    Rows are ranged by tree, id and leaf, so that a part is a stretch of the order; parts' counts, a row for each part
    and tree in it, say where each begins.
    """
    spark = docs.sparkSession
    cols = [F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(fields).alias("leaf"), F.monotonically_increasing_id().alias("row")]
    leaves, _ = written(docs.select(*cols, *[c.alias(n) for n, c in carry.items()]), "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PART_ROWS))
    by = [F.col(c).asc_nulls_first() for c in ("tree", "id", "leaf", "row")]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "at": place}).drop("row")
    ranged, _ = written(ranged, "ranged")
    tree = Window.partitionBy("tree")
    runs = ranged.groupBy("part", "tree").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "tree", "first", F.sum("n").over(tree).alias("total"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), (F.col("part") == F.min("part").over(tree)).cast("long").alias("new"))
    runs, _ = written(runs, "runs")
    begun = runs.groupBy("part").agg(F.sum("new").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    begun = begun.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("from"))
    upto = Window.partitionBy("part").orderBy(F.col("tree").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    plan = runs.join(F.broadcast(begun), F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("tree").alias("t"), "first", "total", "start", (F.col("from") + F.sum("new").over(upto) - 1).alias("k"))
    plan, path = written(plan, "plan")
    trees = (plan.agg(F.max("k")).first()[0] or 0) + 1
    j = ranged.join(small(plan, path), (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return j.select("part", "k", "total", (F.col("start") + F.col("at") - F.col("first")).alias("i"), "id", "tree", "leaf", *carry), trees


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree_col: str = "source", id_col: str = "doc_id", arity: int = ARITY, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: id, tree, the columns of carry, leaf, height, subroot, proof and root.

    Trees stand in the order of their UTF-8 bytes, null first; leaves by id, null first, then by leaf, so that rows
    that repeat an id have an order; rows alike in all fields are interchangeable. Texts are hashed where they are and
    go no further. proof has a struct of the hashes to the left and right, joined, for each level, sources' levels first, as many as
    height; folded() of leaf and proof is root. Columns of docs besides the fields, whatever their names, change
    nothing. An empty table gives an empty one.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    spark, carry = docs.sparkSession, dict(carry or {})
    rows, trees = _ordered(docs, fields, tree_col, id_col, carry)
    names = ["id", "tree", *carry]

    def fragment(group: pa.Table) -> pa.Table:
        return _fragment(group, trees, arity)

    found = rows.select("part", "k", "total", "i", "leaf").groupBy("part").applyInArrow(fragment, f"part int, open boolean, {NODES}")
    found, _ = written(found, "forests")

    def forest(nodes: Iterable) -> list[Forest]:
        out = Forest(trees, arity)
        for n in nodes:
            out.add(*n)
        return [out]

    nodes = found.where("open").select("tree", "total", "level", "at", "digest")
    whole = nodes.rdd.map(tuple).mapPartitions(forest).treeReduce(Forest.merge, depth=3)
    root = next((d for (t, lv, _), (total, d) in whole.open.items() if t == TOP and whole.width(total, lv) == 1), None)
    made = spark.createDataFrame(whole.made, NODES) if whole.made else nodes.limit(0)
    edges = nodes.union(made).select("tree", "level", "at", "digest").distinct()
    outer = found.where("NOT open").select("part", "tree", "level", "at").join(edges, ["tree", "level", "at"]).select("part", "tree", "level", "at", "digest")

    def proofs(group: pa.Table, outside: pa.Table) -> pa.Table:
        return _proofs(group, outside, names, trees, arity)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    told = rows.groupBy("part").cogroup(outer.groupBy("part")).applyInArrow(proofs, f"{kinds}, leaf string, height int, subroot string, proof array<struct<left:string,right:string>>")
    return told.withColumn("root", F.lit(root))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, where every other row, by the checksum of its id, has lost the line ends of its text."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    fields = {f: F.col(f) for f in FIELDS}
    other = leaf(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    got = manifest(docs.select(*FIELDS), carry={"told": F.when(tampered, other)})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    got = got.withColumn("folded_root", folded(F.coalesce("told", "leaf"), F.col("proof")))
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
