"""Quality classifier without labels: overlapping heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing. Only the number of documents with each pattern of votes matters to the
labellers' accuracies, and there are at most 3 ^ labellers patterns, however large the corpus: all documents are
counted, and the maximisation runs on that table. Its posteriors are the soft labels of a bounded sample of documents,
which trains a linear scorer on hashed word and shape features; the scorer then scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state, written

#: P(vote | class) at the start and as four pseudo-votes: rows bad and good, columns bad and good.
START = np.array([[0.3, 0.7], [0.005, 0.995]])
LABELLERS = ("symbols", "capitals", "bars", "exclaims", "repeats", "sentences", "length", "variety", "function_words")
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset((
    "the of and to in a is that it for was on are as with by be this at from or an have not but they which "
    "der die das und ist von zu den mit nicht ein eine dem des sich auf auch als für es im war "
    "le la les de des et est un une du en que qui dans pour pas sur plus par au ce il "
    "el los las del y en por con para una su al lo como más pero se"
).split())
#: Distinct texts that train the scorer: those with the least hashes. Buckets of features.
SAMPLE, BUCKETS = 6_000, 1 << 14
KEPT_WORDS, KEPT_CHARS = 200_000, 32


def character_kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, and 2 more if it is a capital."""
    return np.array([c.isalpha() + 2 * c.isupper() for c in map(chr, range(0x110000))], dtype=np.uint8)


def votes(text: str) -> list[int]:
    """1 for good, 0 for bad and -1 for no vote, of each labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1, -1, -1, -1, -1, -1, 0, -1, -1]
    kinds = worker_state("character kinds", character_kinds)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    letters, capitals = np.count_nonzero(kinds & 1), np.count_nonzero(kinds & 2)
    chars = sum(map(len, words))

    def pick(x: float, good: float, bad: float) -> int:
        return 1 if x <= good else 0 if x >= bad else -1

    stops = sum(w[-1] in ".,!?;:" for w in words) / n
    known = sum(w.lower().strip(".,!?;:") in FUNCTION_WORDS for w in words) / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [
        pick(sum(map(text.count, "#*$%&|<>")) / chars, 0.005, 0.03),
        pick(capitals / max(letters, 1), 0.08, 0.25) if n >= 8 else -1,
        pick(words.count("|") / n, 0.0, 0.03),
        pick(sum(w.endswith("!!") for w in words) / n, 0.01, 0.05),
        pick(same, 0.03, 0.1),
        -1 if n < 8 else 1 if 0.04 <= stops <= 0.4 else 0 if stops < 0.005 or stops > 0.7 else -1,
        1 if n > 60 else -1,
        -1 if n < 60 else pick(-len(set(words)) / n, -0.25, -0.12),
        1 if known >= 0.05 else 0 if known < 0.01 and n > 20 else -1,
    ]


def accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, np.ndarray]:
    """The share of good documents and, for each labeller, P(vote | class) over bad and good votes among those cast; from counted vote patterns.

    Labellers are taken as independent given the class. The start is that of specialists, each of which sees few kinds
    of bad document but seldom blames a good one; so that one sure vote can outweigh the others' good votes.
    """
    v = np.array([p for p, _ in patterns], dtype=int)
    c = np.array([n for _, n in patterns], dtype=float)
    prior, right = 0.85, np.repeat(START[None], v.shape[1], axis=0)
    for _ in range(rounds):
        good = posterior(v, prior, right)
        prior = float(np.clip((c * good).sum() / c.sum(), 0.02, 0.98))
        for j in range(v.shape[1]):
            for k, w in enumerate((c * (1 - good), c * good)):
                cast = np.array([w[v[:, j] == x].sum() for x in (0, 1)]) + 4 * START[k]
                right[j, k] = cast / cast.sum()
    return prior, right


def posterior(v: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    odds = np.full(len(v), math.log(prior / (1 - prior)))
    for j in range(v.shape[1]):
        ratio = np.log(right[j, 1] / right[j, 0])
        odds += np.where(v[:, j] >= 0, ratio[np.maximum(v[:, j], 0)], 0.0)
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


RUN = re.compile(r"(.)\1+")


def features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its shape: letter cases and digits as A, a and 0, other characters as they are, runs as one."""
    shape = RUN.sub(r"\1", "".join("a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch for ch in word[:KEPT_CHARS]))
    return zlib.crc32(b"w" + word.lower().encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"s" + shape.encode("utf-8", "surrogatepass")) % BUCKETS


def sparse(text: str) -> tuple[list[int], list[float]]:
    """The buckets of a text's words and shapes, and the scaled mean of each; none for a text without words."""
    words = text.split()
    seen: dict[int, int] = {}
    for w in words:
        for b in features(w):
            seen[b] = seen.get(b, 0) + 1
    return list(seen), [SCALE * n / len(words) for n in seen.values()]


def train(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over rows as of sparse; Adam on all rows at once."""
    at_ = np.array([b for r in rows for b in r[0]], dtype=int)
    val_ = np.array([v for r in rows for v in r[1]], dtype=float)
    row_ = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, bias = np.zeros(BUCKETS), 0.0
    m, s, mb, sb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    weight = 1 + 2 * (1 - labels)  # bad documents are few
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row_, w[at_] * val_, len(rows)) + bias, -60, 60)))
        err = (p - labels) * weight / weight.sum()
        g, gb = np.bincount(at_, err[row_] * val_, BUCKETS) + decay * w, err.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        w -= rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= rate * 0.2 * (mb / (1 - 0.9**t)) / (math.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


SCALE = 10.0


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, posterior (of the labellers' votes), score (of the scorer, from 0 to 1) and kept (score of one half at least) of each row.

    A null text counts as an empty one, whose score is 0. Rows that repeat
    are scored each; null ids stay null. An empty table gives an empty one. sample bounds the texts that train the
    scorer: that many distinct ones, of the least hashes, and of each only its counted features reach the driver, at
    most BUCKETS of them. All else covers every row.
    """
    two = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = two.schema["id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(i, 256).to_pylist()
                code = ["".join({0: "0", -1: "1", 1: "2"}[v] for v in votes(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(code)], names=["votes"])

    counted, _ = written(two.select("text").mapInArrow(vote, "votes string").groupBy("votes").count(), "votes")
    patterns = [(tuple({"0": 0, "1": -1, "2": 1}[c] for c in r.votes), r["count"]) for r in counted.orderBy("votes").collect()]
    if not patterns:
        return two.select(F.col("id").alias(id_col), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    prior, right = accuracies(patterns)
    hashed = two.select(F.xxhash64("text").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    fit = hashed.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, value = zip(*map(sparse, texts), strict=True) if texts else ((), ())
            cols = [batch.column(0), pa.array(map(votes, texts), pa.list_(pa.int8())), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "votes", "at", "value"])

    chosen = sorted(fit.mapInArrow(told, "h long, votes array<tinyint>, at array<int>, value array<float>").toArrow().to_pylist(), key=lambda r: r["h"])
    labels = posterior(np.array([r["votes"] for r in chosen], dtype=int).reshape(-1, len(LABELLERS)), prior, right)
    chosen = [(r["at"], r["value"]) for r in chosen]
    weights, bias = train(chosen, labels)

    told_by = zlib.crc32(weights.tobytes()), bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = worker_state("weights", dict)  # of the last scorer alone, so that a worker keeps no more than one
        if last.get("of") != told_by:
            last.clear()
            last |= {"of": told_by, "kept": {}}
        kept = last["kept"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                out = []
                for t in texts:
                    words = t.split()
                    total = 0.0
                    for w in words:
                        x = kept.get(w)
                        if x is None:
                            a, b = features(w)
                            x = weights[a] + weights[b]
                            if len(w) <= KEPT_CHARS and len(kept) < KEPT_WORDS:
                                kept[w] = x
                        total += x
                    out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, bias + SCALE * total / len(words))))) if words else 0.0)
                post = posterior(np.array([votes(t) for t in texts], dtype=int).reshape(-1, len(LABELLERS)), prior, right)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(post), pa.array(out, pa.float64())], names=["id", "posterior", "score"])

    scored = two.mapInArrow(score, f"id {kind}, posterior double, score double")
    return scored.select(F.col("id").alias(id_col), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
