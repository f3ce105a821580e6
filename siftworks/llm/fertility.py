"""Quality rules: repetition counts, and the fertility of a public tokeniser with rejection bands per language or script."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, worker_state, written

VOCABULARY = "piece_bpe_32k.model"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
KEPT_WORDS, KEPT_BYTES = 250_000, 48
MIN_WORDS = 20
MAX_REPEAT = 30


def repeat_words(ids: np.ndarray, n: int = 8) -> int:
    """Words in n-word windows (n a power of two) that occur twice or more; ids number the words. Windows are numbered exactly, by doubling."""
    if len(ids) <= n:
        return 0
    now, span = ids.astype(np.int64), 1
    while span < n:
        pair = now[:-span] * (now.max() + 1) + now[span:]
        _, now = np.unique(pair, return_inverse=True)
        if now.max() + 1 == len(now):
            return 0
        span *= 2
    again = np.bincount(now)[now] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:-n][again] += 1
    edge[n:][again[: len(edge) - n]] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def script(text: str) -> str:
    """The script of the first letters of all words of a text, by the first word of the letters' names; the most frequent, or "none"."""
    seen: dict[str, int] = {}
    for c, n in Counter([w[0] for w in text.split()]).items():
        if c.isalpha():
            name = "LATIN" if c < "ɐ" else unicodedata.name(c, "OTHER").split(" ", 1)[0]
            seen[name] = seen.get(name, 0) + n
    return max(sorted(seen), key=seen.__getitem__).lower() if seen else "none"


class Measure:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.kept: dict[bytes, bytes] = {}

    def _pieces(self, split: list[list[bytes]]) -> list[np.ndarray]:
        new = list({w for ws in split for w in ws if w not in self.kept})
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept = {}
            new = list({w for ws in split for w in ws})
        more = {w: np.array(p, dtype="<u2").tobytes() for w, p in zip(new, self.model.encode([w.decode() for w in new], num_threads=1), strict=True)} if new else {}
        self.kept.update(more)
        out = [np.frombuffer(b"".join([self.kept[w] for w in ws]), dtype="<u2") for ws in split]
        for w in more:
            if len(w) > KEPT_BYTES:
                del self.kept[w]
        return out

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """The columns of MEASURES for each text; a null text counts as an empty one."""
        texts = [t or "" for t in texts]
        split = [t.encode().split() for t in texts]
        out = []
        for t, ws, pieces in zip(texts, split, self._pieces(split), strict=True):
            numbers: dict[bytes, int] = {}
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in ws], dtype=np.int64)
            lines = t.split("\n")
            full = [x for x in lines if x.strip(SPACES)] if len(set(lines)) < len(lines) else []
            n = len(pieces)
            counts = np.bincount(pieces) if n else np.zeros(1)
            p = counts[counts > 0] / max(n, 1)
            chars = len(t) - sum(map(t.count, SPACES))
            out.append((
                len(ws), chars, sum(map(t.count, SYMBOLS)), len(full) - len(set(full)), repeat_words(ids) if len(numbers) < len(ws) else 0, script(t),
                n, chars / n if n else 0.0, float(self.byte[pieces].mean()) if n else 0.0, float(-(p * np.log2(p)).sum()) if n else 0.0,
            ))
        return out


MEASURES = pa.schema([
    *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("script", pa.string()), ("n_pieces", pa.int64()),
    *((n, pa.float64()) for n in ("chars_per_piece", "byte_share", "entropy")),
])
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_pieces long, chars_per_piece double, byte_share double, entropy double"


def measure(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """The columns of carry and of MEASURES for each row of docs. model: a sentencepiece file, the same path on all workers."""
    kept = docs.select(*[F.col(f"`{c}`") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        file = model or public_tokenizers.path(VOCABULARY)
        m = worker_state(f"measure {file}", lambda: Measure(file))
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = m.rows(part.column(part.num_columns - 1).to_pylist())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MEASURES.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*part.schema.names[:-1], *MEASURES.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).cast("string").alias("__sw_text")).mapInArrow(run, f"{fields}, {MEASURED}")


#: Spreads (interquartile ranges / 1.349) from the median of its group that a measure may lie, either way; that both
#: together may lie below; the least spreads; the byte-fallback share above the group's median; documents that a group needs.
FARTHEST, FARTHEST_SUM, LEAST_SPREAD, MORE_BYTES, GROUP = 7.0, -7.0, {"chars_per_piece": 0.02, "entropy": 0.05}, 0.2, 50


#: Bits by which entropy may grow with a doubling of the pieces; divided by FARTHEST, the spread that a class away adds.
BITS = 1.0
#: The bands of a row, first to last: columns besides the length class, and the classes either way that are pooled; None pools all lengths.
LEVELS = (("lang", 0), ("script", 0), ("lang", 1), ("lang", 2), ("script", 1), ("script", 2), ("lang", None), ("script", None), (None, None))


def bands(measures: DataFrame, by: str | None, width: int | None, least: int = GROUP) -> DataFrame:
    """k, l, and band, the median and spread of the measures, for each value of by and length class (a power of two of pieces) with that many rows in the classes up to width away. Rows that fail the base rules don't count.

    Where classes are pooled, the spread of the entropy is at least what BITS a class makes, since entropy grows with length.
    """
    more = {"chars_per_piece": 0.0, "entropy": (7 if width is None else width) * BITS / FARTHEST}

    def q(c: str) -> tuple:
        three = F.percentile_approx(c, [0.25, 0.5, 0.75], 2000)
        return three[1].alias(c), F.greatest((three[2] - three[0]) / 1.349, F.lit(LEAST_SPREAD[c] + more[c])).alias(f"{c}_s")

    rows = measures.where("NOT base_failed").withColumn("k", F.col(by) if by else F.lit("")).where("k IS NOT NULL")
    at = F.lit(0) if width is None else F.col("length_class") if width == 0 else F.explode(F.sequence(F.col("length_class") - width, F.col("length_class") + width))
    groups = rows.withColumn("l", at).groupBy("k", "l")
    got = groups.agg(F.count("*").alias("n"), *q("chars_per_piece"), *q("entropy"), F.percentile_approx("byte_share", 0.5, 2000).alias("byte_share")).where(F.col("n") >= least)
    return got.select("k", "l", F.struct("chars_per_piece", "chars_per_piece_s", "entropy", "entropy_s", "byte_share").alias("band"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """carry and the columns of MEASURES, base_failed and kept for each row of docs.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that the text repeats. kept: not
    base_failed, and the tokeniser's measures lie in the band of the row's language and length class; where that
    language has too few rows of the class, in the band of its script; then of the language and of the script over
    the classes one and two away; then over all lengths; at last in the band of all rows, however few. Bands come from medians and quartiles over all rows, so junk of less than half a group does not move them. Null
    texts count as empty, null languages go by script; rows that repeat are judged each. An empty table gives an empty
    one. A carried column of the name of a measure, base_failed or kept is replaced; others may have any names.
    """
    lang, held = "__sw_lang", [c for c in carry if c not in (*MEASURES.names, "base_failed", "kept")]
    at = [f"__sw_c{i}" for i in range(len(held))]
    named = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(held, at, strict=True)], F.col(f"`{lang_col}`").cast("string").alias(lang), F.col(f"`{text_col}`").alias("__sw_in"))
    got = measure(named, "__sw_in", (*at, lang), model)
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    got = got.withColumns({"base_failed": failed, "length_class": F.floor(F.log2(F.greatest("n_pieces", F.lit(1)))).cast("int")})
    got, _ = written(got, "measures")
    combos, _ = written(got.where("NOT base_failed").select(lang, "script", "length_class").distinct(), "combos")
    chosen = combos.withColumn("band", F.lit(None).cast("struct<chars_per_piece:double,chars_per_piece_s:double,entropy:double,entropy_s:double,byte_share:double>"))
    for kind, width in LEVELS:
        by = {"lang": lang, "script": "script", None: None}[kind]
        level, path = written(bands(got, by, width, GROUP if by else 1), "bands")
        level = level.withColumnsRenamed({"band": "__sw_band"})
        key = F.col(by) if by else F.lit("")
        chosen = chosen.join(small(level, path), (key == F.col("k")) & ((F.lit(0) if width is None else F.col("length_class")) == F.col("l")), "left")
        chosen = chosen.withColumn("band", F.coalesce("band", "__sw_band")).drop("k", "l", "__sw_band")
    chosen, path = written(chosen.select(F.col(lang).alias("__sw_l"), F.col("script").alias("__sw_s"), F.col("length_class").alias("__sw_c"), "band"), "chosen")
    out = got.join(small(chosen, path), F.col(lang).eqNullSafe(F.col("__sw_l")) & (F.col("script") == F.col("__sw_s")) & (F.col("length_class") == F.col("__sw_c")), "left")
    a, b = ((F.col(c) - F.col("band")[c]) / F.col("band")[f"{c}_s"] for c in LEAST_SPREAD)
    fits = (F.abs(a) <= FARTHEST) & (F.abs(b) <= FARTHEST) & (a + b >= FARTHEST_SUM) & (F.col("byte_share") <= F.col("band")["byte_share"] + MORE_BYTES)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False))).select(*[F.col(a).alias(c) for c, a in zip(held, at, strict=True)], *MEASURES.names, "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that judge keeps, with docs' columns. Columns that clash with the measures' names are kept as they are."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"__sw_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"__sw_c{i}" for i, c in enumerate(docs.columns)}
    kept = judge(renamed, at[text_col], at[lang_col], tuple(at.values())).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])
