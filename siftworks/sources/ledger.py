"""What models have said, kept by a digest of what they were asked (L1, L3-L9): no question is paid for twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.context import RunContext
from siftworks.operators.cut import cut
from siftworks.sources.store import TableStore


class Ledger:
    def __init__(self, store: TableStore, ctx: RunContext) -> None:
        self.store, self.ctx = store, ctx

    def ask(self, model: str, rows: DataFrame, key: list[str], inputs: list[Column], answer: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """key, the columns of answer, __known (it was in the ledger) and __error (null), for each answer to a row, and key and __error for each row of which call gives an error.

        What a row asks is inputs; rows that ask the same are one question. Those without an answer in the ledger go to
        call, which gives key and answer; a row may have several answers or none, and one without any is asked again the
        next time. Where call also gives error, a row of it that isn't null is no answer. Answers are kept before this
        returns, so what fails afterwards does not lose them.
        """
        marked = cut(rows.withColumn("__digest", F.sha2(F.concat_ws("\x1f", F.lit(model), F.to_json(F.struct(*[c.alias(f"i{i}") for i, c in enumerate(inputs)]))), 256)))
        kept = self.store.read("model_answers").where(F.col("model") == model).select(F.col("digest").alias("__digest"), "answers")
        known = cut(marked.select("__digest").distinct().join(kept, "__digest").withColumn("__known", F.lit(True)))
        fresh = marked.join(known, "__digest", "left_anti").dropDuplicates(["__digest"])
        names = [c.split()[0] for c in answer.split(", ")]
        errors = None
        if not fresh.isEmpty():
            fresh = cut(fresh)
            said = cut(call(fresh.drop("__digest")))
            if "error" in said.columns:
                errors, said = said.where("error IS NOT NULL"), said.where("error IS NULL")
            each = fresh.select(*key, "__digest").join(said.select(*key, F.struct(*names).alias("a")), key)
            new = cut(each.groupBy("__digest").agg(F.to_json(F.array_sort(F.collect_list("a"))).alias("answers")).withColumn("__known", F.lit(False)))  # one model's answers to one question
            self.store.upsert("model_answers", new.select(F.lit(model).alias("model"), F.col("__digest").alias("digest"), "answers", F.lit(self.ctx.run_id).alias("run_id"), F.lit(self.ctx.now_iso()).alias("answered_at")))
            known = known.unionByName(new)
        told = marked.select(*key, "__digest").join(known, "__digest").select(*key, "__known", F.explode(F.from_json("answers", f"array<struct<{_fields(answer)}>>")).alias("a"))
        told = told.select(*key, *[F.col("a")[n].alias(n) for n in names], "__known")
        told = told.withColumn("__error", F.lit(None).cast("string"))
        return told if errors is None else told.unionByName(errors.select(*key, F.col("error").alias("__error")), allowMissingColumns=True)

    def ask_whole(self, model: str, asked: list[DataFrame], answer: str, call: Callable[[], DataFrame]) -> DataFrame:
        """The rows of call, a model's answer to all rows of some tables together, which are the question."""
        one = self.store.spark.createDataFrame([(digest(*asked),)], "question string")
        return self.ask(model, one, ["question"], [F.col("question")], answer, lambda q: q.crossJoin(call())).select(*[c.split()[0] for c in answer.split(", ")])  # one question


def _fields(answer: str) -> str:
    return ",".join(":".join(c.split(" ", 1)) for c in answer.split(", "))


def digest(*tables: DataFrame) -> str:
    """A digest of the rows of tables, whatever their order; rows that come twice count twice."""
    parts = []
    for t in tables:
        h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(t.columns)]), {"ignoreNullFields": "false"}))
        parts.append(str(tuple(t.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))).first())))
    return "/".join(parts)
