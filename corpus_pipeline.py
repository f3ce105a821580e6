"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token records.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and all but the last return the
columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next;
what a stage left there besides, and the rows before it, are deleted when its own are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftworks.llm.common import PATHS, documents, drop_written, table, written
from siftworks.llm.decontam import decontaminate
from siftworks.llm.fertility import quality_filter
from siftworks.llm.mixing import mix
from siftworks.llm.records import token_records
from siftworks.llm.similar import drop_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's bands go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more link."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents taken twice are two rows, and those that a block's end cuts keep the words taken."""
    return mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Record files of token ids with their index; a row for each record as read back."""
    return token_records(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token records", tokens)]
#: SQL has no fingerprints, bands or tokenisers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = documents(spark, sf_dir), len(PATHS)
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), "stage")
        drop_written(spark, since, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)
