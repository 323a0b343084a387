"""The corpus pipeline: stages that each take (spark, docs, sf_dir); the driver writes a stage's rows and rereads them for the next.

All stages but the last return the columns of documents. Near duplicates are texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more; the quality threshold, the edit budget and the sequence length are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dubflow.llm.common import materialize
from dubflow.llm.decontaminate import decontaminate
from dubflow.llm.exact_dedup import deduplicate
from dubflow.llm.jaccard import keep_one
from dubflow.llm.packing import pack
from dubflow.llm.quality import keep_quality
from dubflow.llm.queries import table, tokenizer_path

#: Words that a worker of the packing stage remembers: the executors' memory still holds what earlier stages took.
REMEMBERED_WORDS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs, words=5, percent=80)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, packed into sequences."""
    return pack(docs, tokenizer_path(), remembered=REMEMBERED_WORDS)


STAGES = [("quality", quality_stage), ("exact_dedup", dedup_stage), ("near_dedup", near_stage), ("decontamination", leaks_stage), ("packing", packing_stage)]

#: A fitted model and a packing plan are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
