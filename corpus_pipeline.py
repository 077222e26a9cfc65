"""The corpus pipeline: STAGES in order, each over all rows that the one before kept.

toxicity: documents that the classifier rejects go. near_dup: one document of each group of near copies stays (five-word shingles, similarity 0.8). substring_dedup: word windows that occur earlier are
cut out of the texts. decontamination: benchmark passages are cut out of the texts. mixing: each source is taken to its target; one row per document and epoch, with the columns
of documents, size, source_size, target, epoch and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricerank.llm import decontaminate, mixing, near_dup, substring, toxicity
from pricerank.llm.common import discard, intermediate, read, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Texts without words stay; without labels of both classes nothing is learned and all documents stay."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one of rows that repeat whole. Rows with a null id all stay."""
    return near_dup.dedup(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words are cut out of all texts but the first. Rows with a null id stay as they are."""
    return substring.clean(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; every document stays."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and epoch, each source cut at its target. Documents without words give none."""
    return mixing.mixed_texts(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage stores on its way goes when its result is written, and so does the result before. An empty table gives no rows; columns of any name are carried on."""
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with intermediate() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir)))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
