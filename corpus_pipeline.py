"""Raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import line_dedup, packing, pii, quality_rules, simhash
from quayside.llm.common import drop, finished, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many of the kept documents share stay in one of them only."""
    return line_dedup.without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, compared without the lines that were dropped."""
    ship(spark)
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its token ids, its sequence and its place there."""
    ship(spark)
    return packing.best_fit_packing(docs, ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash", near_duplicates), ("personal data", personal_data), ("packing", packed)]
#: SQL has no XXH64 with a seed and no tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and read again. A stage's work folder goes once its result is written, and so does its predecessor's result; nothing that others have written is touched."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = finished(spark, name.replace(" ", "-"), lambda stage=stage, before=before: stage(spark, before, sf_dir))
        if k:
            drop(before)
    return docs
