"""Corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns the packed pieces. Every stage is
written as Parquet and read again by the next one, so that a lost executor costs
tasks of one stage only. Stages that send texts to Python make the session's Arrow
batches smaller (``small_batches``), as an executor holds several batches at once.

* language: documents whose language compression can't tell are dropped;
* exact: of equal texts the row with the largest doc_id stays;
* near: of each group of near duplicates the smallest doc_id stays;
* pii: personal data in the texts gives way to its kind in brackets;
* packing: what is left is encoded, cut and packed into sequences.

No stage can be stated in SQL but the second, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowlens.llm import exact, language, minhash, packing, pii
from rowlens.llm.common import keep_rows, small_batches, stage_table, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_rows(docs, minhash.near_duplicates(docs).filter("kept"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
