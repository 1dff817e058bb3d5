"""Corpus pipeline: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pvlake.llm import pii
from pvlake.llm.common import documents, on_workers, store
from pvlake.llm.line_dedup import line_dedup_stage
from pvlake.llm.minhash_dedup import near_duplicate_stage
from pvlake.llm.packing import pack
from pvlake.llm.quality_rules import quality_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines are cut; a document that held nothing else goes."""
    return line_dedup_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words a shingle, similarity 0.8."""
    on_workers(spark)
    return near_duplicate_stage(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans with personal data are replaced by their kind's name."""
    return pii.redact_personal_data(docs, pii.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Near-dedup, personal data and packing are not expressible in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
