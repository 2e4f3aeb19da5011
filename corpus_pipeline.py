"""From raw documents to packed sequences: quality rules, near duplicates, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of documents
(the last: the pieces of the packed sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vulnlake.llm import mixing, near_dedup, packing, quality, surrogates
from vulnlake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace_in(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_duplicates), ("pii_surrogates", pii), ("source_mixing", source_mix), ("best_fit_packing", packed)]
#: Near duplicates and keyed surrogates have no DuckDB form; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
