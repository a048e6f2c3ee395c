"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import common, mixing, packing, quality, simhash, substring

#: (name, function(spark, docs, sf_dir)); each result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", substring.stage),
    ("mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is dropped once the next one is stored."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, made = docs, common.tables()
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.drop(before)
        common.sweep(spark, docs, since=made)
    return docs
