"""The corpus pipeline: rules, line dedup, near-duplicates, decontamination and the mix, in that order."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, line_dedup, mixing, quality_rules, simhash_dedup
from tessera.llm.common import Scratch, tidy


def settled(stage):
    """The stage; executors give memory back before its tables are made, between them, and before its rows are read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tidy(spark):
            return stage(spark, docs, sf_dir)

    return run


@settled
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines, and documents that fail or lose too much."""
    return quality_rules.stage(spark, docs)


@settled
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template another document has already shown."""
    return line_dedup.stage(spark, docs)


@settled
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash_dedup.stage(spark, docs)


@settled
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontam.stage(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@settled
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their targets."""
    return mixing.stage(spark, docs)


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

#: Fingerprints and sampling hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir), "mix")
