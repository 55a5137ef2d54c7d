"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, html_extract, line_dedup, mixing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontam.digest(decontam.contamination(_read(spark, d, "documents"), _read(spark, d, "benchmark")))


def op2_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.digest(_read(spark, d, "documents"))


def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.digest(_read(spark, d, "documents"))


def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, d, "documents"))


def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.totals(_read(spark, d, "documents"), whole=True)


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.assess(_read(spark, d, "documents"))


def op7_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality_classifier.classify(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op8_html_extract(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(_read(spark, d, "pages"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.severity(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op10_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(_read(spark, d, "documents")))


ALL = (op1_decontaminate, op2_mix, op3_line_dedup, op4_suffix_dedup, op5_token_counts, op6_quality_rules, op7_quality_classifier, op8_html_extract, op9_toxicity, op10_simhash)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontam.SQL, "op2_mix": mixing.SQL, "op3_line_dedup": line_dedup.SQL, "op6_quality_rules": quality_rules.SQL}
