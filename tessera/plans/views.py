"""Deterministic derived relations for the alignment operators, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.strings import tokens as split_tokens
from tessera.sources.tables import table


def pref_pairs(s: SparkSession, d: str) -> DataFrame:
    """Log-probability stand-ins of pairs."""
    c = F.col
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", (-c("l_extendedprice") / 10000).alias("pc"), (-c("l_quantity") / 10).alias("pr"), (-c("l_extendedprice") / 11000 - c("l_tax")).alias("rc"), (-c("l_quantity") / 9 - c("l_discount")).alias("rr"))


def unpaired(s: SparkSession, d: str) -> DataFrame:
    """Labelled log-ratios."""
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("label"), (F.col("n_chars") / 1000.0 - 1).alias("lr"))


def token_logps(s: SparkSession, d: str) -> DataFrame:
    """One row per sequence and position."""
    c, w = F.col, Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("pos", F.row_number().over(w) - 1)
    return e.select(c("user_id").alias("seq_id"), "pos", "event_id", (-c("value") / 100 - 0.001 * (c("event_id") % 7)).alias("new_lp"), (-c("value") / 100).alias("old_lp"), (-c("value") / 110).alias("ref_lp"), (c("user_id") % 5 - 2).cast("double").alias("adv"), F.when(c("pos") < 64, 1).otherwise(0).alias("m"))


def grouped_rewards(s: SparkSession, d: str) -> DataFrame:
    """Two reward functions, the second missing for turns that are not the assistant's."""
    return table(s, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("item_id"), (F.length("text").cast("double") / 100).alias("r1"), F.when(F.col("role") == "assistant", 1.0).alias("r2"))


def pref_text(s: SparkSession, d: str) -> DataFrame:
    """Longest against shortest assistant turn of a conversation."""
    key = F.length("text") * 100 + F.col("turn")
    g = table(s, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", key).alias("chosen"), F.min_by("text", key).alias("rejected"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


def tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", split_tokens("text").alias("tokens"))


PREF_PAIRS = """pref_pairs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, -l_extendedprice/10000::double AS pc, -l_quantity/10::double AS pr,
 -l_extendedprice/11000::double - l_tax AS rc, -l_quantity/9::double - l_discount AS rr FROM lineitem)"""
UNPAIRED = "unpaired AS (SELECT d.doc_id, l.quality = 1 AS label, d.n_chars/1000::double - 1 AS lr FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
TOKEN_LOGPS = """token_logps AS (SELECT seq_id, pos, event_id, new_lp, old_lp, ref_lp, adv, CASE WHEN pos < 64 THEN 1 ELSE 0 END AS m FROM (SELECT user_id AS seq_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id, -value/100::double - 0.001::double*(event_id%7) AS new_lp, -value/100::double AS old_lp, -value/110::double AS ref_lp, (user_id%5-2)::double AS adv FROM events))"""
GROUPED = "grouped_rewards AS (SELECT conv_id AS group_id, turn AS item_id, length(text)::double/100 AS r1, CASE WHEN role='assistant' THEN 1::double END AS r2 FROM conversations)"
PREF_TEXT = """pref_text AS (SELECT conv_id, chosen, rejected FROM (SELECT conv_id, arg_max(text, length(text)*100+turn) AS chosen, arg_min(text, length(text)*100+turn) AS rejected, count(*) AS n
 FROM conversations WHERE role='assistant' GROUP BY conv_id) WHERE n > 1)"""
TOKENS = r"tokens AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tokens FROM documents)"
