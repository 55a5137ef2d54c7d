"""Whole flows: table to model features, preference rows to loss, conversations to an evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import objectives as O
from tessera.functions import strings as S
from tessera.operators import shape as H
from tessera.plans import views as V
from tessera.sources.tables import table
from tessera.streaming import events as E


@query("WITH donors AS (SELECT c_nationkey, c_mktsegment, median(c_acctbal) AS med FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2), c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN med ELSE c_acctbal END AS b FROM customer LEFT JOIN donors USING (c_nationkey, c_mktsegment)), e AS (SELECT min(b) AS lo, max(b) AS hi FROM c) SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::int AS segment, round((b - lo)/(hi - lo), 6) AS scaled FROM c, e")
def flow_features(s, d):
    """Impute, encode, scale."""
    b = F.col("c_acctbal")
    rows = H.impute_group_median(table(s, d, "customer"), "c_acctbal", ["c_nationkey", "c_mktsegment"], b < 0, b > 0, "b")
    rows = H.min_max(H.label_encode(rows, "c_mktsegment", "segment"), "b", "scaled")
    return rows.select("c_custkey", "segment", F.round("scaled", 6).alias("scaled"))


@query("WITH " + V.PREF_TEXT + " SELECT count(*) AS n, round(avg(-(-ln(1 + exp(-0.1::double*(length(chosen)-length(rejected))/100::double)))), 6) AS loss, round(avg((length(chosen) > length(rejected))::int), 6) AS accuracy FROM pref_text WHERE length(chosen) <= 4000")
def flow_preferences(s, d):
    """Pair, filter by length, score (lengths stand in for log-probabilities), reduce."""
    p = V.pref_text(s, d).where(F.length("chosen") <= 4000)
    z = (F.length("chosen") - F.length("rejected")) / 100.0
    return p.agg(F.count("*").alias("n"), F.round(F.avg(-O.log_sigmoid(0.1 * z)), 6).alias("loss"), F.round(F.avg((z > 0).cast("int")), 6).alias("accuracy"))


@query("WITH " + V.PREF_TEXT + " SELECT round(avg((lower(chosen) = lower(rejected))::int), 6) AS em, sum((contains(lower(chosen), 'kill') OR contains(lower(chosen), 'hate') OR contains(lower(chosen), 'violence') OR contains(lower(chosen), 'bomb'))::int)::bigint AS unsafe, count(*) AS n FROM pref_text")
def flow_report(s, d):
    """An evaluation report of one row."""
    return V.pref_text(s, d).agg(F.round(F.avg(S.exact_match("chosen", "rejected").cast("int")), 6).alias("em"), F.sum(S.safety_flag("chosen").cast("int")).alias("unsafe"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def stream_running_moments(s, d):
    """The stream of events, run to its end."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.read.parquet(f"{d}/events.parquet").schema)
    out = E.to_memory(E.running(E.source(s, d, "events.parquet", schema)), "tessera_running", "complete")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
