"""Random choices that every run and engine makes alike, gathers, and orders taken from counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import arrays as A
from tessera.operators import shape
from tessera.plans import views as V
from tessera.sources.tables import table

_SEED = 7


@query(f"SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('{_SEED}:' || o_orderkey), o_orderkey)::bigint AS place FROM orders")
def permute_within(s, d):
    """A random order of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy(shape.digest_order("o_orderkey", _SEED), "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"SELECT doc_id, CASE WHEN ('0x' || substr(md5('{_SEED}:' || doc_id), 1, 8))::bigint / 4294967296::double < 0.3::double THEN 'on' ELSE 'off' END AS branch FROM documents")
def bernoulli_branch(s, d):
    """Each row takes a branch with probability 0.3."""
    return table(s, d, "documents").select("doc_id", F.when(shape.digest_share("doc_id", _SEED) < 0.3, "on").otherwise("off").alias("branch"))


@query(f"SELECT o_custkey, arg_min(o_orderkey, {{'a': o_orderpriority, 'b': md5('{_SEED}:' || o_orderkey)}}) AS picked FROM orders GROUP BY o_custkey")
def random_tie_break(s, d):
    """Each customer's order of best priority; among equals one at random."""
    rank = F.struct("o_orderpriority", shape.digest_order("o_orderkey", _SEED))
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("picked"))


@query("WITH " + V.TOKENS + " SELECT doc_id, coalesce(tokens[1], '~') || ' ' || coalesce(tokens[3], '~') || ' ' || coalesce(tokens[6], '~') AS picked FROM tokens")
def gather_elements(s, d):
    return V.tokens(s, d).select("doc_id", F.array_join(A.gather("tokens", [0, 2, 5]), " ", "~").alias("picked"))


@query("SELECT mktsegment, n, row_number() OVER (ORDER BY n DESC, mktsegment)::bigint AS place FROM (SELECT c_mktsegment AS mktsegment, count(*)::bigint AS n FROM customer GROUP BY 1)")
def reorder_levels(s, d):
    """Levels in order of their counts, as for the axis of a plot; one row per level is ranked."""
    n = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "mktsegment")).cast("bigint"))


@query("SELECT round(10 - avg(length(text)::double / 100), 6) AS loss FROM conversations")
def reward_alignment_loss(s, d):
    """Ten less the mean reward."""
    return V.grouped_rewards(s, d).agg(F.round(10 - F.avg("r1"), 6).alias("loss"))


@query("SELECT event_id, row_number() OVER (ORDER BY md5('11:' || event_id::varchar), event_id)::bigint AS place FROM events")
def permute_rows(s, d):
    """A permutation of the whole table: the place of each row.  Digests are even, so their first digits cut them into pieces."""
    e = table(s, d, "events").select("event_id", shape.digest_order("event_id", 11).alias("draw"))
    return shape.global_rank(e, F.substring("draw", 1, 2), ["draw", "event_id"], "place").select("event_id", "place")
