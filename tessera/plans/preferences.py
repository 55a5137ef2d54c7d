"""Pairing, unpairing, batching and class balance of preference data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.strings import tokens
from tessera.operators import shape as H
from tessera.operators.udfs import metric, pack, rouge_l
from tessera.plans import views as V
from tessera.sources.tables import table


@query("WITH " + V.PREF_TEXT + " SELECT conv_id, chosen, rejected FROM pref_text")
def pair_preferences(s, d):
    return V.pref_text(s, d)


@query("WITH " + V.PREF_TEXT + " SELECT conv_id, chosen AS completion, true AS label FROM pref_text UNION ALL SELECT conv_id, rejected, false FROM pref_text")
def unpair_preferences(s, d):
    """Two rows per pair, from one scan."""
    return V.pref_text(s, d).select("conv_id", F.explode(F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))).alias("x")).select("conv_id", "x.*")


@query("SELECT text, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1")
def dedupe_prompts(s, d):
    c = table(s, d, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("first"))
    return H.keep_first(c, ["text"], ["first"])


@query("SELECT conv_id, turn, g::bigint AS g FROM conversations, range(1, 5) r(g)")
def group_repeat(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("g"))


@query("SELECT conv_id, turn, coalesce(lead(text) OVER w, first_value(text) OVER w) AS kl_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def kl_mismatch(s, d):
    """Each prompt with the next completion of its batch, the last with the first."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.lead("text").over(w), F.first("text").over(w)).alias("kl_text"))


@query("WITH " + V.UNPAIRED + ", n AS (SELECT greatest(count(*) FILTER (label), 1) AS p, greatest(count(*) FILTER (NOT label), 1) AS q FROM unpaired) SELECT p AS n_desirable, q AS n_undesirable, round(q * 1.0::double / p, 2) AS des_low, round(q * 1.33::double / p, 2) AS des_high, round(p * 1.0::double / q / 1.33::double, 2) AS und_low, round(p * 1.0::double / q, 2) AS und_high FROM n")
def class_balance(s, d):
    """Counts of both labels and the bounds between which class weights are balanced."""
    n = V.unpaired(s, d).agg(F.greatest(F.count_if("label"), F.lit(1)).alias("p"), F.greatest(F.count_if(~F.col("label")), F.lit(1)).alias("q"))
    p, q, r = F.col("p"), F.col("q"), lambda x, n: F.round(x, 2).alias(n)
    return n.select(p.alias("n_desirable"), q.alias("n_undesirable"), r(q * 1.0 / p, "des_low"), r(q * 1.33 / p, "des_high"), r(p * 1.0 / q / 1.33, "und_low"), r(p * 1.0 / q, "und_high"))


@query("WITH " + V.UNPAIRED + " SELECT label, count(*) AS n, round(avg(lr), 6) AS mean FROM unpaired GROUP BY 1")
def label_partition(s, d):
    u = V.unpaired(s, d)
    sides = u.where("label").unionByName(u.where("NOT label"))
    return sides.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("lr"), 6).alias("mean"))


@query("WITH p AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN a ELSE b END AS first, CASE WHEN conv_id % 2 = 0 THEN b ELSE a END AS second FROM p")
def conditional_swap(s, d):
    p = table(s, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    even = F.col("conv_id") % 2 == 0
    return p.select("conv_id", F.when(even, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("second"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r * 2 <= n")
def split_halves(s, d):
    w = Window.partitionBy("conv_id")
    rows = table(s, d, "conversations").withColumn("r", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    return rows.where("r * 2 <= n").select("conv_id", "turn", "text")


@query()
def rouge_l_pairs(s, d):
    """Longest-common-subsequence F of chosen against rejected."""
    return V.pref_text(s, d).select("conv_id", F.round(rouge_l(F.col("chosen"), F.col("rejected")), 6).alias("rouge_l"))


@query()
def pack_sequences(s, d):
    """Documents packed into bins of 2048 tokens."""
    n = table(s, d, "documents").select("doc_id", F.size(tokens("text")).alias("n"))
    return pack(n, "doc_id", "n", 2048)


@query("SELECT conv_id * 1000 + turn AS key FROM conversations ORDER BY md5('3:' || (conv_id * 1000 + turn)::varchar), 1 LIMIT 20")
def sample_without_replacement(s, d):
    """Twenty rows, the same in every run and engine."""
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"))
    return c.orderBy(H.digest_order("key", 3), "key").limit(20)


_U5 = "('0x' || substr(md5('5:' || (conv_id * 1000 + turn)::varchar), 1, 8))::bigint / 4294967296::double"


@query(f"WITH u AS (SELECT conv_id, turn, {_U5} AS u FROM conversations), n AS (SELECT conv_id, turn, " + " + ".join(f"(u >= {c!r}::double)::int" for c in H.poisson_cuts(0.5)) + " AS n FROM u) SELECT conv_id, turn FROM n, range(1, 12) r(k) WHERE k <= n")
def sample_with_replacement(s, d):
    """Half as many rows, each drawn a Poisson number of times that its key alone decides: the same on any number of machines."""
    c = table(s, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("key"))
    return H.with_replacement(c, "key", 0.5, 5).select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN ('0x' || substr(md5('10:' || event_id::varchar), 1, 8))::bigint / 4294967296::double < 0.75::double THEN 'train' ELSE 'test' END AS part FROM events")
def random_split(s, d):
    """Three quarters to train; the key alone decides, whatever the layout of the rows."""
    return table(s, d, "events").select("event_id", F.when(H.digest_share("event_id", 10) < 0.75, "train").otherwise("test").alias("part"))


@query("SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'system' ELSE 'plain' END AS kind FROM conversations GROUP BY 1")
def column_switch(s, d):
    """Which template rows take depends on whether a column is there: with ``messages`` they are conversations, else plain text."""
    c = table(s, d, "conversations")
    m = c.groupBy("conv_id").agg(F.collect_set("role").alias("messages"))
    kind = H.by_column(m, "messages", lambda: F.when(F.array_contains("messages", "system"), "system").otherwise("plain"), lambda: F.lit("text"))
    return m.select("conv_id", kind.alias("kind"))


@query("WITH " + V.PREF_TEXT + " SELECT conv_id % 3 AS grp, count(*) AS n, round(avg(length(chosen) - length(rejected)), 6) AS margin, max(length(chosen))::bigint AS longest FROM pref_text GROUP BY 1")
def metric_callback(s, d):
    """A user's metric function of whole groups, as a grouped aggregate over Arrow batches: partial sums per batch, then one merge."""

    def partial(texts):
        a, b = (np.array([len(t) for t in texts[c].to_pylist()], np.int64) for c in ("chosen", "rejected"))
        return {"n": len(a), "margin": int((a - b).sum()), "longest": int(a.max(initial=0))}

    p = V.pref_text(s, d).select((F.col("conv_id") % 3).alias("grp"), "chosen", "rejected")
    sums = metric(p, "grp", partial, "n bigint, margin bigint, longest bigint")
    out = sums.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("margin").alias("m"), F.max("longest").alias("longest"))
    return out.select("grp", "n", F.round(F.col("m") / F.col("n"), 6).alias("margin"), "longest")
