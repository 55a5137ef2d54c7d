"""Ordered operators: rolling, lags, scaling, chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import profile as P
from tessera.operators import shape as H
from tessera.sources.tables import table

_DAILY = "daily AS (SELECT o_orderpriority AS sym, o_orderdate::date::varchar AS day, sum(o_totalprice) AS px FROM orders GROUP BY 1, 2)"


def _daily(s, d):
    """A price series per symbol and day."""
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("sym"), F.to_date("o_orderdate").cast("string").alias("day")).agg(F.sum("o_totalprice").alias("px"))


def rolling_mean(c: str, n: int, w):
    """Mean of the last n rows; null before there are n."""
    over = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(over) == n, F.avg(c).over(over))


@query("WITH " + _DAILY + " SELECT sym, day, " + ", ".join(f"round(CASE WHEN count(*) OVER w{n} = {n} THEN avg(px) OVER w{n} END, 4) AS ma{n}" for n in (10, 20, 50)) + " FROM daily WINDOW " + ", ".join(f"w{n} AS (PARTITION BY sym ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 20, 50)))
def rolling_mean_10_20_50(s, d):
    w = Window.partitionBy("sym").orderBy("day")
    return _daily(s, d).select("sym", "day", *[F.round(rolling_mean("px", n, w), 4).alias(f"ma{n}") for n in (10, 20, 50)])


def change(value: Column, before: Column, digits: int = 6) -> Column:
    """``value / before - 1``, rounded, with the floating-point results of SQL.

    Division by zero is infinite or NaN (Spark's own gives null); what is rounded is the product with the power of ten, as SQL engines do (Spark's own rounds the
    shortest decimal, which differs near ties).
    """
    x = F.when(before == 0, value * F.pow(before, F.lit(-1.0))).otherwise(F.try_divide(value, before)) - 1
    scaled = x * 10.0**digits
    whole = F.when(F.round(scaled) == 0, scaled * 0.0).otherwise(F.round(scaled))  # a zero keeps its sign
    return F.when(F.abs(scaled) < float("inf"), whole / 10.0**digits).otherwise(x)


@query("SELECT event_id, round(value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 6) AS change FROM events")
def pct_change(s, d):
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    rows = table(s, d, "events").select("event_id", "value", F.lag("value").over(w).alias("before"))
    return rows.select("event_id", change(F.col("value"), F.col("before")).alias("change"))


@query("WITH f AS (SELECT *, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events) SELECT event_id, round(v / lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 6) AS change FROM f")
def pct_change_filled(s, d):
    """Missing values (here those up to 20) take the last one before; the change is from row to row."""
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    seen = F.last(F.when(F.col("value") > 20, F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = table(s, d, "events").withColumn("v", seen).select("event_id", "v", F.lag("v").over(w).alias("before"))
    return rows.select("event_id", change(F.col("v"), F.col("before")).alias("change"))


@query("WITH " + _DAILY + " SELECT sym, day, round(sum(px) OVER w, 2) AS window_sum, round(px, 4) AS label FROM daily WINDOW w AS (PARTITION BY sym ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 60")
def lag_window_60(s, d):
    """Windows of 60 lags with the next value as label, shown by their sums."""
    w = Window.partitionBy("sym").orderBy("day").rowsBetween(-60, -1)
    rows = _daily(s, d).withColumn("x", F.collect_list("px").over(w)).where(F.size("x") == 60)
    return rows.select("sym", "day", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 2).alias("window_sum"), F.round("px", 4).alias("label"))


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= ceil(0.8::double * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part, row_number() OVER (ORDER BY ts, event_id) > ceil(0.8::double * count(*) OVER ()) - 60 AS test_window FROM events")
def chrono_split_80(s, d):
    """First 80 % in time order; test windows reach 60 rows back.

    Nothing is sorted as a whole: the rows at the two ranks are found by time, then by number among the rows of that time, and every row is compared with them.
    """
    e = table(s, d, "events").select("event_id", "ts")
    if H.small(e):
        w = Window.orderBy("ts", "event_id")
        cut = F.ceil(F.count("*").over(Window.partitionBy()) * 0.8)
        return e.withColumn("rn", F.row_number().over(w)).select("event_id", F.when(F.col("rn") <= cut, "train").otherwise("test").alias("part"), (F.col("rn") > cut - 60).alias("test_window"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    last = lambda n: (F.ceil(n * 0.8) - 1).cast("bigint")  # noqa: E731  ranks from 0: of the last training row, and of the last row before the test windows
    times = H.at_ranks(e.select(micros.alias("t")), "t", lambda n: F.array(last(n), F.greatest(last(n) - 60, F.lit(0).cast("bigint"))), [0.8])
    found = times.select(last(F.col("n")).alias("last"), "found").first()  # two numbers of microseconds
    later = []
    for place in found["found"] or ():
        left = max(found["last"] - 60 * place["at"], 0) - place["before"]
        same = e.where(micros == place["value"]).select("event_id")
        if left < H.SORTED:  # each task keeps so many rows at most
            number = same.orderBy("event_id").limit(left + 1).agg(F.max("event_id")).first()[0]
        else:
            number = H.at_ranks(same, "event_id", lambda n, left=left: F.array(F.lit(left)), [k / 16 for k in range(17)]).first()["found"][0]["value"]
        later.append((micros > place["value"]) | ((micros == place["value"]) & (F.col("event_id") > number)))
    later += [F.lit(False)] * (2 - len(later))
    return e.select("event_id", F.when(later[0], "test").otherwise("train").alias("part"), (later[1] | F.lit((found["last"] or 0) < 60)).alias("test_window"))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo), 6) AS scaled, round((value - lo) / (hi - lo) * (hi - lo) + lo, 6) AS back FROM events, e")
def minmax_scale(s, d):
    out = H.min_max(table(s, d, "events"), "value", "scaled")
    return out.select("event_id", F.round("scaled", 6).alias("scaled"), F.round(F.col("scaled") * (F.col("__hi") - F.col("__lo")) + F.col("__lo"), 6).alias("back"))


@query("WITH e AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - m) / s, 6) AS z FROM events, e")
def standardize(s, d):
    return H.standardise(table(s, d, "events"), "value", "z").select("event_id", F.round("z", 6).alias("z"))




@query("WITH t AS (SELECT ts::date AS day, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) SELECT round(corr(a, b), 6) AS corr, count(*) AS days FROM t")
def pivot_corr(s, d):
    """Long to wide by event type, then the correlation of two columns."""
    wide = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return wide.agg(F.round(P.correlation("click", "view"), 6).alias("corr"), F.count("*").alias("days"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def ring_buffer(s, d):
    """The last five rows of each kind."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_type", "event_id")


@query("WITH b AS (SELECT ts::date::varchar AS batch, sum(value) AS s, count(*) AS n, sum(value*value) AS q FROM events GROUP BY 1) SELECT batch, round(sum(s) OVER w / sum(n) OVER w, 6) AS mean, round(sqrt(greatest(sum(q) OVER w / sum(n) OVER w - pow(sum(s) OVER w / sum(n) OVER w, 2), 0)), 4) AS std FROM b WINDOW w AS (ORDER BY batch)")
def running_moments(s, d):
    """Mean and deviation of all batches so far: rows are summed by batch, batches by month, and months are few."""
    b = table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("batch")).agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("q"))
    r = H.running_sums(b, F.substring("batch", 1, 7), "batch", ["s", "n", "q"])
    mean = F.col("run_s") / F.col("run_n")
    return r.select("batch", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("run_q") / F.col("run_n") - mean * mean, F.lit(0.0))), 4).alias("std"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::bigint AS position FROM events")
def position_ids(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


@query("SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events")
def shift_next(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.lead("value").over(w).alias("nxt"))


@query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4)::bigint AS batch FROM events")
def batch_chunks(s, d):
    """Batches of four, per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.floor((F.row_number().over(w) - 1) / 4).alias("batch"))


@query("SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) - min(value) > 0 AS varies FROM events GROUP BY 1")
def per_prompt_stats(s, d):
    v = F.col("value")
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), (F.max(v) - F.min(v) > 0).alias("varies"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(CASE WHEN count(*) OVER w < 4 THEN 0 ELSE (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6::double) END, 4) AS advantage FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)")
def per_prompt_tracker(s, d):
    """Running statistics: each reward against the last 16 of its prompt (a buffer of bounded length); 0 while there are under four."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-15, 0)
    v = F.col("value")
    advantage = F.when(F.count("*").over(w) < 4, 0.0).otherwise((v - F.avg(v).over(w)) / (F.stddev_pop(v).over(w) + 1e-6))
    return table(s, d, "events").select("event_id", F.round(F.avg(v).over(w), 6).alias("mean"), F.round(advantage, 4).alias("advantage"))
