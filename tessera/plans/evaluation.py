"""Metric aggregation and evaluation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import strings as S
from tessera.plans.text import _like
from tessera.sources.tables import table


def _r(x, name, n=6):
    return F.round(x, n).alias(name)


_PRED = "(length(text) % 3 > 0)::int"


def _scored(s, d):
    """Labels with a stand-in prediction."""
    t = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return t.select("doc_id", "quality", (F.length("text") % 3 > 0).cast("int").alias("pred"))


@query(f"SELECT quality, {_PRED} AS pred, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(s, d):
    return _scored(s, d).groupBy("quality", "pred").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT quality, {_PRED} AS pred FROM documents JOIN labels USING (doc_id)) SELECT round(avg((quality = pred)::int), 6) AS accuracy, round(sum(quality*pred)/sum(quality)::double, 6) AS recall, round(sum(quality*pred)/sum(pred)::double, 6) AS precision FROM t")
def classification_metrics(s, d):
    hit = F.sum(F.col("quality") * F.col("pred"))
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return _scored(s, d).agg(_r(F.avg((F.col("quality") == F.col("pred")).cast("int")), "accuracy"), _r(div(hit, F.sum("quality")), "recall"), _r(div(hit, F.sum("pred")), "precision"))


@query("WITH m AS (SELECT avg(l_extendedprice) AS mu FROM lineitem) SELECT round(avg(abs(l_extendedprice - l_quantity*1000)), 4) AS mae, round(avg(pow(l_extendedprice - l_quantity*1000, 2))/1000000, 4) AS mse, round(sqrt(avg(pow(l_extendedprice - l_quantity*1000, 2))), 4) AS rmse, round(1 - sum(pow(l_extendedprice - l_quantity*1000, 2))/sum(pow(l_extendedprice - mu, 2)), 6) AS r2 FROM lineitem, m")
def regression_metrics(s, d):
    """One pass: the total sum of squares is n times the population variance."""
    e, y = F.col("l_extendedprice") - F.col("l_quantity") * 1000, F.col("l_extendedprice")
    sq = F.avg(e * e)
    return table(s, d, "lineitem").agg(_r(F.avg(F.abs(e)), "mae", 4), _r(sq / 1e6, "mse", 4), _r(F.sqrt(sq), "rmse", 4), _r(1 - F.try_divide(sq, F.var_pop(y)), "r2"))


@query("SELECT coalesce(round(sum((turn % 2)::int)/nullif(count(*), 0)::double, 6), 0) AS win_rate FROM conversations")
def win_rate(s, d):
    """0 when there is nothing to win."""
    return table(s, d, "conversations").agg(F.coalesce(F.round(F.try_divide(F.sum(F.col("turn") % 2).cast("double"), F.count("*").cast("double")), 6), F.lit(0.0)).alias("win_rate"))


@query(f"SELECT round(avg((NOT {_like('text', S.REFUSALS)})::int), 6) AS attack_success, count(*) FILTER ({_like('text', S.UNSAFE)}) AS n_unsafe, count(*) AS n FROM conversations WHERE role = 'assistant'")
def attack_success_rate(s, d):
    a = table(s, d, "conversations").where("role = 'assistant'")
    return a.agg(_r(F.avg((~S.looks_like_refusal("text")).cast("int")), "attack_success"), F.count_if(S.safety_flag("text")).alias("n_unsafe"), F.count("*").alias("n"))


@query("SELECT event_type, (event_id // 1000)::bigint AS step, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def metric_flush(s, d):
    """Metrics averaged per logging step, with sum and count kept apart."""
    step = F.floor(F.col("event_id") / 1000).alias("step")
    return table(s, d, "events").groupBy("event_type", step).agg(_r(F.avg("value"), "mean"), _r(F.sum("value"), "total", 4), F.count("*").alias("n"))


@query("WITH g AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT round((SELECT avg(value) FROM events), 6) AS row_mean, round(avg(m), 6) AS mean_of_means, round(var_samp(m), 6) AS variance FROM g")
def mean_of_means(s, d):
    """The rows' mean beside the mean of group means; they differ."""
    g = table(s, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("*").alias("n"))
    return g.agg(_r(F.sum("s") / F.sum("n"), "row_mean"), _r(F.avg("m"), "mean_of_means"), _r(F.var_samp("m"), "variance"))


@query("SELECT arg_min(user_id, m * 1000000 + user_id) AS best FROM (SELECT user_id, round(avg(value), 2) AS m FROM events GROUP BY 1)")
def argmin_first(s, d):
    g = table(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 2).alias("m"))
    return g.agg(F.min_by("user_id", F.struct("m", "user_id")).alias("best"))


@query(r"SELECT count(*) AS n, round(avg((lower(regexp_replace(c.text, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(u.text, '^\s+|\s+$', '', 'g')))::int), 6) AS em FROM conversations c JOIN conversations u ON c.conv_id = u.conv_id AND u.turn = c.turn - 1")
def eval_exact_match(s, d):
    c = table(s, d, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return c.join(u, ["conv_id", "turn"]).agg(F.count("*").alias("n"), _r(F.avg(S.exact_match("text", "ref").cast("int")), "em"))
