"""Policy-gradient objectives over derived token log-probabilities and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import arrays as A
from tessera.functions import objectives as O
from tessera.operators import policy as P
from tessera.operators import shape as H
from tessera.plans import views as V
from tessera.sources.tables import table

_T = "WITH " + V.TOKEN_LOGPS
_G = "WITH " + V.GROUPED
_RHO = "exp(new_lp-old_lp)"
_CLIP = f"-least({_RHO}*adv, greatest(least({_RHO}, 1.2::double), 0.8::double)*adv)"


def _ratio():
    return F.exp(F.col("new_lp") - F.col("old_lp"))


def _loss():
    return O.clipped(_ratio(), "adv", 0.2, 0.2)


def _r(x, name, n=6):
    return F.round(x, n).alias(name)


@query(f"{_G} SELECT group_id, item_id, round(coalesce(r1*0.7::double, 0) + coalesce(r2*0.3::double, 0), 6) AS reward FROM grouped_rewards")
def grpo_rewards(s, d):
    return V.grouped_rewards(s, d).select("group_id", "item_id", _r(P.weighted_rewards({"r1": 0.7, "r2": 0.3}), "reward"))


@query(f"{_G} SELECT group_id, item_id, round((r1 - avg(r1) OVER w) / (stddev_samp(r1) OVER w + 0.0001::double), 6) AS advantage, round(r1 - avg(r1) OVER w, 6) AS unscaled FROM grouped_rewards WINDOW w AS (PARTITION BY group_id)")
def grpo_advantage(s, d):
    g = P.group_advantages(V.grouped_rewards(s, d), "group_id", "r1", scale=False).withColumnRenamed("advantage", "plain")
    return P.group_advantages(g, "group_id", "r1").select("group_id", "item_id", _r("advantage", "advantage"), _r("plain", "unscaled"))


@query(f"{_G}, g AS (SELECT group_id, avg(r1) AS m, stddev_samp(r1) AS sd FROM grouped_rewards GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(avg(sd), 6) AS std, round(avg((coalesce(abs(sd) <= 0.00000001::double, false))::int), 6) AS frac_zero FROM g")
def grpo_reward_stats(s, d):
    g = V.grouped_rewards(s, d).groupBy("group_id").agg(F.avg("r1").alias("m"), F.stddev_samp("r1").alias("sd"))
    return g.agg(_r(F.avg("m"), "mean"), _r(F.avg("sd"), "std"), _r(F.avg(F.coalesce(O.is_close("sd"), F.lit(False)).cast("int")), "frac_zero"))


@query(f"{_T} SELECT seq_id, round(avg(new_lp-old_lp), 6) AS log_w, round(exp(avg(new_lp-old_lp)), 6) AS w FROM token_logps WHERE m=1 GROUP BY 1")
def importance_weights(s, d):
    """Sequence-level weights."""
    x = F.avg(F.col("new_lp") - F.col("old_lp"))
    return V.token_logps(s, d).where("m = 1").groupBy("seq_id").agg(_r(x, "log_w"), _r(F.exp(x), "w"))


@query(f"{_T}, q AS (SELECT seq_id, sum({_CLIP}*m)/greatest(sum(m), 1) AS l FROM token_logps GROUP BY 1) SELECT round(avg(l), 8) AS loss FROM q")
def grpo_clip_loss_grpo(s, d):
    q = V.token_logps(s, d).groupBy("seq_id").agg((F.sum(_loss() * F.col("m")) / F.greatest(F.sum("m"), F.lit(1))).alias("l"))
    return q.agg(_r(F.avg("l"), "loss", 8))


@query(f"{_T} SELECT round(sum({_CLIP}*m)/greatest(sum(m), 1), 8) AS loss FROM token_logps")
def grpo_clip_loss_bnpo(s, d):
    return V.token_logps(s, d).agg(_r(F.sum(_loss() * F.col("m")) / F.greatest(F.sum("m"), F.lit(1)), "loss", 8))


@query(f"{_T} SELECT round(sum({_CLIP}*m)/(count(DISTINCT seq_id)*64), 8) AS loss FROM token_logps")
def grpo_clip_loss_dr_grpo(s, d):
    """A fixed denominator: sequences times their greatest length."""
    q = V.token_logps(s, d).groupBy("seq_id").agg(F.sum(_loss() * F.col("m")).alias("l"))
    return q.agg(_r(F.sum("l") / (F.count("*") * 64), "loss", 8))


@query(f"{_T}, t AS (SELECT quantile_cont(-new_lp, 0.8) AS q FROM token_logps WHERE m=1) SELECT seq_id, count(*) FILTER (-new_lp >= q) AS n_high, count(*) AS n FROM token_logps, t WHERE m=1 GROUP BY 1")
def high_entropy_mask(s, d):
    """Tokens at or over the 80 % quantile of entropy (the surprise stands in for it)."""
    t = V.token_logps(s, d).where("m = 1").withColumn("h", -F.col("new_lp"))
    q = H.quantiles(t, "h", [0.8]).select(F.col("q")[0].alias("q"))
    return t.crossJoin(F.broadcast(q)).groupBy("seq_id").agg(F.count_if(F.col("h") >= F.col("q")).alias("n_high"), F.count("*").alias("n"))


@query(f"{_T} SELECT round(sum(({_RHO} < 0.99::double AND adv < 0)::int*m)/sum(m)::double, 6) AS low, round(sum(({_RHO} > 1.01::double AND adv > 0)::int*m)/sum(m)::double, 6) AS high FROM token_logps")
def clip_fraction(s, d):
    lo, hi = (_ratio() < 0.99) & (F.col("adv") < 0), (_ratio() > 1.01) & (F.col("adv") > 0)
    f = lambda c: F.sum(c.cast("int") * F.col("m")) / F.sum("m")
    return V.token_logps(s, d).agg(_r(f(lo), "low"), _r(f(hi), "high"))


@query(f"{_T}, e AS (SELECT seq_id, max((event_id % 97 = 0)::int) AS ended FROM token_logps GROUP BY 1) SELECT t.seq_id, sum(m * ended)::bigint AS kept FROM token_logps t JOIN e USING (seq_id) GROUP BY 1")
def truncated_mask(s, d):
    """Sequences without an end token are masked out."""
    w = Window.partitionBy("seq_id")
    t = V.token_logps(s, d).withColumn("ended", F.max((F.col("event_id") % 97 == 0).cast("int")).over(w))
    return t.groupBy("seq_id").agg(F.sum(F.col("m") * F.col("ended")).alias("kept"))


@query(f"{_T} SELECT seq_id, round(sum(m*new_lp), 6) AS total, round(sum(m*new_lp)/greatest(sum(m), 1), 6) AS mean FROM token_logps GROUP BY 1")
def sequence_logps(s, d):
    m = F.col("m") * F.col("new_lp")
    return V.token_logps(s, d).groupBy("seq_id").agg(_r(F.sum(m), "total"), _r(F.sum(m) / F.greatest(F.sum("m"), F.lit(1)), "mean"))


@query(f"{_T} SELECT round(avg(new_lp-ref_lp), 8) AS k1, round(avg(exp(ref_lp-new_lp)-1-(ref_lp-new_lp)), 8) AS k3 FROM token_logps WHERE m=1")
def kl_estimators(s, d):
    return V.token_logps(s, d).where("m = 1").agg(_r(F.avg(O.kl("k1", "new_lp", "ref_lp")), "k1", 8), _r(F.avg(O.kl("k3", "new_lp", "ref_lp")), "k3", 8))


#: Rewards have few decimals, so that some advantages end in a five, which engines round either way: all go a little up.
_NUDGE = 3e-12
_GAE = f"""{_T}, t AS (SELECT seq_id, pos, ref_lp AS v, -0.05::double*(new_lp-ref_lp) + CASE WHEN pos = max(pos) OVER (PARTITION BY seq_id) THEN adv - CASE WHEN seq_id % 2 = 0 THEN 0 ELSE 1 END ELSE 0 END AS r FROM token_logps WHERE m=1),
 e AS (SELECT seq_id, pos, v, r + coalesce(lead(v) OVER (PARTITION BY seq_id ORDER BY pos), 0) - v AS delta FROM t),
 g AS (SELECT a.seq_id, a.pos, any_value(a.v) AS v, sum(b.delta * pow(0.95::double, b.pos - a.pos)) AS adv FROM e a JOIN e b ON a.seq_id = b.seq_id AND b.pos >= a.pos GROUP BY 1, 2)"""


@query(f"{_GAE} SELECT seq_id, pos::bigint AS pos, round(adv + {_NUDGE}::double, 7) AS advantage, round(adv + v + {_NUDGE}::double, 7) AS returns FROM g")
def ppo_gae(s, d):
    """Token rewards from divergence and score, then advantages and returns by a reverse pass over each sequence."""
    t = V.token_logps(s, d).where("m = 1").withColumn("kl", F.col("new_lp") - F.col("ref_lp"))
    q = P.sequences(t, "seq_id", "pos", "kl", "ref_lp", "adv")
    q = q.withColumn("r", P.shaped_rewards("kl", F.get("adv", F.lit(0)), F.col("seq_id") % 2 == 0, 0.05, 1.0))
    adv, ret = P.gae("r", "ref_lp")
    q = q.select("seq_id", "pos", adv.alias("a"), ret.alias("g"))
    return q.select("seq_id", F.explode(F.arrays_zip("pos", "a", "g")).alias("x")).select("seq_id", F.col("x.pos").cast("bigint").alias("pos"), _r(F.col("x.a") + _NUDGE, "advantage", 7), _r(F.col("x.g") + _NUDGE, "returns", 7))


@query(f"{_T} SELECT round(avg(greatest(-adv*{_RHO}, -adv*greatest(least({_RHO}, 1.2::double), 0.8::double))), 8) AS policy_loss, round(0.5::double*avg(greatest(pow(new_lp-ref_lp, 2), pow(greatest(least(new_lp, old_lp+0.001::double), old_lp-0.001::double)-ref_lp, 2))), 8) AS value_loss, round(0.5::double*avg(pow(new_lp-old_lp, 2)), 8) AS approx_kl, round(var_samp({_RHO}), 8) AS ratio_var FROM token_logps WHERE m=1")
def ppo_losses(s, d):
    t, p, a = V.token_logps(s, d).where("m = 1"), _ratio(), F.col("adv")
    new, old, ret = F.col("new_lp"), F.col("old_lp"), F.col("ref_lp")
    near = F.greatest(F.least(new, old + 0.001), old - 0.001)
    return t.agg(
        _r(F.avg(F.greatest(-a * p, -a * O.clip(p, 0.8, 1.2))), "policy_loss", 8),
        _r(0.5 * F.avg(F.greatest(F.pow(new - ret, 2), F.pow(near - ret, 2))), "value_loss", 8),
        _r(0.5 * F.avg(F.pow(new - old, 2)), "approx_kl", 8),
        _r(F.var_samp(p), "ratio_var", 8),
    )


@query(f"{_G} SELECT group_id, item_id, round(r1 - (sum(r1) OVER w - r1) / nullif(count(*) OVER w - 1, 0), 6) AS advantage FROM grouped_rewards WINDOW w AS (PARTITION BY group_id)")
def rloo_advantage(s, d):
    return P.leave_one_out(V.grouped_rewards(s, d), "group_id", "r1").select("group_id", "item_id", _r("advantage", "advantage"))


@query(f"{_G}, m AS (SELECT avg(r1) AS mu, stddev_samp(r1) AS sd, stddev_pop(r1) AS sp FROM grouped_rewards) SELECT group_id, item_id, round(greatest(least((r1-mu)/(sd+0.00000001::double), 1), -1), 6) AS clipped, round((r1-mu)/(sp+0.00000001::double), 6) AS population FROM grouped_rewards, m")
def whiten(s, d):
    g = P.whiten(V.grouped_rewards(s, d), "r1", "c", bound=1.0)
    return P.whiten(g, "r1", "p", population=True).select("group_id", "item_id", _r("c", "clipped"), _r("p", "population"))


@query(f"{_T}, q AS (SELECT seq_id, sum(new_lp-ref_lp) AS kl, exp(sum(new_lp-old_lp)) AS rho, max(adv) AS a FROM token_logps WHERE m=1 GROUP BY 1) SELECT round(avg(a - 0.05::double*kl), 6) AS reward, round(avg(greatest(-a*rho, -a*greatest(least(rho, 1.2::double), 0.8::double))), 6) AS loss FROM q")
def rloo_loss(s, d):
    """Sequence-level divergence penalty and ratio."""
    q = V.token_logps(s, d).where("m = 1").groupBy("seq_id").agg(F.sum(F.col("new_lp") - F.col("ref_lp")).alias("kl"), F.exp(F.sum(F.col("new_lp") - F.col("old_lp"))).alias("rho"), F.max("adv").alias("a"))
    a, p = F.col("a"), F.col("rho")
    return q.agg(_r(F.avg(a - 0.05 * F.col("kl")), "reward"), _r(F.avg(F.greatest(-a * p, -a * O.clip(p, 0.8, 1.2))), "loss"))


@query(f"{_T} SELECT round(avg(greatest(-a*{_RHO}, -a*greatest(least({_RHO}, 1.0001::double), 0.9999::double))), 8) AS loss, round(avg((abs({_RHO}-1) > 0.0001::double)::int), 6) AS clipfrac, round(10 - avg(adv), 6) AS align_prop FROM (SELECT *, greatest(least(adv, 5), -5) AS a FROM token_logps WHERE m=1)")
def ddpo_loss(s, d):
    t, p = V.token_logps(s, d).where("m = 1").withColumn("a", O.clip("adv", -5, 5)), _ratio()
    a = F.col("a")
    return t.agg(_r(F.avg(F.greatest(-a * p, -a * O.clip(p, 0.9999, 1.0001))), "loss", 8), _r(F.avg((F.abs(p - 1) > 1e-4).cast("int")), "clipfrac"), _r(10 - F.avg("adv"), "align_prop"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::double AS e FROM embeddings), z AS (SELECT vec_id, ln(sum(exp(e))) AS lse FROM x GROUP BY 1) SELECT vec_id, round(lse, 6) AS lse, round(embedding[1]::double - lse, 6) AS first, round((SELECT -sum(exp(x.e-lse)*(x.e-lse)) FROM x WHERE x.vec_id = z.vec_id), 6) AS entropy FROM z JOIN embeddings USING (vec_id)")
def log_softmax(s, d):
    """Log-sum-exp, the selected log-probability and the entropy of logits."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", _r(A.log_sum_exp("e"), "lse"), _r(F.get(A.log_softmax("e"), F.lit(0)), "first"), _r(A.softmax_entropy("e"), "entropy"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::double AS a, unnest(list_reverse(embedding))::double AS b FROM embeddings), l AS (SELECT vec_id, ln(sum(exp(a))) AS la, ln(sum(exp(b))) AS lb FROM x GROUP BY 1), p AS (SELECT vec_id, a-la AS s, b-lb AS t, ln(0.5::double*exp(a-la)+0.5::double*exp(b-lb)) AS m FROM x JOIN l USING (vec_id)) SELECT vec_id, round(0.5::double*sum(exp(t)*(t-m)) + 0.5::double*sum(exp(s)*(s-m)), 6) AS jsd, round(sum(exp(t)*(t-s)), 6) AS kl_ts FROM p GROUP BY 1")
def gkd_jsd(s, d):
    """Embeddings stand in for logits of student and teacher (reversed)."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = e.select("vec_id", A.log_softmax("e").alias("s"), A.log_softmax(F.reverse("e")).alias("t"))
    return e.select("vec_id", _r(P.jensen_shannon(F.col("s"), F.col("t"), 0.5), "jsd"), _r(P.jensen_shannon(F.col("s"), F.col("t"), 0), "kl_ts"))


@query("SELECT event_id, round(value*tanh(value/30::double), 6) AS capped, round(greatest(least(value, 100), 1), 6) AS clipped FROM events")
def soft_cap(s, d):
    return table(s, d, "events").select("event_id", _r(O.soft_cap("value", 30.0), "capped"), _r(O.clip("value", 1, 100), "clipped"))


@query(f"{_T} SELECT event_id, CASE WHEN m = 1 THEN new_lp ELSE 1 END AS filled FROM token_logps")
def masked_fill(s, d):
    return V.token_logps(s, d).select("event_id", F.when(F.col("m") == 1, F.col("new_lp")).otherwise(1.0).alias("filled"))
