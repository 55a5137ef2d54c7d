"""Policy-gradient quantities per group and per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import discounted_advantages


def weighted_rewards(weights: dict[str, float]) -> Column:
    """Weighted sum over reward functions; a missing one adds nothing, all missing give 0."""
    return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))


def group_advantages(df: DataFrame, group: str, reward: str, scale: bool = True, eps: float = 1e-4) -> DataFrame:
    """Rewards centred on their group's mean and, if ``scale``, divided by its sample deviation; null for one-row groups then."""
    w = Window.partitionBy(group)
    a = F.col(reward) - F.avg(reward).over(w)
    return df.withColumn("advantage", a / (F.stddev_samp(reward).over(w) + eps) if scale else a)


def leave_one_out(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rewards less the mean of the group's others; null for one-row groups."""
    w = Window.partitionBy(group)
    others = F.try_divide(F.sum(reward).over(w) - F.col(reward), (F.count("*").over(w) - 1).cast("double"))
    return df.withColumn("advantage", F.col(reward) - others)


def whiten(df: DataFrame, c: str, out: str, population: bool = False, bound: float | None = None, eps: float = 1e-8) -> DataFrame:
    """Centred on the mean of all rows and divided by their deviation (one row of aggregates), clipped if asked."""
    dev = F.stddev_pop if population else F.stddev_samp
    m = df.agg(F.avg(c).alias("__m"), dev(c).alias("__s"))
    z = (F.col(c) - F.col("__m")) / (F.col("__s") + eps)
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.greatest(F.least(z, F.lit(bound)), F.lit(-bound)) if bound else z).drop("__m", "__s")


def sequences(df: DataFrame, seq: str, pos: str, *cols: str) -> DataFrame:
    """One row per sequence with its columns as arrays in position order."""
    items = F.array_sort(F.collect_list(F.struct(pos, *cols)))
    return df.groupBy(seq).agg(items.alias("__i")).select(seq, *[F.col(f"__i.{c}").alias(c) for c in (pos, *cols)])


def shaped_rewards(kl: str, score: Column, ended: Column, kl_coef: float, penalty: float) -> Column:
    """-kl_coef * kl per token; the sequence's score, less a penalty when it did not end, is added to the last."""
    last = score - F.when(ended, 0.0).otherwise(penalty)
    n = F.size(F.col(kl))
    return F.transform(F.col(kl), lambda x, i: -kl_coef * x + F.when(i == n - 1, last).otherwise(0.0))


def gae(rewards: str, values: str, gamma: float = 1.0, lam: float = 0.95) -> tuple[Column, Column]:
    """Generalised advantage estimates and returns of a sequence; the value after the last token is 0."""
    v = F.col(values)
    nxt = F.concat(F.slice(v, 2, F.size(v)), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(F.col(rewards), nxt, lambda r, n: r + gamma * n), v, lambda a, b: a - b)
    adv = discounted_advantages(delta, gamma * lam)
    return adv, F.zip_with(adv, v, lambda a, b: a + b)


def jensen_shannon(student: Column, teacher: Column, beta: float) -> Column:
    """Generalised divergence of two log-softmax arrays: beta * KL(T|M) + (1 - beta) * KL(S|M), the ends are plain KL."""
    kl = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    if beta == 0:
        return kl(teacher, student)
    if beta == 1:
        return kl(student, teacher)
    mix = F.zip_with(student, teacher, lambda s, t: F.log((1 - beta) * F.exp(s) + beta * F.exp(t)))
    return beta * kl(teacher, mix) + (1 - beta) * kl(student, mix)
