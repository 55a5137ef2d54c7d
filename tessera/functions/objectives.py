"""Preference and policy objectives as column expressions.

c, r: policy log-probabilities of chosen and rejected; C, R: the reference's; z = (c - r) - (C - R).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.strings import col


def log_sigmoid(x) -> Column:
    x = col(x)
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def softplus(x) -> Column:
    return -log_sigmoid(-col(x))


def relu(x) -> Column:
    return F.greatest(col(x), F.lit(0.0))


def clip(x, lo: float, hi: float) -> Column:
    """Null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def soft_cap(x, cap: float) -> Column:
    """x times tanh(x / cap)."""
    x = col(x)
    return x * F.tanh(x / cap)


def cap_exp(x, cap: float = 88.0) -> Column:
    return F.exp(F.least(col(x), F.lit(cap)))


def is_close(x, to: float = 0.0, tolerance: float = 1e-8) -> Column:
    return F.abs(col(x) - to) <= tolerance


def margin(c="pc", r="pr", C="rc", R="rr") -> Column:
    return (col(c) - col(r)) - (col(C) - col(R))


def dpo(kind: str, c="pc", r="pr", C="rc", R="rr", beta: float = 0.1, smoothing: float = 0.0, tau: float = 0.05, delta: Column | float = 0.0) -> Column:
    """The pairwise loss of one row.  ``delta`` is the running reward mean of bco_pair; aot kinds need ranks, see operators.preferences."""
    c, r, C, R = col(c), col(r), col(C), col(R)
    x, y, z = c - C, r - R, (c - r) - (C - R)
    ls, eps = log_sigmoid, smoothing
    if kind == "sigmoid":
        return -ls(beta * z) * (1 - eps) - ls(-beta * z) * eps
    if kind == "robust":
        return (-ls(beta * z) * (1 - eps) + ls(-beta * z) * eps) / (1 - 2 * eps)
    if kind == "exo_pair":
        e = eps or 1e-3
        return sigmoid(beta * z) * (ls(beta * z) - math.log(1 - e)) + sigmoid(-beta * z) * (ls(-beta * z) - math.log(e))
    if kind == "hinge":
        return relu(1 - beta * z)
    if kind == "ipo":
        return F.pow(z - 1 / (2 * beta), 2)
    if kind == "bco_pair":
        return -ls(beta * x - delta) - ls(-(beta * y - delta))
    if kind == "sppo_hard":
        return F.pow(x - 0.5 / beta, 2) + F.pow(y + 0.5 / beta, 2)
    if kind == "nca_pair":
        return -ls(beta * x) - 0.5 * ls(-beta * x) - 0.5 * ls(-beta * y)
    if kind == "apo_zero":
        return 1 - sigmoid(beta * x) + sigmoid(beta * y)
    if kind == "apo_down":
        return sigmoid(beta * x) + 1 - sigmoid(beta * (x - y))
    if kind == "discopop":
        mod = sigmoid(beta * z / tau)
        return -ls(beta * z) * (1 - mod) + F.exp(-beta * z) * mod
    if kind == "sft":
        return -c
    raise ValueError(f"no pairwise loss {kind!r}")


def divergence_margin(kind: str, c="pc", r="pr", C="rc", R="rr", alpha: float = 1.0) -> Column:
    """The margin under another divergence: alpha, or Jensen-Shannon."""
    x, y = col(c) - col(C), col(r) - col(R)
    if kind == "alpha":
        return (cap_exp(-alpha * y) - cap_exp(-alpha * x)) / alpha
    return (x - y) - (softplus(x) - softplus(y))


def kto(label, lr, kl, beta: float = 0.1, chosen_weight: float = 1.0, rejected_weight: float = 1.0) -> Column:
    """Unpaired loss; kl is the batch's, not below 0."""
    lr, kl = col(lr), F.greatest(col(kl), F.lit(0.0))
    return F.when(col(label), chosen_weight * (1 - sigmoid(beta * (lr - kl)))).otherwise(rejected_weight * (1 - sigmoid(beta * (kl - lr))))


def apo_zero_unpaired(label, lr, beta: float = 0.1) -> Column:
    return F.when(col(label), 1 - sigmoid(beta * col(lr))).otherwise(sigmoid(beta * col(lr)))


def density_ratio(p, lo: float = 0.5, hi: float = 10.0) -> Column:
    """Weight of a rejected row from the probability of being chosen-like."""
    p = col(p)
    return clip(p / (1 - p + 1e-8), lo, hi)


def cpo(kind: str, c="pc", r="pr", beta: float = 0.1, smoothing: float = 0.0, gamma: float = 0.5) -> Column:
    """Reference-free losses."""
    z = col(c) - col(r)
    if kind == "simpo":
        z = z - gamma / beta
    if kind in ("sigmoid", "simpo"):
        return -log_sigmoid(beta * z) * (1 - smoothing) - log_sigmoid(-beta * z) * smoothing
    if kind == "hinge":
        return relu(1 - beta * z)
    if kind == "ipo":
        return F.pow(z - 1 / (2 * beta), 2)
    raise ValueError(f"no loss {kind!r}")


def log_odds(c, r) -> Column:
    """Log odds ratio of two mean log-probabilities below 0."""
    c, r = col(c), col(r)
    return (c - r) - (F.log1p(-F.exp(c)) - F.log1p(-F.exp(r)))


def orpo(c, r, beta: float = 0.1) -> Column:
    """The preference part of the odds-ratio loss."""
    return beta * log_sigmoid(log_odds(c, r))


def bradley_terry(c, r, margin=0.0, centre: float = 0.0) -> Column:
    """Reward-model loss of a pair; a coefficient over 0 pulls the rewards' sum to 0."""
    c, r = col(c), col(r)
    loss = -log_sigmoid(c - r - margin)
    return loss + centre * F.pow(c + r, 2) if centre else loss


def kl(kind: str, new, ref) -> Column:
    """k1: -(ref - new); k3: exp(r) - 1 - r with r = ref - new."""
    r = col(ref) - col(new)
    return -r if kind == "k1" else F.exp(r) - 1 - r


def clipped(ratio, adv, lo: float, hi: float, delta: float | None = None) -> Column:
    """-min(ratio * A, clip(ratio) * A); ``delta`` bounds the unclipped ratio from above too."""
    ratio, adv = col(ratio), col(adv)
    first = F.least(ratio, F.lit(delta)) if delta is not None else ratio
    return -F.least(first * adv, clip(ratio, 1 - lo, 1 + hi) * adv)


def scheduled(values: list[float], epoch) -> Column:
    """The value of an epoch; the last one from then on."""
    a = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(a, F.least(col(epoch).cast("int") + 1, F.lit(len(values))))
