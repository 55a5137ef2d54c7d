"""Array expressions for token sequences.  Padding is never made unless asked for: a mask is an array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.strings import col


def keep_end(a, n: int) -> Column:
    """The last ``n`` elements, all when there are fewer."""
    a = col(a)
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def keep_start(a, n: int) -> Column:
    return F.slice(col(a), 1, n)


def with_bos(a, bos) -> Column:
    """Begins with ``bos``, added if it is not there."""
    a = col(a)
    return F.when((F.size(a) > 0) & (F.get(a, F.lit(0)) == bos), a).otherwise(F.array_prepend(a, bos))


def with_eos(a, eos) -> Column:
    a = col(a)
    return F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1) == eos), a).otherwise(F.array_append(a, eos))


def label_mask(prompt, answer, ignore: int = -100) -> Column:
    """Labels of prompt and answer: the prompt's are ignored."""
    return F.concat(F.array_repeat(F.lit(ignore), F.size(col(prompt))), col(answer))


def step_labels(steps, labels, ignore: int = -100) -> Column:
    """Labels of steps of tokens: the last token of a step has its label, the others are ignored."""
    pairs = F.zip_with(col(steps), col(labels), lambda s, y: F.concat(F.array_repeat(F.lit(ignore), F.size(s) - 1), F.array(y.cast("int"))))
    return F.flatten(pairs)


def until_first(a, stop, inclusive: bool = True) -> Column:
    """Up to the first ``stop``; all of it when there is none."""
    a = col(a)
    at = F.array_position(a, stop).cast("int")
    return F.when(at == 0, a).otherwise(F.slice(a, 1, at if inclusive else at - 1))


def gather(a, places: list[int]) -> Column:
    """The elements at the given places from 0; null where there is none."""
    a = col(a)
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(a, i))


def has(a, token) -> Column:
    return F.array_contains(col(a), token)


def pad(a, n: int, value, left: bool = False) -> Column:
    """At least ``n`` long."""
    a = col(a)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def differing(a, b) -> Column:
    """Positions that differ, over the longer length."""
    return F.size(F.filter(F.zip_with(col(a), col(b), lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def common_prefix(a, b) -> Column:
    """The longest common prefix of two arrays."""
    a, b = col(a), col(b)
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.slice(a, 1, F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1))


def shifted(a, by: int = 1) -> Column:
    """Without the first ``by`` elements, for next-token alignment."""
    a = col(a)
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _minus(a, value) -> Column:
    """Every element less one value.  The value is repeated first: inside a lambda it would be worked out for each element."""
    a = col(a)
    return F.zip_with(a, F.array_repeat(value, F.size(a)), lambda x, v: x - v)


def log_sum_exp(a) -> Column:
    m = F.array_max(col(a))
    return m + F.log(F.aggregate(_minus(a, m), F.lit(0.0), lambda s, x: s + F.exp(x)))


def log_softmax(a) -> Column:
    return _minus(a, log_sum_exp(a))


def softmax_entropy(a) -> Column:
    """Entropy of the softmax of logits."""
    return -F.aggregate(log_softmax(a), F.lit(0.0), lambda s, x: s + F.exp(x) * x)


def discounted_advantages(delta, decay: float) -> Column:
    """Reverse recurrence A_t = delta_t + decay * A_(t+1) over an array."""
    delta = col(delta)
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))
    run = F.aggregate(F.reverse(delta), start, lambda s, d: F.struct((d + decay * s["last"]).alias("last"), F.array_append(s["out"], d + decay * s["last"]).alias("out")))
    return F.reverse(run["out"])
