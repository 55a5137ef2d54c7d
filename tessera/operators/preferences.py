"""Losses that need more than one row: rank pairing, running means, batch divergences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.objectives import log_sigmoid
from tessera.operators.shape import paired_by_rank, running_sums, small, value_ranks


def rank_paired(df: DataFrame, left: Column, right: Column, beta: float = 0.1, smoothing: float = 0.0, within: list[str] | None = None) -> DataFrame:
    """Both sides sorted by themselves and paired by rank, with the sigmoid loss of each pair's difference.

    Values are counted, the counts ranked in even pieces and paired as runs, so no task sorts all rows and no side is sent to all tasks; ``within`` pairs
    inside batches instead.  Nulls have no rank.
    """
    if within:
        w = Window.partitionBy(*within)
        a = df.select(*within, left.alias("a")).withColumn("rank", F.row_number().over(w.orderBy("a")))
        b = df.select(*within, right.alias("b")).withColumn("rank", F.row_number().over(w.orderBy("b")))
        pairs = a.join(b, [*within, "rank"])
    else:
        both = df.select(left.alias("a"), right.alias("b"))
        if small(both):
            pairs = value_ranks(both.select("a"), "a").hint("merge").join(value_ranks(both.select("b"), "b"), "rank")
        else:
            pairs = paired_by_rank(both, "a", "b")
    z = beta * (F.col("a") - F.col("b"))
    return pairs.withColumn("loss", -log_sigmoid(z) * (1 - smoothing) - log_sigmoid(-z) * smoothing)


def running_delta(df: DataFrame, batch: str, reward: Column, out: str = "delta", coarse: Column | None = None) -> DataFrame:
    """The mean reward of all batches up to each one, joined to its rows; batches are summed before they are ordered, and pieces of them (``coarse``, which grows with them; a number's thousands where it isn't given) before those."""
    sums = df.groupBy(batch).agg(F.sum(reward).alias("s"), F.count(reward).alias("n"))
    sums = running_sums(sums, coarse if coarse is not None else F.floor(F.col(batch) / 1024), batch, ["s", "n"])
    return df.join(sums.select(batch, F.try_divide("run_s", "run_n").alias(out)), batch)


def batch_mean(df: DataFrame, batch: str, value: Column, out: str, floor: float | None = None) -> DataFrame:
    """The mean over each batch, joined to its rows and not below ``floor``."""
    m = df.groupBy(batch).agg(F.avg(value).alias(out))
    if floor is not None:
        m = m.withColumn(out, F.greatest(out, F.lit(floor)))
    return df.join(m, batch)
