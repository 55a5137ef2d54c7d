"""Imputation, encoding, ranking and row selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Even pieces that a column is dealt into, by sampled bounds, and the parts that each is cut into by width.
PIECES, PARTS = 24, 64
#: How far from a wanted quantile the rows are that are sorted for it, as a share of all, and the accuracy of sampled bounds.
NEAR, ACCURACY = 0.002, 10_000
#: Rows that one task may sort, and bytes, by the optimizer's estimate, of a relation whose values one task may hold.
SORTED, SMALL = 1 << 16, 32 << 20


def small(df: DataFrame) -> bool:
    """Whether the optimizer is sure that a relation is small; of joins and unknown sources it isn't.

    Its sources have to be small too: a few columns of a large table look small where the files are compressed.
    """
    plan, of = df._jdf.queryExecution().optimizedPlan(), lambda p: int(str(p.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    return of(plan) <= SMALL and sum(of(leaves.apply(i)) for i in range(leaves.size())) <= SMALL


def impute_group_median(df: DataFrame, value: str, keys: list[str], bad: Column, donor: Column, out: str) -> DataFrame:
    """Bad values take the median of the donors with the same keys; null without donors.

    Donor medians are one row per key; whether they are broadcast is left to their measured size.
    """
    med = df.where(donor).groupBy(*keys).agg(F.median(value).alias("__med"))
    return df.join(med, keys, "left").withColumn(out, F.when(bad, F.col("__med")).otherwise(F.col(value))).drop("__med")


def fill_median(df: DataFrame, c: str) -> DataFrame:
    """Nulls take the column's exact median (one row, joined to all)."""
    med = quantiles(df, c, [0.5]).select(F.col("q")[0].alias("__med"))
    return df.crossJoin(F.broadcast(med)).withColumn(c, F.coalesce(c, "__med")).drop("__med")


def fill_mean(df: DataFrame, c: str) -> DataFrame:
    """Nulls take the column's mean (one row, joined to all)."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(c).alias("__mean")))).withColumn(c, F.coalesce(c, "__mean")).drop("__mean")


def label_encode(df: DataFrame, c: str, out: str, prefix: int = 3) -> DataFrame:
    """Numbers from 0 by sorted value.  Distinct values are ranked, not rows; those of one beginning of ``prefix`` characters (texts) or of one piece (numbers) in a task."""
    kinds = df.select(c).where(F.col(c).isNotNull()).distinct()
    if isinstance(df.schema[c].dataType, StringType):
        ranks = global_rank(kinds, F.substring(c, 1, prefix), [c], "__rank")
    else:
        ranks = global_rank(*with_pieces(kinds, c), [c], "__rank")
    return df.join(ranks.select(c, (F.col("__rank") - 1).cast("int").alias(out)), c, "left")


def one_hot(c: str, values: list[str], prefix: str = "cat_") -> list[Column]:
    """A 0/1 column per listed value."""
    return [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]


def ordinal(c: str, levels: list[str]) -> Column:
    """Place of a value among ordered levels from 1; null for others."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(c))
    return F.when(at > 0, at.cast("int"))


def min_max(df: DataFrame, c: str, out: str, fit: DataFrame | None = None) -> DataFrame:
    """Scaled to 0..1 by the extremes of ``fit`` (the rows themselves when not given)."""
    ends = (fit if fit is not None else df).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.try_divide(F.col(c) - F.col("__lo"), F.col("__hi") - F.col("__lo")))


def standardise(df: DataFrame, c: str, out: str) -> DataFrame:
    """Centred and divided by the population deviation."""
    m = df.agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.try_divide(F.col(c) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def with_pieces(df: DataFrame, c: str) -> tuple[DataFrame, Column]:
    """The rows with columns that tell their piece, and the piece: it grows with the values of a number, and values are dealt evenly."""
    inner = F.percentile_approx(F.col(c).cast("double"), [k / PIECES for k in range(1, PIECES)], ACCURACY)
    cuts = df.agg(F.concat(F.array(F.min(c).cast("double")), inner, F.array(F.max(c).cast("double"))).alias("__cuts"))  # one row
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("__at", F.size(F.filter(F.slice("__cuts", 2, PIECES - 1), lambda x: x < F.col(c))))
    low, high = F.get("__cuts", F.col("__at")), F.get("__cuts", F.col("__at") + 1)
    part = F.floor(F.coalesce(F.try_divide((F.col(c) - low) * PARTS, high - low), F.lit(0.0)))
    return rows, F.col("__at") * PARTS + F.least(F.greatest(part, F.lit(0)), F.lit(PARTS - 1))


def running_sums(df: DataFrame, coarse: Column, order: str, sums: list[str]) -> DataFrame:
    """Adds ``run_<c>``: the sum of each column up to and with each row, in order.  ``coarse`` grows with the order: pieces are summed before their rows, so no task sees more than a piece."""
    rows = df.withColumn("__piece", coarse)
    up = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("__piece").agg(*[F.sum(c).alias(f"__of_{c}") for c in sums])
    pieces = pieces.select("__piece", *[F.coalesce(F.sum(f"__of_{c}").over(up), F.lit(0)).alias(f"__to_{c}") for c in sums])
    own = Window.partitionBy("__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(c).over(own).alias(f"__own_{c}") for c in sums]).join(pieces, "__piece")
    return rows.select(*df.columns, *[(F.coalesce(F.col(f"__own_{c}"), F.lit(0)) + F.col(f"__to_{c}")).alias(f"run_{c}") for c in sums])


def at_ranks(df: DataFrame, c: str, ranks, near: list[float], *keys: str, **also: Column) -> DataFrame:
    """Order statistics per group without a task that holds a column: rows (keys, n, found), found an array of the structs (at, value, before).

    ranks(n): array of ranks from 0, as longs, for a group of ``n`` values, which may read the aggregates ``also``; near: the quantiles about which the ranks
    are; before: values that are less.  Values are counted, the counts cut a little below and above those quantiles, and only the pieces that hold a wanted rank
    are sorted; a rank that is elsewhere is found all the same.  Nulls don't count.
    """
    rows = df.where(F.col(c).isNotNull()).withColumn("__v", F.col(c))
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    cuts = sorted({min(max(q + d, 0.0), 1.0) for q in near for d in (-NEAR, NEAR)})
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", cuts, ACCURACY).alias("__cuts"), *[a.alias(name) for name, a in also.items()])
    both = counts.join(groups, list(keys)) if keys else counts.crossJoin(F.broadcast(groups))
    both = both.select(*keys, "__v", "__n", F.size(F.filter("__cuts", lambda x: x < F.col("__v"))).alias("__piece"))
    up = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = both.groupBy(*keys, "__piece").agg(F.sum("__n").alias("__s")).withColumn("__to", F.coalesce(F.sum("__s").over(up), F.lit(0)))
    asked = groups.select(*keys, "n", F.posexplode(ranks(F.col("n"))).alias("__at", "__rank"))
    wanted = pieces.join(asked, list(keys)) if keys else pieces.crossJoin(F.broadcast(asked))
    wanted = wanted.where("__to <= __rank AND __rank < __to + __s").select(*keys, "n", "__piece", "__to", "__at", "__rank")
    own = Window.partitionBy(*keys, "__piece").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.join(wanted.select(*keys, "__piece").distinct(), [*keys, "__piece"], "left_semi").withColumn("__own", F.coalesce(F.sum("__n").over(own), F.lit(0)))
    hit = placed.join(wanted, [*keys, "__piece"]).withColumn("__to", F.col("__to") + F.col("__own")).where("__to <= __rank AND __rank < __to + __n")
    one = F.struct(F.col("__at").alias("at"), F.col("__v").alias("value"), F.col("__to").alias("before"))
    return hit.groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(one)).alias("found"))  # a row per wanted rank


def quantiles(df: DataFrame, c: str, qs: list[float], *keys: str) -> DataFrame:
    """Rows (keys, q): the exact quantiles of each group, interpolated, as an array; a null one where no value is there (ungrouped only)."""
    if small(df.select(*keys, c)):
        return df.where(F.col(c).isNotNull()).groupBy(*keys).agg(F.percentile(c, F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    place = lambda n, q: F.lit(float(q)) * (n - 1)
    ranks = lambda n: F.array(*[f(place(n, q)).cast("bigint") for q in qs for f in (F.floor, F.ceil)])
    got = at_ranks(df, c, ranks, qs, *keys)
    v = lambda i: F.get("found", F.lit(i))["value"].cast("double")
    between = [v(2 * i) + (v(2 * i + 1) - v(2 * i)) * (place(F.col("n"), q) - F.floor(place(F.col("n"), q))) for i, q in enumerate(qs)]
    return got.select(*keys, F.when(F.col("n").isNotNull(), F.array(*between)).alias("q"))


def ranked_values(df: DataFrame, c: str) -> DataFrame:
    """Rows (c, n, rank): distinct values of a number, how many rows show each, and the rank of the first of them, from 1."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    rows, piece = with_pieces(counts, c)
    out = running_sums(rows.select(c, "n", piece.alias("__cut")), F.col("__cut"), c, ["n"])
    return out.select(c, "n", (F.col("run_n") - F.col("n") + 1).alias("rank"))


def value_ranks(df: DataFrame, c: str) -> DataFrame:
    """Rows (c, rank): every row's value of a number with its rank from 1; nulls have none."""
    if small(df):
        return df.where(F.col(c).isNotNull()).select(c, F.row_number().over(Window.orderBy(c)).cast("bigint").alias("rank"))
    return spread(ranked_values(df, c), c)


def spread(ranked: DataFrame, c: str, chunk: int = 1 << 16) -> DataFrame:
    """A row (c, rank) for each row that ``ranked_values`` counted; a frequent value goes to many tasks, ``chunk`` rows at a time."""
    parts = ranked.select(c, "n", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {chunk}"))).alias("__part"))
    parts = parts.select(c, (F.col("rank") + F.col("__part") * chunk).alias("__lo"), F.least(F.col("n") - F.col("__part") * chunk, F.lit(chunk)).alias("__len"))
    return parts.repartition("__lo").select(c, F.explode(F.sequence(F.col("__lo"), F.col("__lo") + F.col("__len") - 1)).alias("rank"))


def paired_by_rank(df: DataFrame, left: str, right: str, block: int = 1 << 16) -> DataFrame:
    """Rows (rank, left, right): both columns of numbers sorted by themselves and put side by side; nulls have no rank.

    Runs of equal values are paired, not rows: they are cut at every ``block`` ranks, those of a block meet in a task, and a pair of runs becomes rows where it
    is read.  The blocks have a fixed number of partitions: by their bytes the optimizer would take them, and what comes of them, for small.
    """

    def runs(c: str, names: list[str]) -> DataFrame:
        r = ranked_values(df.select(c), c).withColumn("__last", F.col("rank") + F.col("n") - 1)
        r = r.select(c, "rank", "__last", F.explode(F.sequence(F.expr(f"(rank - 1) div {block}"), F.expr(f"(__last - 1) div {block}"))).alias("__block"))
        run = F.struct(F.col(c).alias("v"), F.least("__last", (F.col("__block") + 1) * block).alias("end"))
        return r.select("__block", F.greatest("rank", F.col("__block") * block + 1).alias("__lo"), *[(run if x == c else F.lit(None)).alias(x) for x in names])

    names = [left, right]
    both = runs(left, names).unionByName(runs(right, names))
    both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__block")
    both = both.groupBy("__block", "__lo").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    w = Window.partitionBy("__block").orderBy("__lo")
    now = [F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names]
    both = both.select("__lo", *now, F.lead("__lo").over(w).alias("__next"))
    hi = F.least(F.col("__next") - 1, F.col(left)["end"], F.col(right)["end"])
    both = both.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("__hi", hi).where("__lo <= __hi")
    return both.select(F.explode(F.sequence("__lo", "__hi")).alias("rank"), *[F.col(c)["v"].alias(c) for c in names])


def global_rank(df: DataFrame, coarse: Column, order: list, out: str) -> DataFrame:
    """Row numbers from 1 over all rows without one task for all: ``coarse`` grows with the order and cuts it into pieces.

    Rows are numbered inside a piece; the rows of pieces before are summed over the pieces, which are few.
    """
    rows = df.withColumn("__piece", coarse)
    sizes = rows.groupBy("__piece").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__piece").orderBy(*order)
    return rows.withColumn("__own", F.row_number().over(w)).join(sizes, "__piece").withColumn(out, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__piece", "__own", "__before")


def zip_by_key(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Columns of two equally long relations side by side, matched by the key that both carry."""
    return left.join(right, key)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def hash_fold(key: str, folds: int) -> Column:
    """A fold number from the key alone, the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed permutation of the rows, by digest of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same in every run."""
    return shuffled(df, key, seed).limit(n)


def digest_order(key: str, seed: int) -> Column:
    """A text to order by at random: the same for a key in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def digest_share(key: str, seed: int) -> Column:
    """A number from 0 (included) to 1 drawn for the key, the same in every run and engine."""
    return F.conv(F.substring(digest_order(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def poisson_cuts(rate: float, most: int = 10) -> list[float]:
    """Cumulated chances of 0, 1 and more draws: a number from 0 to 1 at or over the first k of them stands for k draws."""
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(most):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def with_replacement(df: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """Each row as often as a Poisson draw for its key says: ``rate`` times on average."""
    u = digest_share(key, seed)
    n = sum((F.when(u >= c, 1).otherwise(0) for c in poisson_cuts(rate)), F.lit(0))
    return df.withColumn("__n", n).where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def by_column(df: DataFrame, name: str, there, missing) -> Column:
    """The column that ``there()`` makes where the relation has a column of that name, else that of ``missing()``."""
    return there() if name in df.columns else missing()


def same_length(df: DataFrame, *arrays: str) -> DataFrame:
    """The rows; running it fails on the first row whose arrays differ in length."""
    first, *rest = arrays
    wrong = F.lit(False)
    for a in rest:
        wrong = wrong | (F.size(a) != F.size(first))
    message = F.concat(F.lit(f"{', '.join(arrays)} differ in length: "), F.concat_ws(", ", *[F.size(a).cast("string") for a in arrays]))
    return df.withColumn(first, F.when(wrong, F.raise_error(message)).otherwise(F.col(first)))
