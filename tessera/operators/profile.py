"""Profiling and descriptive statistics as relations: aggregates in one pass, and exact quantiles from counts of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shape import quantiles, small


def long_form(df: DataFrame, stats: dict[str, dict[str, Column]], key: str = "col") -> DataFrame:
    """One row per column from {column: {statistic: aggregate}}, all taken in a single pass."""
    flat = df.agg(*[a.alias(f"{c}|{s}") for c, d in stats.items() for s, a in d.items()])
    rows = [F.struct(F.lit(c).alias(key), *[F.col(f"`{c}|{s}`").alias(s) for s in d]) for c, d in stats.items()]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _with_quantiles(df: DataFrame, cols: list[str], qs: dict[str, float], rest: DataFrame) -> DataFrame:
    """``rest``, a row per column named in ``col``, with the exact quantiles of each; the values of all columns are counted in one pass."""
    if small(df.select(*cols)):
        flat = df.agg(*[F.percentile(c, F.array(*[F.lit(float(x)) for x in qs.values()])).alias(c) for c in cols])
        q = flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("q")) for c in cols])).alias("x")).select("x.*")
        return rest.join(F.broadcast(q), "col").select(*rest.columns, *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(qs)])
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    q = quantiles(values, "v", list(qs.values()), "col")
    return rest.join(q, "col", "left").select(*rest.columns, *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(qs)])


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles (interpolated) and greatest per column."""
    rest = long_form(df, {c: {"n": F.count(c), "mean": F.round(F.avg(c), 6), "std": F.round(F.stddev_samp(c), 6), "low": F.min(c), "high": F.max(c)} for c in cols})
    return _with_quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rest).select("col", "n", "mean", "std", "low", "q25", "q50", "q75", "high")


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, median and sample deviation per column."""
    rest = long_form(df, {c: {"mean": F.round(F.avg(c), 6), "std": F.round(F.stddev_samp(c), 6)} for c in cols})
    return _with_quantiles(df, cols, {"median": 0.5}, rest).select("col", "mean", "median", "std")


def skewness_g1(c: str) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(c)
    return F.skewness(c) * F.try_divide(F.sqrt((n * (n - 1)).cast("double")), (n - 2).cast("double"))


def correlation(a: str, b: str) -> Column:
    """Correlation over rows where both are there; null where one is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (a, b, corr) for each pair of columns, a before b."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    flat = df.agg(*[F.round(correlation(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("r")).select("r.*")


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls and whether there are any, per column."""
    return long_form(df, {c: {"n_null": F.count_if(F.col(c).isNull()), "any_null": F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False))} for c in cols})


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values per column, null counting as one."""
    return long_form(df, {c: {"n_unique": F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))} for c in cols})


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def shares(df: DataFrame, c: str) -> DataFrame:
    """Share of each value among non-null ones: totals are summed from the counts, not from the rows."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(c, F.round(F.col("n") / F.col("total"), 6).alias("share"))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins are left out."""
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.least(F.floor((F.col(c) - F.col("lo")) / width) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, c: str, *hues: str) -> DataFrame:
    """Five-number summary per group with whisker ends at 1.5 times the quartile range."""
    g = df.groupBy(*hues).agg(F.min(c).alias("low"), F.max(c).alias("high")).join(quantiles(df, c, [0.25, 0.5, 0.75], *hues), list(hues))
    g = g.select(*hues, "low", "high", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    r = lambda x: F.round(x, 6)
    return g.select(*hues, "low", r(F.col("q1")).alias("q1"), r(F.col("q2")).alias("q2"), r(F.col("q3")).alias("q3"), "high", r(F.col("q1") - reach).alias("fence_low"), r(F.col("q3") + reach).alias("fence_high"))


def box_outliers(df: DataFrame, c: str, *hues: str) -> DataFrame:
    """Values beyond the fences per group: how many, and how many in all."""
    fences = box(df, c, *hues).select(*hues, "fence_low", "fence_high")
    out = (F.col(c) < F.col("fence_low")) | (F.col(c) > F.col("fence_high"))
    return df.join(fences, list(hues)).groupBy(*hues).agg(F.count_if(out).alias("n_out"), F.count("*").alias("n"))


def density(df: DataFrame, c: str, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density at the points of a grid; the rows are read once, the grid is in the program."""
    k = lambda x: F.round(F.avg(F.exp(-0.5 * F.pow((F.lit(float(x)) - F.col(c)) / bandwidth, 2))) / (bandwidth * 2.5066282746310002), 9)
    flat = df.agg(*[k(x).alias(f"g{i}") for i, x in enumerate(grid)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"g{i}").alias("density")) for i, x in enumerate(grid)])).alias("r")).select("r.*")


def simple_regression(df: DataFrame, y: Column, x: Column) -> DataFrame:
    """Slope, intercept, their standard errors and t values, R squared, the residual deviation and its degrees of freedom, and the rows used."""
    d = df.select(y.alias("y"), x.alias("x"))
    fit = d.agg(*[f("y", "x").alias(n) for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2), ("n", F.regr_count), ("sxx", F.regr_sxx), ("syy", F.regr_syy), ("mx", F.regr_avgx))])
    fit = fit.withColumn("sigma", F.sqrt(F.try_divide(F.col("syy") * (1 - F.col("r2")), F.col("n") - 2)))
    fit = fit.withColumn("slope_se", F.try_divide("sigma", F.sqrt("sxx"))).withColumn("intercept_se", F.col("sigma") * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))))
    r = lambda c, n: F.round(c, 6).alias(n)
    c = F.col
    return fit.select(
        r(c("slope"), "slope"), r(c("intercept"), "intercept"), r(c("r2"), "r2"), "n", r(c("slope_se"), "slope_se"), r(c("intercept_se"), "intercept_se"),
        F.round(F.try_divide("slope", "slope_se"), 3).alias("slope_t"), F.round(F.try_divide("intercept", "intercept_se"), 3).alias("intercept_t"), r(c("sigma"), "sigma"), (c("n") - 2).alias("df"),
    )


def introspect(df: DataFrame) -> DataFrame:
    """Name, position and type of each column."""
    rows = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "col string, pos int, type string")
