"""Rank statistics of two samples, by ranks and running counts instead of a product of the samples.

Values are pre-aggregated per distinct value first. With `by`, a window holds the distinct values of one group: samples that the
operators of this package draw are bounded, so is that window. Without, running counts go over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.functions.ranks import running
from scriptoria.functions.stats import correlation_p, normal_p


def two_samples(df: DataFrame, value: str, is_x: Column, by: list[str] | None = None) -> DataFrame:
    """(by, n_x, n_y, delta, u, z): Cliff's delta of x against y, Mann-Whitney U of x, and its z.

    delta is (pairs x > y less pairs x < y) / all pairs, null if a side is empty. z is corrected for ties and continuity. Null
    values are left out.
    """
    by = by or []
    return of_counts(df.filter(F.col(value).isNotNull() & is_x.isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(is_x).alias("x"), F.count_if(~is_x).alias("y")), by)


def of_counts(c: DataFrame, by: list[str]) -> DataFrame:
    """`two_samples` from (by, v, x, y): how often each value v, once per group, stands in x and in y."""
    c = _running(c, "v", "y", by, "upto").withColumn("below", F.col("upto") - F.col("y"))
    t = F.col("x") + F.col("y")
    g = c.groupBy(*by) if by else c
    a = g.agg(
        F.sum("x").alias("n_x"), F.sum("y").alias("n_y"), F.sum(F.col("x").cast("double") * F.col("below")).alias("above"), F.sum(F.col("x").cast("double") * F.col("y")).alias("tied"),
        F.sum(t.cast("double") * t * t - t).alias("ties"),
    )
    n_x, n_y, n = F.col("n_x"), F.col("n_y"), (F.col("n_x") + F.col("n_y")).cast("double")
    u = F.col("above") + 0.5 * F.col("tied")
    product = n_x.cast("double") * n_y
    sd = F.sqrt(product / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    big = F.greatest(u, product - u) - product / 2 - 0.5
    full = (n_x > 0) & (n_y > 0)
    return a.select(
        *by, "n_x", "n_y", F.when(full, 2 * u / product - 1).alias("delta"), F.when(full, u).alias("u"),
        F.when(full, F.try_divide(big, sd)).alias("z"),
    )


def _running(df: DataFrame, value: str, amount: str, by: list[str], name: str) -> DataFrame:
    if not by:
        return running(df, F.col(value), amount=amount, name=name)
    return df.withColumn(name, F.sum(amount).over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))


def with_p(df: DataFrame, z: str = "z", p: str = "p") -> DataFrame:
    """The two-sided asymptotic p of a z."""
    return df.withColumn(p, F.least(F.lit(1.0), normal_p(F.greatest(F.col(z), F.lit(0.0)))))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, rho, p): Pearson's correlation of mid-ranks with its two-sided p; null if either is constant. Null values are left out."""
    by = by or []
    pair = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    return spearman_of_counts(pair, by)


def spearman_of_counts(pair: DataFrame, by: list[str]) -> DataFrame:
    """`spearman` from (by, _x, _y, _n): how often each pair of values occurs, each once per group.

    Mid-ranks come from running counts over distinct values, joined back to the counted value pairs.
    """

    def mid(c: str) -> DataFrame:
        d = _running(pair.groupBy(*by, c).agg(F.sum("_n").alias("k")), c, "k", by, "upto")
        return d.select(*by, c, (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{c}"))

    full = pair.join(mid("_x"), [*by, "_x"]).join(mid("_y"), [*by, "_y"])
    s = lambda e: F.sum(F.col("_n") * e)
    a, b = F.col("r_x"), F.col("r_y")
    # the mean rank is known: sums about it keep their digits for any n
    n = full.groupBy(*by).agg(F.sum("_n").alias("n")) if by else full.agg(F.sum("_n").alias("n"))
    full = (full.join(n, by) if by else full.join(n)).withColumns({"r_x": a - (F.col("n") + 1) / 2, "r_y": b - (F.col("n") + 1) / 2})
    g = full.groupBy(*by) if by else full
    m = g.agg(F.sum("_n").alias("n"), s(a * b).alias("cov"), s(a * a).alias("va"), s(b * b).alias("vb"))
    rho = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))
    return m.select(*by, "n", rho.alias("rho")).withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each."""
    g = df.groupBy(*by) if by else df
    return g.agg(F.count(value).alias("n"), *[F.percentile(value, q).alias(k) for k, q in at.items()])
