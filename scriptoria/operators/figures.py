"""The data behind figures: pivots, bins, leading rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.ranking import top


def heatmap(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """`value` (its mean where a cell repeats) per row and given column; a fixed list saves the pass that would find it."""
    return df.groupBy(row).pivot(column, columns).agg(F.round(F.avg(value), 6))


def colour_limit(df: DataFrame, value: str) -> DataFrame:
    """One row: the largest absolute value, the limit of a symmetric scale."""
    return df.agg(F.max(F.abs(F.col(value))).alias("limit"))


def leading(df: DataFrame, k: int, condition: Column, *order: Column) -> DataFrame:
    """The first k rows that meet a condition."""
    return top(df.filter(condition), k, *order)


def of_leading(df: DataFrame, name: str, k: int, condition: Column, *order: Column) -> DataFrame:
    """All rows of the names that the first k rows meeting a condition have."""
    return df.join(F.broadcast(leading(df, k, condition, *order).select(name).distinct()), name, "left_semi")


def trajectories(trends: DataFrame, k: int, item: str, groups: list[str]) -> DataFrame:
    """(item, direction, issue, share): the k strongest rises and falls in long form."""
    rise = leading(trends, k, F.col("direction") == "rising", F.col("z").desc(), F.col(item))
    fall = leading(trends, k, F.col("direction") == "falling", F.col("z").asc(), F.col(item))
    wide = rise.union(fall)
    long = F.explode(F.array(*[F.struct(F.lit(g).alias("issue"), F.col(f"share_{i}").alias("share")) for i, g in enumerate(groups, 1)]))
    return wide.select(item, "direction", long.alias("x")).select(item, "direction", "x.issue", "x.share")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins 1..bins over [low, high]; the upper end belongs to the last bin."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def grid(df: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple, bins: int) -> DataFrame:
    """(bin_x, bin_y, n): a two-dimensional histogram."""
    b = lambda c, r: F.least(F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / bins)) + 1, F.lit(bins)).cast("int")
    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return df.filter(inside).groupBy(b(x, x_range).alias("bin_x"), b(y, y_range).alias("bin_y")).agg(F.count("*").alias("n"))


def binned_medians(df: DataFrame, x: str, y: str, edges: list[tuple[float, float, str]]) -> DataFrame:
    """(bin, n, median): the median of y in half-open bins (low, high] of x; empty bins have no row."""
    label = F
    for low, high, name in edges:
        label = label.when((F.col(x) > low) & (F.col(x) <= high), name)
    return df.withColumn("bin", label).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.percentile(y, 0.5), 6).alias("median"))
