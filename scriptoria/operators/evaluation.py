"""Multi-label evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.operators import rankstats


def matches(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """`df` with tp, fp, fn and precision, recall, f1 of each row's sets; an empty denominator gives 0."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    df = df.withColumns({"tp": F.size(F.array_intersect(g, p)), "fp": F.size(F.array_except(p, g)), "fn": F.size(F.array_except(g, p))})
    return rates(df)


def rates(df: DataFrame) -> DataFrame:
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    df = df.withColumn("precision", z(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", z(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def micro(df: DataFrame) -> DataFrame:
    """One row: summed tp, fp, fn, then the rates."""
    got = rates(df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))
    return got.select("tp", "fp", "fn", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")])


def known_items(df: DataFrame, key: str, items: str, inventory: DataFrame) -> DataFrame:
    """(key, items): each row's items that the inventory (item) has, in order; rows left with none have no row. `df` has each key once.

    A join, so an inventory of any size will do.
    """
    flat = df.select(key, F.posexplode(items).alias("pos", "item")).join(inventory.select("item").distinct(), "item", "left_semi")
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias(items))


def recovery(counts: DataFrame) -> DataFrame:
    """(layer, n_x, n_y, delta) of `pairs.label_counts`: pairs that share a label against those that don't; 0 if either is empty."""
    got = rankstats.of_counts(counts, ["layer"])
    return got.select("layer", "n_x", "n_y", F.round(F.coalesce("delta", F.lit(0.0)), 6).alias("delta"))


def mid_ranks(counts: DataFrame) -> DataFrame:
    """(layer, v, mid): the mid-rank of each similarity over all pairs. A layer has at most as many values as its digits allow."""
    t = F.col("x") + F.col("y")
    upto = F.sum(t).over(W.partitionBy("layer").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return counts.select("layer", "v", (upto - t + (t + 1) / 2).alias("mid"))


def permutation_test(counts: DataFrame, sums: DataFrame) -> DataFrame:
    """(layer, delta, n_runs, null_mean, null_sd, z, p) of the seen delta and the runs' rank sums (`pairs.permuted_sums`).

    A run without both kinds of pairs has delta 0. sd has n - 1 in its denominator; p is the share of |null| >= |seen|.
    """
    seen = recovery(counts)
    n = counts.groupBy("layer").agg(F.sum(F.col("x") + F.col("y")).alias("pairs"))
    x, y = F.col("n").cast("double"), (F.col("pairs") - F.col("n")).cast("double")
    delta = F.coalesce(F.round(2 * F.try_divide(F.col("total") - x * (x + 1) / 2, x * y) - 1, 6), F.lit(0.0))
    null = sums.join(n, "layer").select("layer", delta.alias("null")).join(seen.select("layer", "delta"), "layer")
    got = null.groupBy("layer").agg(
        F.first("delta").alias("delta"), F.count("*").alias("n_runs"), F.avg("null").alias("m"), F.stddev_samp("null").alias("s"),
        F.round(F.avg((F.abs("null") >= F.abs("delta")).cast("double")), 4).alias("p"),
    )
    z = F.round(F.coalesce(F.try_divide(F.col("delta") - F.col("m"), F.col("s")), F.lit(0.0)), 3)
    return got.select("layer", "delta", "n_runs", F.round("m", 6).alias("null_mean"), F.round("s", 6).alias("null_sd"), z.alias("z"), "p")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """`df`, or an error if a key repeats."""
    twice = df.groupBy(key).count().filter("count > 1").head(3)
    if twice:
        raise ValueError(f"{key} repeats: {[r[0] for r in twice]}")
    return df


def require_known(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`ids`, or an error naming those that `known` lacks."""
    missing = ids.select(key).distinct().join(known.select(key), key, "left_anti").orderBy(key).head(5)
    if missing:
        raise ValueError(f"unknown {key}: {[r[0] for r in missing]}")
    return ids
