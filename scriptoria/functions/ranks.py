"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.plans.lineage import cut


def _offsets(df: DataFrame, value: Column, start: float = 0, reverse: bool = False) -> dict:
    """Running combination of one number per partition, before (or after) each; one row per partition comes to the driver."""
    got = sorted((r[0], r[1]) for r in df.groupBy("_part").agg(value.alias("v")).collect())
    out, so_far = {}, start
    for part, v in got[::-1] if reverse else got:
        out[part] = so_far
        so_far = so_far + v if not reverse else min(so_far, v)
    return out


def _of(values: dict, default) -> Column:
    """The value of the row's part: an array indexed by part, not a map that each row would search."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.get(F.array(*[F.lit(values.get(k, default)) for k in range(max(values) + 1)]), F.col("_part")), F.lit(default))


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """`df` with its place (from 1) in a total order: range partitions, numbered within, shifted by those before.

    Ties in `order` get some order of their own; give a unique last column for a fixed one. An empty table stays empty.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts, "ranges")
    before = _offsets(parts, F.count("*"), 0)
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, place + _of(before, 0)).drop("_part")


def running(df: DataFrame, *order: Column, amount: str, name: str) -> DataFrame:
    """`df` with the running sum of `amount` in a total order, without gathering it in one task. No two rows may tie."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = _offsets(parts, F.sum(amount), 0)
    upto = F.sum(amount).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn(name, upto + _of(before, 0)).drop("_part")


#: Tests of one part of a false-discovery pass.
TESTS = 1 << 20


def false_discovery(df: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """`df` with Benjamini-Hochberg q over all its rows: p x m / rank, made monotone from the largest p down, at most 1.

    Null p-values aren't tests: they get a null q. Equal p-values share one q.
    """
    tests = df.filter(F.col(p).isNotNull())
    ranked = cut(numbered(tests, F.col(p).asc(), name="_rank").withColumn("_part", F.spark_partition_id()), "tests")
    m = ranked.count()
    raw = F.col(p) * F.lit(m) / F.col("_rank")
    # rows of one file need not stay together: parts are made anew by rank
    ranked = ranked.drop("_part").withColumn("_part", F.floor((F.col("_rank") - 1) / TESTS).cast("int")).withColumn("_raw", raw)
    later = _offsets(ranked, F.min("_raw"), 1.0, reverse=True)
    down = F.min("_raw").over(W.partitionBy("_part").orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0))
    out = ranked.withColumn(q, F.least(down, _of(later, 1.0), F.lit(1.0))).drop("_rank", "_raw", "_part")
    return out.unionByName(df.filter(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))
