"""Association of items with groups: 2x2 tables, log odds, Fisher's exact test, false-discovery control, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.ranks import false_discovery
from scriptoria.functions.stats import fisher_p, log_odds, normal_p
from scriptoria.operators.postings import frequency
from scriptoria.plans.lineage import cut


def cells(items: DataFrame, groups: DataFrame, key: str, n: int, item: str, group: str, least_item: int = 10, least_group: int = 0, support: int = 3) -> DataFrame:
    """(item, group, a, n_group, n_item, b, c, d) of the cells with at least `support` common rows out of n.

    `items` and `groups` are distinct postings of the same rows. They meet on the row, so the marginals and the cell count rows
    alike; groups may overlap. Thresholds apply before the join.
    """
    df_i = frequency(items, item, "n_item").filter(F.col("n_item") >= least_item)
    df_g = frequency(groups, group, "n_group").filter(F.col("n_group") >= least_group)
    x, y = items.join(df_i, item), groups.join(df_g, group)
    a = x.join(y, key).groupBy(item, group).agg(F.count("*").alias("a"), F.max("n_item").alias("n_item"), F.max("n_group").alias("n_group"))
    a = a.filter(F.col("a") >= support)
    b, c = F.col("n_group") - F.col("a"), F.col("n_item") - F.col("a")
    return a.select(item, group, "a", "n_group", "n_item", b.alias("b"), c.alias("c"), F.greatest(F.lit(n) - F.col("n_group") - c, F.lit(0)).alias("d"))


def tested(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Cells with log_odds, p, q over all of them, and significant, which is decided before q is rounded."""
    four = [F.col(k) for k in "abcd"]
    df = df.withColumn("log_odds", F.round(log_odds(*four), 3)).withColumn("p", fisher_p(*four))
    df = false_discovery(cut(df, "cells")).withColumn("significant", F.col("q") < alpha)
    return df.withColumns({"p": F.round("p", 6), "q": F.round("q", 6)}).drop("b", "c", "d")


def anchor(df: DataFrame, in_anchor, least: int = 3, share: float = 0.6) -> DataFrame:
    """One row: how many anchor cells there are, positive and significant ones, and whether the map holds up."""
    got = df.filter(in_anchor).agg(F.count("*").alias("n_cells"), F.count_if(F.col("log_odds") > 0).alias("n_pos"), F.count_if("significant").alias("n_sig"))
    part = F.coalesce(F.try_divide(F.col("n_pos"), F.col("n_cells")), F.lit(0.0))
    return got.select("*", F.round(part, 3).alias("frac_pos"), ((F.col("n_cells") >= least) & (part >= share) & (F.col("n_sig") >= 1)).alias("ok"))


def trends(items: DataFrame, rows: DataFrame, key: str, order: list[str], item: str, group: str, least_item: int = 10) -> DataFrame:
    """Cochran-Armitage trend of each item over ordered groups.

    (item, n_item, share_1..k, direction, z, p, q). Every item of at least `least_item` rows is tested. Nothing to tell (no
    or only rows with the item, or one group) is flat with z 0 and p 1. Rows of other groups count in n_item only.
    """
    place = F.create_map(*[x for i, g in enumerate(order, 1) for x in (F.lit(g), F.lit(i))])
    per = rows.filter(F.col(group).isin(order)).groupBy(F.element_at(place, F.col(group)).alias("t")).agg(F.count("*").alias("n"))
    sizes = {r["t"]: r["n"] for r in per.collect()}  # one number per group of the given order
    n = [sizes.get(i, 0) for i in range(1, len(order) + 1)]
    total = sum(n)
    mean = sum(k * i for i, k in enumerate(n, 1)) / total if total else 0.0
    spread = sum(k * (i - mean) ** 2 for i, k in enumerate(n, 1))
    t = F.element_at(place, F.col(group))
    joined = items.join(rows.select(key, t.alias("t")), key, "left")
    a = joined.groupBy(item).agg(F.count("*").alias("n_item"), *[F.count_if(F.col("t") == i).alias(f"a_{i}") for i in range(1, len(order) + 1)]).filter(F.col("n_item") >= least_item)
    held = sum((F.col(f"a_{i}") for i in range(1, len(order) + 1)), F.lit(0))
    u = sum((F.col(f"a_{i}") * (i - mean) for i in range(1, len(order) + 1)), F.lit(0.0))
    share = held / F.lit(float(total or 1))
    v = share * (1 - share) * F.lit(float(spread))
    z = F.when((held > 0) & (held < total) & (v > 0), u / F.sqrt(v)).otherwise(0.0)
    out = a.withColumn("z", z).withColumn("p", F.when(F.col("z") == 0, 1.0).otherwise(normal_p(F.col("z"))))
    out = false_discovery(cut(out, "trends"))
    shares = [F.round(F.col(f"a_{i}") / n[i - 1], 4).alias(f"share_{i}") if n[i - 1] else F.lit(0.0).alias(f"share_{i}") for i in range(1, len(order) + 1)]
    direction = F.when(F.col("z") > 0, "rising").when(F.col("z") < 0, "falling").otherwise("flat")
    return out.select(item, "n_item", *shares, direction.alias("direction"), F.round("z", 3).alias("z"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))
