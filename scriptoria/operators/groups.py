"""Row groups as boolean columns, and set algebra on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, a: Column, b: Column, c: Column, named: Column | None = None) -> DataFrame:
    """`df` with in_a, in_b, in_c (which may overlap), in_d (none of them), named, and the stratified in_a_s, in_b_s.

    D isn't stratified: it keeps its named rows. A null condition counts as false.
    """
    no = F.lit(False)
    df = df.withColumns({"in_a": F.coalesce(a, no), "in_b": F.coalesce(b, no), "in_c": F.coalesce(c, no), "named": F.coalesce(named, no) if named is not None else no})
    return df.withColumns({"in_d": ~(F.col("in_a") | F.col("in_b") | F.col("in_c")), "in_a_s": F.col("in_a") & ~F.col("named"), "in_b_s": F.col("in_b") & ~F.col("named")})


def sizes(df: DataFrame) -> DataFrame:
    """One row: the size of each group."""
    f = {"n_a": "in_a", "n_b": "in_b", "n_c": "in_c", "n_d": "in_d", "n_named": "named", "n_a_strat": "in_a_s", "n_b_strat": "in_b_s"}
    return df.agg(*[F.count_if(c).alias(k) for k, c in f.items()], F.count_if(F.col("in_a") & F.col("in_b")).alias("n_ab"), F.count("*").alias("n"))


def sides(df: DataFrame, key: str, classes: dict[str, tuple[str, str]]) -> DataFrame:
    """(run, side, key): the left (0) and right (1) members of each pair class, given as names of boolean columns."""
    tags = [F.when(F.col(col), F.struct(F.lit(run).alias("run"), F.lit(side).alias("side"))) for run, pair in classes.items() for side, col in enumerate(pair)]
    return df.select(key, F.explode(F.array_compact(F.array(*tags))).alias("t")).select("t.run", "t.side", key)


def leave_one_out(post: DataFrame, members: list[str], key: str, name: str = "item") -> DataFrame:
    """(variant, key): rows of the union of all members ('full'), of all but one, and of one only."""
    spark = post.sparkSession
    rows = [("full", m) for m in members] + [(f"minus_{v}", m) for v in members for m in members if m != v] + [(f"only_{v}", v) for v in members]
    wanted = spark.createDataFrame(rows or [("full", None)], f"variant string, {name} string")
    return post.join(F.broadcast(wanted), name).select("variant", key).distinct()


def dossier_parts(df: DataFrame, dossier: Column, issue: Column, b: Column) -> DataFrame:
    """`df` with part: 'dossier', 'issue_rest' (its issue without it) and 'rest' (all rows in neither the dossier nor B).

    A row can be in two parts: the last two overlap. Null conditions count as false.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    parts = F.array(F.when(no(dossier), "dossier").when(no(issue), "issue_rest"), F.when(~no(dossier) & ~no(b), "rest"))
    return df.withColumn("part", F.explode(F.array_compact(parts)))


def compared(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """(item, part): whether each item is in both lists or in the left or right only."""
    both = left.select(name).distinct().withColumn("l", F.lit(True)).join(right.select(name).distinct().withColumn("r", F.lit(True)), name, "full")
    return both.select(name, F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right").alias("part"))
