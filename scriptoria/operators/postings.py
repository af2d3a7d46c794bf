"""Inverted indexes: distinct (row, item) rows and what is counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postings(df: DataFrame, key: str, items: str, name: str = "item") -> DataFrame:
    """(key, item), each item once per row. Distinctness is within the row's own list: no shuffle."""
    return df.select(key, F.explode(F.array_distinct(items)).alias(name)).filter(F.col(name).isNotNull())


def frequency(post: DataFrame, name: str = "item", count: str = "n_rows") -> DataFrame:
    """In how many rows each item stands."""
    return post.groupBy(name).agg(F.count("*").alias(count))


def frequent(post: DataFrame, least: int, name: str = "item") -> tuple[DataFrame, DataFrame]:
    """The postings of items of at least `least` rows, and those items with n_rows."""
    df = frequency(post, name).filter(F.col("n_rows") >= least)
    return post.join(df.select(name), name, "left_semi"), df


def candidates(post: DataFrame, stop: DataFrame, seeds: list[str], name: str = "item") -> DataFrame:
    """(item, n_rows) of the tokens that are neither stop words nor seeds."""
    left = frequency(post, name).join(stop, name, "left_anti")
    return left.filter(~F.col(name).isin(seeds)) if seeds else left


def surface_forms(df: DataFrame, lemma: str, form: str) -> DataFrame:
    """(lemma, forms): the lemma and all its canonical forms, sorted."""
    got = df.groupBy(lemma).agg(F.collect_set(form).alias("f"))
    return got.select(lemma, F.array_sort(F.array_union("f", F.array(lemma))).alias("forms"))


def in_any(post: DataFrame, wanted: DataFrame, key: str, name: str = "item") -> DataFrame:
    """The rows that hold any of the wanted items: a union of postings."""
    return post.join(wanted, name, "left_semi").select(key).distinct()


#: Rows of an item that one task of a pair join takes.
ROWS = 100_000


def shared_item_pairs(post: DataFrame, key: str, name: str = "item", asks: Column | None = None) -> DataFrame:
    """(i, j, shared): pairs i < j that share items, and how many.

    With `asks`, a condition on i, only pairs of which a member meets it: a stated query set against all rows. Without, it is quadratic in
    the rows of one item. An item of many rows is split: its rows fall into parts of ROWS, and each of its asking rows meets every part.
    """
    parts = frequency(post, name, "n").select(name, F.ceil(F.col("n") / ROWS).cast("int").alias("parts"))
    post = post.join(parts, name)
    x = post.select(F.col(key).alias("i"), name, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    y = post.select(F.col(key).alias("j"), name, F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"))
    if asks is None:
        got = x.join(y, [name, "part"]).filter("i < j")
    else:
        too = y.withColumn("i", F.col("j")).withColumn("too", asks).drop("i")  # of two that ask, one asks
        got = x.filter(asks).join(too, [name, "part"]).filter("i <> j AND NOT (too AND j < i)").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return got.groupBy("i", "j").agg(F.count("*").alias("shared"))
