"""Ranking items and rows: tf-idf, candidate tables, top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.functions.ranks import numbered
from scriptoria.operators.postings import frequency


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(lists)
        full = flat.is_valid().to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(full)).dictionary_encode()
        size = max(1, len(coded.dictionary))
        pair, uses = np.unique(parent[full] * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row = pair // size
        kinds = np.bincount(row, minlength=b.num_rows)
        cols = [b.column(0).take(pa.array(row)), pa.array(kinds[row].astype(np.int32)), coded.dictionary.take(pa.array(pair % size)), pa.array(uses.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["key", "n_items", "item", "uses"])


def bag_counts(df: DataFrame, key: str, items: str, name: str = "item") -> DataFrame:
    """(key, n_items, item, uses) counted within each row's list, with the number of its different items: one pass over Arrow batches.

    Null items don't count; null and empty lists have no row.
    """
    kind = dict(df.dtypes)[key]
    got = df.select(key, items).mapInArrow(_bag_batches, f"key {kind}, n_items int, item string, uses int")
    return got.select(F.col("key").alias(key), "n_items", F.col("item").alias(name), "uses")


def tfidf_scores(counts: DataFrame, key: str, n: int, name: str = "item") -> DataFrame:
    """(item, n_rows, score): uses x (ln((1+n)/(1+rows)) + 1), each row scaled to length 1, summed over rows.

    n is the number of all rows, those without items included.
    """
    idf = frequency(counts, name).withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("n_rows") + 1)) + 1)
    w = counts.join(idf, name).withColumn("w", F.col("uses") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).groupBy(name).agg(F.max("n_rows").alias("n_rows"), F.sum(F.col("w") / F.col("norm")).alias("score"))


def ranked(scores: DataFrame, name: str = "item", digits: int = 6) -> DataFrame:
    """`scores` with rank 1.. by descending score (rounded, so float noise breaks no tie), ties by item."""
    s = scores.withColumn("score", F.round("score", digits))
    return numbered(s, F.col("score").desc(), F.col(name).asc(), name="rank")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps k."""
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; a row group limit runs before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def joined_list(df: DataFrame, by: list[str], place: str, value: str, name: str, sep: str = "; ") -> DataFrame:
    """(by, name): values in the order of `place`, joined."""
    got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, value))).alias("l"))
    return got.select(*by, F.array_join(F.transform("l", lambda x: x[value].cast("string")), sep).alias(name))


def candidate_table(uses: DataFrame, rows: DataFrame, key: str, seeds: list[str], ranks: DataFrame) -> DataFrame:
    """Candidate lemmas from (key, lemma, form) uses and (key, label, in_group) rows.

    n_instances counts uses with repeats, n_rows distinct rows; the three commonest forms (ties by form) and the first three
    labels by key; enrichment = ln of the smoothed odds in the group over the base odds; rank of `ranks` (item, rank); whether
    it is a seed; and an empty keep.
    """
    per = uses.groupBy("lemma", key, "form").agg(F.count("*").alias("k"))
    row = per.groupBy("lemma", key).agg(F.sum("k").alias("k")).join(rows, key)
    base = rows.agg(F.count_if("in_group").alias("g"), F.count_if(~F.col("in_group")).alias("r")).first()
    main = row.groupBy("lemma").agg(F.sum("k").alias("n_instances"), F.count("*").alias("n_rows"), F.count_if("in_group").alias("c_in"))
    forms = top_per(per.groupBy("lemma", "form").agg(F.sum("k").alias("k")), 3, ["lemma"], F.col("k").desc(), F.col("form"))
    labels = top_per(row, 3, ["lemma"], F.col(key)).filter(F.col("label").isNotNull() & (F.col("label") != ""))
    odds = (F.col("c_in") + 0.5) / (F.col("n_rows") - F.col("c_in") + 0.5)
    out = main.join(joined_list(forms, ["lemma"], "rank", "form", "example_forms"), "lemma", "left").join(joined_list(labels, ["lemma"], "rank", "label", "example_ids"), "lemma", "left")
    out = out.join(ranks.select(F.col("item").alias("lemma"), F.col("rank").alias("tfidf_rank")), "lemma", "left")
    return out.select(
        "lemma", "n_instances", "n_rows", "tfidf_rank", F.coalesce("example_forms", F.lit("")).alias("example_forms"), F.coalesce("example_ids", F.lit("")).alias("example_ids"),
        F.round(F.log(odds / ((base["g"] + 0.5) / (base["r"] + 0.5))), 3).alias("enrichment_score"), F.col("lemma").isin(seeds).alias("in_seeds"), F.lit("").alias("keep"),
    )


def list_overlap(left: DataFrame, right: DataFrame, name: str = "item", first: int = 10) -> DataFrame:
    """One row: Jaccard of two top lists, and the first items that only the left has."""
    from scriptoria.operators.groups import compared

    c = compared(left, right, name)
    only = top(c.filter(F.col("part") == "left"), first, F.col(name).asc()).agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias("left_only"))
    return c.agg(F.count_if(F.col("part") == "both").alias("n_both"), F.count("*").alias("n_any"), F.round(F.count_if(F.col("part") == "both") / F.count("*"), 6).alias("jaccard")).join(only)
