"""k-means, principal components, and what describes clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.stats import log_odds
from scriptoria.operators import vectors
from scriptoria.operators.ranking import joined_list, top_per


def kmeans(df: DataFrame, key: str, k: int = 16, seed: int = 0, rounds: int = 20) -> DataFrame:
    """(key, cluster_id): labels of k-means|| over `vec`. Label numbers mean nothing across fits."""
    x = df.select(key, array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(x).transform(x).select(key, F.col("prediction").alias("cluster_id"))


def nearest(df: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(key, cluster_id, distance): the nearest of a few given centroids (cluster_id, centre) by squared distance, ties to the smaller id."""
    given = sorted((r["cluster_id"], r["centre"]) for r in centroids.select("cluster_id", "centre").collect())  # as many as there are clusters
    kinds = dict(df.dtypes) | dict(centroids.dtypes)
    names, c = np.array([n for n, _ in given], np.int64 if kinds["cluster_id"] == "bigint" else np.int32), np.array([v for _, v in given], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                d = np.round((m * m).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (m @ c.T), 9)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[at]), pa.array(d[np.arange(len(m)), at])], [key, "cluster_id", "distance"])

    return df.select(key, "vec").mapInArrow(run, f"{key} {kinds[key]}, cluster_id {kinds['cluster_id']}, distance double")


def principal(df: DataFrame, key: str, k: int = 2) -> DataFrame:
    """(key, pc): coordinates on the first k principal components of the centred vectors; signs are arbitrary."""
    centre = [r[0] for r in vectors.sums(df, []).orderBy("dim").select(F.col("total") / F.col("n")).collect()]  # one number per dimension
    x = df.select(key, array_to_vector(F.zip_with("vec", F.array(*[F.lit(c) for c in centre]), lambda a, b: a - b)).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(x).transform(x).select(key, vector_to_array("pc").alias("pc"))


def described(member: DataFrame, items: DataFrame, gold: DataFrame, key: str, n: int, k: int = 10, least: int = 3, sep: str = "; ") -> DataFrame:
    """(cluster_id, size, top_lemmas, distinctive_lemmas, n_gold, gold_labels) of (key, cluster_id).

    `items` is a posting (key, item) of all n rows, `gold` one (key, label). The commonest items by count, the distinctive ones of at
    least `least` rows by log odds against the rest, ties by item; labels with counts.
    """
    size = member.groupBy("cluster_id").agg(F.count("*").alias("size"))
    total = items.groupBy("item").agg(F.count("*").alias("n_item"))
    cell = member.join(items, key).groupBy("cluster_id", "item").agg(F.count("*").alias("a")).join(total, "item").join(size, "cluster_id")
    a, b, c = F.col("a"), F.col("size") - F.col("a"), F.col("n_item") - F.col("a")
    cell = cell.withColumn("odds", F.round(log_odds(a, b, c, F.lit(n) - F.col("size") - c), 9))
    tops = joined_list(top_per(cell, k, ["cluster_id"], F.col("a").desc(), F.col("item")), ["cluster_id"], "rank", "item", "top_lemmas", sep)
    own = joined_list(top_per(cell.filter(F.col("a") >= least), k, ["cluster_id"], F.col("odds").desc(), F.col("item")), ["cluster_id"], "rank", "item", "distinctive_lemmas", sep)
    g = member.join(gold, key)
    tally = g.groupBy("cluster_id", "label").agg(F.count("*").alias("m")).withColumn("rank", F.struct(-F.col("m"), F.col("label"))).withColumn("said", F.concat("label", F.lit("("), F.col("m").cast("string"), F.lit(")")))
    labels = joined_list(tally, ["cluster_id"], "rank", "said", "gold_labels", sep)
    with_gold = g.select("cluster_id", key).distinct().groupBy("cluster_id").agg(F.count("*").alias("n_gold"))
    out = size.join(tops, "cluster_id", "left").join(own, "cluster_id", "left").join(with_gold, "cluster_id", "left").join(labels, "cluster_id", "left")
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("top_lemmas", "distinctive_lemmas")]
    return out.select("cluster_id", "size", *said, F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("gold_labels", F.lit("")).alias("gold_labels"))
