"""How distinctive a term is per record (problem 2): counts, histograms, two-Poisson mixtures, tf-idf.

The number of uses of each term in each record is counted once. A term's frequency histogram is a handful of
(uses, records) pairs however many records hold it; it gives both the number of records with the term and,
by expectation-maximisation, a mixture of two Poisson laws: 'elite' records that are about the term, and the
rest. `scored` gives each occurrence count the posterior probability of the elite component, and the number of
records of its term, which is that of the fit. The posterior's order isn't that of uses x ln(N / records), so `top_terms`,
whose order is fixed, ranks the scored occurrences by the latter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.llm import records
from scriptoria.operators import ranking
from scriptoria.plans.lineage import cut


def uses(df: DataFrame) -> DataFrame:
    """(row_id, n_items, term, uses) of (row_id, items), counted within each record: no shuffle."""
    return ranking.bag_counts(df.select("row_id", "items"), "row_id", "items", "term")


def histograms(counted: DataFrame) -> DataFrame:
    """(term, uses, records): how many records use the term so often."""
    return counted.groupBy("term", "uses").agg(F.count("*").alias("records"))


def em(k: np.ndarray, n: np.ndarray, total: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the elite, its rate and the rest's rate, per row of counts k held by n records; the other total - n.sum() records have 0.

    Each row is one term. Rows whose occurrences are all 0 get weight 0.
    """
    zero = total - n.sum(1, keepdims=True)
    k, n = np.hstack([np.zeros_like(zero, float), k]), np.hstack([zero, n]).astype(float)
    mean = (k * n).sum(1) / max(total, 1)
    held = np.maximum(n[:, 1:].sum(1), 1)
    high = (k * n).sum(1) / held + 0.5
    low = np.maximum(mean / 4, 1e-12)
    share = np.clip(held / max(total, 1) / 2, 1e-9, 0.5)
    for _ in range(rounds):
        # log odds of the elite; k! cancels
        odds = np.log(share / (1 - share))[:, None] + k * np.log(high / low)[:, None] - (high - low)[:, None]
        p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        w = p * n
        inside, outside = w.sum(1), (n - w).sum(1)
        share = np.clip(inside / max(total, 1), 1e-12, 1 - 1e-12)
        high = np.maximum((w * k).sum(1) / np.maximum(inside, 1e-12), 1e-12)
        low = np.maximum(((n - w) * k).sum(1) / np.maximum(outside, 1e-12), 1e-12)
        high, low = np.maximum(high, low), np.minimum(high, low)
    return np.where(mean > 0, share, 0), high, low


def _em_batches(total: int):
    schema = pa.schema([("term", pa.string()), ("records", pa.int64()), ("share", pa.float64()), ("high", pa.float64()), ("low", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            entries = b.column(1)
            size = np.diff(entries.offsets.to_numpy())
            flat = entries.flatten()
            at = np.repeat(np.arange(b.num_rows), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            k, n = np.zeros((b.num_rows, size.max())), np.zeros((b.num_rows, size.max()))
            k[at], n[at] = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            share, high, low = em(k, n, total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.sum(1).astype(np.int64)), pa.array(share), pa.array(high), pa.array(low)], schema=schema)

    return run


def two_poisson(counted: DataFrame, total: int) -> DataFrame:
    """(term, records, share, high, low) of every term: the fitted mixture.

    A term's list holds one entry per distinct number of uses, at most the largest number of uses in one record.
    """
    gathered = histograms(counted).groupBy("term").agg(F.collect_list(F.struct("uses", "records")).alias("h"))
    return gathered.mapInArrow(_em_batches(total), "term string, records long, share double, high double, low double")


def elite(u: str = "uses", share: str = "share", high: str = "high", low: str = "low"):
    """Posterior probability that a count comes from the elite component."""
    c = F.col
    odds = F.log(c(share) / (1 - c(share))) + c(u) * F.log(c(high) / c(low)) - (c(high) - c(low))
    return 1 / (1 + F.exp(-odds))


def _joined(counted: DataFrame, stats: DataFrame, total: int) -> DataFrame:
    hot = stats.filter(F.col("records") * 16 > total)
    names = [r[0] for r in hot.select("term").collect()]
    is_hot = F.col("term").isin(names) if names else F.lit(False)
    often = counted.filter(is_hot).join(F.broadcast(hot), "term")
    return counted.filter(~is_hot).join(stats.filter(F.col("records") * 16 <= total), "term").unionByName(often)


def scored(counted: DataFrame, total: int, min_items: int = 1, min_records: int = 1) -> DataFrame:
    """(row_id, term, uses, records, elite, score) of `uses`, which is read twice: every occurrence count by its term's mixture.

    elite is the two-Poisson posterior, score = uses x ln(total / records) with the records of the same fit. Only records of at least
    `min_items` distinct terms and terms of at least `min_records` records. A term held by more than total / 16 records is joined
    through a broadcast list, of which there are at most 16 x the mean number of terms of a record; the others meet in a shuffle no
    key of which holds more than a sixteenth of the records. Null or empty lists give no rows; one row_id must be one record.
    """
    fitted = cut(two_poisson(counted, total).filter(F.col("records") >= min_records), "mixtures")
    got = _joined(counted.filter(F.col("n_items") >= min_items), fitted, total)
    score = F.col("uses") * F.log(F.lit(float(total)) / F.col("records"))
    return got.select("row_id", "term", "uses", "records", elite().alias("elite"), score.alias("score"))


def top_terms(df: DataFrame, total: int, k: int = 3, min_items: int = 8, min_records: int = 2) -> DataFrame:
    """(row_id, term, score, elite, rank): the k occurrences of each record (`scored`) with the highest score, ties to the first term by
    code point. The posterior isn't in that order: it says how likely the record is about the term."""
    best = W.partitionBy("row_id").orderBy(F.col("score").desc(), "term")
    ranked = scored(cut(uses(df), "uses"), total, min_items, min_records).select("row_id", "term", "score", "elite", F.row_number().over(best).alias("rank"))
    return ranked.filter(F.col("rank") <= k)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_terms(records.lemmas(spark, d), records.total(spark, d)).select("row_id", F.col("term").alias("lemma"))


def p2_two_poisson(spark: SparkSession, d: str) -> DataFrame:
    """Every lemma of every record with its two-Poisson posterior."""
    return scored(cut(uses(records.lemmas(spark, d)), "uses"), records.total(spark, d)).select("row_id", F.col("term").alias("lemma"), "uses", "records", "elite")
