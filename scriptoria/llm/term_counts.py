"""Frequency of every distinct value or term (problem 3): suffix-sorted n-gram counting.

Each record's sequence gives one suffix per position, cut to `max_terms` terms. A suffix also carries how
many of its prefixes stood earlier in the same record, so the number of records per n-gram is a plain sum
and no set of record ids is ever gathered. Equal suffixes are added up within each Arrow batch before the
shuffle; they are routed by their first two terms (so a hot first term spreads over many tasks), sorted in
reverse order, and one pass over the common prefixes gives the totals of all prefixes. Totals of one-term
prefixes that were routed apart are added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import arrow, records


def suffixes(parent: np.ndarray, code: np.ndarray, max_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """For elements in row order: the suffix at each, padded by -1, and how many of its prefixes came before in the row."""
    n = len(code)
    terms = np.full((n, max_terms), -1, np.int64)
    seen = np.zeros(n, np.int64)
    gram = np.zeros(n, np.int64)
    for k in range(max_terms):
        at = np.arange(n) + k
        inside = (at < n) & (parent[np.minimum(at, n - 1)] == parent) if n else np.zeros(0, bool)
        terms[inside, k] = code[at[inside]]
        # a number for each (row, gram of k+1 terms); the first of equal ones is new
        _, gram = np.unique(np.stack([gram, parent, terms[:, k]]), axis=1, return_inverse=True) if k else np.unique(np.stack([parent, terms[:, 0]]), axis=1, return_inverse=True)
        gram = gram.ravel()
        first = np.zeros(n, bool)
        first[np.unique(gram, return_index=True)[1]] = True
        seen += inside & ~first
    return terms, seen


def _suffix_batches(max_terms: int):
    schema = pa.schema([("field", pa.string()), ("terms", pa.list_(pa.string())), ("seen", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).dictionary_encode()
            parent, flat = arrow.exploded(b.column(1))
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            terms, seen = suffixes(parent, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max_terms)
            own = fields.indices.to_numpy(zero_copy_only=False)[parent]
            rows = np.column_stack([own, terms, seen])
            if max_terms == 1:  # one number says it all
                size = len(coded.dictionary)
                key, n = np.unique((rows[:, 0] * size + rows[:, 1]) * 2 + rows[:, 2], return_counts=True)
                rows = np.column_stack([key // 2 // size, key // 2 % size, key % 2])
            else:
                rows, n = np.unique(rows, axis=0, return_counts=True)
            held = rows[:, 1:-1] >= 0
            at, _ = np.nonzero(held)
            words = coded.dictionary.take(pa.array(rows[:, 1:-1][held]))
            yield arrow.batch(schema, fields.dictionary.take(pa.array(rows[:, 0])), arrow.lists(at, words, len(rows)), rows[:, -1].astype(np.int32), n)

    return run


def _prefix_batches(max_terms: int):
    schema = pa.schema([("field", pa.string()), ("terms", pa.list_(pa.string())), ("uses", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            field = b.column(0).dictionary_encode()
            parent, flat = arrow.exploded(b.column(1))
            coded = flat.dictionary_encode()
            size = np.bincount(parent, minlength=b.num_rows)
            terms = np.full((b.num_rows, max_terms), -1, np.int64)
            terms[parent, np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size)] = coded.indices.to_numpy(zero_copy_only=False)
            own = field.indices.to_numpy(zero_copy_only=False)
            seen, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            # rows are sorted: the stack of open prefixes closes those longer than what the next suffix shares
            new = np.ones(b.num_rows, bool)
            new[1:] = own[1:] != own[:-1]
            for k in range(max_terms):
                new[1:] |= terms[1:, k] != terms[:-1, k]
                start = np.flatnonzero(new)
                uses, held = np.add.reduceat(n, start), np.add.reduceat(np.where(seen <= k, n, 0), start)
                full = terms[start, k] >= 0
                start, uses, held = start[full], uses[full], held[full]
                if len(start):
                    words = coded.dictionary.take(pa.array(terms[start, : k + 1].ravel()))
                    yield arrow.batch(schema, field.dictionary.take(pa.array(own[start])), arrow.lists(np.repeat(np.arange(len(start)), k + 1), words, len(start)), uses, held)

    return run


def ngram_counts(df: DataFrame, max_terms: int = 1) -> DataFrame:
    """(field, terms, uses, records) of every run of 1..max_terms items in (field, row_id, items).

    Each row_id of a field must be there once. Null elements count as no item only if dropped before; empty
    lists and an empty table give no rows.
    """
    if max_terms < 1:
        raise ValueError("max_terms must be at least 1")
    suffix = df.select("field", "items").mapInArrow(_suffix_batches(max_terms), "field string, terms array<string>, seen int, n long")
    routed = suffix.repartition("field", F.col("terms")[0], F.get("terms", F.lit(1))) if max_terms > 1 else suffix.repartition("field", F.col("terms")[0])
    ordered = routed.sortWithinPartitions("field", F.col("terms").desc())
    partial = ordered.mapInArrow(_prefix_batches(max_terms), "field string, terms array<string>, uses long, records long")
    return partial.groupBy("field", "terms").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))


def item_counts(df: DataFrame) -> DataFrame:
    """(field, item, uses, records): `ngram_counts` of single items."""
    return ngram_counts(df, 1).select("field", F.col("terms")[0].alias("item"), "uses", "records")


def marked(counts: DataFrame, n: int, rare: dict[str, int], common: dict[str, int]) -> DataFrame:
    """(field, item, mark): 'rare' below rare[field] records, 'common' above n / common[field]."""
    of = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in x.items() for v in kv]), F.col("field"))
    mark = F.when(F.col("records") < of(rare), "rare").when(F.col("records") * of(common) > n, "common")
    return counts.select("field", "item", mark.alias("mark")).filter("mark IS NOT NULL")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Uses and records of every lemma and person."""
    return item_counts(records.both(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return marked(p3_counts(spark, d), records.total(spark, d), {"lemmas": 10, "persons": 5}, {"lemmas": 10, "persons": 20})


def p3_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Runs of up to three lemmas, with uses and records."""
    got = ngram_counts(records.lemmas(spark, d).select(F.lit("lemmas").alias("field"), "*"), 3)
    return got.select(F.array_join("terms", " | ").alias("terms"), "uses", "records")
