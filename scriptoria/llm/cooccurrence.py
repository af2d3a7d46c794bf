"""Items that appear together (problem 5): a blocked Gram matrix of binary baskets.

A block of records becomes a sparse binary record x item matrix X; the non-zero upper triangle of X'X is added
up within the block before anything is shuffled, and the blocks' sums are added per pair. Counts are then
divided by what the margins would give by chance.

Two exact prunings keep the product small. A pair with n_ab <= min(n_a, n_b) can reach `lift` only if the larger
margin is at most n / lift, and both margins must reach `min_records`. Items outside these margins leave the
baskets before the product: through a table of `SLOTS` bits that holds every wanted item (a fixed size,
whatever the vocabulary; an unwanted item that shares a slot is dropped after the product by the margins
themselves) and through the list of the items above n / lift, of which there are at most lift x the mean
basket size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import records
from scriptoria.plans.lineage import cut

#: Slots of the table of wanted items: 1 MB as bits.
SLOTS = 1 << 23
#: Pair codes that are added up at once in a task.
BLOCK = 1 << 21


def gram(parent: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of the items of the same row, in pieces; elements in row order, items ascending in a row."""
    n, step = len(item), 1
    left = np.arange(n)
    while len(left):
        left = left[left + step < n]
        left = left[parent[left] == parent[left + step]]
        if len(left):
            yield item[left], item[left + step]
        step += 1


def _gram_batches(wanted: bytes):
    schema = pa.schema([("field", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, int] = {}

        def added(field: str) -> pa.RecordBatch:
            a, b, n = (np.concatenate(x) for x in zip(*held.pop(field)))
            waiting[field] = 0
            ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
            pair, at = np.unique(code[: len(a)] * len(ids) + code[len(a) :], return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([field] * len(pair), pa.string()), pa.array(ids[pair // len(ids)]), pa.array(ids[pair % len(ids)]), pa.array(total)], schema=schema)

        for b in batches:
            size = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            parent = np.repeat(np.arange(b.num_rows), size)
            slot = (flat & (SLOTS - 1)).astype(np.int64)
            keep = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            parent, flat = parent[keep], flat[keep]
            fields = b.column(0).dictionary_encode()
            own = fields.indices.to_numpy(zero_copy_only=False)[parent]
            for f, field in enumerate(fields.dictionary.to_pylist()):
                sel = own == f
                for x, y in gram(parent[sel], flat[sel]):
                    held.setdefault(field, []).append((x, y, np.ones(len(x), np.int64)))
                    waiting[field] = waiting.get(field, 0) + len(x)
                    if waiting[field] >= BLOCK:
                        yield added(field)
        for field in list(held):
            yield added(field)

    return run


def associated(df: DataFrame, n: int, lift: float, min_records: dict[str, int], min_both: dict[str, int]) -> DataFrame:
    """(field, item_a, item_b, n_a, n_b, n_ab, lift): pairs with n_ab * n >= lift * n_a * n_b and enough records.

    `df` has (field, row_id, items), a record once per field; repeats in a record count once, null lists and
    elements not at all. item_a < item_b by code point. An empty table gives no pairs.
    """
    spark = df.sparkSession
    of = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in x.items() for v in kv]), F.col("field"))
    code = F.transform("items", lambda x: F.xxhash64("field", x))
    base = cut(df.select("field", "items").filter(F.size("items") > 0), "baskets")
    margins = base.select("field", F.explode(F.array_distinct("items")).alias("item")).filter("item IS NOT NULL").groupBy("field", "item").agg(F.count("*").alias("n"))
    margins = cut(margins.filter((F.col("n") >= of(min_records)) & (F.col("n") <= F.lit(n / lift))).withColumn("code", F.xxhash64("field", "item")), "margins")
    slots = margins.select(F.col("code").bitwiseAND(SLOTS - 1).alias("s")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    wanted = bits.tobytes()
    baskets = base.select("field", F.array_sort(F.array_distinct(code)).alias("code")).filter(F.size("code") > 1)
    partial = baskets.mapInArrow(_gram_batches(wanted), "field string, a long, b long, n long")
    pairs = partial.groupBy("field", "a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= of(min_both))
    m = margins.select("code", "item", "n")
    pairs = pairs.join(m.toDF("a", "x", "n_x"), "a").join(m.toDF("b", "y", "n_y"), "b")
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    pairs = pairs.select("field", pick("x", "y").alias("item_a"), pick("y", "x").alias("item_b"), pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), "n_ab")
    pairs = pairs.filter(F.col("n_ab") * F.lit(n) >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
    return pairs.withColumn("lift", F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b")))


def p5_lift(spark: SparkSession, d: str) -> DataFrame:
    return associated(records.both(spark, d), records.total(spark, d), 15, {"lemmas": 10, "persons": 5}, {"lemmas": 8, "persons": 5})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_lift(spark, d).select("field", "item_a", "item_b")
