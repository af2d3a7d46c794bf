"""All similar pairs between set-valued records (problem 1): banded minwise signatures, verified exactly.

1. Equal sets become one class, whose id is its smallest row_id; everything below runs on classes.
2. Each class gets `bands` x `rows` minwise values; the values of a band are one bucket key. At a similarity of
   0.70 the 40 bands of 4 miss a pair with a probability of 2e-5, at 0.75 of 2e-7.
3. Band rows meet by bucket key and are sorted, so a task streams its buckets whatever their size. A bucket of up
   to `CAP` classes gives its candidate pairs, less those whose sketches (56 bits, carried along) prove that they
   share too little. A larger one gives none: its members go on in chunks of `CHUNK`, and
   each pair of chunks is verified as one sparse product in a task of its own (`tiles`), so a bucket that holds a
   third of all classes is spread over the cluster and only true pairs are ever written.
4. Candidates are made distinct and verified on the sets themselves.
5. Classes are expanded to the records that belong to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import records
from scriptoria.plans.lineage import cut

#: Classes of a bucket that are paired at once; members of a chunk of a larger bucket.
CAP, CHUNK = 256, 4096
BANDS, ROWS = 40, 4


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.random.default_rng(20240229)
    return own.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), own.integers(0, 2**63, n, dtype=np.uint64)


def bucket_keys(flat: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys of non-empty sets of hashes, laid end to end from `start`."""
    mul, add = _mixers(bands * rows)
    flat = flat.astype(np.uint64)
    out = np.empty((len(start), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(start), band, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            h = (flat ^ add[i]) * mul[i]
            h ^= h >> np.uint64(31)
            low = np.minimum.reduceat(h * mul[i - 1], start)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def sketches(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The set size in the top 8 bits (255: that or more) and below it a bit for every item's hash modulo 56."""
    bits = np.uint64(1) << ((flat.astype(np.uint64) >> np.uint64(7)) % np.uint64(56))
    size = np.minimum(np.diff(np.r_[start, len(flat)]), 255).astype(np.uint64)
    return (np.bitwise_or.reduceat(bits, start) | size << np.uint64(56)).view(np.int64)


def may_reach(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sketched sets can be that similar: a bit of one only is at least one item of one only."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    m, n = ((z >> np.uint64(56)).astype(np.int64) for z in (x, y))
    low = np.uint64((1 << 56) - 1)
    both = np.minimum(m - np.bitwise_count(x & ~y & low), n - np.bitwise_count(y & ~x & low))
    return (both >= threshold * (m + n - both) - 1e-9) | (m == 255) | (n == 255)


def _band_batches(bands: int, rows: int):
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("sketch", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = b.column(1)
                at = sets.offsets.to_numpy()
                flat, start = sets.flatten().to_numpy(zero_copy_only=False), at[:-1] - at[0]
                keys = bucket_keys(flat, start, bands, rows)
                ids, bits = np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands), np.repeat(sketches(flat, start), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(bits)], schema=schema)

    return run


def _bucket_batches(cap: int, chunk: int, threshold: float):
    """Sorted (bucket, id, sketch) to pairs (a, b, null, null), or chunk members (id, null, bucket, chunk) of a bucket above the cap."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("chunk", pa.int64())])

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        keep = may_reach(a[:, 1].copy(), b[:, 1].copy(), threshold)
        a, b = a[keep, 0], b[keep, 0]
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], schema=schema)

    def members(bucket: int, held: np.ndarray, before: int) -> pa.RecordBatch:
        ids = held[:, 0]
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.array(np.full(n, bucket)), pa.array((before + np.arange(n)) // chunk)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, gone = None, np.zeros((0, 2), np.int64), 0  # the last bucket may go on in the next batch

        def close() -> Iterator[pa.RecordBatch]:
            if gone:
                yield members(open_key, held, gone)
            elif len(held) > 1:
                i, j = np.triu_indices(len(held), 1)
                yield pairs(held[i], held[j])

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1)
            if not len(key):
                continue
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[edge, len(key)])
            first, last = 0, len(edge)
            if open_key is not None and key[0] == open_key:
                held = np.concatenate([held, ids[: size[0]]])
                first = 1
            if first < last and open_key is not None:
                yield from close()
                open_key, held, gone = None, held[:0], 0
            if first < last:
                inner, n = edge[first : last - 1], size[first : last - 1]
                for k in np.unique(n[(n > 1) & (n <= cap)]):  # buckets of one size at once
                    i, j = np.triu_indices(k, 1)
                    at, step = inner[n == k], max(1, (1 << 20) // len(i))
                    for x in range(0, len(at), step):
                        block = ids[at[x : x + step, None] + np.arange(k)]
                        yield pairs(block[:, i].reshape(-1, 2), block[:, j].reshape(-1, 2))
                for e, k in zip(inner[n > cap], n[n > cap]):
                    yield members(key[e], ids[e : e + k], 0)
                open_key, held, gone = key[edge[-1]], ids[edge[-1] :], 0
            if len(held) > cap or gone:
                yield members(open_key, held, gone)
                gone, held = gone + len(held), held[:0]
        if open_key is not None:
            yield from close()

    return run


def _tile(threshold: dict[str, float]):
    import pandas as pd

    def run(pdf: "pd.DataFrame") -> "pd.DataFrame":
        """True pairs of one pair of chunks: counts of shared items by sorted search."""
        out_a, out_b, out_f = [], [], []
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = len(right) == 0
        if same:
            right = left
        size_r = right["items"].map(len).to_numpy()
        items_r = np.concatenate(right["items"].to_list()) if len(right) else np.zeros(0, np.int64)
        owner_r = np.repeat(np.arange(len(right)), size_r)
        order = np.argsort(items_r, kind="stable")
        items_r, owner_r = items_r[order], owner_r[order]
        ids_l, ids_r = left["id"].to_numpy(), right["id"].to_numpy()
        fields = left["field"].to_numpy()
        limit = left["field"].map(threshold).to_numpy()
        for k, own in enumerate(left["items"]):
            lo, hi = np.searchsorted(items_r, own, "left"), np.searchsorted(items_r, own, "right")
            hits = np.concatenate([owner_r[x:y] for x, y in zip(lo, hi)]) if len(own) else owner_r[:0]
            both = np.bincount(hits, minlength=len(right))
            good = both >= limit[k] * (len(own) + size_r - both) - 1e-9
            good &= ids_r > ids_l[k] if same else ids_r != ids_l[k]
            at = np.flatnonzero(good)
            out_a.append(np.full(len(at), ids_l[k]))
            out_b.append(ids_r[at])
            out_f += [fields[k]] * len(at)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pd.DataFrame({"field": pd.Series(out_f, dtype=object), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def tiles(chunks: DataFrame, sets: DataFrame, threshold: dict[str, float]) -> DataFrame:
    """True pairs within buckets given as (id, bucket, chunk): each pair of chunks is a task's group of at most 2 x CHUNK rows."""
    count = chunks.groupBy("bucket").agg((F.max("chunk") + 1).alias("n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    spread = chunks.join(count, "bucket").select("id", "bucket", "chunk", other)
    spread = spread.select("id", "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"))
    full = spread.join(sets.select("field", "id", "items"), "id")
    return full.groupBy("bucket", "i", "j").applyInPandas(_tile(threshold), "field string, a long, b long").distinct()


def classes(df: DataFrame) -> DataFrame:
    """(field, id, items, members) of the different sets in (field, row_id, items: sorted hashes); an id is one set's within its field."""
    return df.groupBy("field", "items").agg(F.min("row_id").alias("id"), F.count("*").alias("members"))


def similar_sets(sets: DataFrame, threshold: dict[str, float], bands: int = BANDS, rows: int = ROWS, cap: int = CAP, chunk: int = CHUNK) -> DataFrame:
    """(field, a, b): pairs of classes at least as similar as their field's threshold, a < b.

    `sets` is (field, id, items): distinct non-empty sets of 64-bit hashes that differ between fields.
    """
    rowed = sets.select("id", "items").mapInArrow(_band_batches(bands, rows), "bucket long, id long, sketch long")
    met = rowed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_batches(cap, chunk, min(threshold.values())), "a long, b long, bucket long, chunk long")
    met = cut(met, "candidates")
    found = met.filter("b IS NOT NULL").select("a", "b").distinct()
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"), "field")
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"), "field")
    both = F.size(F.array_intersect("x", "y"))
    least = F.element_at(F.create_map(*[F.lit(v) for kv in threshold.items() for v in kv]), F.col("field"))
    pairs = found.join(x, "a").join(y, ["field", "b"]).withColumn("both", both).withColumn("either", F.size("x") + F.size("y") - F.col("both"))
    pairs = pairs.filter(F.col("both") >= least * F.col("either") - 1e-9).select("field", "a", "b")
    over = met.filter("b IS NULL")
    if not over.isEmpty():
        pairs = pairs.union(tiles(over.select(F.col("a").alias("id"), "bucket", "chunk"), sets, threshold)).distinct()
    return pairs


def hashed(df: DataFrame, least: dict[str, int]) -> DataFrame:
    """(field, row_id, items: sorted distinct hashes) of the records with enough different items."""
    size = F.element_at(F.create_map(*[F.lit(v) for kv in least.items() for v in kv]), F.col("field"))
    codes = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.xxhash64("field", x))))
    return df.filter(F.size("items") >= size).select("field", "row_id", codes.alias("items")).filter(F.size("items") >= size)


def similar_records(df: DataFrame, threshold: dict[str, float], least: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes (field, a, b), the classes (field, id, items, members), and the records (field, row_id, items).

    Records with fewer than `least` different items, null lists and null elements are left out.
    """
    held = cut(hashed(df, least), "sets")
    sets = cut(classes(held), "classes")
    return similar_sets(sets, threshold), sets, held


#: Records of one class that one task pairs.
SPLIT = 20_000


def expanded(pairs: DataFrame, sets: DataFrame, held: DataFrame) -> DataFrame:
    """(field, row_a, row_b) of all records behind pairs of classes, and of equal sets.

    A class of many records, such as a stock list held by a third of the rows, falls into parts of SPLIT: what it meets, another class
    or itself, meets each part in a task of its own. Its pairs are part of the result and are written there; nothing is gathered.
    """
    pairs = cut(pairs, "pairs")
    copies = sets.filter("members > 1")
    wanted = pairs.select("field", F.explode(F.array("a", "b")).alias("id")).distinct()
    single = sets.filter("members = 1").join(wanted, ["field", "id"], "left_semi").select("field", "id", F.col("id").alias("row_id"), F.lit(1).alias("parts"))
    parts = F.ceil(F.col("members") / SPLIT).cast("int").alias("parts")
    several = cut(held.join(copies.select("field", "items", "id", parts), ["field", "items"]).select("field", "id", "row_id", "parts"), "copies")
    member = single.union(several)
    own = F.pmod(F.xxhash64("row_id"), "parts").cast("int").alias("part")
    size = single.select("field", "id", "parts").union(copies.select("field", "id", parts))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    # the parts of a meet the records of b
    x = member.select("field", F.col("id").alias("a"), own, F.col("row_id").alias("p"))
    met = pairs.join(size.select("field", F.col("id").alias("a"), "parts"), ["field", "a"]).select("field", "a", "b", every)
    right = met.join(member.select("field", F.col("id").alias("b"), F.col("row_id").alias("q")), ["field", "b"]).select("field", "a", "part", "q")
    across = x.join(right, ["field", "a", "part"]).select("field", "p", "q")
    x, y = several.select("field", "id", own, F.col("row_id").alias("p")), several.select("field", "id", every, F.col("row_id").alias("q"))
    within = x.join(y, ["field", "id", "part"]).filter("p < q").select("field", "p", "q")
    return across.union(within).select("field", F.least("p", "q").alias("row_a"), F.greatest("p", "q").alias("row_b"))


THRESHOLD, LEAST = {"lemmas": 0.70, "persons": 0.75}, {"lemmas": 8, "persons": 4}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return expanded(*similar_records(records.both(spark, d), THRESHOLD, LEAST))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_id, class_id, links): each record's class of equal sets and the number of other classes it is similar to."""
    pairs, sets, held = similar_records(records.both(spark, d), THRESHOLD, LEAST)
    ends = cut(pairs, "pairs").select("field", F.explode(F.array("a", "b")).alias("id")).groupBy("field", "id").agg(F.count("*").alias("links"))
    linked = sets.join(ends, ["field", "id"], "left").select("field", "items", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return held.join(linked, ["field", "items"]).select("field", "row_id", "class_id", "links")
