"""Blocked joins of vectors: which pairs of blocks can hold a pair above a similarity, and their tasks.

Centres are chosen from a sample so that no two lie within the radius; only those with company become centres. Their number
grows as the root of that of the vectors, so placing n vectors and comparing them within their cells both cost n^1.5. A vector within the radius of its nearest centre is a member of that centre's cell,
any other is an outlier. By the triangle inequality of angles a pair above the threshold lies in one cell, or
one of the two visits the other's cell, being within radius + threshold angle of its centre, or both are
outliers. So nothing is lost, wherever the centres lie; a poor sample only makes more outliers, which are
compared with each other by `vector_far`, or in full, block by block.

Each cell's members are cut into chunks of about `BLOCK` (the outliers, of `FAR_BLOCK`); a task's group holds two chunks, whatever the cell's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centres at most: so many, or so many times the root of the number of vectors if that is more; and vectors of the sample for each.
CENTRES, OF_ROOT, SAMPLE = 2048, 2, 4
#: Vectors of a chunk of a cell; of the outliers, which are compared in full but seldom linked.
BLOCK, FAR_BLOCK = 16384, 65536
OUTLIERS = -1


def usable(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(id, vec): binary of float32 of the usable vectors: right length, no null, NaN or infinity, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("vec", pa.binary())])
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, width)
            ok = np.isfinite(flat).all(1) & flat.any(1)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), packed(flat[ok])], schema=schema)

    right = df.filter(F.size(values) == width).select(F.col(key).cast("long"), F.col(values).cast("array<float>"))
    return right.filter(~F.exists(values, lambda x: x.isNull())).mapInArrow(run, "id long, vec binary")


def packed(m: np.ndarray) -> pa.Array:
    w = m.itemsize * m.shape[1]
    m = np.ascontiguousarray(m)
    return pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * w).astype(np.int32).tobytes()), pa.py_buffer(m.tobytes())])


def unpacked(a: pa.Array, dtype: str = "<f4") -> np.ndarray:
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks() if a.num_chunks != 1 else a.chunk(0)
    n = len(a)
    if not n:
        return np.zeros((0, 1), dtype)
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + n + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(n, -1)


def unit32(m: np.ndarray) -> np.ndarray:
    """`unit` in float32, a few rows at a time."""
    out = np.empty(m.shape, np.float32)
    for i in range(0, len(m), 8192):
        out[i : i + 8192] = unit(m[i : i + 8192])
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1 in float64, whatever their scale."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True) if len(m) else 1
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def centres(vectors: DataFrame, radius: float, n: int) -> np.ndarray:
    """Unit vectors, no two within `radius` (radians), from a sample in hash order of the n vectors or rows they come from.

    At most max(CENTRES, OF_ROOT x root of n) centres from SAMPLE times as many vectors, which is what comes to the driver: 8,192 up to
    a million vectors, 80,000 (20 MB) at a hundred million. Company is counted a block at a time, never as a matrix.
    """
    most = max(CENTRES, int(OF_ROOT * math.sqrt(n)))
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).select("vec").toArrow().column(0)
    m = unit32(unpacked(got))
    if len(got) == 0:
        return np.zeros((0, 1), np.float32)
    close = math.cos(radius)
    company = np.concatenate([(m[i : i + 1024] @ m.T >= close).sum(1) for i in range(0, len(m), 1024)])
    free, chosen = np.ones(len(m), bool), []
    for i in np.argsort(-company, kind="stable"):
        if company[i] < 2 or len(chosen) == most:
            break
        if free[i]:
            near = m @ m[i] >= close
            if (near & free).sum() >= 2:
                chosen.append(i)
                free &= ~near
    return m[chosen]


def placed(vectors: DataFrame, centre: np.ndarray, radius: float, angle: float) -> DataFrame:
    """(id, vec, home, visits): the cell of each vector, or OUTLIERS, and the other cells that may hold a partner.

    Of two members of different cells only the visit to the lower-numbered cell is made; an outlier visits cells only.
    """
    slack = 1e-4
    wide = math.cos(min(math.pi, radius + angle + slack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("vec", pa.binary()), ("home", pa.int32()), ("visits", pa.list_(pa.int32()))])
        for b in batches:
            if not b.num_rows:
                continue
            m = unit32(unpacked(b.column(1)))
            if len(centre):
                c = m @ centre.T
                home = c.argmax(1)
                home = np.where(c[np.arange(len(m)), home] >= math.cos(radius), home, OUTLIERS).astype(np.int32)
                at, cell = np.nonzero(c >= wide)
                keep = (home[at] == OUTLIERS) | (cell < home[at])
                at, cell = at[keep], cell[keep].astype(np.int32)
            else:
                home, at, cell = np.full(len(m), OUTLIERS, np.int32), np.zeros(0, int), np.zeros(0, np.int32)
            offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=len(m)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell))], schema=schema)

    return vectors.mapInArrow(run, "id long, vec binary, home int, visits array<int>")


def outliers(at: DataFrame) -> DataFrame:
    """(id, vec) of the vectors of `placed` that are in no cell."""
    return at.filter(F.col("home") == OUTLIERS).select("id", "vec")


def homed(at: DataFrame) -> DataFrame:
    """`placed` without a home for outliers: they visit cells, but `tiled` doesn't pair them with each other."""
    return at.withColumn("home", F.when(F.col("home") != OUTLIERS, F.col("home")))


def tiled(at: DataFrame, block: int = BLOCK, far_block: int = FAR_BLOCK) -> DataFrame:
    """(cell, i, j, side, id, ...): each vector once in every pair of chunks it takes part in.

    Members of a cell are chunks 0..g-1; visitors of a cell are chunks of their own, compared with members only. side 1
    is the right side where i <> j; with i = j all are side 0. Chunk counts come from one count per cell, of which there
    is one more than centres.
    """
    spark = at.sparkSession
    home = {r[0]: r[1] for r in at.filter(F.col("home").isNotNull()).groupBy("home").count().collect()}
    away = {r[0]: r[1] for r in at.select(F.explode("visits").alias("c")).groupBy("c").count().collect()}
    # chunks of members and of visitors of each cell that has members: as many rows as cells, joined, not searched
    sizes = [(c, max(1, -(-n // (far_block if c == OUTLIERS else block))), -(-away.get(c, 0) // block)) for c, n in home.items()]
    size = F.broadcast(spark.createDataFrame(sizes, "cell int, g int, v int"))
    rest = [c for c in at.columns if c not in ("home", "visits")]
    chunk = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    members = at.withColumnRenamed("home", "cell").join(size, "cell").select("cell", chunk(F.col("g")).alias("own"), "g", "v", *rest)
    other = F.explode(F.sequence(F.lit(0), F.col("g") + F.col("v") - 1)).alias("other")
    members = members.select("cell", "own", "g", other, *rest)
    members = members.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), *rest)
    visitors = at.select(F.explode("visits").alias("cell"), *rest).join(size, "cell")
    visitors = visitors.select("cell", chunk(F.col("v")).alias("own"), "g", *rest)
    visitors = visitors.select("cell", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), (F.col("g") + F.col("own")).alias("j"), F.lit(1).alias("side"), *rest)
    return members.unionByName(visitors)
