"""Most similar vectors for every vector (problem 6): int8 product tiles with error bounds, then exact merging.

A unit vector x is stored as bytes q and a step s; e = |x - s q| is known for each, so the true cosine of two
lies within e_x + e_y + e_x e_y of the product of their codes. Tiles of code products (whole numbers, exact in
float32) give such bounds for all pairs of two chunks. A pair survives if its upper bound reaches the floor and
is not below the k-th best lower bound of the query in the tile, which cannot drop any of the k best. Survivors
are computed again from the floats and merged to k per query.

Where a tile holds so many near-equal vectors that bounds can't tell them apart, it gives on its own name instead of
its survivors, and is done again from the floats: k candidates per query, however dense it is.

With a floor, `vector_blocks` rules out pairs of blocks that can't reach it, and `vector_far` compares the vectors near no centre. A stated query set meets all chunks. Without either
every chunk meets every other: exact, and quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.llm import vector_blocks, vector_far
from scriptoria.llm.vector_clusters import PIECE, _sides, _vectors
from scriptoria.llm.vector_far import part_of
from scriptoria.plans.lineage import cut

BLOCK, FAR_BLOCK = 8192, 32768
#: Survivors per row and k from which a tile is dense.
DENSE = 8


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, step and error length of unit rows."""
    m = m.astype(np.float64)
    step = np.abs(m).max(1) / 127
    q = np.rint(m / step[:, None]).astype(np.int8)
    return q, step, np.sqrt(((m - q * step[:, None]) ** 2).sum(1)) + 1e-7


def _code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            q, step, off = quantised(vector_blocks.unit(vector_blocks.unpacked(b.column("vec"))))
            rest = [n for n in b.schema.names if n != "vec"]
            cols = [b.column(n) for n in rest] + [vector_blocks.packed(q), pa.array(step.astype(np.float32)), pa.array(off.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(cols, [*rest, "code", "step", "off"])


def coded(at: DataFrame) -> DataFrame:
    """`at` with (code, step, off) in place of vec: a quarter of the bytes to shuffle."""
    rest = ", ".join(f"{n} {t}" for n, t in at.dtypes if n != "vec")
    return at.mapInArrow(_code_batches, f"{rest}, code binary, step float, off float")


def _survivors(k: int, floor: float | None, dense: float, one_way: bool):
    empty = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int32()), ("i", pa.int32()), ("j", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        left, right, same = _sides(t)
        q = vector_blocks.unpacked(t.column("code"), "i1").astype(np.float32)
        step, off = (t.column(c).to_numpy().astype(np.float32) for c in ("step", "off"))
        ids = t.column("id").to_numpy()
        low = -np.inf if floor is None else floor - 1e-6
        kth = np.full(len(ids), -2, np.float32)  # the k-th best lower bound so far
        best = np.full((len(ids), k), -2, np.float32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def ask(p: np.ndarray, r: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
            """Queries p against r, given products and bounds; -2 marks a row with itself."""
            up = s + e
            if floor is not None:
                x, y = np.nonzero(up >= low)
            else:
                lower = s - e
                n = min(k, lower.shape[1])
                both = np.concatenate([best[p], np.partition(lower, lower.shape[1] - n, axis=1)[:, lower.shape[1] - n :]], axis=1)
                best[p] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                kth[p] = best[p].min(1)
                x, y = np.nonzero(up >= np.maximum(kth[p], -1.5)[:, None])
            out.append((p[x], r[y], up[x, y]))

        for x in range(0, len(left), PIECE):
            for y in range(x if same else 0, len(right), PIECE):
                p, r = left[x : x + PIECE], right[y : y + PIECE]
                s = q[p] @ q[r].T
                if floor is not None and not len(np.flatnonzero(s.max(1) * step[p] * step[r].max() + off[p] * (1 + off[r].max()) + off[r].max() >= low)):
                    continue
                s *= step[p][:, None]
                s *= step[r][None, :]
                e = off[p][:, None] * (1 + off[r][None, :]) + off[r][None, :]
                if same and x == y or one_way:
                    s[ids[p][:, None] == ids[r][None, :]] = -4
                ask(p, r, s, e)
                if not one_way and (not same or x != y):
                    ask(r, p, s.T, e.T)
                if sum(len(z[0]) for z in out) > dense * k * len(ids):  # later bounds may have made earlier ones void
                    a, b, up = (np.concatenate(z) for z in zip(*out))
                    keep = up >= kth[a]
                    out[:] = [(a[keep], b[keep], up[keep])]
                    if keep.sum() > dense * k * len(ids):
                        return pa.table([[None], [None], *([t.column(c)[0].as_py()] for c in ("cell", "i", "j"))], schema=empty)
        a, b, up = (np.concatenate(z) if out else np.zeros(0, np.int64) for z in (zip(*out) if out else ((), (), ())))
        keep = up >= kth[a] if len(a) else np.zeros(0, bool)
        a, b = (ids[x[keep]] if len(x) else np.zeros(0, np.int64) for x in (a, b))
        return pa.table([a, b, *(pa.nulls(len(a), pa.int32()) for _ in range(3))], schema=empty)

    return run


def _closest(k: int, floor: float | None, one_way: bool):
    """Of a tile of float vectors, the k best partners of each row (of each left row, if one way), ties to the smaller id."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        left, right, same = _sides(t)
        m, ids = vector_blocks.unit(vector_blocks.unpacked(t.column("vec"))), t.column("id").to_numpy()
        out_a, out_b = [], []
        for mine, others in ((left, right),) if same or one_way else ((left, right), (right, left)):
            for x in range(0, len(mine), PIECE):
                p = mine[x : x + PIECE]
                best, who = np.full((len(p), k), -2.0), np.full((len(p), k), -1)
                for y in range(0, len(others), PIECE):
                    q = others[y : y + PIECE]
                    s = np.round(m[p] @ m[q].T, 12)
                    s[ids[p][:, None] == ids[q][None, :]] = -2
                    s, at = np.hstack([best, s]), np.hstack([who, np.broadcast_to(q, s.shape)])
                    order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # earlier columns have smaller ids
                    best, who = np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
                good = (best > -2) if floor is None else best >= floor - 1e-9
                out_a.append(ids[p[np.nonzero(good)[0]]])
                out_b.append(ids[who[good]])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
        return pa.table({"a": a, "b": b})

    return run


def _best(q: np.ndarray, r: np.ndarray, m: list[np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates r of rows q, the k best of each q, ties to the smaller id; m holds the raw rows of q and r in two pieces."""
    n = len(m[0])

    def unit(at: np.ndarray) -> np.ndarray:
        out, own = np.empty((len(at), m[0].shape[1])), at < n
        out[own], out[~own] = m[0][at[own]], m[1][at[~own] - n]
        return vector_blocks.unit(out)

    s = np.concatenate([np.round((unit(q[i : i + 65536]) * unit(r[i : i + 65536])).sum(1), 12) for i in range(0, len(q), 65536)])
    order = np.lexsort((ids[r], -s, q))
    q, r = q[order], r[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep]


def _far_pairs(k: int):
    """(a, b) of outliers and a part of them: candidates from the floor on, of each row of a batch or the part at most about k once they are many."""

    def of_part(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = part_of(shared)
            for b in batches:
                if not b.num_rows:
                    continue
                raw, own = vector_blocks.unpacked(b.column("vec")), b.column("id").to_numpy()
                n, ids = len(own), np.concatenate([own, part.ids])
                q, r, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
                for x, y, _ in part.pairs(own, vector_blocks.unit32(raw), b.column("cell").to_numpy()):
                    new.append((np.concatenate([x, y + n]), np.concatenate([y + n, x])))
                    held += 2 * len(x)
                    if held > 2 * k * len(ids):
                        q, r = _best(*(np.concatenate(z) for z in zip((q, r), *new)), [raw, part.raw], ids, k)
                        new, held = [], len(q)
                q, r = (np.concatenate(z) for z in zip((q, r), *new))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ids[r])], ["a", "b"])

        return run

    return of_part


def _exact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            p, q = (vector_blocks.unit(vector_blocks.unpacked(b.column(c))) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(np.round((p * q).sum(1), 12))], ["a", "b", "s"])


def asked_tiles(at: DataFrame, asks, block: int) -> DataFrame:
    """Chunks of the rows that ask (left) x chunks of all rows (right), as `vector_blocks.tiled` gives them; i and j never agree."""
    n = at.agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).first()
    gq, gr = max(1, -(-n["q"] // block)), max(1, -(-n["n"] // block))
    chunk = lambda g: F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    of = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    rest = at.columns
    cell = F.lit(vector_blocks.OUTLIERS).alias("cell")
    left = at.filter(asks).select(cell, chunk(gq).alias("i"), of(gr).alias("j"), F.lit(0).alias("side"), *rest)
    right = at.select(cell, of(gq).alias("i"), chunk(gr).alias("j"), F.lit(1).alias("side"), *rest)
    return left.unionByName(right).withColumn("j", F.col("j") + gq)


def neighbours(df: DataFrame, key: str, values: str, k: int, floor: float | None = None, width: int = 64, asks=None) -> DataFrame:
    """(a, b, s, rank): the k most similar other vectors b of each usable vector a, ties to the smaller b.

    With `floor`, only those at least that similar; with `asks`, a condition on `id`, only for such a. A vector has fewer than k if
    there are no more. Equal vectors are neighbours like any others; unusable ones take no part.
    """
    raw = vector_blocks.usable(df, key, values, width)
    if asks is not None:
        at = raw
    elif floor is not None:
        angle = math.acos(floor)
        radius = max(angle, math.acos(0.85))
        at = vector_blocks.placed(raw, vector_blocks.centres(raw, radius, df.count()), radius, angle)
    else:
        at = raw.select("id", "vec", F.lit(vector_blocks.OUTLIERS).alias("home"), F.array().cast("array<int>").alias("visits"))
    at = cut(at, "placed")
    far = None
    if asks is None and floor is not None:
        far = vector_far.met(vector_blocks.outliers(at), floor, _far_pairs(k), "a long, b long")
        at = vector_blocks.homed(at)
    tiled = (lambda x: vector_blocks.tiled(x, BLOCK, FAR_BLOCK)) if asks is None else (lambda x: asked_tiles(x, asks, FAR_BLOCK))
    one_way = asks is not None
    got = tiled(coded(at)).groupBy("cell", "i", "j").applyInArrow(_survivors(k, floor, DENSE, one_way), "a long, b long, cell int, i int, j int")
    if far is not None:
        got = got.unionByName(far, allowMissingColumns=True)
    # a query's neighbours come from many tiles: each pair once
    got = cut(got.distinct(), "survivors")
    pairs, dense = got.filter("b IS NOT NULL").select("a", "b"), got.filter("b IS NULL").select("cell", "i", "j")
    if not dense.isEmpty():
        again = tiled(at).join(dense, ["cell", "i", "j"], "left_semi")
        pairs = pairs.union(again.groupBy("cell", "i", "j").applyInArrow(_closest(k, floor, one_way), "a long, b long")).distinct()
    vec = raw.select("id", "vec")
    full = pairs.join(vec.toDF("a", "x"), "a").join(vec.toDF("b", "y"), "b").select("a", "b", "x", "y")
    exact = full.mapInArrow(_exact_batches, "a long, b long, s double")
    if floor is not None:
        exact = exact.filter(F.col("s") >= floor)
    return exact.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.col("s").desc(), "b"))).filter(F.col("rank") <= k)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that choose each other among their five, from a cosine of 0.98.

    Whatever is closer to a vector than a partner above the floor is above the floor itself, so the five best above it
    are all that count.
    """
    near = cut(neighbours(_vectors(spark, d), "vec_id", "embeddings", 5, 0.98), "near")
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return near.filter("a < b").join(back.filter("a < b"), ["a", "b"]).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 100, against all."""
    got = neighbours(_vectors(spark, d), "vec_id", "embeddings", 5, asks=F.col("id") % 100 == 0)
    return got.select(F.col("a").alias("vec_id"), F.col("b").alias("other"), "rank", F.round("s", 6).alias("similarity"))
