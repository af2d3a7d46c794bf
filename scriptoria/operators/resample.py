"""Null models as one plan each: runs are rows, draws are keyed hashes. No run's rows are gathered in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.ranks import numbered
from scriptoria.functions.text import keyed, keyed_int
from scriptoria.operators.ranking import top_per
from scriptoria.operators.sampling import of_all_runs, thresholds


def shuffled_labels(rows: DataFrame, key: str, n_a: int, n_b: int, runs: int, seed: str) -> DataFrame:
    """(run, kind, key): per run the first n_a rows of a shuffle are A, the next n_b B, all others D; `rows` has each key once.

    Two thresholds a run decide that where the rows are read: nothing is shuffled.
    """
    bound = thresholds(rows, runs, [n_a, n_a + n_b], seed, key)
    h = keyed(seed, F.col("run"), F.col(key))
    spread = of_all_runs(rows.select(key), runs).join(F.broadcast(bound), "run").withColumn("h", h)
    return spread.select("run", F.when(F.col("h") <= F.col("t_0"), "a").when(F.col("h") <= F.col("t_1"), "b").otherwise("d").alias("kind"), key)


def random_sets(rows: DataFrame, key: str, n: int, runs: int, seed: str) -> DataFrame:
    """`rows` with run: the n rows of each run's set, drawn without replacement; `rows` has each key once."""
    bound = thresholds(rows, runs, [n], seed, key)
    return of_all_runs(rows, runs).join(F.broadcast(bound), "run").filter(keyed(seed, F.col("run"), F.col(key)) <= F.col("t_0")).drop("t_0")


def matched_pools(targets: DataFrame, pool: DataFrame, low: float = 0.5, high: float = 2.0, nearest: int = 50) -> DataFrame:
    """(target, item): for each (target, n) the pool items of (item, n) with low x n <= their n <= high x n.

    A target without any gets the `nearest` by |difference|, ties by item; nearest 0 gives it the whole pool. Targets are few and
    broadcast.
    """
    t = F.broadcast(targets.select("target", F.col("n").alias("tn")))
    band = pool.join(t, (F.col("n") >= F.col("tn") * low) & (F.col("n") <= F.col("tn") * high)).select("target", "item")
    miss = targets.join(band.select("target").distinct(), "target", "left_anti").select("target", F.col("n").alias("tn"))
    near = pool.join(F.broadcast(miss), F.col("item").isNotNull())
    near = near if nearest == 0 else top_per(near, nearest, ["target"], F.abs(F.col("n") - F.col("tn")), F.col("item"))
    return band.union(near.select("target", "item"))


def drawn(pools: DataFrame, runs: int, seed: str) -> DataFrame:
    """(run, target, item): one item of each target's pool per run; a number modulo the pool's size picks it.

    Two targets of a run may get the same item: their postings are united anyway. Pools are numbered over range partitions, so no
    task holds one.
    """
    placed = numbered(pools, F.col("target"), F.col("item"), name="place")
    size = placed.groupBy("target").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    pick = of_all_runs(size, runs)
    pick = pick.withColumn("place", (F.col("first") + F.pmod(keyed_int(seed, F.col("run"), F.col("target")), F.col("size"))).cast("int"))
    return pick.select("run", "target", "place").join(placed, ["target", "place"]).select("run", "target", "item")


def runs_of(items: Column, draws: DataFrame) -> Column:
    """The runs in which any of a row's items was drawn, each once: a union of postings, row by row, without a shuffle.

    `draws` is (run, item, ..), at most runs x targets rows, both given by the caller: it is collected.
    """
    of: dict[str, set[int]] = {}
    for r in draws.select("item", "run").distinct().collect():
        of.setdefault(r["item"], set()).add(r["run"])
    names = pa.array(sorted(of), pa.string())
    size = np.array([len(of[x]) for x in names.to_pylist()], np.int64)
    first, flat = np.cumsum(size) - size, np.array([run for x in names.to_pylist() for run in sorted(of[x])], np.int64)

    def find(lists: pa.Array) -> pa.Array:
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        code = pc.index_in(pc.list_flatten(lists).cast(pa.string()), names)
        held = code.is_valid().to_numpy(zero_copy_only=False)
        row, code = parent[held].astype(np.int64), code.drop_null().to_numpy(zero_copy_only=False)
        n = size[code]
        at = np.repeat(first[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = int(flat.max()) + 1 if len(flat) else 1
        pair = np.unique(np.repeat(row, n) * width + flat[at])
        offsets = np.r_[0, np.cumsum(np.bincount(pair // width, minlength=len(lists)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((pair % width).astype(np.int32)))

    return F.arrow_udf(find, "array<int>")(items)


def kinds(rows: DataFrame, key: str, a: Column, b: Column, excluded: Column, runs: int) -> DataFrame:
    """(run, kind, key) from the runs (arrays) in which a row is in A and in B; D is every other run of a row that isn't excluded."""
    every = F.sequence(F.lit(0), F.lit(runs - 1))
    rest = F.when(F.col("_x"), F.array().cast("array<int>")).otherwise(F.array_except(every, F.array_union("a", "b")))
    wide = rows.select(key, a.alias("a"), b.alias("b"), excluded.alias("_x")).withColumn("d", rest)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("runs")) for k in "abd"]))
    return wide.select(key, each.alias("s")).select(F.explode("s.runs").alias("run"), "s.kind", key)


def permuted(rows: DataFrame, key: str, value: str, runs: int, seed: str) -> DataFrame:
    """(run, key, value): the values dealt anew to the rows in each run. Both orders are numbered over range partitions."""
    base = rows.select(key, value)
    n = base.count()
    fixed = of_all_runs(numbered(base.select(key), F.col(key), name="p"), runs)
    dealt = numbered(of_all_runs(base, runs), F.col("run"), keyed(seed, F.col("run"), F.col(key)), F.col(key), name="p")
    dealt = dealt.select("run", (F.col("p") - F.col("run").cast("long") * n).alias("p"), value)
    return fixed.join(dealt, ["run", "p"]).select("run", key, value)
