"""Pair mining: a stated set of query rows against all rows, in blocks.

Query and row chunks are shuffled to the tasks that compare them; a task computes one block of cosines as a matrix product
and the shared items by sorted search, and gives on only what its reducer keeps: a summary, the best few, or per-row
lists. Nothing of quadratic size is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import digests
from scriptoria.plans.lineage import new_path

#: Rows of a chunk of queries and of rows.
QUERIES, ROWS = 512, 8192


class Block:
    """One block: arrays of the two sides and their pairwise values."""

    def __init__(self, t: pa.Table):
        side = t.column("side").to_numpy()
        self.q, self.r = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        self.i, self.j = self.q.column("row_id").to_numpy(), self.r.column("row_id").to_numpy()
        self.asked = self.r.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        self.text_i, self.text_j = (x.column("text_code").to_numpy() for x in (self.q, self.r))
        m = [self._matrix(x.column("vec")) for x in (self.q, self.r)]
        self.cos = np.round(m[0] @ m[1].T, 9) if len(self.i) and len(self.j) else np.zeros((len(self.i), len(self.j)))
        self.shared = self._shared("lemmas")
        self.cited = self._shared("persons")
        n, k = (np.diff(self._lists(x, "lemmas").offsets.to_numpy()) for x in (self.q, self.r))
        self.size_i, self.size_j = n, k
        either = n[:, None] + k[None, :] - self.shared
        self.jaccard = np.where(either > 0, self.shared / np.maximum(either, 1), 0.0)

    @staticmethod
    def _matrix(c: pa.ChunkedArray) -> np.ndarray:
        flat = pa.concat_arrays(c.chunks).flatten().to_numpy(zero_copy_only=False) if len(c) else np.zeros(0)
        return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 1))

    @staticmethod
    def _lists(t: pa.Table, name: str) -> pa.ListArray:
        return pa.concat_arrays(t.column(name).chunks) if t.num_rows else pa.array([], pa.list_(pa.int64()))

    def _shared(self, name: str) -> np.ndarray:
        a, b = self._lists(self.q, name), self._lists(self.r, name)
        out = np.zeros((len(a), len(b)), np.int32)
        if not len(a) or not len(b):
            return out
        items = b.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(b)), np.diff(b.offsets.to_numpy()))
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        own, at = a.flatten().to_numpy(zero_copy_only=False), a.offsets.to_numpy() - a.offsets[0].as_py()
        lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
        for k in range(len(a)):
            s = slice(at[k], at[k + 1])
            if at[k + 1] > at[k]:
                out[k] = np.bincount(np.concatenate([owner[x:y] for x, y in zip(lo[s], hi[s])]), minlength=len(b))
        return out

    def others(self) -> np.ndarray:
        """Pairs of a query and any other row; of two queries only i < j."""
        return (self.i[:, None] != self.j[None, :]) & ~(self.asked[None, :] & (self.j[None, :] < self.i[:, None]))

    def eligible(self, apart: int = 1) -> np.ndarray:
        """Pairs of different texts, more than `apart` rows apart, with items on both sides; of two queries only i < j."""
        ok = (self.text_i[:, None] != self.text_j[None, :]) & (np.abs(self.i[:, None] - self.j[None, :]) > apart)
        ok &= (self.size_i > 0)[:, None] & (self.size_j > 0)[None, :]
        return ok & ~(self.asked[None, :] & (self.j[None, :] < self.i[:, None]))


def blocked(rows: DataFrame, is_query: Column, reduce: Callable[[Block], pa.Table], schema: str, queries: int = QUERIES, chunk: int = ROWS) -> DataFrame:
    """`reduce` of every block of query rows x all rows.

    `rows` has (row_id, text_id, vec, lemmas, persons); items are compared by 64-bit hashes. One count fixes the number of chunks.
    """
    code = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.xxhash64(x))))
    base = rows.select("row_id", F.xxhash64("text_id").alias("text_code"), "vec", code("lemmas").alias("lemmas"), code("persons").alias("persons"), is_query.alias("ask"))
    n = base.agg(F.count("*").alias("n"), F.count_if("ask").alias("q")).first()
    gq, gr = max(1, -(-n["q"] // queries)), max(1, -(-n["n"] // chunk))
    at = lambda g: F.pmod(F.xxhash64("row_id"), g).cast("int")
    of = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    ask = base.filter("ask").withColumn("x", at(gq)).withColumn("y", of(gr)).withColumn("side", F.lit(0))
    all_ = base.withColumn("y", at(gr)).withColumn("x", of(gq)).withColumn("side", F.lit(1))

    def run(t: pa.Table) -> pa.Table:
        return reduce(Block(t))

    return ask.unionByName(all_).groupBy("x", "y").applyInArrow(run, schema)


PAIR = "i long, j long, e_cos double, c_jaccard double, shared_lemmas int, h_shared int"


def _picked(b: Block, ok: np.ndarray, order: np.ndarray | None = None, k: int | None = None) -> pa.Table:
    x, y = np.nonzero(ok)
    if k is not None and len(x) > k:
        key = order[x, y]
        edge = np.partition(key, k - 1)[k - 1]
        keep = key <= edge  # ties stay: the whole order is settled at the end
        x, y = x[keep], y[keep]
    return pa.table({"i": b.i[x], "j": b.j[y], "e_cos": b.cos[x, y], "c_jaccard": b.jaccard[x, y], "shared_lemmas": b.shared[x, y].astype(np.int32), "h_shared": b.cited[x, y].astype(np.int32)})


def hotspots(rows: DataFrame, is_query: Column, k: int = 200, least_shared: int = 3) -> DataFrame:
    """(direction, rank, i, j, ...): the k most similar pairs without any shared item or person, and the k least similar pairs of at least
    `least_shared` shared items; ties by i, j."""

    def near(b: Block) -> pa.Table:
        ok = b.eligible() & (b.shared == 0) & (b.cited == 0)
        return _picked(b, ok, -b.cos, k)

    def far(b: Block) -> pa.Table:
        return _picked(b, b.eligible() & (b.shared >= least_shared), b.cos, k)

    out = []
    for name, f, order in (("E_high_surface_zero", near, F.col("e_cos").desc()), ("C_high_E_low", far, F.col("e_cos").asc())):
        best = blocked(rows, is_query, f, PAIR).orderBy(order, "i", "j").limit(k)
        out.append(best.select(F.lit(name).alias("direction"), "i", "j", F.round("e_cos", 4).alias("e_cos"), F.round("c_jaccard", 4).alias("c_jaccard"), "shared_lemmas", "h_shared"))
    return out[0].union(out[1])


def scale(rows: DataFrame, is_query: Column, least_shared: int = 3) -> DataFrame:
    """One row: counts, means, population sd, tails and high percentiles of the two directions over all eligible pairs of the query rows.

    Percentiles are those of cosines at four digits, which are counted per value.
    """

    def sums(b: Block) -> pa.Table:
        ok = b.eligible()
        m1, m2 = ok & (b.shared == 0) & (b.cited == 0), ok & (b.shared >= least_shared)
        e, e1, e2 = b.cos[ok], b.cos[m1], b.cos[m2]
        return pa.table({k: [v] for k, v in {
            "n": float(len(e)), "s": e.sum(), "n1": float(len(e1)), "s1": e1.sum(), "q1": (e1 * e1).sum(), "gt05": float((e1 > 0.5).sum()), "gt06": float((e1 > 0.6).sum()), "gt07": float((e1 > 0.7).sum()),
            "n2": float(len(e2)), "s2": e2.sum(), "q2": (e2 * e2).sum(), "lt025": float((e2 < 0.25).sum()), "lt03": float((e2 < 0.3).sum()),
        }.items()})

    names = ["n", "s", "n1", "s1", "q1", "gt05", "gt06", "gt07", "n2", "s2", "q2", "lt025", "lt03"]
    t = blocked(rows, is_query, sums, ", ".join(f"{c} double" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names])
    bare = _summed(value_counts(rows, is_query).filter("c_jaccard = 0 AND NOT h"), "e_cos")
    high = bare.agg(*[F.round(F.percentile("e_cos", q, F.col("n")), 3).alias(k) for k, q in (("d1_p999", 0.999), ("d1_p9999", 0.9999))])
    t = t.join(high)
    c = F.col
    mean = lambda s, n: F.try_divide(c(s), c(n))
    sd = lambda s, q, n: F.sqrt(F.greatest(F.try_divide(c(q), c(n)) - mean(s, n) * mean(s, n), F.lit(0.0)))
    i = lambda x, name: c(x).cast("long").alias(name)
    return t.select(
        i("n", "n_eligible"), F.round(mean("s", "n"), 3).alias("mean_all"), i("n1", "d1_pool"), F.round(mean("n1", "n"), 3).alias("d1_share"), F.round(mean("s1", "n1"), 3).alias("d1_mean"),
        F.round(sd("s1", "q1", "n1"), 3).alias("d1_sd"), i("gt05", "d1_gt05"), i("gt06", "d1_gt06"), i("gt07", "d1_gt07"), "d1_p999", "d1_p9999", i("n2", "d2_pool"), F.round(mean("n2", "n"), 4).alias("d2_share"),
        F.round(mean("s2", "n2"), 3).alias("d2_mean"), F.round(sd("s2", "q2", "n2"), 3).alias("d2_sd"), i("lt025", "d2_lt025"), i("lt03", "d2_lt03"),
    )


def neighbourhoods(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(row_id, neigh_jaccard): agreement of the k nearest rows by vector and by items, per query row.

    Partners are rows of another text with items; adjacency doesn't matter here. Queries without items or with fewer than k
    partners are left out; ties go to the smaller row_id.
    """

    def lists(b: Block) -> pa.Table:
        out: dict[str, list] = {"kind": [], "i": [], "j": [], "score": [], "n": []}
        ok = (b.text_i[:, None] != b.text_j[None, :]) & (b.size_j > 0)[None, :] & (b.i[:, None] != b.j[None, :])
        for x in np.flatnonzero(b.size_i > 0):
            at = np.flatnonzero(ok[x])
            for kind, s in ((0, b.cos), (1, b.jaccard)):
                best = at[np.lexsort((b.j[at], -s[x, at]))[:k]]
                out["kind"] += [kind] * len(best)
                out["i"] += [b.i[x]] * len(best)
                out["j"] += b.j[best].tolist()
                out["score"] += s[x, best].tolist()
                out["n"] += [len(at)] + [0] * (len(best) - 1) if len(best) else []
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "i": pa.array(out["i"], pa.int64()), "j": pa.array(out["j"], pa.int64()), "score": pa.array(out["score"], pa.float64()), "n": pa.array(out["n"], pa.int64())})

    from scriptoria.operators.ranking import top_per

    part = blocked(rows, is_query, lists, "kind int, i long, j long, score double, n long")
    best = top_per(part, k, ["kind", "i"], F.col("score").desc(), F.col("j"))
    enough = best.groupBy("i").agg(F.count_if(F.col("kind") == 0).alias("e"), F.collect_set(F.when(F.col("kind") == 0, F.col("j"))).alias("a"), F.collect_set(F.when(F.col("kind") == 1, F.col("j"))).alias("b"))
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return enough.filter(F.col("e") >= k).select(F.col("i").alias("row_id"), F.round(j, 4).alias("neigh_jaccard"))


def neighbours_outside(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(i, j, e_cos, rank): the k nearest rows of another text by vector, per query row; ties by j."""

    def best(b: Block) -> pa.Table:
        ok = b.text_i[:, None] != b.text_j[None, :]
        s = np.where(ok, b.cos, -2)
        n = min(k, s.shape[1])
        edge = np.sort(np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :], axis=1)[:, 0] if n else np.full(len(s), 2.0)
        return _picked(b, ok & (s >= edge[:, None]))

    from scriptoria.operators.ranking import top_per

    return top_per(blocked(rows, is_query, best, PAIR), k, ["i"], F.col("e_cos").desc(), F.col("j")).select("i", "j", F.round("e_cos", 6).alias("e_cos"), "rank")


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("n").alias("n"))


def value_counts(rows: DataFrame, is_query: Column, digits: int = 4) -> DataFrame:
    """(e_cos, c_jaccard, h, n): how many eligible pairs of the query rows have each pair of values, and whether they share a person.

    The cosine is rounded to `digits`, the Jaccard to 9. A block gives on its counts, never its pairs.
    """
    one = 10**digits

    def count(b: Block) -> pa.Table:
        ok = b.eligible()
        v = (np.sign(b.cos[ok]) * np.floor(np.abs(b.cos[ok]) * one + 0.5)).astype(np.int64) + 2 * one
        c, at = np.unique(np.round(b.jaccard[ok], 9), return_inverse=True)
        key, n = np.unique((v * max(1, len(c)) + at.ravel()) * 2 + (b.cited[ok] > 0), return_counts=True)
        v, at = key // 2 // max(1, len(c)), key // 2 % max(1, len(c))
        return pa.table({"e_cos": (v - 2 * one) / one, "c_jaccard": c[at], "h": key % 2 == 1, "n": n.astype(np.int64)})

    return _summed(blocked(rows, is_query, count, "e_cos double, c_jaccard double, h boolean, n long"), "e_cos", "c_jaccard", "h")


def shared_counts(rows: DataFrame, is_query: Column, column: str, digits: int = 4) -> DataFrame:
    """(v, x, y): over all pairs of a query row and any other, how many of each cosine share a value of `column` (lemmas or persons), and
    how many there are in all. v is the cosine in units of the last of `digits` digits."""
    one = 10**digits

    def count(b: Block) -> pa.Table:
        ok, same = b.others(), (b.shared if column == "lemmas" else b.cited) > 0
        v = (np.sign(b.cos) * np.floor(np.abs(b.cos) * one + 0.5)).astype(np.int64) + 2 * one
        y, x = np.bincount(v[ok], minlength=4 * one + 1), np.bincount(v[ok & same], minlength=4 * one + 1)
        at = np.flatnonzero(y)
        return pa.table({"v": at - 2 * one, "x": x[at].astype(np.int64), "y": y[at].astype(np.int64)})

    return blocked(rows, is_query, count, "v long, x long, y long").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def _bin(x: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """Equal bins 1..bins over [low, high]; the upper end belongs to the last."""
    return np.minimum(np.floor((x - low) / ((high - low) / bins)) + 1, bins).astype(np.int64)


def histograms(rows: DataFrame, is_query: Column, bins: int = 120, fewer: int = 60, least_shared: int = 3) -> DataFrame:
    """(part, bin, n): the cosines of the eligible pairs of the query rows over [-1, 1]: all, and those without anything shared, in `bins`
    bins; those of at least `least_shared` shared items in `fewer`. A block gives on one row per bin."""

    def count(b: Block) -> pa.Table:
        ok = b.eligible()
        out = {"part": [], "bin": [], "n": []}
        for name, m, k in (("all", ok, bins), ("E_high_surface_zero", ok & (b.shared == 0) & (b.cited == 0), bins), ("C_high_E_low", ok & (b.shared >= least_shared), fewer)):
            at, n = np.unique(_bin(np.clip(b.cos[m], -1, 1), -1.0, 1.0, k), return_counts=True)
            out["part"] += [name] * len(at)
            out["bin"] += at.tolist()
            out["n"] += n.tolist()
        return pa.table({"part": pa.array(out["part"], pa.string()), "bin": pa.array(out["bin"], pa.int32()), "n": pa.array(out["n"], pa.int64())})

    return _summed(blocked(rows, is_query, count, "part string, bin int, n long"), "part", "bin")


def grid(rows: DataFrame, is_query: Column, bins: int = 60) -> DataFrame:
    """(bin_x, bin_y, n): eligible pairs of the query rows by cosine over [-1, 1] and Jaccard over [0, 1]."""

    def count(b: Block) -> pa.Table:
        ok = b.eligible()
        key, n = np.unique(_bin(np.clip(b.cos[ok], -1, 1), -1.0, 1.0, bins) * (bins + 1) + _bin(np.round(b.jaccard[ok], 9), 0.0, 1.0, bins), return_counts=True)
        return pa.table({"bin_x": (key // (bins + 1)).astype(np.int32), "bin_y": (key % (bins + 1)).astype(np.int32), "n": n.astype(np.int64)})

    return _summed(blocked(rows, is_query, count, "bin_x int, bin_y int, n long"), "bin_x", "bin_y")


#: Labelled rows of a chunk, and runs that a task does of one block.
LABELLED, AT_ONCE = 2048, 128
#: Layers of `recovery` that compare sets, and the columns that hold them.
SET_LAYERS = {"C-open": "open", "C-closed": "closed"}


def _incidence(side: pa.Table, name: str, known: np.ndarray) -> np.ndarray:
    """Rows x known values of a list column."""
    lists = pa.concat_arrays(side.column(name).chunks) if side.num_rows else pa.array([], pa.list_(pa.int64()))
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out = np.zeros((len(lists), len(known)), np.float32)
    out[at, np.searchsorted(known, flat)] = 1
    return out


def _known(t: pa.Table, name: str) -> np.ndarray:
    return np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t.column(name).chunks] or [np.zeros(0, np.int64)]))


class _Labelled:
    """One block of labelled rows: similarities per layer in units of the last digit, and which pairs count."""

    def __init__(self, t: pa.Table, one: int):
        c, x, y = t.column("c").to_numpy(), t.column("x")[0].as_py(), t.column("y")[0].as_py()
        # a row of a diagonal block stands there once
        self.a, self.b = (t.filter(pa.array(c == k)) for k in (x, y))
        shape = (self.a.num_rows, self.b.num_rows)
        self.met = np.triu(np.ones(shape, bool), 1) if x == y else np.ones(shape, bool)
        cos = Block._matrix(self.a.column("vec")) @ Block._matrix(self.b.column("vec")).T if min(shape) else np.zeros(shape)
        self.layers = {"E": cos}
        for name, column in SET_LAYERS.items():
            known = _known(t, column)
            p, q = _incidence(self.a, column, known), _incidence(self.b, column, known)
            both = p @ q.T
            either = p.sum(1)[:, None] + q.sum(1)[None, :] - both
            self.layers[name] = np.where(either > 0, both.astype(np.float64) / np.maximum(either, 1), 0.0)
        self.layers = {k: (np.sign(v) * np.floor(np.abs(v) * one + 0.5)).astype(np.int64) for k, v in self.layers.items()}
        self.known = _known(t, "labels")

    def same(self) -> np.ndarray:
        """Which counted pairs share a label."""
        return (_incidence(self.a, "labels", self.known) @ _incidence(self.b, "labels", self.known).T > 0)[self.met]


def _blocks_of(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """`rows` once in every pair of chunks (x, y) it takes part in; c is its own chunk."""
    g = max(1, -(-rows.count() // chunk))
    base = rows.withColumn("c", F.pmod(F.xxhash64(key), g).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    return base.withColumns({"x": F.least("c", "other"), "y": F.greatest("c", "other")}).drop("other")


def _hashed(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.xxhash64(x)))).alias(name)


def label_counts(rows: DataFrame, key: str, labels: str, digits: int = 4, chunk: int = LABELLED) -> DataFrame:
    """(layer, v, x, y): over all pairs of `rows` (key, vec, open, closed, labels), how many of each similarity v share a label (x), how many don't (y).

    Layers: E, the cosine; C-open and C-closed, the Jaccard of those sets (0 of two empty ones). v is in units of the last of `digits`
    digits. Chunks of rows meet in blocks, and a block gives on its counts, never its pairs.
    """
    one = 10**digits

    def count(t: pa.Table) -> pa.Table:
        b = _Labelled(t, one)
        out = {"layer": [], "v": [], "x": [], "y": []}
        same = b.same()
        for name, v in b.layers.items():
            got = np.bincount(2 * (v[b.met] + 2 * one) + same, minlength=8 * one + 2).reshape(-1, 2)
            at = np.flatnonzero(got.sum(1))
            out["layer"] += [name] * len(at)
            out["v"] += (at - 2 * one).tolist()
            out["x"] += got[at, 1].tolist()
            out["y"] += got[at, 0].tolist()
        return pa.table({"layer": pa.array(out["layer"], pa.string()), **{k: pa.array(out[k], pa.int64()) for k in "vxy"}})

    base = _blocks_of(rows.select(key, "vec", _hashed("open"), _hashed("closed"), _hashed(labels).alias("labels")), key, chunk)
    blocks = base.groupBy("x", "y").applyInArrow(count, "layer string, v long, x long, y long")
    return blocks.groupBy("layer", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def permuted_sums(rows: DataFrame, key: str, deals: DataFrame, labels: str, ranks: DataFrame, runs: int, digits: int = 4, chunk: int = LABELLED) -> DataFrame:
    """(layer, run, total, n): per run, the summed mid-ranks of the pairs that share a label, and their number.

    `deals` is (run, key, labels), every row once per run, `ranks` (layer, v, mid) the mid-rank of each similarity over all pairs: at most
    2 x 10^digits + 1 values a layer, collected. A run needs no more than this sum, so no pair and no value is written per run.
    """
    one = 10**digits
    mid = {}
    for r in ranks.collect():
        mid.setdefault(r["layer"], np.zeros(4 * one + 1))[r["v"] + 2 * one] = r["mid"]

    def count(t: pa.Table) -> pa.Table:
        b = _Labelled(t, one)
        of = {name: np.where(b.met, mid[name][v + 2 * one], 0) for name, v in b.layers.items() if name in mid}
        part, known = t.column("part")[0].as_py(), _known_deals(t)
        mine = range(part * AT_ONCE, min(runs, (part + 1) * AT_ONCE))
        left, right = _dealt(b.a, known, len(mine)), _dealt(b.b, known, len(mine))
        out = {"layer": [], "run": [], "total": [], "n": []}
        for k, run in enumerate(mine):
            same = (left(k) @ right(k).T > 0) & b.met
            for name, m in of.items():
                out["layer"].append(name)
                out["run"].append(run)
                out["total"].append(float(m[same].sum()))
                out["n"].append(int(same.sum()))
        return pa.table({"layer": pa.array(out["layer"], pa.string()), "run": pa.array(out["run"], pa.int32()), "total": pa.array(out["total"], pa.float64()), "n": pa.array(out["n"], pa.int64())})

    part = F.floor(F.col("run") / AT_ONCE).cast("int")
    sets = deals.groupBy(key, part.alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", F.transform(labels, lambda x: F.xxhash64(x)).alias("l")))), lambda s: s["l"]).alias("deals"))
    # labels of the rows themselves aren't needed: those of the runs are
    base = rows.select(key, "vec", _hashed("open"), _hashed("closed"), F.array().cast("array<bigint>").alias("labels")).join(sets, key)
    blocks = _blocks_of(base, key, chunk).groupBy("x", "y", "part").applyInArrow(count, "layer string, run int, total double, n long")
    return blocks.groupBy("layer", "run").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


#: Bytes of dealt labels that are broadcast at once, and pairs of a block done at once, chosen for the processor's cache.
DEALT, TILE = 96 << 20, 32768


def _deals(given, seed: str):
    """(run, deal): the labels, as bits, that each row, in the order of keys, is dealt in a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own = given.value
            tails = digests.decimals(ids)
            for r in b.column(0).to_pylist():
                deal = own[np.argsort(digests.first_bits(f"{seed}|{r}|", tails), kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([deal.tobytes()], pa.binary())], ["run", "deal"])

    return run


def shuffled_sums(rows: DataFrame, key: str, labels: str, ranks: DataFrame, runs: int, seed: str, digits: int = 4, chunk: int = LABELLED) -> DataFrame | None:
    """`permuted_sums` of the deals of `resample.permuted`, without their table; None if there are more than 64 labels.

    Keys and labels are collected, two numbers a row: the work grows as the square of the rows. A block is made once for as many
    runs as `DEALT` bytes hold.
    """
    spark, one = rows.sparkSession, 10**digits
    got = rows.select(key, _hashed(labels)).orderBy(key).toArrow()
    lists = got.column(1).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    known = np.unique(flat)
    if len(known) > 64 or not len(lists):
        return None
    ids, kind = got.column(0).to_numpy().astype(np.int64), next(t for t in (np.uint16, np.uint32, np.uint64) if len(known) <= np.iinfo(t).bits)
    own = np.zeros(len(ids), kind)  # a bit for each label
    np.bitwise_or.at(own, np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), np.left_shift(kind(1), np.searchsorted(known, flat).astype(kind)))
    mid = {}
    for r in ranks.collect():
        mid.setdefault(r["layer"], np.zeros(4 * one + 1))[r["v"] + 2 * one] = r["mid"]
    g = max(1, -(-len(ids) // chunk))
    base = _blocks_of(rows.select(key, "vec", _hashed("open"), _hashed("closed"), F.array().cast("array<bigint>").alias("labels")), key, chunk)
    base = base.repartition(min(200, g * (g + 1) // 2), "x", "y")
    given, path = spark.sparkContext.broadcast((ids, own)), new_path(spark, "sums")
    at_once = max(1, DEALT // own.nbytes)
    for start in range(0, runs, at_once):
        deals = spark.range(start, min(runs, start + at_once), 1, 24).mapInArrow(_deals(given, seed), "run long, deal binary").orderBy("run").toArrow()
        shared = spark.sparkContext.broadcast((start, np.stack([np.frombuffer(x.as_buffer(), own.dtype) for x in deals.column("deal")]), ids, mid))
        base.groupBy("x", "y").applyInArrow(_block_sums(shared, key, one), "layer string, run int, total double, n long").write.mode("append").parquet(path)
        shared.destroy()
    given.destroy()
    sums = spark.read.schema("layer string, run int, total double, n long").parquet(path)
    return sums.groupBy("layer", "run").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _block_sums(shared, key: str, one: int):
    def count(t: pa.Table) -> pa.Table:
        start, deals, ids, mid = shared.value
        b = _Labelled(t, one)
        of = {name: np.where(b.met, mid[name][v + 2 * one], 0).ravel() for name, v in b.layers.items() if name in mid}
        met, all_met, width = b.met.ravel(), b.met.all(), b.b.num_rows
        left, right = (np.searchsorted(ids, x.column(key).to_numpy()) for x in (b.a, b.b))
        total, n = np.zeros((len(deals), len(of))), np.zeros(len(deals), np.int64)
        width = len(right)
        high = max(1, TILE // max(1, width))
        for first in range(0, len(left), high):
            rows = left[first : first + high]
            part = slice(first * width, (first + len(rows)) * width)
            m = np.stack([x[part] for x in of.values()])
            counted = None if b.met.all() else b.met.ravel()[part]
            shape = (len(rows), width)
            both, same, value = np.empty(shape, deals.dtype), np.empty(shape, bool), np.empty(shape)
            for k, deal in enumerate(deals):
                np.bitwise_and(deal[rows][:, None], deal[right][None, :], out=both)
                np.not_equal(both, 0, out=same)
                np.copyto(value, same)
                total[k] += m @ value.ravel()
                n[k] += np.count_nonzero(same if counted is None else same.ravel() & counted)
        run = np.arange(start, start + len(deals))
        return pa.table({"layer": pa.array([x for x in of for _ in run], pa.string()), "run": pa.array(np.tile(run, len(of)), pa.int32()), "total": pa.array(total.T.ravel(), pa.float64()), "n": pa.array(np.tile(n, len(of)), pa.int64())})

    return count


def _known_deals(t: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([x.flatten().flatten().to_numpy(zero_copy_only=False) for x in t.column("deals").chunks] or [np.zeros(0, np.int64)]))


def _dealt(side: pa.Table, known: np.ndarray, runs: int):
    """k -> incidence of the labels dealt to each row in the k-th run of a part."""
    n = side.num_rows
    inner = pa.concat_arrays(side.column("deals").chunks).flatten() if n else pa.array([], pa.list_(pa.int64()))
    size = np.diff(inner.offsets.to_numpy())
    code = np.searchsorted(known, inner.flatten().to_numpy(zero_copy_only=False))
    slot = np.repeat(np.arange(len(inner)), size)  # row x runs + run
    order = np.argsort(slot % max(1, runs), kind="stable")
    slot, code = slot[order], code[order]
    edge = np.searchsorted(slot % max(1, runs), np.arange(runs + 1))

    def of(k: int) -> np.ndarray:
        out = np.zeros((n, len(known)), np.float32)
        out[slot[edge[k] : edge[k + 1]] // runs, code[edge[k] : edge[k + 1]]] = 1
        return out

    return of
