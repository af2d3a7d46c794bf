"""The probe: do pairs of groups lie closer than a baseline? And what nulls say of it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import rankstats, vectors
from scriptoria.operators.sampling import first_places
from scriptoria.plans.lineage import cut

#: Pairs drawn per class.
N_PAIRS = 50_000


def pair_cosines(pairs: DataFrame, vecs: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """`pairs` (.., i, j) with cos, rounded so that summation order breaks no rank tie. Rows without a vector drop."""
    x, y = vecs.select(F.col(key).alias("i"), F.col("vec").alias("x")), vecs.select(F.col(key).alias("j"), F.col("vec").alias("y"))
    return pairs.join(x, "i").join(y, "j").withColumn("cos", F.round(vectors.dot(F.col("x"), F.col("y")), digits)).drop("x", "y")


def against(cosines: DataFrame, base: dict[str, str], run: str = "run") -> DataFrame:
    """(run, n, n_base, delta, u, z): each pair class against its baseline class."""
    pairs = [F.struct(F.lit(c).alias("of"), F.lit(b).alias("base")) for c, b in base.items()]
    named = cosines.withColumn("t", F.explode(F.array(*pairs))).filter((F.col(run) == F.col("t.of")) | (F.col(run) == F.col("t.base")))
    # a class that is its own baseline is on both sides
    sides = named.select(F.col("t.of").alias("class"), "cos", F.explode(F.array_compact(F.array(F.when(F.col(run) == F.col("t.of"), F.lit(True)), F.when(F.col(run) == F.col("t.base"), F.lit(False))))).alias("is_x"))
    return rankstats.two_samples(sides, "cos", F.col("is_x"), ["class"])


def class_table(cosines: DataFrame, base: str, run: str = "run") -> DataFrame:
    """(class, n_pairs, median, iqr_low, iqr_high, delta): each class, its quartiles, and its delta against `base`.

    The base's own delta is 0. A class without pairs has no row.
    """
    q = rankstats.quantiles(cosines, "cos", {"median": 0.5, "iqr_low": 0.25, "iqr_high": 0.75}, [run]).withColumnsRenamed({run: "class", "n": "n_pairs"})
    names = [r[0] for r in cosines.select(run).distinct().collect()]  # the pair classes given, a handful
    d = against(cosines, {c: base for c in names} or {base: base}, run).select("class", "delta", "z")
    r = lambda c: F.round(c, 6).alias(c)
    return rankstats.with_p(q.join(d, "class", "left")).select("class", "n_pairs", r("median"), r("iqr_low"), r("iqr_high"), F.round(F.when(F.col("class") == base, 0.0).otherwise(F.col("delta")), 6).alias("delta"), r("p"))


#: Pair classes of a delta by the kinds of their members, and the stratified ones.
CLASSES = {"ab": ("a", "b"), "ad": ("a", "d")}
STRATIFIED = {"sb": ("as", "bs"), "sd": ("as", "d")}


def _cosines(n: int, seed: str, digits: int = 9):
    """The cosines of one pair class from its placed members with their vectors, as `sampling.cross_pairs` pairs them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        side, name = t.column("side").to_numpy(), t.column("run")[0].as_py()
        left, right = (t.filter(pa.array(side == k)) for k in (0, 1))
        p, q = left.num_rows, right.num_rows
        cos = np.zeros(0)
        if p and q:
            k = np.arange(min(n, p * q))
            if p * q <= n:
                x, y = k // q, k % q
            else:
                x, y = k % p, np.array([int(hashlib.md5(f"{seed}|{name}|{v}".encode()).hexdigest()[:8], 16) for v in range(n)]) % q
            met = left.column("key").to_numpy(zero_copy_only=False)[x] != right.column("key").to_numpy(zero_copy_only=False)[y]
            x, y = x[met], y[met]
            a, b = (vectors.matrix(s.column("vec")) for s in (left, right))
            cos = np.concatenate([np.einsum("ij,ij->i", a[x[s : s + 8192]], b[y[s : s + 8192]]) for s in range(0, len(x), 8192)] or [cos])
        return pa.table({"run": [name], "cos": pa.array([np.round(cos, digits).tobytes()], pa.binary())})

    return run


def _compared(names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        of = {k: np.sort(np.frombuffer(v, np.float64)) for k, v in zip(t.column("c").to_pylist(), t.column("cos").to_pylist())}
        out = {"run": [t.column("of")[0].as_py()]}
        for x, y, tag in zip(names[::2], names[1::2], ("", "_s")):
            a, b = of.get(x, np.zeros(0)), of.get(y, np.zeros(0))
            u = (np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).sum() / 2
            out |= {f"n_{x}": [len(a)], f"n_{y}": [len(b)], f"delta{tag}": [round(2 * float(u) / (len(a) * len(b)) - 1, 6) if len(a) and len(b) else None]}
        return pa.table(out, schema=pa.schema([("run", pa.string()), *((k, pa.float64() if k[0] == "d" else pa.int64()) for k in out if k != "run")]))

    return run


def deltas(members: DataFrame, vecs: DataFrame, key: str, n: int, seed: str, stratified: bool = False) -> DataFrame:
    """(run, n_ab, n_ad, delta) for many runs in one plan, from (run, kind, key) with kind 'a', 'b' or 'd'; `vecs` has (key, vec).

    delta compares cosines of A x B with A x D, n pairs of each at most; null if a class has no pair. `stratified` adds n_sb, n_sd and
    delta_s of kinds 'as' x 'bs' against 'as' x 'd'. A task holds one class of one run: at most 2n vectors, whatever the groups' sizes.
    Only members are shuffled, never pairs with their vectors.
    """
    classes = CLASSES | (STRATIFIED if stratified else {})
    tag = lambda c, side, kind: F.when(F.col("kind") == kind, F.struct(F.lit(c).alias("c"), F.lit(side).alias("side")))
    tags = F.array_compact(F.array(*[tag(c, side, kind) for c, pair in classes.items() for side, kind in enumerate(pair)]))
    both = members.select("run", key, F.explode(tags).alias("t")).select(F.concat_ws("/", F.col("run").cast("string"), "t.c").alias("run"), "t.side", key)
    at = first_places(both, key, n, seed, ["run", "side"]).join(vecs.select(key, "vec"), key)
    cos = at.select("run", "side", "place", F.col(key).alias("key"), "vec").groupBy("run").applyInArrow(_cosines(n, seed), "run string, cos binary")
    parts = cos.select(F.substring_index("run", "/", 1).alias("of"), F.substring_index("run", "/", -1).alias("c"), "cos").filter(F.length("cos") > 0)
    names = list(classes)
    schema = "run string" + "".join(f", n_{x} long, n_{y} long, delta{tag} double" for x, y, tag in zip(names[::2], names[1::2], ("", "_s")))
    return parts.groupBy("of").applyInArrow(_compared(names), schema)


def counted_table(counts: DataFrame, name: str, base: str, digits: int = 4) -> DataFrame:
    """`class_table` of a class x and its baseline y from (v, x, y): how many pairs of each have a cosine of v units of the last digit."""
    c = counts.withColumn("cos", F.col("v") / 10.0**digits)
    q = lambda k, label: c.filter(F.col(k) > 0).agg(F.lit(label).alias("class"), F.coalesce(F.sum(k), F.lit(0)).alias("n_pairs"), *[F.round(F.percentile("cos", p, F.col(k)), 6).alias(a) for a, p in (("median", 0.5), ("iqr_low", 0.25), ("iqr_high", 0.75))])
    d = rankstats.with_p(rankstats.of_counts(counts, [])).select(F.round("delta", 6).alias("d"), F.round("p", 6).alias("pv"))
    both = q("x", name).union(q("y", base)).filter("n_pairs > 0").join(d)
    return both.select("class", "n_pairs", "median", "iqr_low", "iqr_high", F.when(F.col("class") == base, 0.0).otherwise(F.col("d")).alias("delta"), F.when(F.col("class") == base, 1.0).otherwise(F.col("pv")).alias("p"))


def dossiers(rows: DataFrame, items: DataFrame, people: DataFrame, vecs: DataFrame, of: dict[str, tuple[list[str], list[str]]], key: str, n: int, seed: str) -> DataFrame:
    """One row per dossier (its items, its people): the probe of A, rows with any of the items, and B, rows that cite any of the people,
    against D, all rows in neither; how A spreads over `issue`; and which items and people occur at all, sorted.

    `rows` is (key, issue), `items` and `people` postings (key, item). Dossiers are few and broadcast.
    """
    spark = rows.sparkSession
    given = lambda k: F.broadcast(spark.createDataFrame([(name, x) for name, lists in of.items() for x in lists[k]], "run string, item string"))
    hit = lambda post, k: post.join(given(k), "item").select("run", key, "item")
    known = lambda post, k, name: hit(post, k).groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("item")), "|").alias(name))
    a, b = (cut(hit(post, k).select("run", key).distinct().join(rows, key), name) for post, k, name in ((items, 0, "dossier_a"), (people, 1, "dossier_b")))
    runs = F.explode(F.array(*map(F.lit, of))).alias("run")
    ab = a.select("run", key).union(b.select("run", key))
    rest = rows.select(runs, key).join(ab, ["run", key], "left_anti")
    members = a.select("run", F.lit("a").alias("kind"), key).union(b.select("run", F.lit("b").alias("kind"), key)).union(rest.select("run", F.lit("d").alias("kind"), key))
    spread = a.filter("issue IS NOT NULL").groupBy("run", "issue").agg(F.count("*").alias("k"))
    spread = spread.groupBy("run").agg(F.round(F.max("k") / F.sum("k"), 6).alias("dispersion"), F.max_by("issue", F.struct("k", "issue")).alias("dominant"))
    size = lambda df, name: df.groupBy("run").agg(F.count("*").alias(name))
    out = deltas(members, vecs, key, n, seed).join(size(a, "n_a"), "run").join(size(b, "n_b"), "run", "left").join(spread, "run")
    out = out.join(known(items, 0, "matched_vocab"), "run").join(known(people, 1, "matched_authors"), "run")
    return out.select(F.col("run").alias("dossier"), "n_a", F.coalesce("n_b", F.lit(0)).alias("n_b"), "n_ab", "n_ad", "delta", "dispersion", "dominant", "matched_vocab", "matched_authors")


def _summary(value: str) -> list[Column]:
    return [
        F.count(value).alias("n_runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"),
        F.round(F.percentile(value, 0.05), 6).alias("low"), F.round(F.percentile(value, 0.95), 6).alias("high"),
    ]


def null_summary(runs: DataFrame, value: str = "delta") -> DataFrame:
    """One row: mean, population sd, 5 % and 95 % quantiles of a null, the median of its absolute values and what that says."""
    m = F.percentile(F.abs(F.col(value)), 0.5)
    # fixed thresholds: a null this close to 0 passes, one this far from it fails
    return runs.agg(*_summary(value), F.round(m, 6).alias("median_abs"), F.when(m < 0.05, "passes").when(m > 0.10, "fails").otherwise("marginal").alias("verdict"))


def standing(runs: DataFrame, seen: float | None, value: str = "delta") -> DataFrame:
    """One row: a null's summary, the share of runs at least as high as `seen`, and whether `seen` lies above, within or below its middle 90 %."""
    s = F.lit(seen).cast("double")
    v = F.when(s > F.percentile(value, 0.95), "special").when(s < F.percentile(value, 0.05), "below null").otherwise("generic")
    return runs.agg(*_summary(value), F.round(F.avg((F.col(value) >= s).cast("double")), 6).alias("share_at_least"), v.alias("verdict"))


def dependence(variants: DataFrame, name: str, member: str) -> DataFrame:
    """(verdict): whether leave-one-out deltas stay high without `member` (robust), fall (dependent), or neither."""
    d, v = F.col("delta"), F.col(name)
    g = variants.agg(F.max(F.when(v == "full", d)).alias("f"), F.max(F.when(v == f"minus_{member}", d)).alias("m"), F.min(F.when(v.startswith("minus_"), d)).alias("low"))
    f, m = F.col("f"), F.col("m")
    # fixed thresholds
    robust = (m >= 0.33) & (F.abs(f - m) <= 0.10) & (F.col("low") >= 0.33)
    return g.select(F.when(robust, "robust").when((m < 0.30) | (f - m > 0.15), "dependent").otherwise("intermediate").alias("verdict"))


def coherence(delta: Column, rho: Column) -> list[Column]:
    """What a delta of shared-item pairs and a rank correlation say: strength, graded. Fixed thresholds."""
    strength = F.when(delta >= 0.33, "strong").when(delta >= 0.15, "modest").otherwise("none")
    return [strength.alias("strength"), F.when(rho >= 0.15, "tracks").when(rho >= 0.05, "weak").otherwise("none").alias("graded")]
