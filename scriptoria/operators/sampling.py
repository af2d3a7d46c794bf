"""Samples and pairs drawn by keyed hashes: no sequential random stream, so order and partitioning can't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.functions.ranks import numbered
from scriptoria.functions.text import keyed, keyed_int
from scriptoria.operators.postings import shared_item_pairs
from scriptoria.plans.lineage import cut

#: Of shared pairs: up to so many times n (row pairs, item) all are listed; at most so many times n draws are made.
LISTED, DRAWS = 50, 64


def choose(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows without replacement, those of the smallest keyed hash (all if there are fewer)."""
    return df.orderBy(keyed(seed, F.col(key)), key).limit(n)


def keep_and_fill(df: DataFrame, keep, cap: int, seed: str, key: str) -> DataFrame:
    """All rows of `keep`, filled by chosen others up to `cap` rows (all of `keep` if that is more)."""
    sure = df.filter(keep)
    more = max(0, cap - sure.count())
    return sure.union(choose(df.filter(~F.coalesce(keep, F.lit(False))), more, seed, key))


def _share_key(share: float) -> str:
    """The smallest key that about `share` of all keys don't reach."""
    return "g" if share >= 1 else format(int(share * (1 << 52)), "013x")


def first_places(members: DataFrame, key: str, n: int, seed: str, by: list[str]) -> DataFrame:
    """(by, key, place): places 1..n of each group of `by` in the order of its rows' keyed hashes.

    Rows are cut before they are shuffled: a count per group gives the share of hashes that holds its first n, with a margin
    of eight deviations; rows beyond it are dropped where they are read. A group that comes out short, which is next to
    impossible, is cut again at a doubled share, so the first n are always exact. No task sorts more than about n rows of a
    group. There is one count and one bound per group; groups are runs and sides, given by the caller, not by the data.
    """
    spark = members.sparkSession
    h = keyed(seed, *[F.col(c) for c in by], F.col(key))
    size = {tuple(r)[:-1]: r["c"] for r in members.groupBy(*by).agg(F.count("*").alias("c")).collect()}
    share = {g: (n + 8 * n**0.5 + 16) / c if c > n else 1.0 for g, c in size.items()}
    kind = ", ".join(f"{c} {t}" for c, t in members.select(*by).dtypes)
    while True:
        bound = spark.createDataFrame([(*g, _share_key(s)) for g, s in share.items()], f"{kind}, bound string")
        kept = members.select(*by, key).withColumn("h", h).join(F.broadcast(bound), by).filter(F.col("h") < F.col("bound")).drop("bound")
        if all(s >= 1 for s in share.values()):
            break
        kept = cut(kept, "kept")
        got = {tuple(r)[:-1]: r["c"] for r in kept.groupBy(*by).agg(F.count("*").alias("c")).collect()}
        short = [g for g, c in size.items() if got.get(g, 0) < min(n, c)]
        if not short:
            break
        share |= {g: 2 * share[g] for g in short}
    w = W.partitionBy(*by).orderBy("h", key)
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("h")


def order_of_runs(rows: DataFrame, runs: int, seed: str, key: str, first: int) -> DataFrame:
    """(run, key, place): for each run the `first` places of a shuffle of all rows, which are cut before anything is shuffled."""
    return first_places(of_all_runs(rows.select(key), runs), key, first, seed, ["run"])


def of_all_runs(rows: DataFrame, runs: int) -> DataFrame:
    return rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def thresholds(rows: DataFrame, runs: int, ranks: list[int], seed: str, key: str) -> DataFrame:
    """(run, t_0, t_1, ..): the keyed hash of the row at each rank of each run's shuffle of all rows; '' for rank 0, 'g' beyond the last.

    So a row is among the first r of a run if its hash isn't above t: membership of any size without a shuffle. A hash that has rank r of
    n lies near r / n of all hashes; those below that window are counted, and only the window (about 16 standard deviations,
    of the order of the root of n rows a run) is sorted. A rank outside its window, which is next to impossible, widens it.
    """
    spark, n = rows.sparkSession, rows.count()
    out = {run: ["" if r <= 0 else "g" for r in ranks] for run in range(runs)}
    spread = of_all_runs(rows.select(key), runs).withColumn("h", keyed(seed, F.col("run"), F.col(key)))
    for at, rank in enumerate(ranks):
        if not 0 < rank <= n:
            continue
        q, wide = rank / n, 8.0
        while True:
            off = wide * (q * (1 - q) / n) ** 0.5 + wide * wide / n
            low, high = ("" if q - off <= 0 else _share_key(q - off)), _share_key(q + off)
            near = cut(spread.filter(F.col("h") < high).groupBy("run").agg(F.count_if(F.col("h") < low).alias("below")), "below")
            placed = spread.filter((F.col("h") >= low) & (F.col("h") < high)).withColumn("p", F.row_number().over(W.partitionBy("run").orderBy("h")))
            found = placed.join(F.broadcast(near), "run").filter(F.col("p") + F.col("below") == rank).select("run", "h").collect()  # one row a run
            if len(found) == runs:
                break
            wide *= 4
        for r in found:
            out[r["run"]][at] = r["h"]
    return spark.createDataFrame([(run, *t) for run, t in out.items()], "run int" + "".join(f", t_{k} string" for k in range(len(ranks))))


def cross_pairs(members: DataFrame, key: str, n: int, seed: str, run: str = "run") -> DataFrame:
    """(run, i, j): pairs of a left (side 0) and a right (side 1) member of each run, without self-pairs.

    All pairs if there are at most n, else n draws, repeats possible: left and right members in keyed order meet by number. Both
    sides are cut to about n rows before the shuffle, so a pair class costs n rows however large its groups are.
    """
    placed = first_places(members, key, n, seed, [run, "side"]).withColumn("place", F.col("place") - 1)
    placed = cut(placed, "places")  # at most n rows of each side, read three times
    size = placed.groupBy(run).agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r")).filter("l > 0 AND r > 0")
    k = F.col("k")
    count = F.least(F.col("l") * F.col("r"), F.lit(n))
    at = size.withColumn("exact", F.col("l") * F.col("r") <= n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    pairs = at.select(
        run, F.when(F.col("exact"), F.floor(k / F.col("r"))).otherwise(F.pmod(k, F.col("l"))).cast("int").alias("x"),
        F.when(F.col("exact"), F.pmod(k, F.col("r"))).otherwise(F.pmod(keyed_int(seed, F.col(run), k), F.col("r"))).cast("int").alias("y"),
    )
    left = placed.filter("side = 0").select(run, F.col("place").alias("x"), F.col(key).alias("i"))
    right = placed.filter("side = 1").select(run, F.col("place").alias("y"), F.col(key).alias("j"))
    return pairs.join(left, [run, "x"]).join(right, [run, "y"]).filter("i <> j").select(run, "i", "j")


def within_pairs(members: DataFrame, key: str, n: int, seed: str, run: str = "run") -> DataFrame:
    """(run, i, j), i < j: different pairs within each run's members, all if there are at most n, else those of 2n draws."""
    both = members.select(run, key, F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    # all ordered pairs are twice the unordered ones
    return cross_pairs(both, key, 2 * n, seed, run).select(run, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def _unit(seed: str, *parts) -> Column:
    """`keyed` as a number of 52 bits from 0 to below 1."""
    return F.conv(F.substring(keyed(seed, *parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def shared_pairs(post: DataFrame, key: str, name: str, n: int, seed: str) -> DataFrame:
    """(i, j), i < j: n different pairs of rows that share an item, each such pair as likely as any other; all if there are fewer.

    `post` is (key, name), each once. An item gets its share of the draws, which is that of the pairs of its rows (a fraction is rounded
    up as often as it is large), and both members come from its whole posting. A pair that shares m items has m ways to be drawn, so one
    in m of its draws counts. Draws are doubled until n pairs are found or DRAWS x n are made; where there are few pairs all are listed.
    """
    placed = cut(numbered(post.select(key, name), F.col(name), F.col(key), name="at"), "placed")
    size = cut(placed.groupBy(name).agg(F.count("*").alias("c"), F.min("at").cast("long").alias("first")).filter("c > 1"), "sizes")
    c = F.col("c")
    own = c.cast("double") * (c - 1) / 2
    ways = size.agg(F.sum(own)).first()[0] or 0
    if ways <= LISTED * n:
        return shared_item_pairs(placed.select(key, name), key, name).select("i", "j").orderBy(keyed(seed, F.col("i"), F.col("j")), "i", "j").limit(n)
    row = lambda at, of: placed.select(F.col("at").cast("long").alias(at), F.col(key).alias(of))
    found, made, turn = None, 0, 0
    while made < DRAWS * n and (found is None or found.count() < n):
        now = min(max(2 * n, made), DRAWS * n - made)
        u = lambda kind, *k, t=turn: _unit(f"{seed}|{kind}|{t}", F.col(name), *k)
        k = F.col("k")
        drawn = size.withColumn("q", F.floor(own * (now / ways) + u("share"))).filter("q > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
        drawn = drawn.withColumn("x", F.floor(u("x", k) * c)).withColumn("y", F.floor(u("y", k) * (c - 1)))
        drawn = drawn.select(
            (F.col("first") + F.col("x")).alias("x"), (F.col("first") + F.col("y") + F.when(F.col("y") >= F.col("x"), 1).otherwise(0)).alias("y"),
            u("luck", k).alias("luck"), F.struct(F.lit(turn).alias("turn"), u("order", k).alias("u")).alias("order"),
        )
        drawn = drawn.join(row("x", "a"), "x").join(row("y", "b"), "y")
        drawn = cut(drawn.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "luck", "order"), "draws")
        of = placed.join(drawn.select(F.explode(F.array("i", "j")).alias(key)).distinct(), key, "left_semi").groupBy(key).agg(F.collect_set(name).alias("items"))
        both = drawn.join(of.select(F.col(key).alias("i"), F.col("items").alias("p")), "i").join(of.select(F.col(key).alias("j"), F.col("items").alias("q")), "j")
        new = both.filter(F.col("luck") * F.size(F.array_intersect("p", "q")) < 1).select("i", "j", "order")
        found = cut((new if found is None else found.union(new)).groupBy("i", "j").agg(F.min("order").alias("order")), "found")
        made, turn = made + now, turn + 1
    return found.orderBy("order", "i", "j").limit(n).select("i", "j")
