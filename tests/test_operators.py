import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import assoc, evaluation, figures, groups, inference, pairs, postings, probe, ranking, rankstats, resample, sampling, vectors


def samples(spark, x, y):
    return spark.createDataFrame([(float(v), True) for v in x] + [(float(v), False) for v in y] + [(None, True)], "v double, s boolean")


def brute_delta(x, y):
    return sum((a > b) - (a < b) for a in x for b in y) / (len(x) * len(y))


def test_delta(spark):
    r = random.Random(5)
    x, y = [r.randint(0, 9) for _ in range(60)], [r.randint(2, 12) for _ in range(45)]
    got = rankstats.two_samples(samples(spark, x, y), "v", F.col("s")).first()
    back = rankstats.two_samples(samples(spark, y, x), "v", F.col("s")).first()
    assert got["delta"] == pytest.approx(brute_delta(x, y)) and back["delta"] == pytest.approx(-got["delta"])
    assert got["u"] == sum((a > b) + 0.5 * (a == b) for a in x for b in y) and (got["n_x"], got["n_y"]) == (60, 45)
    n = 105
    ties = sum(k**3 - k for k in np.unique(x + y, return_counts=True)[1])
    sd = math.sqrt(60 * 45 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got["z"] == pytest.approx((max(got["u"], 60 * 45 - got["u"]) - 60 * 45 / 2 - 0.5) / sd)
    assert rankstats.two_samples(samples(spark, x, x), "v", F.col("s")).first()["delta"] == 0
    assert rankstats.two_samples(samples(spark, x, []), "v", F.col("s")).first()["delta"] is None
    p = rankstats.with_p(rankstats.two_samples(samples(spark, x, y), "v", F.col("s"))).first()["p"]
    assert p == pytest.approx(math.erfc(got["z"] / math.sqrt(2)))


def test_spearman(spark):
    r = random.Random(6)
    xs = [(float(r.randint(0, 5)), float(r.randint(0, 5))) for _ in range(80)]

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    want = np.corrcoef(ranks([a for a, _ in xs]), ranks([b for _, b in xs]))[0, 1]
    assert rankstats.spearman(spark.createDataFrame(xs, "x double, y double"), "x", "y").first()["rho"] == pytest.approx(want)
    assert rankstats.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()["rho"] is None


def test_association(spark):
    items = spark.createDataFrame([(k, "a") for k in range(12)] + [(k, "b") for k in range(8, 20)] + [(1, "rare")], "row_id long, item string")
    grp = spark.createDataFrame([(k, "g") for k in range(10)], "row_id long, g string")
    got = {r["item"]: r for r in assoc.tested(assoc.cells(items, grp, "row_id", 40, "item", "g", 10, 5, 2)).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["a"], got["b"]["a"], got["a"]["n_group"], got["a"]["n_item"]) == (10, 2, 10, 12)
    assert got["a"]["log_odds"] == pytest.approx(round(math.log(10.5 * 28.5 / (0.5 * 2.5)), 3)) and got["a"]["significant"] and not got["b"]["significant"]
    assert assoc.tested(assoc.cells(items.limit(0), grp, "row_id", 40, "item", "g")).count() == 0


def test_trend(spark):
    rows = spark.createDataFrame([(k, f"i{k // 20}") for k in range(60)], "row_id long, issue string")
    items = spark.createDataFrame([(k, "flat") for k in range(60)] + [(k, "up") for k in [1, 21, 22, 23, 24, *range(41, 52)]], "row_id long, item string")
    got = {r["item"]: r for r in assoc.trends(items, rows, "row_id", ["i0", "i1", "i2"], "item", "issue", 1).collect()}
    assert (got["flat"]["direction"], got["flat"]["z"], got["flat"]["p"]) == ("flat", 0, 1) and got["up"]["direction"] == "rising"
    a, n, t = [1, 4, 11], [20] * 3, [1, 2, 3]
    p = 16 / 60
    z = sum(x * (k - 2) for x, k in zip(a, t)) / math.sqrt(p * (1 - p) * sum(m * (k - 2) ** 2 for m, k in zip(n, t)))
    assert got["up"]["z"] == pytest.approx(round(z, 3)) and got["up"]["share_3"] == 0.55


def test_cross_pairs(spark):
    members = spark.createDataFrame([("r", 0, k) for k in range(5)] + [("r", 1, k) for k in range(3, 7)] + [("alone", 0, 1)], "run string, side int, id long")
    got = {(r["i"], r["j"]) for r in sampling.cross_pairs(members, "id", 100, "s").collect()}
    assert got == {(i, j) for i in range(5) for j in range(3, 7) if i != j}
    many = spark.createDataFrame([("r", s, k) for s in (0, 1) for k in range(300)], "run string, side int, id long")
    a, b = (sorted(map(tuple, sampling.cross_pairs(x, "id", 500, "s").collect())) for x in (many, many.repartition(7)))
    assert a == b and 480 <= len(a) <= 500 and all(i != j for _, i, j in a)
    few = {(r["i"], r["j"]) for r in sampling.within_pairs(members.filter("side = 0 AND run = 'r'"), "id", 50, "s").collect()}
    assert few == {(i, j) for i in range(5) for j in range(i + 1, 5)}


def test_choose_and_fill(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert sorted(map(tuple, sampling.choose(df, 7, "s", "k").collect())) == sorted(map(tuple, sampling.choose(df.repartition(3), 7, "s", "k").collect()))
    got = sampling.keep_and_fill(df, F.col("k") < 10, 15, "s", "k")
    assert got.count() == 15 and got.filter("k < 10").count() == 10 and sampling.keep_and_fill(df, F.col("k") < 10, 5, "s", "k").count() == 10


def test_resampling(spark):
    rows = spark.range(40).withColumnRenamed("id", "k")
    lab = resample.shuffled_labels(rows, "k", 5, 3, 4, "s").collect()
    for run in range(4):
        own = [r for r in lab if r["run"] == run]
        assert len({r["k"] for r in own}) == 40 and [sum(r["kind"] == x for r in own) for x in "abd"] == [5, 3, 32]
    pool = spark.createDataFrame([("p", 10), ("q", 19), ("r", 100)], "item string, n long")
    t = spark.createDataFrame([("x", 10), ("y", 1000)], "target string, n long")
    assert sorted(map(tuple, resample.matched_pools(t, pool, nearest=1).collect())) == [("x", "p"), ("x", "q"), ("y", "r")]
    assert resample.matched_pools(t, pool, nearest=0).filter("target = 'y'").count() == 3
    draws = resample.drawn(resample.matched_pools(t, pool, nearest=2), 6, "s")
    assert draws.count() == 12 and draws.filter("target = 'x'").select("item").distinct().count() == 2
    deal = resample.permuted(rows.withColumn("v", F.col("k") * 2), "k", "v", 3, "s")
    assert all(sorted(r["v"] for r in deal.filter(F.col("run") == k).collect()) == [2 * x for x in range(40)] for k in range(3))


def test_probe_of_known_groups(spark):
    r = np.random.default_rng(0)
    centre = r.normal(size=8)
    vs = [(k, "a" if k < 20 else "b" if k < 40 else "d", (r.normal(size=8) + (3 * centre if k < 40 else 0))) for k in range(100)]
    vec = spark.createDataFrame([(k, (v / np.linalg.norm(v)).tolist()) for k, _, v in vs], "id long, vec array<double>")
    members = spark.createDataFrame([("run", kind, k) for k, kind, _ in vs], "run string, kind string, id long")
    got = probe.deltas(members, vec, "id", 5000, "s").first()
    u = {k: v / np.linalg.norm(v) for k, _, v in vs}
    ab = [round(float(u[i] @ u[j]), 9) for i in range(20) for j in range(20, 40)]
    ad = [round(float(u[i] @ u[j]), 9) for i in range(20) for j in range(40, 100)]
    assert got["delta"] == pytest.approx(brute_delta(ab, ad), abs=1e-6) and got["delta"] > 0.9
    same = probe.deltas(members.filter("kind <> 'd'").union(members.filter("kind = 'b'").withColumn("kind", F.lit("d"))), vec, "id", 5000, "s").first()
    assert same["delta"] == 0


def test_mean_cross_cosine(spark):
    m = np.random.default_rng(1).normal(size=(12, 4))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id long, vec array<double>")
    got = vectors.mean_cross_cosine(df.filter("id < 5"), df.filter("id >= 3")).first()
    assert got["mean_cos"] == pytest.approx((m[:5] @ m[3:].T).mean()) and (got["n_a"], got["n_b"]) == (5, 9)
    assert spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_scores(spark):
    df = spark.createDataFrame([(["x", "y"], ["y", "z", "y"]), ([], []), ([], ["q"]), (None, ["q"])], "g array<string>, p array<string>")
    got = evaluation.micro(evaluation.matches(df.filter("g IS NOT NULL"), F.col("g"), F.col("p"))).first()
    assert tuple(got) == (1, 2, 1, 0.333, 0.5, 0.4)
    with pytest.raises(ValueError):
        evaluation.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    with pytest.raises(ValueError):
        evaluation.require_known(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b",)], "k string"), "k")


def test_tfidf(spark):
    bags = {0: ["a", "a", "b"], 1: ["b"], 2: [], 3: ["c", "b"]}
    df = spark.createDataFrame(list(bags.items()), "k long, items array<string>")
    got = {r["item"]: r for r in ranking.ranked(ranking.tfidf_scores(ranking.bag_counts(df, "k", "items"), "k", 4)).collect()}
    dfs = {"a": 1, "b": 3, "c": 1}
    want = dict.fromkeys(dfs, 0.0)
    for b in bags.values():
        w = {t: b.count(t) * (math.log(5 / (1 + dfs[t])) + 1) for t in set(b)}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        for t, x in w.items():
            want[t] += x / norm
    assert {t: r["score"] for t, r in got.items()} == {t: round(x, 6) for t, x in want.items()}
    assert [t for t, _ in sorted(got.items(), key=lambda kv: kv[1]["rank"])] == sorted(want, key=lambda t: (-round(want[t], 6), t))


def test_postings(spark, rows):
    df = spark.createDataFrame([(1, ["a", "a", None]), (2, ["a", "b"]), (3, None), (4, ["b", "a"])], "k long, x array<string>")
    p = postings.postings(df, "k", "x")
    assert rows(p) == [(1, "a"), (2, "a"), (2, "b"), (4, "a"), (4, "b")]
    assert rows(postings.shared_item_pairs(p, "k")) == [(1, 2, 1), (1, 4, 1), (2, 4, 2)]
    assert rows(postings.frequent(p, 3)[0].select("k")) == [(1,), (2,), (4,)]
    assert rows(groups.leave_one_out(p, ["a", "b"], "k")) == sorted([("full", 1), ("full", 2), ("full", 4), ("minus_a", 2), ("minus_a", 4), ("minus_b", 1), ("minus_b", 2), ("minus_b", 4), ("only_a", 1), ("only_a", 2), ("only_a", 4), ("only_b", 2), ("only_b", 4)])


def test_pair_blocks(spark, rows):
    r = np.random.default_rng(2)
    n = 60
    data = []
    for k in range(n):
        v = r.normal(size=4)
        data.append((k, f"t{k % 7}", (v / np.linalg.norm(v)).tolist(), sorted({str(x) for x in r.integers(0, 9, r.integers(0, 5))}) or None, [str(x) for x in r.integers(0, 4, 2)]))
    df = spark.createDataFrame(data, "row_id long, text_id string, vec array<double>, lemmas array<string>, persons array<string>")
    got = {(x["i"], x["j"]): x for x in pairs.blocked(df, F.col("row_id") % 5 == 0, lambda b: pairs._picked(b, b.eligible()), pairs.PAIR, queries=5, chunk=16).collect()}
    want = {}
    for i, ti, vi, li, pi in data:
        for j, tj, vj, lj, pj in data:
            if i % 5 == 0 and i != j and ti != tj and abs(i - j) > 1 and li and lj and not (j % 5 == 0 and j < i):
                want[i, j] = (round(float(np.dot(vi, vj)), 6), len({*li} & {*lj}), round(len({*li} & {*lj}) / len({*li} | {*lj}), 6), len({*pi} & {*pj}))
    assert {k: (round(x["e_cos"], 6), x["shared_lemmas"], round(x["c_jaccard"], 6), x["h_shared"]) for k, x in got.items()} == want
    assert pairs.hotspots(df, F.col("row_id") % 5 == 0, k=3, least_shared=2).count() == 6
    assert pairs.scale(df.limit(0), F.lit(True)).first()["n_eligible"] == 0
    hood = pairs.neighbourhoods(df, F.col("row_id") % 5 == 0, 4).collect()
    assert hood and all(0 <= x["neigh_jaccard"] <= 1 for x in hood)


def test_figures(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (None,)], "v double")
    assert rows(figures.histogram(df, "v", 0, 1, 2)) == [(1, 1), (2, 2)]
    assert rows(figures.grid(df.withColumn("w", F.col("v")), "v", "w", (0, 1), (0, 1), 2)) == [(1, 1, 1), (2, 2, 2)]


def test_inference_asks_only_for_what_is_missing(spark, rows):
    df = spark.createDataFrame([(1, "uno"), (2, "dos"), (3, "uno")], "k long, t string")
    keyed = inference.with_keys(df, "t", "m", "open")
    cache = keyed.filter("t = 'dos'").select("key", F.lit("old").alias("answer"))
    asked = inference.missing(keyed, cache)
    assert rows(inference.answered(asked, "t", lambda: lambda ts: [t.upper() for t in ts]).select("answer")) == [("UNO",)]
    assert rows(inference.lemmatised(spark.createDataFrame([(1, ["La Casa Roja", "casa de Ana"]), (2, None)], "k long, t array<string>"), "k", "t", None, ["la", "de"], ["ana"])) == [(1, ("casa", "roja")), (2, ())]
