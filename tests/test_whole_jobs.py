"""Operators do the whole job: nothing is cut that the question doesn't cut."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria import catalog
from scriptoria.functions import stats
from scriptoria.operators import evaluation, groups, pairs, postings, rankstats, resample, sampling
from scriptoria.sources import files

SMALL = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="session")
def labelled(spark, tmp_path_factory):
    """sf0.01 with labels on every fourth row."""
    d = tmp_path_factory.mktemp("labelled")
    for f in os.listdir(SMALL):
        if f != "paragraphs.parquet":
            os.symlink(f"{SMALL}/{f}", d / f)
    label = F.array(F.concat(F.lit("l"), (F.col("row_id") % 7).cast("string")))
    p = spark.read.parquet(f"{SMALL}/paragraphs.parquet")
    p.withColumn("ana_gold", F.when(F.col("row_id") % 4 == 0, label).otherwise(F.array().cast("array<string>"))).write.parquet(str(d / "paragraphs.parquet"))
    return str(d)


def test_shared_pairs_are_drawn_evenly(spark):
    """A posting of more rows than draws and many small ones: each item gets its share, and a pair of several shared items no more than others."""
    common = [(k, "common") for k in range(300)]  # 44,850 pairs
    twice = [(k, f"also{x}") for k in range(100) for x in range(4)]  # 4,950 of those share five items
    rare = [(k, f"rare{k // 2}") for k in range(1000, 3000)]  # 1,000 pairs
    post = spark.createDataFrame(common + twice + rare, "row_id long, item string")
    got, again = ([(r["i"], r["j"]) for r in sampling.shared_pairs(x, "row_id", "item", 1000, "s").collect()] for x in (post, post.repartition(7)))
    assert sorted(got) == sorted(again) and len(set(got)) == len(got) == 1000 and all(i < j for i, j in got)
    n_rare, n_twice = sum(i >= 1000 for i, _ in got), sum(j < 100 for _, j in got)
    assert 5 <= n_rare <= 45 and 75 <= n_twice <= 145  # 22 and 108 on average
    assert len({x for p in got for x in p if x < 300}) > 290
    few = spark.createDataFrame([(1, "p"), (2, "p"), (1, "q"), (2, "q"), (3, "q"), (4, "r")], "row_id long, item string")
    assert sorted(map(tuple, sampling.shared_pairs(few, "row_id", "item", 10, "s").collect())) == [(1, 2), (1, 3), (2, 3)]


def test_shared_item_pairs_of_a_split_item(spark, monkeypatch):
    post = spark.createDataFrame([(k, "all") for k in range(30)] + [(k, f"x{k % 3}") for k in range(30)], "id long, item string")
    want = {(i, j): 1 + ((j - i) % 3 == 0) for i in range(30) for j in range(i + 1, 30)}
    monkeypatch.setattr(postings, "ROWS", 7)
    got = {(r["i"], r["j"]): r["shared"] for r in postings.shared_item_pairs(post, "id").collect()}
    asked = {(r["i"], r["j"]): r["shared"] for r in postings.shared_item_pairs(post, "id", asks=F.col("i") % 10 == 0).collect()}
    assert got == want and asked == {p: n for p, n in want.items() if p[0] % 10 == 0 or p[1] % 10 == 0}


def test_rows_are_cut_before_they_are_shuffled(spark):
    """Ten times the members shuffle as many rows, and the places are those of the whole order."""
    kept = {}
    for size in (20_000, 200_000):
        members = spark.range(size).select(F.lit("r").alias("run"), F.lit(0).alias("side"), F.col("id").alias("k"))
        got = sampling.first_places(members, "k", 500, "s", ["run", "side"])
        order = sorted((hashlib.md5(f"s|r|0|{k}".encode()).hexdigest(), k) for k in range(size))
        assert {r["place"]: r["k"] for r in got.collect()} == {p: k for p, (_, k) in enumerate(order[:500], 1)}
        source = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in source
        bound = sampling._share_key((500 + 8 * 500**0.5 + 16) / size)
        kept[size] = sum(h < bound for h, _ in order)
    assert all(500 <= n <= 1000 for n in kept.values())


def test_a_short_cut_is_made_again(spark, monkeypatch):
    members = spark.range(4000).select(F.lit("r").alias("run"), F.col("id").alias("k"))
    whole = sorted(map(tuple, sampling.first_places(members, "k", 300, "s", ["run"]).collect()))
    monkeypatch.setattr(sampling, "_share_key", lambda share: "g" if share >= 1 else format(int(share / 4 * (1 << 52)), "013x"))
    assert sorted(map(tuple, sampling.first_places(members, "k", 300, "s", ["run"]).collect())) == whole and len(whole) == 300


def test_thresholds_hold_the_exact_ranks(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    for r in sampling.thresholds(rows, 3, [0, 1, 700, 5000, 9000], "s", "k").collect():
        order = sorted(hashlib.md5(f"s|{r['run']}|{k}".encode()).hexdigest() for k in range(5000))
        assert list(r)[1:] == ["", order[0], order[699], order[4999], "g"]


def _delta(cos, same):
    x, y = np.sort(cos[same]), np.sort(cos[~same])
    return (np.searchsorted(y, x, "left").sum() - (len(y) - np.searchsorted(y, x, "right")).sum()) / (len(x) * len(y))


@data
def test_label_recovery_takes_all_labelled_rows(spark, labelled, monkeypatch):
    g = catalog._labelled(spark, labelled).select("row_id", "vec", "labels").collect()
    v, own = np.array([r["vec"] for r in g]), np.array([r["labels"][0] for r in g])
    i, j = np.triu_indices(len(g), 1)
    same = own[i] == own[j]
    seen = {r["layer"]: r for r in catalog.queries()["label_recovery__R8_J6_J12"](spark, labelled).collect()}
    assert set(seen) == {"E", "C-open", "C-closed"} and len(g) > 450 and {(r["n_x"], r["n_y"]) for r in seen.values()} == {(same.sum(), (~same).sum())}
    assert seen["E"]["delta"] == pytest.approx(_delta(np.round((v @ v.T)[i, j], 4), same), abs=2e-6)
    monkeypatch.setattr(catalog, "N_PERM", 20)
    null = {r["layer"]: r for r in catalog.queries()["permutation_null__R8_T16"](spark, labelled).collect()}
    assert set(null) == set(seen) and all(r["n_runs"] == 20 and abs(r["null_mean"]) < 0.1 and r["delta"] == seen[k]["delta"] for k, r in null.items())


def test_label_counts_and_permutations_of_several_chunks(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(30, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    own = [sorted({f"l{x}" for x in r.integers(0, 6, size=k % 3 + 1)}) for k in range(30)]
    sets = [[f"s{x}" for x in r.integers(0, 8, size=k % 4)] for k in range(30)]
    rows = spark.createDataFrame([(k, v[k].tolist(), sets[k], None, own[k]) for k in range(30)], "id long, vec array<double>, open array<string>, closed array<string>, l array<string>")
    runs = 5
    deals = spark.createDataFrame([(run, k, own[(k + run) % 30]) for run in range(runs) for k in range(30)], "run int, id long, l array<string>")

    def value(layer, i, j):
        a, b = set(sets[i]), set(sets[j])
        return {"E": round(float(v[i] @ v[j]) * 10000), "C-open": int(10000 * len(a & b) / len(a | b) + 0.5) if a | b else 0, "C-closed": 0}[layer]

    pairs_of = [(i, j) for i in range(30) for j in range(i)]
    for chunk, at_once in ((7, 2), (100, 128)):
        counts = pairs.label_counts(rows, "id", "l", chunk=chunk)
        want = {}
        for layer in ("E", "C-open", "C-closed"):
            for i, j in pairs_of:
                k = (layer, value(layer, i, j), bool(set(own[i]) & set(own[j])))
                want[k] = want.get(k, 0) + 1
        assert {(x["layer"], x["v"], same): x[c] for x in counts.collect() for c, same in (("x", True), ("y", False)) if x[c]} == want
        pairs.AT_ONCE, kept = at_once, pairs.AT_ONCE
        mid = {(x["layer"], x["v"]): x["mid"] for x in evaluation.mid_ranks(counts).collect()}
        got = {(x["layer"], x["run"]): (x["total"], x["n"]) for x in pairs.permuted_sums(rows, "id", deals, "l", evaluation.mid_ranks(counts), runs, chunk=chunk).collect()}
        pairs.AT_ONCE = kept
        for layer in ("E", "C-open", "C-closed"):
            for run in range(runs):
                met = [mid[layer, value(layer, i, j)] for i, j in pairs_of if set(own[(i + run) % 30]) & set(own[(j + run) % 30])]
                assert got[layer, run] == (sum(met), len(met))


@data
def test_no_label_of_the_inventory_is_dropped(spark):
    got = {r["row_id"]: r["labels"] for r in catalog.queries()["valid_labels__P25"](spark, SMALL).collect()}
    p = spark.read.parquet(f"{SMALL}/paragraphs.parquet").filter(F.size("ana_gold") > 0).select("row_id", "ana_gold").collect()
    assert got == {r["row_id"]: ";".join(r["ana_gold"]) for r in p} and len({x for v in got.values() for x in v.split(";")}) == 16


@data
def test_null_groups_are_as_large_as_the_real_ones(spark):
    g, _vec = catalog._with_vectors(spark, SMALL, catalog._grouped(spark, SMALL))
    n = groups.sizes(g).first()
    labels = resample.shuffled_labels(g, "row_id", n["n_a"], n["n_b"], 6, "shuffle")
    got = {(r["run"], r["kind"]): (r["n"], r["m"]) for r in labels.groupBy("run", "kind").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("m")).collect()}
    size = {"a": n["n_a"], "b": n["n_b"], "d": n["n"] - n["n_a"] - n["n_b"]}
    assert size["a"] > 200 and size["b"] > 100 and got == {(run, k): (m, m) for run in range(6) for k, m in size.items()}


def test_rank_correlation_and_its_p(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 7.0), (5.0, 7.0), (None, 1.0)], "x double, y double")
    got = rankstats.spearman(df, "x", "y").first()
    x, y = np.array([1, 2, 3, 4, 5.5, 5.5]), np.array([2, 1, 4, 3, 5.5, 5.5])
    rho = np.corrcoef(x, y)[0, 1]
    t = rho * math.sqrt(4 / (1 - rho * rho))
    w = t * t / (1 + t * t / 4)  # Student's law of 4 degrees of freedom in closed form
    assert (got["n"], got["rho"]) == (6, pytest.approx(rho)) and got["p"] == pytest.approx(1 - 0.75 * math.sqrt(w) * (1 - w / 12))
    assert stats.student(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and stats.student(1.0, 1) == pytest.approx(0.5)


def test_fingerprint_is_the_digest_of_the_joined_texts(spark, monkeypatch):
    texts = [(k, None if k == 3 else f"text {k}\nñ") for k in range(20)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(5)
    joined = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    assert tuple(files.fingerprint(df, "id", "text").first()) == (20, joined(["\x00" if t is None else t for _, t in texts]))
    monkeypatch.setattr(files, "FAN", 4)
    leaves = [joined(["\x00" if t is None else t for _, t in texts[k : k + 4]]) for k in range(0, 20, 4)]
    assert tuple(files.fingerprint(df, "id", "text").first()) == (20, joined([joined(leaves[:4]), joined(leaves[4:])]))
    assert files.fingerprint(df.filter("id < 0"), "id", "text").count() == 0


def test_fisher_at_the_expectation_and_in_the_tail():
    n = 10**9
    row = col = n // 10
    a = row * col // n
    assert stats.fisher(a, row - a, col - a, n - row - col + a) == 1.0
    for off in (1000, 15811):
        p = stats.fisher(a + off, row - a - off, col - a - off, n - row - col + a + off)
        sd = (n * 0.1 * 0.1 * 0.9 * 0.9) ** 0.5
        assert p == pytest.approx(math.erfc((off - 0.5) / sd / math.sqrt(2)), rel=0.02)
    for t in ((3, 1, 2, 9), (0, 10, 5, 5), (12, 5, 7, 40), (50, 0, 0, 50)):
        r, c, m = t[0] + t[1], t[0] + t[2], sum(t)
        law = [math.comb(r, k) * math.comb(m - r, c - k) for k in range(max(0, r + c - m), min(r, c) + 1)]
        seen = math.comb(r, t[0]) * math.comb(m - r, c - t[0])
        assert stats.fisher(*t) == pytest.approx(sum(x for x in law if x <= seen * (1 + 1e-9)) / math.comb(m, c), rel=1e-12)
    x = np.linspace(0, 26, 500)
    assert stats.erfc(x) == pytest.approx(np.array([math.erfc(v) for v in x]), rel=1e-12)
