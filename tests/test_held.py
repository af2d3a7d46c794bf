"""Deltas over held rows: the same draws and pairs as those that are shuffled."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from scriptoria.functions import digests
from scriptoria.operators import evaluation, held, pairs, probe, resample


def test_digests_are_those_of_hashlib():
    keys = np.r_[0, -5, 7, np.arange(98, 103), 10**18, -(10**18)]
    for prefix in ("", "s|", "matched|12/ab|0|", "é|", "x" * 34, "x" * 54, "x" * 80):
        got = digests.first_bits(prefix, digests.decimals(keys)).tolist()
        assert got == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:16], 16) for k in keys]


def test_held_deltas_are_the_shuffled_ones_and_no_vector_is_shuffled(spark, monkeypatch):
    r = np.random.default_rng(0)
    size, runs = 150, 3
    v = r.normal(size=(size, 8)).astype(np.float32)
    own = lambda share: [[x for x in range(runs) if r.random() < share] for _ in range(size)]
    p, q = own(0.3), own(0.2)
    flag = lambda share: (r.random(size) < share).tolist()
    a, b, c = flag(0.3), flag(0.2), flag(0.1)
    rows = spark.createDataFrame([(k * 7, v[k].tolist(), a[k], b[k], c[k], p[k], q[k]) for k in range(size)], "key long, vec array<float>, in_a boolean, in_b boolean, in_c boolean, p array<int>, q array<int>").repartition(3)
    sets = {"one": ("p", "in_b"), "two": ("in_a", "q"), "both": ("p", "q")}
    unit = spark.createDataFrame([(k * 7, (v[k].astype(float) / np.linalg.norm(v[k].astype(float))).tolist()) for k in range(size)], "key long, vec array<double>")
    every = {x: F.when(F.col(x), F.sequence(F.lit(0), F.lit(runs - 1))).otherwise(F.array().cast("array<int>")) for x in ("in_a", "in_b")}
    for n, part in ((40, 64 << 20), (40, 1000), (10_000, 64 << 20)):
        monkeypatch.setattr(held, "PART", part)
        df = held.deltas(rows, sets, ["in_a", "in_b", "in_c"], "in_c", runs, n, "s")
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and "vec" not in df._jdf.queryExecution().analyzed().toString().split("Relation")[0]
        got = {(x["set"], x["run"]): tuple(x)[2:] for x in df.collect()}
        for name, (x, y) in sets.items():
            kinds = resample.kinds(rows, "key", every.get(x, F.col(x)), every.get(y, F.col(y)), F.col("in_c"), runs)
            assert {k[1]: z for k, z in got.items() if k[0] == name} == {z["run"]: tuple(z)[1:] for z in probe.deltas(kinds, unit, "key", n, "s").collect()}
    monkeypatch.setattr(held, "HELD", 100)
    assert held.deltas(rows, sets, ["in_a", "in_b", "in_c"], "in_c", runs, 5, "s") is None


def test_shuffled_sums_are_those_of_the_dealt_table(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(30, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    own = [sorted({f"l{x}" for x in r.integers(0, 6, size=k % 3 + 1)}) for k in range(30)]
    sets = [[f"s{x}" for x in r.integers(0, 8, size=k % 4)] for k in range(30)]
    rows = spark.createDataFrame([(k * 3, v[k].tolist(), sets[k], None, own[k]) for k in range(30)], "id long, vec array<double>, open array<string>, closed array<string>, l array<string>")
    ranks = evaluation.mid_ranks(pairs.label_counts(rows, "id", "l", chunk=7))
    of = lambda df: {(x["layer"], x["run"]): (x["total"], x["n"]) for x in df.collect()}
    want = of(pairs.permuted_sums(rows, "id", resample.permuted(rows, "id", "l", 5, "deal"), "l", ranks, 5))
    for chunk, held_bytes, tile in ((7, 60, 9), (100, 64 << 20, 32768)):
        monkeypatch.setattr(pairs, "TILE", tile)
        monkeypatch.setattr(pairs, "DEALT", held_bytes)
        assert of(pairs.shuffled_sums(rows, "id", "l", ranks, 5, "deal", chunk=chunk)) == want and len(want) == 15
    many = rows.withColumn("l", F.array(F.col("id").cast("string"), F.concat(F.lit("b"), "id"), F.concat(F.lit("c"), "id")))
    assert pairs.shuffled_sums(many, "id", "l", ranks, 5, "deal") is None
