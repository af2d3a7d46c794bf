import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import vector_blocks, vector_clusters, vector_neighbours


def cloud(seed, groups=6, each=25, alone=40, width=64, spread=0.35):
    r = np.random.default_rng(seed)
    out = [c + spread * r.normal(size=width) * np.linalg.norm(c) / np.sqrt(width) for c in r.normal(size=(groups, width)) for _ in range(each)]
    out += list(r.normal(size=(alone, width)))
    out += [out[0] * 3, out[1] * 1e-20, out[2]]  # other lengths and a copy
    return [v.astype(np.float32) for v in out]


def frame(spark, vs):
    data = [(100 + 7 * k, v.tolist(), "clash") for k, v in enumerate(vs)]
    bad = [(1, None), (2, [0.0] * 64), (3, [float("nan")] + [1.0] * 63), (4, [1.0] * 32), (5, [])]
    return spark.createDataFrame(data + [(k, v, "clash") for k, v in bad], "vec_id long, e array<float>, id string")


def unit(vs):
    m = np.stack(vs).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def components(vs, threshold):
    s = unit(vs) @ unit(vs).T >= threshold
    lab = np.arange(len(vs))
    while True:
        new = np.array([lab[s[k]].min() for k in range(len(vs))])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("block, centres", [(65536, 2048), (16, 2048), (16, 2), (16, 0)])
def test_clusters(spark, monkeypatch, block, centres):
    monkeypatch.setattr(vector_blocks.tiled, "__defaults__", (block, block))
    monkeypatch.setattr(vector_blocks, "CENTRES", centres)
    monkeypatch.setattr(vector_clusters, "PIECE", 8)
    vs = cloud(1)
    lab = components(vs, 0.85)
    size = collections.Counter(lab)
    want = {(100 + 7 * k, 100 + 7 * int(c)) for k, c in enumerate(lab) if size[c] >= 8}
    got = [tuple(r) for r in vector_clusters.clusters(frame(spark, vs), "vec_id", "e").select("id", "cluster_key").collect()]
    assert set(got) == want and len(got) == len(want) and len({c for _, c in want}) >= 5


def test_chain_of_links(spark, monkeypatch):
    """A long thin cluster: many peaks, linked in a row, across blocks."""
    monkeypatch.setattr(vector_blocks.tiled, "__defaults__", (8, 8))
    angle = np.arccos(0.85) * 0.95
    vs = [np.r_[np.cos(k * angle / 3), np.sin(k * angle / 3), np.zeros(62)].astype(np.float32) for k in range(20)]
    got = [tuple(r) for r in vector_clusters.clusters(frame(spark, vs), "vec_id", "e").select("id", "cluster_key").collect()]
    assert sorted(got) == [(100 + 7 * k, 100) for k in range(20)]


def test_no_vectors(spark):
    assert vector_clusters.clusters(frame(spark, []), "vec_id", "e").count() == 0
    assert vector_neighbours.neighbours(frame(spark, []), "vec_id", "e", 3, 0.9).count() == 0


def test_density_counts_links(spark):
    vs = cloud(2, 3, 12, 5)
    deg = (unit(vs) @ unit(vs).T >= 0.85).sum(1) - 1
    got = {r["id"]: r["density"] for r in vector_clusters.clusters(frame(spark, vs), "vec_id", "e", least=2).collect()}
    assert got == {100 + 7 * k: int(n) for k, n in enumerate(deg) if n}


def best(vs, k, floor=-2):
    u = unit(vs)
    s = np.round((u[:, None, :] * u[None, :, :]).sum(2), 12)
    np.fill_diagonal(s, -3)
    return {100 + 7 * i: {100 + 7 * int(j) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= floor} for i in range(len(vs))}


@pytest.mark.parametrize("block, floor", [(65536, None), (16, None), (16, 0.9), (65536, 0.9)])
def test_neighbours(spark, monkeypatch, block, floor):
    monkeypatch.setattr(vector_neighbours, "BLOCK", block)
    monkeypatch.setattr(vector_neighbours, "FAR_BLOCK", block)
    monkeypatch.setattr(vector_neighbours, "PIECE", 8)
    vs = cloud(3)[:-3]
    got = collections.defaultdict(set)
    for r in vector_neighbours.neighbours(frame(spark, vs), "vec_id", "e", 4, floor).collect():
        got[r["a"]].add(r["b"])
    want = best(vs, 4, floor or -2)
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if v}
    asked = vector_neighbours.neighbours(frame(spark, vs), "vec_id", "e", 4, floor, asks=F.col("id") % 3 == 0)
    assert {r["a"] for r in asked.select("a").distinct().collect()} == {k for k, v in want.items() if v and k % 3 == 0}


def test_ties_and_few(spark):
    v = np.ones(64, np.float32)
    got = [(r["a"], r["b"], r["rank"]) for r in vector_neighbours.neighbours(frame(spark, [v] * 5), "vec_id", "e", 3).collect()]
    assert (121, 100, 1) in got and (121, 107, 2) in got and (121, 114, 3) in got and len(got) == 15
    assert vector_neighbours.neighbours(frame(spark, [v] * 2), "vec_id", "e", 3).count() == 2


@pytest.mark.parametrize("floor", [None, 0.98])
@pytest.mark.parametrize("block", [65536, 40])
def test_dense_tiles(spark, monkeypatch, block, floor):
    """A third of all vectors are nearly or wholly equal: bounds can't tell them apart."""
    monkeypatch.setattr(vector_neighbours, "BLOCK", block)
    monkeypatch.setattr(vector_neighbours, "FAR_BLOCK", block)
    monkeypatch.setattr(vector_neighbours, "PIECE", 16)
    r = np.random.default_rng(5)
    c = r.normal(size=64)
    vs = [(c * (1 + k % 3) if k % 4 else c + 0.02 * r.normal(size=64)).astype(np.float32) for k in range(120)] + [r.normal(size=64).astype(np.float32) for _ in range(200)]
    got = collections.defaultdict(set)
    frame_ = vector_neighbours.neighbours(frame(spark, vs), "vec_id", "e", 3, floor)
    for x in frame_.collect():
        got[x["a"]].add(x["b"])
    assert dict(got) == {k: v for k, v in best(vs, 3, floor or -2).items() if v}


def test_bounds_hold():
    m = unit(cloud(4))
    q, step, off = vector_neighbours.quantised(m)
    approx = (q.astype(np.float32) @ q.astype(np.float32).T) * step[:, None] * step[None, :]
    bound = off[:, None] * (1 + off[None, :]) + off[None, :]
    assert (np.abs(approx - m @ m.T) <= bound + 1e-6).all()
