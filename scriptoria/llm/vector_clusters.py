"""Grouping records into similarity clusters (problem 4): density peaks over blocked neighbour joins.

Pass 1 counts each vector's links, the vectors at least as similar as the threshold: its density. Pass 2 finds,
again block by block, its most similar linked vector of higher density (ties by smaller id): its pointer, and
which of a block pair's trees of pointers are linked to each other. A vector without a denser linked one is a
peak; pointers lead every vector to a peak. Trees that are linked are then one cluster, found by passing the
smallest id along the links between peaks. A block pair writes no more rows than it has vectors: links
themselves, of which a dense cluster has the square, are never written.

Pointers are followed by doubling and links by passing minima, in rounds of joins that are cut by written tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptoria.llm import records, vector_blocks, vector_far
from scriptoria.llm.vector_far import OFF as FAR_OFF
from scriptoria.llm.vector_far import part_of
from scriptoria.operators import ranking
from scriptoria.plans.lineage import cut, discard
from scriptoria.sources.tables import table

#: Rows and columns of a piece of a product, chosen for the processor's cache.
PIECE = 1024
#: What float32 products may be off by; closer ones are computed again in float64.
OFF = 4e-6


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the left and right side, and whether they are the same chunk."""
    side = t.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    return left, left if same else right, same


def linked(m: np.ndarray, raw: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of rows p and q of m, the unit rows of raw, and whether they reach the threshold, decided in float64 where it is close."""
    s = m[p] @ m[q].T
    hit = s >= threshold
    x, y = np.nonzero(np.abs(s - np.float32(threshold)) < OFF)
    if len(x):
        hit[x, y] = (vector_blocks.unit(raw[p[x]]) * vector_blocks.unit(raw[q[y]])).sum(1) >= threshold
    return s, hit


def _degrees(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        left, right, same = _sides(t)
        raw = vector_blocks.unpacked(t.column("vec"))
        m = vector_blocks.unit32(raw)
        n = np.zeros(len(m), np.int64)
        for x in range(0, len(left), PIECE):
            for y in range(x if same else 0, len(right), PIECE):
                p, q = left[x : x + PIECE], right[y : y + PIECE]
                hit = linked(m, raw, p, q, threshold)[1]
                n[p] += np.count_nonzero(hit, axis=1)
                if not same or x != y:
                    n[q] += np.count_nonzero(hit, axis=0)
        if same:
            n[left] -= 1  # itself
        some = n > 0
        return pa.table({"id": t.column("id").filter(pa.array(some)), "n": pa.array(n[some])})

    return run


def _far_degrees(shared):
    """(id, n) of outliers and a part of them: links of a batch's rows, and in the end of the part's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = part_of(shared)
        low = np.float32(part.threshold)
        theirs = np.zeros(len(part.ids), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            raw, ids = vector_blocks.unpacked(b.column("vec")), b.column("id").to_numpy()
            own = np.zeros(len(ids), np.int64)
            for x, y, s in part.pairs(ids, vector_blocks.unit32(raw), b.column("cell").to_numpy()):
                hit = s >= low
                close = np.flatnonzero(np.abs(s - low) < FAR_OFF)
                hit[close] = (vector_blocks.unit(raw[x[close]]) * vector_blocks.unit(part.raw[y[close]])).sum(1) >= part.threshold
                own += np.bincount(x[hit], minlength=len(own))
                np.add.at(theirs, y[hit], 1)
            some = own > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(own[some])], ["id", "n"])
        some = theirs > 0
        yield pa.RecordBatch.from_arrays([pa.array(part.ids[some]), pa.array(theirs[some])], ["id", "n"])

    return run


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each connected set, by passing minima and jumping."""
    lab = np.arange(n)
    while len(a):
        before = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while (lab[lab] != lab).any():
            lab = lab[lab]
        if (before == lab).all():
            break
    return lab


def _pointers(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        left, right, same = _sides(t)
        raw = vector_blocks.unpacked(t.column("vec"))
        m, ids, dens = vector_blocks.unit32(raw), t.column("id").to_numpy(), t.column("density").to_numpy()
        # the densest first, ties by id: denser is simply before
        order = np.lexsort((ids, -dens))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        left, right = left[np.argsort(place[left])], right[np.argsort(place[right])]
        best, to = np.full(len(ids), -2.0), np.full(len(ids), -1)
        pairs_a, pairs_b = [], []

        def offer(of: np.ndarray, s: np.ndarray, who: np.ndarray) -> None:
            up = s > best[of]
            best[of[up]], to[of[up]] = s[up], who[up]

        pieces = [(x, y) for x in range(0, len(left), PIECE) for y in range(x if same else 0, len(right), PIECE)]
        for x, y in pieces:
            p, q = left[x : x + PIECE], right[y : y + PIECE]
            s, hit = linked(m, raw, p, q, threshold)
            if not hit.any():
                continue
            s = np.where(hit, s, -2)
            before = place[q][None, :] < place[p][:, None]
            up = np.where(before, s, -2)
            k = up.argmax(1)
            offer(p, up[np.arange(len(p)), k], q[k])
            if not same or x != y:
                down = np.where(before, -2, s)
                k = down.argmax(0)
                offer(q, down[k, np.arange(len(q))], p[k])
        root = np.where(to >= 0, to, np.arange(len(ids)))
        while (root[root] != root).any():
            root = root[root]
        # links between different trees, at most one for each pair of trees and piece
        if len(np.unique(root)) > 1:
            for x, y in pieces:
                p, q = left[x : x + PIECE], right[y : y + PIECE]
                tp, tq = root[p], root[q]
                if (tp == tp[0]).all() and (tq == tp[0]).all():
                    continue
                hit = linked(m, raw, p, q, threshold)[1]
                if not hit.any():
                    continue
                op, oq = np.argsort(tp, kind="stable"), np.argsort(tq, kind="stable")
                sp, sq = tp[op], tq[oq]
                ep, eq = np.flatnonzero(np.r_[True, sp[1:] != sp[:-1]]), np.flatnonzero(np.r_[True, sq[1:] != sq[:-1]])
                some = np.logical_or.reduceat(np.logical_or.reduceat(hit[op][:, oq], ep, axis=0), eq, axis=1)
                u, v = np.nonzero(some)
                u, v = sp[ep][u], sq[eq][v]
                pairs_a.append(u[u != v])
                pairs_b.append(v[u != v])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (pairs_a, pairs_b))
        lab = _components(len(ids), a, b)
        roots = np.flatnonzero((root == np.arange(len(ids))) & (lab != np.arange(len(ids))))
        own = np.flatnonzero(to >= 0)
        # kind 0: a pointer with its similarity; kind 1: two linked trees, by their roots here
        return pa.table({
            "id": pa.array(np.r_[ids[own], ids[roots]]), "to": pa.array(np.r_[ids[to[own]], ids[lab[roots]]]),
            "s": pa.array(np.r_[best[own], np.zeros(len(roots))]), "kind": pa.array(np.r_[np.zeros(len(own), np.int32), np.ones(len(roots), np.int32)]),
        })

    return run


def peaks(pointers: DataFrame) -> DataFrame:
    """(id, peak) of everything that points somewhere, by pointer doubling: log2 of the longest path rounds."""
    now = cut(pointers.select("id", "to"), "pointers")
    last = now
    while True:
        on = now.select("id", "to").toDF("to", "next")
        now = cut(now.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jumps", replaces=last)
        if now.filter("moved").isEmpty():
            return now.select("id", F.col("to").alias("peak"))
        last, now = now, now.select("id", "to")


def smallest(edges: DataFrame) -> DataFrame:
    """(id, low): the smallest id of the connected set of each end of (a, b).

    Each round gives every node the smallest label about it and contracts the edges to labels; the sets shrink until
    no edge is left, in about log rounds. Nothing is collected but whether edges remain.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).select(F.col("a").alias("id"), "low"), "minima")
        # follow the minima of this round to their ends
        flat = peaks(step.filter("low < id").select("id", F.col("low").alias("to"))).select("id", F.col("peak").alias("low"))
        label = flat if label is None else cut(_through(label, flat).unionByName(flat.join(label, "id", "left_anti")), "labels", replaces=label)
        x, y = flat.select(F.col("id").alias("a"), F.col("low").alias("x")), flat.select(F.col("id").alias("b"), F.col("low").alias("y"))
        moved = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("p"), F.coalesce("y", "b").alias("q")).filter("p <> q")
        edges = cut(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links", replaces=edges)
        discard(step)
    return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("low"))


def _through(label: DataFrame, flat: DataFrame) -> DataFrame:
    on = flat.select(F.col("id").alias("low"), F.col("low").alias("next"))
    return label.join(on, "low", "left").select("id", F.coalesce("next", "low").alias("low"))


def clusters(df: DataFrame, key: str, values: str, width: int = 64, threshold: float = 0.85, least: int = 8) -> DataFrame:
    """(id, cluster_key, peak, density): members of the connected sets of at least `least` usable vectors.

    Vectors are linked from a cosine of `threshold`. cluster_key is the smallest id of the set, peak the density peak whose
    tree the vector is in, density its links. Unusable vectors (wrong length, null, NaN, all zero) have no row, nor
    has an empty table. Equal vectors are linked like any others.
    """
    angle = math.acos(threshold)
    vectors = vector_blocks.usable(df, key, values, width)
    centre = vector_blocks.centres(vectors, angle, df.count())
    at = cut(vector_blocks.placed(vectors, centre, angle, angle), "placed")
    far = vector_far.met(vector_blocks.outliers(at), threshold, _far_degrees, "id long, n long")
    tiles = vector_blocks.tiled(vector_blocks.homed(at))
    degree = tiles.groupBy("cell", "i", "j").applyInArrow(_degrees(threshold), "id long, n long").union(far)
    degree = cut(degree.groupBy("id").agg(F.sum("n").alias("density")), "density")
    # a vector without a link can't be in any cluster
    dense = at.join(degree, "id")
    found = vector_blocks.tiled(cut(dense, "dense")).groupBy("cell", "i", "j").applyInArrow(_pointers(threshold), "id long, to long, s double, kind int")
    found = cut(found, "found")
    pointer = found.filter("kind = 0").groupBy("id").agg(F.max_by("to", F.struct("s", -F.col("to"))).alias("to"))
    top = peaks(pointer)
    peak = cut(degree.join(top, "id", "left").select("id", "density", F.coalesce("peak", "id").alias("peak")), "peaks")
    # every pointer of a block and every link between trees joins two peaks
    ends = found.select("id", "to").join(peak.select("id", F.col("peak").alias("a")), "id").join(peak.select(F.col("id").alias("to"), F.col("peak").alias("b")), "to")
    low = smallest(ends.select("a", "b"))
    joined = peak.join(low.withColumnRenamed("id", "peak"), "peak", "left").withColumn("set", F.coalesce("low", "peak"))
    size = joined.groupBy("set").agg(F.count("*").alias("size"), F.min("id").alias("cluster_key")).filter(F.col("size") >= least)
    return joined.join(size, "set").select("id", "cluster_key", "size", "peak", "density")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "para_vectors", "vec_id", "embeddings")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters(_vectors(spark, d), "vec_id", "embeddings").select(F.col("id").alias("vec_id"), "cluster_key")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size, its five densest members, and its ten leading and ten most distinctive lemmas."""
    member = cut(clusters(_vectors(spark, d), "vec_id", "embeddings"), "members")
    typical = member.withColumn("r", F.row_number().over(W.partitionBy("cluster_key").orderBy(F.col("density").desc(), "id"))).filter("r <= 5")
    typical = typical.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    rows = member.join(table(spark, d, "para_vectors", "vec_id", "row_id").withColumnRenamed("vec_id", "id"), "id").select("cluster_key", "row_id").distinct()
    terms = records.lemmas(spark, d).select("row_id", F.explode(F.array_distinct("items")).alias("lemma"))
    total = terms.groupBy("lemma").agg(F.count("*").alias("n_l"))
    inside = rows.join(terms, "row_id").groupBy("cluster_key", "lemma").agg(F.count("*").alias("a")).join(total, "lemma")
    n = records.total(spark, d)
    size = rows.groupBy("cluster_key").agg(F.count("*").alias("n_g"))
    a, b, c = F.col("a"), F.col("n_g") - F.col("a"), F.col("n_l") - F.col("a")
    odds = F.log((a + 0.5) * (F.lit(n) - b - c - a + 0.5) / ((b + 0.5) * (c + 0.5)))
    cell = inside.join(size, "cluster_key").withColumn("odds", odds)
    # a limit per group runs before each shuffle, so no task ranks all lemmas of a cluster
    top = ranking.joined_list(ranking.top_per(cell, 10, ["cluster_key"], F.col("a").desc(), F.col("lemma")), ["cluster_key"], "rank", "lemma", "top_lemmas", ";")
    own = ranking.joined_list(ranking.top_per(cell.filter("a >= 3"), 10, ["cluster_key"], F.col("odds").desc(), F.col("lemma")), ["cluster_key"], "rank", "lemma", "distinctive_lemmas", ";")
    words = top.join(own, "cluster_key", "left").withColumn("distinctive_lemmas", F.coalesce("distinctive_lemmas", F.lit("")))
    return member.groupBy("cluster_key").agg(F.first("size").alias("size")).join(typical, "cluster_key").join(words, "cluster_key", "left").select("cluster_key", "size", "typical", "top_lemmas", "distinctive_lemmas")
