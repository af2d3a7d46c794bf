import collections
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import cooccurrence, distinctive, records, set_pairs, term_counts

TH, LEAST = {"f": 0.7, "g": 0.75}, {"f": 4, "g": 3}


def fold(s):
    s = unicodedata.normalize("NFKD", (s or "").strip().lower())
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())


def frame(spark, data):
    return spark.createDataFrame(data, "field string, row_id long, items array<string>, a string, bucket long, id string")


def widened(data):
    return [(f, k, x, "clash", 7, "clash") for f, k, x in data]


def baskets(seed, n=300, vocabulary=60):
    r = random.Random(seed)
    base = [[f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(3, 14))] for _ in range(n // 3)]
    out = [x + [x[0], None] for x in base]
    for x in base:  # near copies and copies
        y = [w if r.random() > 0.12 else f"w{r.randrange(vocabulary)}" for w in x]
        out += [y, y[::-1]]
    return [(f, 10 * k + 3, x) for f in "fg" for k, x in enumerate(out)] + [("f", 1, None), ("f", 2, []), ("g", 4, [None, None, None, None])]


def similar(data):
    sets = {(f, k): {x for x in xs or [] if x is not None} for f, k, xs in data}
    sets = {k: s for k, s in sets.items() if len(s) >= LEAST[k[0]]}
    keys = sorted(sets)
    out = set()
    for i, p in enumerate(keys):
        for q in keys[i + 1 :]:
            both = len(sets[p] & sets[q])
            if p[0] == q[0] and both >= TH[p[0]] * len(sets[p] | sets[q]) - 1e-9:
                out.add((p[0], min(p[1], q[1]), max(p[1], q[1])))
    return out


@pytest.mark.parametrize("cap", [256, 2])
def test_set_pairs(spark, monkeypatch, cap):
    monkeypatch.setattr(set_pairs.similar_sets, "__defaults__", (set_pairs.BANDS, set_pairs.ROWS, cap, 5 if cap == 2 else set_pairs.CHUNK))
    data = baskets(1)
    got = [tuple(r) for r in set_pairs.expanded(*set_pairs.similar_records(frame(spark, widened(data)), TH, LEAST)).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(data) and len(got) > 100


def test_hot_copies_and_empty(spark):
    same = [("f", k, ["a", "b", "c", "d"]) for k in range(40)] + [("f", k, [f"x{k}", f"y{k}", f"z{k}", "q"]) for k in range(40, 60)]
    got = [tuple(r) for r in set_pairs.expanded(*set_pairs.similar_records(frame(spark, widened(same)), TH, LEAST)).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2
    assert set_pairs.expanded(*set_pairs.similar_records(frame(spark, []), TH, LEAST)).count() == 0


def test_sketches_never_drop_a_pair():
    r = np.random.default_rng(3)
    for _ in range(2000):
        n = int(r.integers(1, 40))
        x = r.integers(-(2**63), 2**63 - 1, n)
        y = np.r_[x[: max(1, int(n * r.random()))], r.integers(-(2**63), 2**63 - 1, int(r.integers(0, 12)))]
        x, y = np.unique(x), np.unique(y)
        if len(np.intersect1d(x, y)) >= 0.7 * len(np.union1d(x, y)):
            a, b = (set_pairs.sketches(z, np.array([0])) for z in (x, y))
            assert set_pairs.may_reach(a, b, 0.7)[0]
    long = np.arange(300)
    assert set_pairs.may_reach(set_pairs.sketches(long, np.array([0])), set_pairs.sketches(long[:2], np.array([0])), 0.7)[0]


def test_folding(spark, rows):
    df = spark.createDataFrame([(1, [" Ñandú", "ﬁN ", None, "", " ", "ﬁn", "ΟΔΟΣ"], "x"), (2, None, "x"), (3, [], "x")], "row_id long, lemmas array<string>, items string")
    assert rows(records.folded_items(df)) == [(1, ("nandu", "fin", "fin", fold("ΟΔΟΣ"))), (2, ()), (3, ())]
    p = spark.createDataFrame([(1, ["##a ", " a", "#", None], 1), (1, ["##a ", " a", "#", None], 2), (2, None, 1), (3, [" "], 1)], "row_id long, persons array<string>, t int")
    assert rows(records.id_items(p)) == [(1, ("a", "a"))]


@pytest.mark.parametrize("terms", [1, 2, 3])
def test_ngrams(spark, terms):
    r = random.Random(4)
    data = [("f", k, [r.choice("aabcd") for _ in range(r.randrange(0, 9))]) for k in range(80)] + [("g", 1, ["a"] * 30), ("g", 2, None), ("g", 3, [])]
    uses, held = collections.Counter(), collections.defaultdict(set)
    for f, k, xs in data:
        for i in range(len(xs or [])):
            for n in range(1, terms + 1):
                if i + n <= len(xs):
                    g = (f, tuple(xs[i : i + n]))
                    uses[g] += 1
                    held[g].add(k)
    got = term_counts.ngram_counts(frame(spark, widened(data)).repartition(5), terms).collect()
    assert {(r["field"], tuple(r["terms"])): (r["uses"], r["records"]) for r in got} == {g: (n, len(held[g])) for g, n in uses.items()} and len(got) == len(uses)
    assert term_counts.ngram_counts(frame(spark, []), terms).count() == 0


def test_marks(spark, rows):
    c = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 10), ("f", "d", 9, 11)], "field string, item string, uses long, records long")
    assert rows(term_counts.marked(c, 100, {"f": 3}, {"f": 10})) == [("f", "a", "rare"), ("f", "d", "common")]


def test_cooccurrence(spark):
    data = baskets(5, 600, 40) + [("f", 10**6 + k, ["hot", f"w{k % 5}"]) for k in range(500)]
    n = len({k for f, k, _ in data if f == "f"})
    for lift in (1.2, 3):
        want = set()
        for f in "fg":
            sets = [{x for x in xs or [] if x is not None} for g, _, xs in data if g == f]
            one = collections.Counter(x for s in sets for x in s)
            two = collections.Counter((a, b) for s in sets for a in s for b in s if a < b)
            want |= {(f, a, b, one[a], one[b], k) for (a, b), k in two.items() if one[a] >= 5 and one[b] >= 5 and k >= 4 and k * n >= lift * one[a] * one[b]}
        got = cooccurrence.associated(frame(spark, widened(data)), n, lift, {"f": 5, "g": 5}, {"f": 4, "g": 4}).collect()
        assert {tuple(r)[:6] for r in got} == want and len(got) == len(want)
        assert all(r["lift"] == pytest.approx(r["n_ab"] * n / (r["n_a"] * r["n_b"])) for r in got)
    assert cooccurrence.associated(frame(spark, []), 10, 2, {"f": 1}, {"f": 1}).count() == 0


def test_gram_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(cooccurrence, "BLOCK", 10)
    data = [("f", k, [f"w{j}" for j in range(k % 9)]) for k in range(90)]
    got = cooccurrence.associated(frame(spark, widened(data)), 90, 0.1, {"f": 1}, {"f": 1}).collect()
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == {(f"w{i}", f"w{j}"): 10 * (8 - j) for i in range(8) for j in range(i + 1, 8)}


def test_top_terms(spark):
    r = random.Random(6)
    data = [(k, [r.choice("abcdefghijklmnop") + str(r.randrange(3)) for _ in range(r.randrange(0, 20))]) for k in range(120)] + [(900, None), (901, [])] + [(1000 + k, ["hot"] * 3 + [f"a{k % 3}", "b1", "c1"]) for k in range(60)]
    total = len(data)
    df = collections.Counter(x for _, xs in data for x in set(xs or []))
    want = set()
    for k, xs in data:
        u = collections.Counter(xs or [])
        if len(u) >= 4:
            best = sorted((-n * math.log(total / df[t]), t) for t, n in u.items() if df[t] >= 2)[:3]
            want |= {(k, t) for _, t in best}
    src = spark.createDataFrame([(k, x, "clash") for k, x in data], "row_id long, items array<string>, term string")
    got = [(x["row_id"], x["term"]) for x in distinctive.top_terms(src.select("row_id", "items"), total, 3, 4, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert distinctive.top_terms(src.select("row_id", "items").limit(0), 0, 3, 4, 2).count() == 0


def test_two_poisson_finds_the_mixture():
    rng = np.random.default_rng(7)
    n = 20_000
    elite = rng.random(n) < 0.1
    k = np.where(elite, rng.poisson(6, n), rng.poisson(0.2, n))
    values, counts = np.unique(k[k > 0], return_counts=True)
    share, high, low = distinctive.em(values[None, :].astype(float), counts[None, :].astype(float), n, 300)
    assert share[0] == pytest.approx(0.1, abs=0.01) and high[0] == pytest.approx(6, abs=0.2) and low[0] == pytest.approx(0.2, abs=0.02)


def test_two_poisson_scores(spark):
    data = [(k, ["t"] * (8 if k % 10 == 0 else 1 if k % 3 == 0 else 0) + ["always"]) for k in range(300)]
    counted = distinctive.uses(spark.createDataFrame(data, "row_id long, items array<string>"))
    got = distinctive.scored(counted, 300).filter("term = 't'").groupBy("uses").agg(F.min("elite").alias("e")).collect()
    e = {r["uses"]: r["e"] for r in got}
    assert e[8] > 0.99 and e[1] < 0.1


def test_mixture_is_the_best_of_a_grid():
    """The fit's likelihood isn't beaten by any mixture of a fine grid about it, nor by other starts."""
    r = np.random.default_rng(3)
    k = np.r_[r.poisson(4, 60), r.poisson(0.1, 1940)]
    kinds, n = np.unique(k[k > 0], return_counts=True)
    share, high, low = (float(x[0]) for x in distinctive.em(kinds[None, :].astype(float), n[None, :], 2000, rounds=2000))

    def loglik(w, a, b):
        x = np.r_[0, kinds]
        m = np.r_[2000 - n.sum(), n]
        return (m * np.log(w * a**x * np.exp(-a) + (1 - w) * b**x * np.exp(-b))).sum()

    best = max(loglik(w, a, b) for w in np.linspace(0.005, 0.2, 60) for a in np.linspace(1, 8, 60) for b in np.linspace(0.01, 0.5, 60))
    assert loglik(share, high, low) >= best - 1e-6 and 3 < high < 5 and 0.02 < share < 0.045


def test_found_rows_carry_the_posterior(spark):
    df = spark.createDataFrame([(k, [f"t{(k + j) % 12}" for j in range(9)] + ["t0"] * (k % 3)) for k in range(60)], "row_id long, items array<string>")
    got = distinctive.top_terms(df, 60).collect()
    assert {r["rank"] for r in got} == {1, 2, 3} and all(0 <= r["elite"] <= 1 for r in got)


def test_records_of_split_classes(spark, rows, monkeypatch):
    base = [f"t{k}" for k in range(10)]
    own = {k: base if k < 25 else [*base[:9], "other"] if k < 33 else [f"x{k}_{j}" for j in range(9)] for k in range(40)}
    df = spark.createDataFrame([("lemmas", k, v) for k, v in own.items()], "field string, row_id long, items array<string>")
    want = sorted(("lemmas", a, b) for a in own for b in own if a < b and len({*own[a]} & {*own[b]}) >= 0.7 * len({*own[a]} | {*own[b]}))
    monkeypatch.setattr(set_pairs, "SPLIT", 4)
    assert rows(set_pairs.expanded(*set_pairs.similar_records(df, set_pairs.THRESHOLD, set_pairs.LEAST))) == want
