import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import folding, stats
from scriptoria.functions import text as T
from scriptoria.functions.ranks import false_discovery, numbered
from scriptoria.operators import people, segment


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, clean", [("##kafka ", "kafka"), (" # a", "a"), ("", None), ("#", None), (None, None), ("\tx ", "x")])
def test_clean_id(spark, raw, clean):
    assert one(spark, raw, T.clean_id) == clean


def test_pointers_keep_repeats(spark):
    assert one(spark, "#a  #b #a #", T.pointer_list) == ["a", "b", "a"]
    assert one(spark, None, T.pointer_list) == []


@pytest.mark.parametrize("raw, year", [("1871-10-30", 1871), ("1883", 1883), ("-0075", -75), ("-0075-01", -75), ("", None), ("abc", None), (None, None), (" 12 ", 12)])
def test_year(spark, raw, year):
    assert one(spark, raw, T.year) == year


@pytest.mark.parametrize("year, name", [(-801, "Unknown"), (-800, "Antiquity (Archaic)"), (-500, "Classical Antiquity"), (1999, "Contemporary"), (2000, "Unknown"), (None, "Unknown")])
def test_period(spark, year, name):
    assert one(spark, year, people.period, "int") == name


@pytest.mark.parametrize("text, hit", [("El olvido.", True), ("OLVIDO", True), ("olvidos", False), ("olvidó", False), ("_olvido", False), ("canción", False), (None, False), ("", False), ("CÉLINE y", True)])
def test_has_term(spark, text, hit):
    assert one(spark, text, lambda x: T.has_term(x, ["olvido", "n", "céline"])) is hit
    assert one(spark, text, lambda x: T.has_term(x, [])) is False


def test_words_and_excerpt(spark):
    assert one(spark, "La Niña niña año1 y_z mañana-tarde", T.words) == ["niña", "mañana", "tarde"]
    assert one(spark, "a\n  b" + "x" * 300, T.excerpt) == ("a b" + "x" * 300)[:280] + "…"
    assert one(spark, None, T.excerpt) == ""


def test_sets(spark):
    assert one(spark, " a; b;;a ", T.split_ids) == ["a", "b"]
    assert spark.range(1).select(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 0
    assert T.issue_column("issue_4-5") == "prop_issue_4_5"
    assert one(spark, " ISSUE 3 ", T.issue_key) == "issue_3"


def test_canonical(spark):
    df = spark.createDataFrame([(["Ñandú", " ﬁn  de ", None, "", "Ñandú"],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in df.select(folding.canonical_list("x")).collect()] == [["nandu", "fin de", "nandu"], [], []]
    assert one(spark, "CANCIÓN ", folding.canonical) == "cancion"
    assert one(spark, None, folding.canonical) is None


def test_cache_key_splits(spark):
    df = spark.createDataFrame([("ab", "c", "a", "bc")], "p string, q string, r string, s string")
    assert df.select(T.cache_key("p", "q") if False else T.cache_key(F.col("p"), F.col("q")) == T.cache_key(F.col("r"), F.col("s"))).first()[0] is False


def test_fisher_and_tail(spark):
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert stats.fisher(0, 5, 5, 0) == pytest.approx(2 / math.comb(10, 5))
    assert stats.fisher(300, 100_000, 200, 90_000) == pytest.approx(stats.fisher(200, 90_000, 300, 100_000))
    df = spark.createDataFrame([(3, 1, 1, 3), (None, 1, 1, 1), (1, 1, 1, -1)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(F.round(stats.fisher_p(*map(F.col, "abcd")), 4)).collect()] == [0.4857, None, None]
    assert one(spark, 1.959963985, stats.normal_p, "double") == pytest.approx(0.05)


def test_numbered(spark):
    xs = list(range(1000))
    random.Random(1).shuffle(xs)
    got = numbered(spark.createDataFrame([(x,) for x in xs], "x int"), F.col("x").desc()).collect()
    assert all(r["rank"] == 1000 - r["x"] for r in got) and len(got) == 1000
    assert numbered(spark.createDataFrame([], "x int"), F.col("x")).count() == 0


@pytest.mark.parametrize("ps", [[], [0.2], [0.01, 0.01, 0.04, 0.9, 1.0], [random.Random(3).random() for _ in range(300)]])
def test_false_discovery(spark, ps):
    got = false_discovery(spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double")).collect()
    order = sorted(ps)
    low, q = 1.0, {}
    for k in range(len(order), 0, -1):
        low = min(low, order[k - 1] * len(order) / k)
        q[order[k - 1]] = min(low, q.get(order[k - 1], 1.0))
    assert all((r["q"] is None) if r["p"] is None else r["q"] == pytest.approx(q[r["p"]]) for r in got) and len(got) == len(ps) + 1


def _segments(raw):
    blocks, now = [], []
    for line in [*(raw or "").splitlines(), ""]:
        if line.strip():
            now.append(line.strip())
        elif now:
            blocks.append(" ".join(now))
            now = []
    out = []
    for b in blocks:
        if len(b) <= 1200:
            out.append(b)
            continue
        acc = ""
        for s in re.split(r"(?<=[.!?…])\s+", b):
            acc = f"{acc} {s}".strip()
            if len(acc) >= 700:
                out.append(acc)
                acc = ""
        out += [acc] if acc else []
    return [s for s in out if len(s) >= 50]


def test_segments(spark):
    long = " ".join(f"Esta frase lleva el número {k}." for k in range(80))
    texts = ["", None, "corto", "x" * 1200, "x" * 1201, long, f"{'una línea bastante larga\n' * 4}\n\n \n{long}\r\n\r\n{'otra ' * 30}", "a" * 49 + "\n\n" + "b" * 50]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", segment.segments(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {k: _segments(t) for k, t in enumerate(texts)}


def test_keyed_is_fixed(spark):
    assert spark.range(1).select(T.keyed("s", F.lit(7)), T.keyed_int("s", F.lit(7))).first()[0] == __import__("hashlib").md5(b"s|7").hexdigest()


def test_countries(spark):
    got = spark.createDataFrame([(" Alemania ",), ("narnia",), (None,)], "c string").select(people.country(F.col("c")).alias("c")).select("c", people.region(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("Germany", "Western Europe"), ("narnia", "Other/Unknown"), (None, "Other/Unknown")]
    assert set(people.REGIONS) <= set(people.COUNTRIES.values()) and people.REGIONS["Greece"] == "Southern Europe / Classical"
