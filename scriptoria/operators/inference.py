"""Calls of outside models, behind a cache table: only what the table lacks is asked for."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import cache_key


def with_keys(df: DataFrame, text: str, model: str, mode: str, extra: str = "") -> DataFrame:
    """`df` with key: a digest of model, mode, text and extra."""
    return df.withColumn("key", cache_key(F.lit(model), F.lit(mode), F.col(text), F.lit(extra)))


def missing(df: DataFrame, cache: DataFrame) -> DataFrame:
    """One row of each key that the cache lacks."""
    return df.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def answered(asked: DataFrame, text: str, client: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32, attempts: int = 6, pause: float = 30.0) -> DataFrame:
    """(key, answer) of (key, text): `client()` is made once per task and called with batches, again after pause x attempt on an error.

    Number of tasks bounds the number of calls at once. The last error is raised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                for attempt in range(1, attempts + 1):
                    try:
                        yield pd.DataFrame({"key": part["key"], "answer": call(part[text].tolist())})
                        break
                    except Exception:
                        if attempt == attempts:
                            raise
                        time.sleep(pause * attempt)

    return asked.select("key", text).mapInPandas(run, "key string, answer string")


def vectors_of(df: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 8) -> DataFrame:
    """(key, vec): vectors of texts by a model made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "vec": encode(part[text].fillna("").tolist())})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<float>")


def vector_check(df: DataFrame, vec: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: how many vectors there are, of unit length, null, holding NaN, all zero, and their widths."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n = F.when(x.isNotNull() & ~bad, norm)
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.abs(n - 1) <= tolerance).alias("n_unit"), F.count_if(x.isNull()).alias("n_null"), F.count_if(bad).alias("n_nan"),
        F.count_if(n == 0).alias("n_zero"), F.min(F.when(x.isNotNull(), F.size(x))).alias("least_width"), F.max(F.when(x.isNotNull(), F.size(x))).alias("most_width"),
    )


def lemmatised(df: DataFrame, key: str, terms: str, analyser: Callable[[], Callable[[str], list[tuple[str, str]]]] | None, stop: list[str], names: list[str], least: int = 3) -> DataFrame:
    """(key, lemmas): content lemmas of phrases, first seen first, without stop words, proper-name parts and short ones.

    `analyser()` gives (lemma, part of speech) of each token of a phrase; NOUN, ADJ and VERB are kept. Without one every word is
    its own lemma, an approximation. Lists of stop words and names are bounded.
    """
    import unicodedata

    out = {*stop, *names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = analyser() if analyser else lambda phrase: [(w, "NOUN") for w in phrase.split()]
        known: dict[str, list[str]] = {}

        def lemmas(phrase: str) -> list[str]:
            if phrase not in known:
                plain = ["".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c)) for w, pos in split(phrase) if pos in ("NOUN", "ADJ", "VERB")]
                known[phrase] = [w for w in plain if w.isalpha() and len(w) >= least and w not in out]
            return known[phrase]

        for b in batches:
            yield pd.DataFrame({key: b[key], "lemmas": [list(dict.fromkeys(w for t in (ts if ts is not None else []) if t for w in lemmas(t))) for ts in b[terms]]})

    return df.select(key, terms).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, lemmas array<string>")
