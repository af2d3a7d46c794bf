"""Per-document text quality statistics (problem 10), and text types from them.

Statistics are computed column-wise in Arrow batches. Each one outside its range is a noisy vote against prose:
a labelling function. `text_types` learns how reliable each is, without labels, by expectation-maximisation on
how the votes agree (a two-class model with independent votes), from the counts of the vote patterns only, of
which there are at most 32, and gives each document the posterior probability of prose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import arrow
from scriptoria.plans.lineage import cut
from scriptoria.sources.tables import table

#: Least and most of each statistic in prose.
PROSE = {"word_count": (40, 2000), "mean_word_length": (3.5, 8.0), "symbol_ratio": (None, 0.1), "line_punctuation": (0.5, None), "common_words": (0.2, None)}
STATS = tuple(PROSE)
PIECE = 1 << 22
_B = arrow.BLANK
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("word_count", pa.int64()), *((s, pa.float64()) for s in STATS[1:])])


def _sums(parent: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(parent, weights=x, minlength=n)


def _ratio(x: np.ndarray, y: np.ndarray) -> pa.Array:
    return pa.array(x / np.maximum(y, 1), mask=y == 0)


def measured(text: pa.Array, common: pa.Array) -> list[pa.Array]:
    """The five statistics of each text."""
    n, text = len(text), pc.fill_null(text, "")
    parent, flat = arrow.exploded(pc.split_pattern_regex(text, f"[{_B}]+"))
    keep = pc.not_equal(flat, "")
    parent, flat = parent[keep.to_numpy(zero_copy_only=False).astype(bool)], flat.filter(keep)
    count = np.bincount(parent, minlength=n)
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    word = coded.dictionary
    long = pc.utf8_length(word).to_numpy(zero_copy_only=False)
    odd = pc.utf8_length(pc.replace_substring_regex(word, r"[\p{L}\p{M}\p{N}]+", "")).to_numpy(zero_copy_only=False)
    bare = arrow.lower(pc.replace_substring_regex(word, r"^\P{L}+|\P{L}+$", ""))
    known = pc.is_in(bare, common).to_numpy(zero_copy_only=False).astype(float)
    chars = _sums(parent, long[at], n)
    lines, line = arrow.exploded(pc.split_pattern(text, "\n"))
    line = pc.replace_substring_regex(line, f"[{_B}]+$", "")
    keep = pc.not_equal(line, "")
    lines, line = lines[keep.to_numpy(zero_copy_only=False).astype(bool)], line.filter(keep)
    ends = pc.match_substring_regex(line, r"""[.!?…][»”"')\]]*$""").to_numpy(zero_copy_only=False).astype(float)
    return [pa.array(count), _ratio(chars, count), _ratio(_sums(parent, odd[at], n), chars), _ratio(_sums(lines, ends, n), np.bincount(lines, minlength=n)), _ratio(_sums(parent, known[at], n), count)]


def _stat_batches(common: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(common, pa.string())
        for b in batches:
            size = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(size), 0
            while at < b.num_rows:
                step = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")) - at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, step), *measured(b.column(1).slice(at, step), known)], schema=_SCHEMA)
                at += step

    return run


def statistics(docs: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """(doc_id, word_count, mean_word_length, symbol_ratio, line_punctuation, common_words), one row per row of `docs`.

    A null, empty or blank text has word_count 0 and null for the rest. `common` is a bounded list of lower-case words.
    """
    return docs.select(F.col(key).cast("long"), text).mapInArrow(_stat_batches(common), "doc_id long, word_count long, " + ", ".join(f"{s} double" for s in STATS[1:]))


def votes(stats: DataFrame, ranges: dict[str, tuple] = PROSE) -> DataFrame:
    """`stats` with votes: the names of those outside their range. Null ones don't vote."""
    out = []
    for s, (low, high) in ranges.items():
        c = F.col(s)
        outside = (c < low) if high is None else (c > high) if low is None else (c < low) | (c > high)
        out.append(F.when(outside, F.lit(s)))
    return stats.withColumn("votes", F.array_compact(F.array(*out)))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of prose, and how often each vote falls in other text and in prose, from (pattern, documents)."""
    v = np.array([p for p, _ in patterns], float).reshape(len(patterns), -1)
    n = np.array([k for _, k in patterns], float)
    prose = np.clip(1 - v.mean(1), 0.05, 0.95)  # begin with the share of votes
    for _ in range(rounds):
        share = (n * prose).sum() / n.sum()
        yes = ((n * prose) @ v + 0.5) / ((n * prose).sum() + 1)
        no = ((n * (1 - prose)) @ v + 0.5) / ((n * (1 - prose)).sum() + 1)
        a = np.log(share) + v @ np.log(yes) + (1 - v) @ np.log(1 - yes)
        b = np.log(1 - share) + v @ np.log(no) + (1 - v) @ np.log(1 - no)
        prose = np.clip(1 / (1 + np.exp(np.clip(b - a, -700, 700))), 1e-9, 1 - 1e-9)
    return float(share), no, yes


def text_types(voted: DataFrame) -> DataFrame:
    """`voted` with prose: the posterior probability that the text is prose, null for an empty table."""
    bits = F.array(*[F.array_contains("votes", s).cast("int") for s in STATS])
    rows = voted.groupBy(bits.alias("p")).count().collect()  # at most 2^5
    if not rows:
        return voted.withColumn("prose", F.lit(None).cast("double"))
    share, no, yes = fit([(tuple(r[0]), r[1]) for r in rows])
    odds = F.lit(float(np.log((1 - share) / share)))
    for i, s in enumerate(STATS):
        odds = odds + F.when(F.array_contains("votes", s), float(np.log(no[i] / yes[i]))).otherwise(float(np.log((1 - no[i]) / (1 - yes[i]))))
    return voted.withColumn("prose", 1 / (1 + F.exp(odds)))


#: Common words that are sent to every task; a longer list is refused before it is collected.
MOST_COMMON = 1_000_000


def common_words(words: DataFrame, word: str) -> list[str]:
    """The different words of a list, checked to be short."""
    kinds = words.select(word).filter(F.col(word).isNotNull()).distinct()
    if (n := kinds.count()) > MOST_COMMON:
        raise ValueError(f"{n} common words: more than {MOST_COMMON}")
    return [r[0] for r in kinds.collect()]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    common = common_words(table(spark, d, "function_words", "word"), "word")
    return statistics(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", common)


def typed(stats: DataFrame) -> DataFrame:
    """`stats` with votes and the posterior of prose. Statistics are written once: the fit and its use both read them."""
    return text_types(cut(votes(stats), "votes"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The votes of the labelling functions; the posterior that `p10_types` reports comes from the same fit and changes none of them."""
    return typed(_documents(spark, d)).select("doc_id", F.explode("votes").alias("stat"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", "word_count", *[F.round(s, 6).alias(s) for s in STATS[1:]])


def p10_types(spark: SparkSession, d: str) -> DataFrame:
    """Each document's votes and its posterior probability of being prose."""
    return typed(_documents(spark, d)).select("doc_id", F.concat_ws(";", "votes").alias("votes"), F.round("prose", 6).alias("prose"), F.when(F.col("prose") >= 0.5, "prose").otherwise("other").alias("text_type"))
