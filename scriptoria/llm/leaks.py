"""Evaluation texts leaking into training text (problem 9).

The test items' words become numbers and their runs of `window` words a sorted table of hashes: a fixed set, whose
size is checked and which is broadcast. A document's words are folded column-wise, looked up in the test words (any
other word breaks a run), and rolling hashes of its windows are sought in the table. Hits are verified word by
word against the item's run. Nothing of the documents is shuffled. Verified windows give the spans of the stored text that
leak, by which they are cut out or the document is dropped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import arrow
from scriptoria.plans.lineage import cut
from scriptoria.sources.tables import table

#: Characters of test text of one broadcast table (some 16 million words: 24 bytes each and the distinct words). More is done in parts.
MOST_CHARS = 100_000_000
#: Characters of documents that are split at once.
PIECE = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: pa.Array) -> pa.Array:
    """Lists of the runs of letters and digits after lower-casing, NFKD and without marks; may hold empty ones."""
    return pc.split_pattern_regex(pc.fill_null(arrow.fold(text), ""), r"[^\p{L}\p{N}]+")


def rolled(code: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window of codes."""
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    c = code.astype(np.uint64) + np.uint64(1)
    for k in range(window):
        h = h * _MUL + c[k : k + n]
    return h ^ (h >> np.uint64(32))


class Table:
    """The test items' words and windows."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int):
        parent, flat = arrow.exploded(words(texts))
        keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        self.window, self.words = window, coded.dictionary
        self.code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), parent[keep]
        h = rolled(self.code, window)
        start = np.flatnonzero(row[: len(h)] == row[window - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
        order = np.argsort(h[start], kind="stable")
        self.start = start[order]
        self.hash, self.item = h[self.start], ids[row[self.start]]


def _hits(t: Table, parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, place among the words) of every window of known words found in the table, verified."""
    w = t.window
    n = len(code) - w + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not len(t.hash):
        return none, none, none
    known = np.r_[0, np.cumsum(code >= 0)]
    at = np.flatnonzero((known[w:] - known[:-w] == w) & (parent[:n] == parent[w - 1 :]))
    if not len(at):
        return none, none, none
    h = rolled(code, w)[at]
    lo, hi = np.searchsorted(t.hash, h, "left"), np.searchsorted(t.hash, h, "right")
    many = hi - lo
    at = np.repeat(at, many)
    place = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    same = np.ones(len(at), bool)
    for k in range(w):
        same &= code[at + k] == t.code[t.start[place] + k]
    return parent[at[same]], t.item[place[same]], at[same]


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a stored text begins and ends, as characters. Called for documents with a hit only."""
    start, end, inside = [], [], False
    for k, c in enumerate(text):
        for x in unicodedata.normalize("NFKD", c.lower()):
            kind = unicodedata.category(x)[0]
            if kind == "M":
                continue
            if kind in "LN":
                if not inside:
                    start.append(k)
                    end.append(k + 1)
                end[-1] = k + 1
            inside = kind in "LN"
    return np.array(start, np.int64), np.array(end, np.int64)


def _spans(text: str, places: np.ndarray, items: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(item, start, end) in characters: overlapping and touching windows of an item are one span."""
    start, end = word_places(text)
    out = []
    for item in np.unique(items):
        p = np.unique(places[items == item])
        edge = np.flatnonzero(np.r_[True, np.diff(p) > window])
        for a, z in zip(p[edge], np.r_[p[edge[1:] - 1], p[-1]]):
            out.append((int(item), int(start[a]), int(end[z + window - 1])))
    return out


def _leak_batches(shared, spans: bool):
    """(doc_id, item_id), with `spans` also (start, end), of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            size = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(size), 0
            while at < b.num_rows:
                step = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")) - at)
                parent, flat = arrow.exploded(words(b.column(1).slice(at, step)))
                keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
                code = pc.fill_null(pc.index_in(flat, t.words), -1).to_numpy(zero_copy_only=False)[keep]
                parent = parent[keep]
                row, item, place = _hits(t, parent, code)
                if len(row) and not spans:
                    pair = np.unique(np.stack([row + at, item]), axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair[0])), pa.array(pair[1])], ["doc_id", "item_id"])
                elif len(row):
                    first = np.searchsorted(parent, np.arange(step))
                    got = [(r, *s) for r in np.unique(row) for s in _spans(b.column(1)[int(r) + at].as_py(), place[row == r] - first[r], item[row == r], t.window)]
                    r, i, x, y = (np.array(c, np.int64) for c in zip(*got))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r + at)), pa.array(i), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["doc_id", "item_id", "start", "end"])
                at += step

    return run


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 12, spans: bool = False) -> DataFrame:
    """(doc_id, item_id): documents that share at least `window` consecutive words with an item.

    With `spans` (doc_id, item_id, start, end): the longest stretches of the stored text, in characters, that do. `docs` has one row per
    key. Null and empty texts, and items of fewer words than the window, never match; repeated items are found each. The characters of
    the test texts are counted before any is collected: up to MOST_CHARS are one broadcast table; more fall into parts by their key, and
    the documents are read once for each part, so a test set of any size is done exactly. One item alone must fit.
    """
    spark = docs.sparkSession
    real = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    chars = real.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-chars // MOST_CHARS))
    body = docs.select(F.col(key).cast("long"), text).filter(F.col(text).isNotNull())
    schema = "doc_id long, item_id long" + (", start int, end int" if spans else "")
    out = None
    for k in range(parts):
        got = (real if parts == 1 else real.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)).toArrow()
        t = Table(got.column(0).to_numpy(), pa.concat_arrays(got.column(1).chunks) if got.num_rows else pa.array([], pa.string()), window)
        found = body.mapInArrow(_leak_batches(spark.sparkContext.broadcast(t), spans), schema)
        out = found if out is None else out.union(found)
    return out


def _cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(text, spans.to_pylist()):
        if not s:
            out.append(t.as_py())
            continue
        t, at, kept = t.as_py(), 0, []
        for x in sorted(s, key=lambda x: x["start"]):
            if x["start"] > at:
                kept.append(t[at : x["start"]])
            at = max(at, x["end"])
        out.append(" ".join([*kept, t[at:]]) if kept else t[at:])
    return pa.array(out, pa.string())


def cleaned(docs: DataFrame, key: str, text: str, spans: DataFrame, drop_from: float = 0.5) -> DataFrame:
    """(doc_id, text, removed): every document without its leaked spans (`leaked` with spans), each replaced by a blank where text stands
    on both sides; a document of which at least `drop_from` of the characters leak is dropped. Others stay as they are, null and empty
    ones too. Spans of one document are few: bounded by its length over the window."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # overlapping spans of several items count once
    gathered = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), (s["n"] + F.greatest(x["end"] - F.greatest(s["at"], x["start"]), F.lit(0))).alias("n")))["n"]
    both = d.join(gathered, "doc_id", "left").withColumn("removed", F.coalesce(covered, F.lit(0)))
    stay = both.filter((F.col("removed") == 0) | (F.col("removed") < F.length("text") * drop_from))
    return stay.select("doc_id", F.arrow_udf(_cut_out, "string")("text", "spans").alias("text"), "removed")


def _leaked(spark: SparkSession, d: str, spans: bool = False) -> DataFrame:
    return leaked(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text", spans=spans)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, documents): in how many documents each leaked item stands."""
    return p9_found(spark, d).groupBy("item_id").count().withColumnRenamed("count", "documents")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id, start, end): where in the stored text."""
    return _leaked(spark, d, True)


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, removed): the corpus without leaked spans, and without the documents that are mostly leaks."""
    return cleaned(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", cut(_leaked(spark, d, True), "spans"))
