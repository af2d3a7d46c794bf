"""Encoding of the whole corpus with a public byte-level BPE (problem 8), by content-defined chunk reuse.

A rolling hash over the bytes before a place decides, by content alone, where a text is cut, so documents that share passages
share chunks. Cuts stand before a single blank between two signs, where the vocabulary's splitting pattern always begins a new
piece: such joins are exact as they are. Only stretches of LONG bytes without such a cut are cut elsewhere, at rare hash values.

Digests of chunks, and nothing else of the texts, are counted over the corpus. Those that occur more than once are kept in a
Bloom filter of fixed size, which is broadcast. A document without any shared chunk is encoded whole where it is read. Of the
others the chunks of their own are encoded in place as well; each shared one is encoded once for the whole corpus and goes back
to its documents by its digest. What lies between two exact joins and was cut elsewhere is decoded again from the vocabulary and
re-encoded in one piece, which is what the whole text would give. A false hit of the filter only means that a chunk takes the way
of the shared ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.plans.lineage import cut
from scriptoria.sources.tables import table

#: Bytes that the rolling hash sees; one in SAFE good places is a cut.
SEEN, SAFE = 12, 32
#: A stretch of so many bytes without a cut is cut at one in ANY of its characters.
LONG, ANY = 1 << 16, 1 << 13
#: Bytes of text that are cut at once.
PIECE = 1 << 21
#: Bits of the filter of shared chunks (8 MB, however many there are), and bits per chunk.
BITS, EACH = 1 << 26, 4
_MUL = np.cumprod(np.full(SEEN, 0xD1342543DE82EF95, np.uint64))


def _hash(raw: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the SEEN bytes before each place, as far as its text reaches."""
    where = at[:, None] - np.arange(1, SEEN + 1)
    x = np.where(where >= first[:, None], raw[np.maximum(where, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    h = (x * _MUL).sum(1, dtype=np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def cuts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of texts begin (texts' first places included), whether that join is exact, and the text of each.

    `raw` holds the texts' UTF-8 bytes, `ends` their boundaries, one more than texts.
    """
    n = len(raw)
    at = np.flatnonzero(raw[1 : n - 1] == 32) + 1 if n > 2 else np.zeros(0, np.int64)
    before, after = raw[at - 1], raw[at + 1]
    # plain signs, and letters whose first byte is C3: no blank is among them
    good = (((before > 32) & (before < 127)) | ((before >= 128) & (raw[np.maximum(at - 2, 0)] == 0xC3))) & (((after > 32) & (after < 127)) | (after == 0xC3))
    at = at[good]
    row = np.searchsorted(ends, at, "right") - 1
    inside = (at > ends[row]) & (at + 1 < ends[row + 1])
    at, row = at[inside], row[inside]
    chosen = _hash(raw, at, ends[row]) % np.uint64(SAFE) == 0
    full = np.flatnonzero(np.diff(ends) > 0)
    start = np.concatenate([ends[full], at[chosen]])
    exact = np.ones(len(start), bool)
    order = np.argsort(start, kind="stable")
    start = start[order]
    gap = np.diff(np.r_[start, n])
    more = []
    for k in np.flatnonzero(gap > LONG):
        place = np.arange(start[k] + SEEN, start[k] + gap[k])
        place = place[(raw[place] & 0xC0) != 0x80]
        more.append(place[_hash(raw, place, np.full(len(place), start[k])) % np.uint64(ANY) == 1])
    if more:
        more = np.concatenate(more)
        start, exact = np.concatenate([start, more]), np.concatenate([exact, np.zeros(len(more), bool)])
        order = np.argsort(start, kind="stable")
        start, exact = start[order], exact[order]
    return start, exact, np.searchsorted(ends, start, "right") - 1


class Part:
    """A bounded part of a batch, cut into chunks with their digests."""

    def __init__(self, ids: pa.Array, text: pa.Array):
        at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = text.buffers()[2]
        self.ids, self.ends = ids, at - at[0]
        self.bytes = memoryview(data)[at[0] : at[-1]] if data is not None else memoryview(b"")
        self.start, self.exact, self.row = cuts(np.frombuffer(self.bytes, np.uint8), self.ends)
        self.stop = np.r_[self.start[1:], len(self.bytes)]
        self.keys = [hashlib.blake2b(self.bytes[a:b], digest_size=16).digest() for a, b in zip(self.start.tolist(), self.stop.tolist())]

    def text(self, a: int, b: int) -> str:
        return str(self.bytes[a:b], "utf-8")

    @staticmethod
    def of(b: pa.RecordBatch) -> Iterator[Part]:
        """Parts of (doc_id, text) without nulls."""
        text = b.column(1)
        size = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).astype(np.int64) if len(text) else np.zeros(0, np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(text):
            step = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")) - at)
            yield Part(b.column(0).slice(at, step), text.slice(at, step))
            at += step


def _bits(keys: np.ndarray) -> np.ndarray:
    """The filter's bits of each 16-byte key: EACH columns."""
    half = keys.view("<u8").reshape(-1, 2)
    return (half[:, :1] + half[:, 1:] * np.arange(EACH, dtype=np.uint64)) % np.uint64(BITS)


def _held(keys: list[bytes], words: np.ndarray) -> np.ndarray:
    at = _bits(np.frombuffer(b"".join(keys), np.uint8)) if keys else np.zeros((0, EACH), np.uint64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(1)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in Part.of(b):
            kinds, n = np.unique(np.frombuffer(b"".join(p.keys), "V16"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in kinds], pa.binary()), pa.array(n.astype(np.int64))], ["key", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """(key, n): how often each chunk of (doc_id, text) occurs, by its digest. Texts must not be null."""
    return docs.mapInArrow(_count_batches, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            at = np.unique(_bits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8)).ravel())
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])


def shared_filter(shared: DataFrame) -> np.ndarray:
    """The Bloom filter of (key): words are joined before they come to the driver, at most BITS / 64 of them."""
    got = shared.select("key").mapInArrow(_word_batches, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(BITS // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return words


def encoder(path: str | None = None):
    """The tiktoken encoding of a rank file; byte_bpe_50k by default."""
    import base64

    import public_tokenizers as known
    import tiktoken

    with open(path or known.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _whole_batches(path: str | None, shared):
    """(doc_id, ids) of the documents that have no shared chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, words = encoder(path), shared.value
        for b in batches:
            for p in Part.of(b):
                mixed = np.zeros(len(p.ids), bool)
                mixed[p.row[_held(p.keys, words)]] = True
                own = np.flatnonzero(~mixed)
                ids = [e.encode_ordinary(p.text(p.ends[k], p.ends[k + 1])) for k in own.tolist()]
                yield pa.RecordBatch.from_arrays([p.ids.take(pa.array(own)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


_PIECES = "doc_id long, pos int, exact boolean, key binary, chunk string, ids array<int>"


def _piece_batches(path: str | None, shared):
    """The pieces of documents that have shared chunks: those by key (with text where the task meets it first), all between them by ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, words, met = encoder(path), shared.value, set()
        for b in batches:
            for p in Part.of(b):
                hit = _held(p.keys, words)
                mixed = np.zeros(len(p.ids), bool)
                mixed[p.row[hit]] = True
                # runs of own chunks with exact joins are one piece
                same = np.r_[False, (p.row[1:] == p.row[:-1]) & ~hit[1:] & ~hit[:-1] & p.exact[1:]]
                first = np.flatnonzero(~same)
                last = np.r_[first[1:], len(hit)] - 1
                keep = mixed[p.row[first]]
                first, last = first[keep], last[keep]
                keys, chunks, ids = [], [], []
                for f, g in zip(first.tolist(), last.tolist()):
                    key, a, z = p.keys[f], p.start[f], p.stop[g]
                    keys.append(key if hit[f] else None)
                    chunks.append(p.text(a, z) if hit[f] and key not in met else None)
                    ids.append(None if hit[f] else e.encode_ordinary(p.text(a, z)))
                    if hit[f] and len(met) < PIECE:
                        met.add(key)
                yield pa.RecordBatch.from_arrays(
                    [p.ids.take(pa.array(p.row[first])), pa.array(first.astype(np.int32)), pa.array(p.exact[first]), pa.array(keys, pa.binary()), pa.array(chunks, pa.string()), pa.array(ids, pa.list_(pa.int32()))],
                    ["doc_id", "pos", "exact", "key", "chunk", "ids"],
                )

    return run


def _encode_batches(path: str | None):
    """(key, ids) of each key of the task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, met = encoder(path), set()
        for b in batches:
            keys, ids = [], []
            for key, chunk in zip(b.column(0).to_pylist(), b.column(1)):
                if key not in met:
                    met.add(key)
                    keys.append(key)
                    ids.append(e.encode_ordinary(chunk.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def _repair_batches(path: str | None):
    """Documents of (doc_id, parts: exact and ids in order) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = None
        for b in batches:
            parts = b.column(1)
            offs = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            flat = parts.flatten()
            exact = flat.field("exact").to_numpy(zero_copy_only=False)
            ids = flat.field("ids")
            at = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            at = at - at[0]
            loose = np.flatnonzero(~exact)
            if not len(loose):
                offsets = at[offs].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])
                continue
            e = e or encoder(path)
            run_of = np.cumsum(exact) - 1  # chunks of one run are re-encoded together
            begin = np.r_[np.flatnonzero(exact), len(exact)]
            out, size, last = [], np.diff(at[begin]), 0
            for r in np.unique(run_of[loose]):
                lo, hi = at[begin[r]], at[begin[r + 1]]
                out.append(values[last:lo])
                whole = np.array(e.encode_ordinary(e.decode_bytes(values[lo:hi].tolist()).decode()), np.int32)
                out.append(whole)
                size[r], last = len(whole), hi
            out.append(values[last:])
            where = np.r_[0, np.cumsum(size)]
            offsets = where[np.searchsorted(begin, offs)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))], ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text as stored, without special tokens.

    Each key is one document; null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
    A chunk that more than a 256th of all occurrences of shared chunks are is joined by broadcast (fewer than 256 of them), so no
    key of the shuffled join is hotter than that; its text is sent once by each task that reads it.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    full = d.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    nothing = d.filter(F.col("text").isNull() | (F.col("text") == "")).select("doc_id", F.array().cast("array<int>").alias("ids"))
    shared = cut(counted(full).filter("n > 1"), "shared")
    words = docs.sparkSession.sparkContext.broadcast(shared_filter(shared))
    whole = full.mapInArrow(_whole_batches(path, words), "doc_id long, ids array<int>")
    pieces = cut(full.mapInArrow(_piece_batches(path, words), _PIECES), "pieces")
    once = pieces.filter("chunk IS NOT NULL").select("key", "chunk").repartition("key").mapInArrow(_encode_batches(path), "key binary, ids array<int>")
    once = cut(once, "encoded")
    total = shared.agg(F.sum("n")).first()[0] or 0
    names = [r[0] for r in shared.filter(F.col("n") * 256 > total).select("key").collect()]
    is_hot = F.col("key").isin([F.lit(x) for x in names]) if names else F.lit(False)
    use = pieces.filter("key IS NOT NULL").select("doc_id", "pos", "exact", "key")
    got = use.filter(~is_hot).join(once.filter(~is_hot), "key")
    if names:
        got = got.unionByName(use.filter(is_hot).join(F.broadcast(once.filter(is_hot)), "key"))
    own = pieces.filter("key IS NULL").select("doc_id", "pos", "exact", "ids")
    parts = got.select("doc_id", "pos", "exact", "ids").union(own).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "exact", "ids"))).alias("parts"))
    return whole.union(parts.mapInArrow(_repair_batches(path), "doc_id long, ids array<int>")).union(nothing)


def reuse(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: chunks of all texts, different ones, occurrences of shared ones, and how many of all needn't be encoded."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col(text).isNotNull() & (F.col(text) != ""))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return counted(d).agg(n.alias("chunks"), F.count("*").alias("different"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared"), (n - F.count("*")).alias("saved"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
