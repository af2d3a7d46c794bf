"""Deltas of many runs over rows that workers hold: `probe.deltas` without moving a vector per run.

A run draws up to n members of each side, so shuffling their vectors costs as much for a small corpus as for a large one. Here rows are
packed once, workers hold their keys and vectors, and only who is drawn, one bit for each row and run, is shuffled: a run is
then one task's arrays. Draws and pairs are those of `sampling.first_places` and `sampling.cross_pairs`. More than `HELD` bytes aren't held.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import digests
from scriptoria.operators.probe import CLASSES
from scriptoria.plans.lineage import cut

#: Bytes of vectors that a worker holds at most, and of one broadcast.
HELD, PART = 400 << 20, 64 << 20
#: Pairs whose vectors are gathered at once.
PIECE = 4096


def _flat(c: pa.Array) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False)


def _packed(flags: list[str], drawn: list[str], runs: int):
    """A batch of rows as one row of arrays; bits: for each column of `drawn` and each run, which rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            marks = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in flags])
            bits = np.zeros((len(drawn), runs, n), bool)
            for k, c in enumerate(drawn):
                lists = b.column(c)
                bits[k, _flat(lists), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))] = True
            raw = _flat(b.column("vec"))
            cells = [uuid.uuid4().hex, n, *(np.ascontiguousarray(x).tobytes() for x in (b.column("key").to_numpy().astype(np.int64), np.packbits(marks, axis=1), np.packbits(bits, axis=2), raw)), str(raw.dtype)]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, _PACKED)], schema=_PACKED)

    return run


_PACKED = pa.schema([("chunk", pa.string()), ("n", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("bits", pa.binary()), ("vec", pa.binary()), ("kind", pa.string())])
_SCHEMA = "chunk string, n int, ids binary, marks binary, bits binary, vec binary, kind string"


def _by_run(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, n, bits in zip(*(b.column(k).to_pylist() for k in range(3))):
                m = np.frombuffer(bits, np.uint8).reshape(-1, runs, -(-n // 8))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(runs, dtype=np.int32)), pa.array([chunk] * runs), pa.array([m[:, r].tobytes() for r in range(runs)])], ["run", "chunk", "bits"])

    return run


class Rows:
    """What a worker holds: keys, flags and vectors of all rows, in order of chunks."""

    def __init__(self, parts: list[dict]):
        self.chunks = [c for p in parts for c in p["chunks"]]
        self.sizes = [n for p in parts for n in p["sizes"]]
        self.ids = np.concatenate([p["ids"] for p in parts])
        self.marks = np.concatenate([p["marks"] for p in parts], axis=1)
        self.digits = digests.decimals(self.ids)
        self.parts, self.first = [p["vec"] for p in parts], np.cumsum([0] + [len(p["vec"]) for p in parts])
        self.scale = []
        for v in self.parts:  # lengths in double precision, without a copy of all
            self.scale.append(np.concatenate([np.sqrt((x * x).sum(1)) for x in (v[k : k + PIECE].astype(np.float64) for k in range(0, len(v), PIECE))] or [np.zeros(0)]))
        self.scale = np.concatenate(self.scale)

    def vectors(self, at: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.parts[0][at].astype(np.float64)
        out, own = np.empty((len(at), self.parts[0].shape[1])), np.searchsorted(self.first, at, "right") - 1
        for k in np.unique(own):
            mine = np.flatnonzero(own == k)
            out[mine] = self.parts[k][at[mine] - self.first[k]]
        return out

    def cosines(self, x: np.ndarray, y: np.ndarray, digits: int = 9) -> np.ndarray:
        got = [np.einsum("ij,ij->i", self.vectors(x[k : k + PIECE]), self.vectors(y[k : k + PIECE])) for k in range(0, len(x), PIECE)]
        return np.round(np.concatenate(got) / (self.scale[x] * self.scale[y]), digits) if got else np.zeros(0)

    def drawn(self, chunks: list[str], bits: list[bytes], kinds: int) -> np.ndarray:
        of = dict(zip(chunks, bits))
        one = lambda c, n: np.unpackbits(np.frombuffer(of[c], np.uint8).reshape(kinds, -1), axis=1, count=n)
        return np.concatenate([one(c, n) for c, n in zip(self.chunks, self.sizes)], axis=1).astype(bool) if kinds else np.zeros((0, len(self.ids)), bool)

    def places(self, members: np.ndarray, h: np.ndarray, n: int, prefix: str) -> np.ndarray:
        """The first n of `members`, row numbers, in the order of their keyed hashes."""
        own = h[members]
        if len(own) > n:
            near = own <= np.partition(own, n - 1)[n - 1]
            members, own = members[near], own[near]
        order = np.argsort(own, kind="stable")
        own = own[order]
        if (own[1:] == own[:-1]).any():  # 64 bits don't tell some apart
            full = {k: (hashlib.md5(f"{prefix}{self.ids[k]}".encode()).hexdigest(), int(self.ids[k])) for k in members.tolist()}
            return np.array(sorted(members.tolist(), key=full.__getitem__), np.int64)[:n]
        return members[order][:n]


def rows_of(held: list) -> Rows:
    """The rows of broadcasts, made once per worker."""
    first = held[0].value
    if "rows" not in first:
        first["rows"] = Rows([b.value for b in held])
    return first["rows"]


def _run(held: list, columns: list[str], sets: dict[str, tuple[str, str]], excluded: str, flags: list[str], n: int, seed: str):
    def run(t: pa.Table) -> pa.Table:
        rows, name = rows_of(held), t.column("run")[0].as_py()
        is_in = dict(zip(columns, rows.drawn(t.column("chunk").to_pylist(), t.column("bits").to_pylist(), len(columns)))) | dict(zip(flags, rows.marks))
        kinds = {k: {"a": is_in[a], "b": is_in[b], "d": ~(is_in[a] | is_in[b] | is_in[excluded])} for k, (a, b) in sets.items()}
        cos: dict[str, dict[str, np.ndarray]] = {k: {} for k in sets}
        for c, pair in CLASSES.items():
            placed = []
            for side, kind in enumerate(pair):
                prefix, h = f"{seed}|{name}/{c}|{side}|", np.empty(len(rows.ids), np.uint64)
                some = np.flatnonzero(np.logical_or.reduce([x[kind] for x in kinds.values()]))  # sets share these hashes
                h[some] = digests.first_bits(prefix, rows.digits[some])
                placed.append({k: rows.places(np.flatnonzero(x[kind]), h, n, prefix) for k, x in kinds.items()})
            draws = None
            for k in sets:
                left, right = placed[0][k], placed[1][k]
                p, q = len(left), len(right)
                if not p or not q:
                    cos[k][c] = np.zeros(0)
                    continue
                at = np.arange(min(n, p * q))
                if p * q <= n:
                    x, y = at // q, at % q
                else:
                    if draws is None:
                        draws = (digests.first_bits(f"{seed}|{name}/{c}|", digests.decimals(np.arange(n))) >> np.uint64(32)).astype(np.int64)
                    x, y = at % p, draws % q
                x, y = left[x], right[y]
                met = rows.ids[x] != rows.ids[y]
                cos[k][c] = np.sort(rows.cosines(x[met], y[met]))
        out = {"set": [], "run": [], **{f"n_{c}": [] for c in CLASSES}, "delta": []}
        for k, of in cos.items():
            a, b = of.values()
            if len(a) or len(b):
                u = (np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).sum() / 2
                for c, v in zip(out, (k, str(name), len(a), len(b), round(2 * float(u) / (len(a) * len(b)) - 1, 6) if len(a) and len(b) else None)):
                    out[c].append(v)
        return pa.table(out, schema=pa.schema([("set", pa.string()), ("run", pa.string()), *((f"n_{c}", pa.int64()) for c in CLASSES), ("delta", pa.float64())]))

    return run


def deltas(rows: DataFrame, sets: dict[str, tuple[str, str]], flags: list[str], excluded: str, runs: int, n: int, seed: str) -> DataFrame | None:
    """(set, run, n_ab, n_ad, delta): `probe.deltas` of several sets of runs, or None if the rows' vectors are more than `HELD` bytes.

    `rows` is (key, vec, ..): vectors of one width that needn't be of length 1, boolean `flags`, and arrays of runs. `sets` names for each
    set the columns, flags or runs, of A and of B; D is every other row that isn't `excluded`, a flag. Sets share their seed.
    """
    spark = rows.sparkSession
    columns = sorted({c for pair in sets.values() for c in pair} - set(flags))
    packed = cut(rows.select("key", "vec", *flags, *columns).mapInArrow(_packed(flags, columns, runs), _SCHEMA), "packed")
    sizes = [tuple(r) for r in packed.select("chunk", F.length("vec"), "kind").orderBy("chunk").collect()]  # a row for each batch of rows
    if sum(s for _, s, _ in sizes) > HELD:
        return None
    schema = "set string, run string, " + "".join(f"n_{c} long, " for c in CLASSES) + "delta double"
    if not sizes:
        return spark.createDataFrame([], schema)
    held, at = [], 0
    while at < len(sizes):
        last, size = at, 0
        while last < len(sizes) and (last == at or size + sizes[last][1] <= PART):
            size, last = size + sizes[last][1], last + 1
        got = packed.filter(F.col("chunk").between(sizes[at][0], sizes[last - 1][0])).select("chunk", "n", "ids", "marks", "vec").orderBy("chunk").toArrow()
        of = lambda c, t=got: [memoryview(x.as_buffer()) for x in t.column(c)]
        n_of = got.column("n").to_pylist()
        vec = np.concatenate([np.frombuffer(x, kind).reshape(k, -1) for x, k, (_, _, kind) in zip(of("vec"), n_of, sizes[at:last])])
        marks = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8).reshape(len(flags), -1), axis=1, count=k) for x, k in zip(of("marks"), n_of)], axis=1).astype(bool)
        held.append(spark.sparkContext.broadcast({"chunks": got.column("chunk").to_pylist(), "sizes": n_of, "ids": np.concatenate([np.frombuffer(x, np.int64) for x in of("ids")]), "marks": marks, "vec": vec}))
        at = last
    each = packed.select("chunk", "n", "bits").mapInArrow(_by_run(runs), "run int, chunk string, bits binary")
    # a number given isn't coalesced: the bits are few bytes, but each run is much work
    return each.repartition(max(1, runs // 4), "run").groupBy("run").applyInArrow(_run(held, columns, sets, excluded, flags, n, seed), schema)
