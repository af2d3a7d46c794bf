"""Columnar helpers that run inside Arrow batches, without per-row string calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from scriptoria.functions.folding import fold, lower  # noqa: F401  the canonical spelling is the core's

#: Unicode category Z, tab, line feed, carriage return; as an RE2 and Java character class.
BLANK = r"\p{Z}\t\n\r"


def fold_item(text: pa.Array) -> pa.Array:
    """`fold` plus trimmed and collapsed blanks."""
    s = pc.replace_substring_regex(fold(text), f"[{BLANK}]+", " ")
    return pc.utf8_trim(s, " ")


def exploded(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row index and value of every element; a null or empty list has none."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def folded_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row indices, distinct clean items of the batch, and each remaining element's place among them."""
    parent, flat = exploded(lists)
    coded = flat.dictionary_encode()
    clean = fold_item(coded.dictionary).dictionary_encode()
    code = pc.take(clean.indices, coded.indices)
    names = clean.dictionary
    empty = pc.equal(names, "").to_numpy(zero_copy_only=False).astype(bool)
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = code >= 0
    if len(names):
        keep &= ~empty[np.maximum(code, 0)]
    return parent[keep], names, code[keep]


def lists(parent: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """The list of each of n rows from elements in row order."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(parent, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def hashes(names: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash of each string."""
    if not len(names):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
