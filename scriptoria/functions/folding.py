"""Canonical spelling of terms: lower case, NFKD without combining marks, single blanks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.text import BLANK


def lower(text: pa.Array) -> pa.Array:
    """Lower case; texts with a capital sigma go through Python, whose final form depends on place."""
    low = pc.utf8_lower(text)
    greek = pc.fill_null(pc.match_substring(text, "Σ"), False)
    if pc.any(greek).as_py():
        own = [x.lower() for x in text.filter(greek).to_pylist()]
        low = pc.replace_with_mask(low, greek, pa.array(own, low.type))
    return low


def fold(text: pa.Array) -> pa.Array:
    """Lower case, NFKD, no combining marks; null stays null."""
    return pc.replace_substring_regex(pc.utf8_normalize(lower(text), "NFKD"), r"\p{M}+", "")


def _folded(text: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(fold(text), f"[{BLANK}]+", " "), " ")


def _fold_one(text: pa.Array) -> pa.Array:
    return _folded(text)


def _fold_lists(lists: pa.Array) -> pa.Array:
    """Every element folded once per distinct spelling of the batch; null and empty ones go."""
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    flat = pc.take(_folded(coded.dictionary), coded.indices)
    keep = pc.fill_null(pc.not_equal(flat, ""), False)
    kept = parent[keep.to_numpy(zero_copy_only=False)]
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(np.bincount(kept, minlength=len(lists)), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat.filter(keep))


def canonical(x: str | Column) -> Column:
    """A term in canonical spelling; null stays null."""
    return F.arrow_udf(_fold_one, "string")(x)


def canonical_list(x: str | Column) -> Column:
    """A list's terms in canonical spelling, in order, with repeats; null lists become empty."""
    return F.arrow_udf(_fold_lists, "array<string>")(x)
