"""Visually identical text with different characters (problem 7).

Texts of an Arrow batch are one array of code points. Lookup tables map a code point to what a reader sees:
its compatibility decomposition (not of raised, circled or fraction signs, which look unlike their parts), look-alike letters of other scripts as Latin ones, every blank as a space,
and nothing for characters without width, but for joiners between pictures, which change what is shown. Gathers and expansion offsets
apply the tables; marks are put in canonical order, blanks collapse, and base and mark compose again by a pair table, all without a call
per text. Texts that no table entry touches skip all that. Case, accents, letters, digits and punctuation stay as they are.

Which letters look alike is taken from the public table of confusable characters in the ICU library that Spark ships; where that
library is missing, from the short list here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.plans.lineage import cut
from scriptoria.sources.tables import table

# Letters of the Cyrillic and Greek scripts and what Latin letter looks the same in print.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ԍ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J", "ϲ": "c", "Ϲ": "C",
    "‐": "-", "‑": "-",
}
# Kinds of compatibility decomposition whose sign looks unlike its parts, and single signs that do.
UNLIKE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
UNLIKE_SIGNS = "ſ℀℁℅℆№℡℻"
_N = 0x110000
#: Records of one stored text that one task pairs.
SPLIT = 50_000


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter to the Latin letter it looks like, of the same case: the ICU library's confusables, beside LOOK_ALIKE.

    Two letters are alike if the library gives both the same skeleton. Only cased letters without a decomposition of their own are asked
    for, so digits, punctuation and accents are never merged; letters that stand for two Latin ones stay.
    """
    jvm = spark._jvm
    try:
        checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeleton = lambda x: checker.getSkeleton(0, x)
        latin = {(skeleton(x), x.isupper()): x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    except Exception:  # the class isn't there
        return dict(LOOK_ALIKE)
    found = {}
    for c in range(0x80, 0x20000):
        x = chr(c)
        if unicodedata.category(x) in ("Lu", "Ll") and not unicodedata.decomposition(x):
            to = latin.get((skeleton(x), unicodedata.category(x) == "Lu"))
            if to:
                found[x] = to
    return found | LOOK_ALIKE


#: Pictures: a joiner between two of them joins what is shown. First and last code points.
PICTURES = [(0x2190, 0x21FF), (0x2300, 0x23FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF)]
_JOINER, _KEPT = 0x200D, 0x10FFFD


def _tables(look_alike: dict[str, str]) -> dict[str, np.ndarray]:
    """Expansion start and length of each code point, the expansions, combining classes, the pair table, and which code points are touched."""
    own: dict[int, list[int]] = {}
    ccc = np.zeros(_N, np.uint8)
    look = {ord(k): ord(v) for k, v in look_alike.items()}
    compose: dict[int, int] = {}
    for c in range(_N):
        if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or 0x3400 <= c <= 0x9FFF or c >= 0x30000 and not 0xE0000 <= c < 0xE1000:
            continue  # syllables are done by rule, ideographs stay; nothing else stands there
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        ccc[c] = unicodedata.combining(ch)
        if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r":
            own[c] = [32]
            continue
        if cat == "Cf" or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F:
            own[c] = []
            continue
        # a sign that decomposes into a blank and a mark is a sign of its own
        unlike = unicodedata.decomposition(ch).startswith(UNLIKE) or ch in UNLIKE_SIGNS
        full = unicodedata.normalize("NFD" if unlike else "NFKD", ch)
        if full[0] == " " and len(full) > 1:
            full = ch
        got = [look.get(ord(x), ord(x)) for x in full]
        got = [x for x in got if not unicodedata.category(chr(x)) == "Cf"]
        if got != [c]:
            own[c] = got
        pair = unicodedata.decomposition(ch)
        if pair and pair[0] != "<" and len(parts := [int(x, 16) for x in pair.split()]) == 2 and unicodedata.normalize("NFC", ch) == ch:
            compose[(parts[0] << 21) | parts[1]] = c
    size = np.ones(_N, np.int32)
    start = np.full(_N, -1, np.int32)
    flat: list[int] = []
    for c, x in own.items():
        start[c], size[c] = len(flat), len(x)
        flat += x
    keys = np.array(sorted(compose), np.int64)
    t = {"start": start, "size": size, "flat": np.array(flat, np.int32), "ccc": ccc, "pair": keys, "made": np.array([compose[k] for k in keys.tolist()], np.int32)}
    # the second of a pair may join what is before it; syllables' parts do
    second = np.zeros(_N, bool)
    second[keys & ((1 << 21) - 1)] = True
    t["second"] = second
    # a code point that comes out of the tables as it went in touches nothing on its own
    touched = second | (ccc > 0)
    touched[0x1100:0x1200] = True
    asked = np.array(sorted(own), np.int32)
    cp, row = canonical(asked, np.arange(len(asked)), t)
    alone = np.bincount(row, minlength=len(asked)) == 1
    value = np.full(len(asked), -1, np.int64)
    value[row] = cp
    touched[asked] |= ~alone | (value != asked)
    touched[32] = False
    t["touched"] = touched
    return t


_CACHE: dict[tuple, dict[str, np.ndarray]] = {}


def canonical(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their rows (ascending) to those of the one form."""
    s = cp - 0xAC00
    syl = (s >= 0) & (s < 11172)
    if syl.any():  # Korean syllables fall apart by rule and are put together below
        n = np.where(syl, 2 + (s % 28 > 0), 1)
        first = np.cumsum(n) - n
        out, orow = np.repeat(cp, n), np.repeat(row, n)
        at = first[syl]
        out[at], out[at + 1] = 0x1100 + s[syl] // 588, 0x1161 + s[syl] % 588 // 28
        tail = syl & (s % 28 > 0)
        out[first[tail] + 2] = 0x11A7 + s[tail] % 28
        cp, row = out, orow
    joiner = np.flatnonzero(cp == _JOINER)
    if len(joiner):
        picture = np.zeros(len(cp) + 1, bool)
        for a, z in PICTURES:
            picture[:-1] |= (cp >= a) & (cp <= z)
        before, after = joiner - 1, joiner + 1
        before = np.where((before > 0) & (cp[before] >= 0xFE00) & (cp[before] <= 0xFE0F), before - 1, before)
        kept = (before >= 0) & picture[before] & picture[after]
        kept[kept] = (row[before[kept]] == row[joiner[kept]]) & (row[after[kept]] == row[joiner[kept]])
        cp = cp.copy()
        cp[joiner[kept]] = _KEPT
    n = t["size"][cp]
    if (n != 1).any() or (t["start"][cp] >= 0).any():
        src = np.repeat(np.arange(len(cp), dtype=np.int32), n)
        start = t["start"][cp]
        inside = np.arange(len(src), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        row = row[src]
        first = start[src]
        cp = np.where(first >= 0, t["flat"][np.maximum(first + inside, 0)] if len(t["flat"]) else 0, cp[src])
    # collapse blanks, and drop them at the ends
    blank = cp == 32
    edge = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    after = np.r_[False, blank[:-1]] & ~edge if len(row) else edge
    keep = ~(blank & (after | edge))
    cp, row = cp[keep], row[keep]
    if len(cp):
        last = np.r_[row[1:] != row[:-1], True]
        keep = ~((cp == 32) & last)
        cp, row = cp[keep], row[keep]
    # marks in canonical order within their run
    ccc = t["ccc"][cp]
    if len(cp) and (wrong := (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])).any():
        run = np.cumsum((ccc == 0) | np.r_[True, row[1:] != row[:-1]])
        order = np.lexsort((np.arange(len(cp)), ccc, run))
        cp, ccc = cp[order], ccc[order]
    # compose, one mark at a time: only where the second can join what is before it
    while len(cp) > 1:
        at = np.flatnonzero(t["second"][cp[1:]] | ((cp[1:] >= 0x1161) & (cp[1:] <= 0x11C2)))
        at = at[row[at + 1] == row[at]]
        if not len(at):
            break
        l_, v = cp[at].astype(np.int64), cp[at + 1].astype(np.int64)
        key = (l_ << 21) | v
        place = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        lv = (l_ >= 0x1100) & (l_ <= 0x1112) & (v >= 0x1161) & (v <= 0x1175)
        lvt = (l_ >= 0xAC00) & (l_ <= 0xD7A3) & ((l_ - 0xAC00) % 28 == 0) & (v > 0x11A7) & (v <= 0x11C2)
        hit = (t["pair"][place] == key) | lv | lvt
        made = np.where(lv, 0xAC00 + (l_ - 0x1100) * 588 + (v - 0x1161) * 28, np.where(lvt, l_ + v - 0x11A7, t["made"][place]))
        at, made = at[hit], made[hit]
        if not len(at):
            break
        # left to right: of hits in a row every second one waits
        run = np.cumsum(np.r_[True, np.diff(at) > 1])
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        turn = (np.arange(len(at)) - first[run - 1]) % 2 == 0
        at, made = at[turn], made[turn]
        cp = cp.copy()
        cp[at] = made
        keep = np.ones(len(cp), bool)
        keep[at + 1] = False
        cp, row = cp[keep], row[keep]
    return np.where(cp == _KEPT, _JOINER, cp), row


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the row of each, read from the UTF-8 buffer."""
    n = len(text)
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    bufs = text.buffers()
    at = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(bufs[2], np.uint8)[at[0] : at[-1]] if bufs[2] is not None and n else np.zeros(0, np.uint8)
    lead = (raw & 0xC0) != 0x80
    where = np.flatnonzero(lead)
    before = np.r_[0, np.cumsum(lead)]
    count = np.diff(before[np.asarray(at, np.int64) - at[0]]) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n, dtype=np.int32), count)
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.int32)
    assert len(cp) == len(where)
    return cp, row


def _encoded(cp: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, bytes]:
    """Bytes of each of n texts, and all of them."""
    wide = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    size = np.bincount(row, weights=wide, minlength=n).astype(np.int64)
    return size, cp.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def forms(text: pa.Array, look_alike: dict[str, str] = LOOK_ALIKE) -> pa.Array:
    """The one form of each text; null and empty stay."""
    name = tuple(sorted(look_alike.items()))
    if name not in _CACHE:
        _CACHE[name] = _tables(look_alike)
    t = _CACHE[name]
    cp, row = code_points(text)
    if not len(cp):
        return text.cast(pa.large_string())
    # texts that nothing touches, without blanks at the ends or in a row, are in their form
    edge = np.r_[True, row[1:] != row[:-1]]
    blank = cp == 32
    odd = t["touched"][cp] | (blank & (edge | np.r_[edge[1:], True] | np.r_[False, blank[:-1]]))
    touched = np.zeros(len(text), bool)
    touched[row[odd]] = True
    if not touched.any():
        return text.cast(pa.large_string())
    which = np.flatnonzero(touched)
    number = np.cumsum(touched, dtype=np.int32) - 1
    mine = touched[row]
    size, raw = _encoded(*canonical(cp[mine], number[row[mine]], t), len(which))
    offsets = np.r_[0, np.cumsum(size)]
    changed = pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw))
    return pa.compute.replace_with_mask(text.cast(pa.large_string()), pa.array(touched), changed)


def _form_batches(look_alike: dict[str, str]):
    """(id, .., form) of (id, .., text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # long texts: a few at a time
            text = b.column(b.num_columns - 1)
            size = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(size), 0
            while at < len(text):
                step = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")) - at)
                rest = [c.slice(at, step) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, forms(text.slice(at, step), look_alike).cast(pa.string())], [*b.schema.names[:-1], "form"])
                at += step

    return run


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, form): each text as a reader sees it. A null text gives null, an empty one ''."""
    look = look_alikes(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(_form_batches(look), "id long, form string")


def same_print(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_a, row_b): records whose stored texts differ but have one form; row_a < row_b.

    A record may be delivered repeatedly with the same text. Null texts, and texts empty as stored or as read, never
    count. Only 128-bit digests are shuffled, made in the JVM. Texts that are equal as stored are one class: pairs are made of
    differing classes, then of their records, so a stock line held by a third of the rows pairs with its soiled
    variants only.
    """
    look = look_alikes(df.sparkSession)
    digest = lambda c: F.unhex(F.md5(c))
    seen = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("long").alias("id"), digest(F.col(text)).alias("text"), F.col(text).alias("t"))
    seen = seen.mapInArrow(_form_batches(look), "id long, text binary, form string").filter("form <> ''").select("id", digest(F.col("form")).alias("form"), "text")
    held = cut(seen.distinct(), "forms")
    kinds = held.groupBy("form", "text").agg(F.count("*").alias("n"))
    mixed = kinds.groupBy("form").agg(F.min("text").alias("x"), F.max("text").alias("y")).filter("x <> y").select("form")
    mine = cut(held.join(mixed, "form", "left_semi"), "mixed")
    kind = mine.groupBy("form", "text").agg(F.count("*").alias("n"))
    # records of a class are split over parts: a stock line of many records meets each of its variants in every part
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    left = mine.join(kind.select("form", "text", parts.alias("parts")), ["form", "text"]).select("form", F.col("text").alias("x"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("p"))
    # (form, x, part) of every class, and the records of every other class of its form
    classes = kind.select("form", F.col("text").alias("x"), F.col("n").alias("n_x"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    other = classes.join(kind.select("form", F.col("text").alias("y"), F.col("n").alias("n_y")), "form").filter("n_x > n_y OR (n_x = n_y AND x < y)")
    right = other.join(mine.select("form", F.col("text").alias("y"), F.col("id").alias("q")), ["form", "y"]).select("form", "x", "part", "q")
    rows = left.join(right, ["form", "x", "part"]).filter("p <> q")
    return rows.select(F.least("p", "q").alias("row_a"), F.greatest("p", "q").alias("row_b")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_print(table(spark, d, "paragraphs", "row_id", "text"), "row_id", "text")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every record's text in its one form."""
    return one_form(table(spark, d, "paragraphs", "row_id", "text").distinct(), "row_id", "text").select(F.col("id").alias("row_id"), "form")
