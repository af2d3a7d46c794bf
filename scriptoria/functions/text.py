"""Column expressions on text, identifiers and delimited lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode category Z, tab, line feed, carriage return, as a character class.
BLANK = r"\p{Z}\t\n\r"
#: What stands before and after a whole word. Letters of any script count, which `\\b` doesn't see everywhere.
_BEFORE, _AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{BLANK}]+|[{BLANK}]+$", "")


def clean_id(x: Column) -> Column:
    """A pointer without blanks and leading #; null if nothing is left."""
    inner = F.regexp_replace(F.regexp_replace(x, f"^[{BLANK}]*#*[{BLANK}]*", ""), f"[{BLANK}]+$", "")
    return F.nullif(inner, F.lit(""))


def clean_ids(xs: Column) -> Column:
    """Clean pointers of a list, in order, with repeats; a null list is empty."""
    return F.coalesce(F.filter(F.transform(xs, clean_id), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def pointer_list(x: Column) -> Column:
    """Clean pointers of a blank-separated attribute; repeats stay."""
    return clean_ids(F.split(x, r"\s+"))


def split_ids(x: Column, sep: str = ";") -> Column:
    """The distinct trimmed parts of a delimited string; null is empty."""
    parts = F.transform(F.split(x, sep), trimmed)
    return F.coalesce(F.array_distinct(F.filter(parts, lambda p: p != "")), F.array().cast("array<string>"))


def year(x: Column) -> Column:
    """The year of an ISO date, negative before our era; null if it isn't one."""
    return F.regexp_extract(F.trim(x), r"^(-?\d+)(-|$)", 1).try_cast("int")


def issue_key(x: Column) -> Column:
    """An issue label in one spelling: lower case, trimmed, with underscores."""
    return F.regexp_replace(F.lower(trimmed(x)), " +", "_")


def issue_column(issue: str) -> str:
    """The column name of an issue's share."""
    return "prop_" + issue.replace("-", "_")


def has_term(text: Column, terms: Iterable[str]) -> Column:
    """Whether a whole word (or phrase) of `terms` stands in the text, whatever its case. Accents matter.

    Terms are patterns, not escaped. A null text holds nothing; without terms nothing is held.
    """
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){_BEFORE}({'|'.join(terms)}){_AFTER}")


def entity_tags(text: Column, patterns: Mapping[str, str]) -> Column:
    """The ids whose pattern stands as a whole word in the text, in the mapping's order."""
    hits = [F.when(has_term(text, [p]), F.lit(k)) for k, p in patterns.items()]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def words(text: Column, least: int = 4) -> Column:
    """The distinct lower-case words of at least `least` letters, letters only."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: w.rlike(rf"^\p{{L}}{{{least},}}$")))


def open_words(text: Column) -> Column:
    """The distinct lower-case words of three letters and more of a ';' list, with their accents. Stop words are the caller's to take out."""
    return words(F.translate(text, ";", " "), 3)


def excerpt(text: Column, most: int = 280) -> Column:
    """The text on one line, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def keep_valid(ids: Column, known: Column) -> Column:
    """The ids that the inventory has, in order."""
    return F.filter(ids, lambda x: F.array_contains(known, x))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 of two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def cache_key(*parts: Column) -> Column:
    """A digest of parts that no other split of the same characters shares."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def keyed(seed: str, *parts: Column) -> Column:
    """A pseudo-random hexadecimal key of a row: the same in any engine, order and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def keyed_int(seed: str, *parts: Column) -> Column:
    """`keyed` as a number of 32 bits."""
    return F.conv(F.substring(keyed(seed, *parts), 1, 8), 16, 10).cast("long")
