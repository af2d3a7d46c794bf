"""Texts to paragraphs: blank-line blocks, long ones split again at sentence ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _collected(sentences: Column, target: int) -> Column:
    """Sentences gathered until a piece has `target` characters; the rest is a piece too."""
    start = F.struct(F.lit("").alias("acc"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, sentence: Column) -> Column:
        acc = F.trim(F.concat_ws(" ", state["acc"], sentence))
        full = F.length(acc) >= target
        return F.struct(F.when(full, "").otherwise(acc).alias("acc"), F.when(full, F.concat(state["out"], F.array(acc))).otherwise(state["out"]).alias("out"))

    return F.aggregate(sentences, start, add, lambda s: F.when(s["acc"] != "", F.concat(s["out"], F.array(s["acc"]))).otherwise(s["out"]))


def segments(text: Column, whole: int = 1200, target: int = 700, least: int = 50) -> Column:
    """The paragraphs of a text, in order, of at least `least` characters.

    Lines of a block are joined by a blank. A block of up to `whole` characters stays; a longer one is split after . ! ? … and
    gathered to at least `target`. A null text has none.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    blocks = F.transform(F.split(F.array_join(lines, "\n"), r"\n\n+"), lambda b: F.regexp_replace(F.regexp_replace(b, r"^\n+|\n+$", ""), "\n", " "))
    blocks = F.filter(blocks, lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.when(F.length(b) <= whole, F.array(b)).otherwise(_collected(F.split(b, r"(?U)(?<=[.!?…])\s+"), target)))
    return F.filter(F.flatten(parts), lambda p: F.length(p) >= least)


def segmented(df: DataFrame, key: str, text: str, **sizes: int) -> DataFrame:
    """(key, place, text): one row per paragraph."""
    return df.select(key, F.posexplode(segments(F.col(text), **sizes)).alias("place", "text"))
