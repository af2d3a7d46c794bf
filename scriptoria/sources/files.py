"""Plain files: texts, tables, settings, and what is written."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.ranks import numbered
from scriptoria.plans.lineage import cut


def texts(spark: SparkSession, path: str, least_files: int = 0) -> DataFrame:
    """(doc, folder, text) of every */*.txt; undecodable bytes become the replacement character.

    Fewer than `least_files` files is an error.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    if least_files and raw.select("path").count() < least_files:
        raise ValueError(f"fewer than {least_files} texts in {path}")
    decode = F.arrow_udf(_decoded, "string")
    return raw.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), decode("content").alias("text"))


def _decoded(raw):
    return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def csv(spark: SparkSession, path: str, schema: str | None = None, keep_na: bool = True) -> DataFrame:
    """A CSV with header and quoted line breaks; a byte order mark is no part of the first name.

    With `keep_na`, words such as 'nan' stay words; without, they are null.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    r = r.schema(schema) if schema else r
    df = r.csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("﻿"))
    if not keep_na:
        # fixed values: words read as missing
        na = ["", "nan", "NaN", "NA", "N/A", "null", "NULL", "None"]
        df = df.select(*[F.when(~F.col(c).isin(na), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def settings(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file over many lines."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): the lower-case alphabetic words of a list; blank lines and # comments are skipped."""
    line = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    word = line.select(F.explode(F.split(F.lower(F.trim("value")), r"\s+")).alias("word"))
    return word.filter(F.col("word").rlike(r"^\p{L}+$")).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """One-row settings or provenance as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Texts of one leaf of a fingerprint.
FAN = 4096


def _leaf_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, rank, text) in order to (g, h, n): a digest of each group's texts joined by line feeds, updated text by text."""
    now, digest, n, out = None, None, 0, []
    for b in batches:
        for g, text in zip(b.column(0).to_pylist(), b.column(2)):
            raw = text.as_buffer() if text.is_valid else b"\x00"
            if g != now:
                if digest:
                    out.append((now, digest.hexdigest(), n))
                now, digest, n = g, hashlib.sha256(raw), 1
            else:
                digest.update(b"\n")
                digest.update(raw)
                n += 1
    if digest:
        out.append((now, digest.hexdigest(), n))
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.string(), pa.int64()))], ["g", "h", "n"])


def _digests(ordered: DataFrame, text: str) -> DataFrame:
    """(rank, h, n): the next level of (rank, text)."""
    grouped = ordered.select(F.floor((F.col("rank") - 1) / FAN).alias("g"), "rank", text)
    sorted_ = grouped.repartition("g").sortWithinPartitions("g", "rank")
    return sorted_.mapInArrow(_leaf_digests, "g long, h string, n long").select((F.col("g") + 1).alias("rank"), "h", "n")


def fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """(n_rows, digest) of a corpus in the order of its keys; a null text counts as a NUL character.

    Of up to FAN texts it is the SHA-256 of the texts joined by line feeds. Of more, groups of FAN texts are digested so, then the
    digests of groups, until one is left: ordered, but no task reads more than FAN texts, one at a time. An empty corpus gives no row.
    """
    level = cut(_digests(numbered(df.select(key, text), F.col(key)), text), "digests")
    total = level.agg(F.sum("n").alias("n_rows"))
    while level.count() > 1:
        level = cut(_digests(level.select("rank", "h"), "h"), "digests")
    return level.join(total).select("n_rows", F.col("h").alias("digest"))


def is_current(df: DataFrame, key: str, text: str, manifest: DataFrame) -> bool:
    """Whether cached vectors with this manifest (n_rows, digest) are those of the corpus."""
    return not fingerprint(df, key, text).join(manifest.select("n_rows", "digest"), ["n_rows", "digest"], "left_anti").head(1)
