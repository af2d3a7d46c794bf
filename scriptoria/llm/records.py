"""The value sets of the corpus tables: cleaned lemmas and cited persons, one row per record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import arrow
from scriptoria.sources.tables import table


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row_id", pa.int64()), ("items", pa.list_(pa.string()))])
    for b in batches:
        parent, names, code = arrow.folded_lists(b.column(1))
        yield arrow.batch(schema, b.column(0), arrow.lists(parent, names.take(pa.array(code)), b.num_rows))


def folded_items(df: DataFrame, key: str = "row_id", values: str = "lemmas") -> DataFrame:
    """(row_id, items): values lower-cased, NFKD without marks, blanks trimmed and collapsed.

    Repeats and order stay; null and empty elements go; a null list becomes an empty one.
    """
    return df.select(F.col(key).cast("long").alias("row_id"), F.col(values).alias("items")).mapInArrow(_fold_batches, "row_id long, items array<string>")


def clean_id(x: Column) -> Column:
    """Blanks trimmed, leading # removed, trimmed again."""
    b = arrow.BLANK
    return F.regexp_replace(F.regexp_replace(x, f"^[{b}]*#*[{b}]*", ""), f"[{b}]+$", "")


def id_items(df: DataFrame, key: str = "row_id", values: str = "persons") -> DataFrame:
    """(row_id, items) of pointer lists, one row per record however often it was delivered.

    A record without any id is left out: it can't count anywhere.
    """
    clean = F.filter(F.transform(F.col(values), clean_id), lambda x: x.isNotNull() & (x != ""))
    got = df.filter(F.size(values) > 0).select(F.col(key).cast("long").alias("row_id"), clean.alias("items"))
    return got.filter(F.size("items") > 0).distinct()


def lemmas(spark: SparkSession, d: str) -> DataFrame:
    return folded_items(table(spark, d, "concept_layer", "row_id", "lemmas"))


def persons(spark: SparkSession, d: str) -> DataFrame:
    return id_items(table(spark, d, "paragraphs", "row_id", "persons"))


def both(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_id, items) of either field."""
    return lemmas(spark, d).select(F.lit("lemmas").alias("field"), "*").union(persons(spark, d).select(F.lit("persons").alias("field"), "*"))


def total(spark: SparkSession, d: str) -> int:
    """N, the records of concept_layer: answered from the parquet footers."""
    return table(spark, d, "concept_layer").count()
