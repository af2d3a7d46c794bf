"""The corpus tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import folding, text
from scriptoria.operators.vectors import unit
from scriptoria.sources.tables import table

#: Shorter texts are left out of the corpus.
MIN_TEXT = 50
WIDTH = 64


def delivered_once(df: DataFrame, key: str = "row_id", *columns: str) -> DataFrame:
    """The different rows of a table whose rows may be delivered again unchanged: one per key, if they are.

    A hash aggregate on what is selected, without the sort that picking a first row would need.
    """
    return df.select(key, *columns).distinct()


def paragraphs(spark: SparkSession, d: str, *columns: str, least: int = MIN_TEXT, derived: dict[str, Column] | None = None) -> DataFrame:
    """Records whose text has at least `least` characters; a null text drops. The filter reaches the scan.

    `persons` comes clean, `issue` in one spelling. `derived` columns may use any column: they are made before deliveries are
    merged, so what they are made of needn't be shuffled.
    """
    df = table(spark, d, "paragraphs").filter(F.length("text") >= least)
    df = df.withColumns({"persons": text.clean_ids(F.col("persons")), "issue": text.issue_key(F.col("issue"))}).withColumns(derived or {})
    return delivered_once(df, "row_id", *[c for c in dict.fromkeys([*columns, *(derived or {})]) if c != "row_id"])


def lemmas(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, lemmas): canonical lemmas of every record, with repeats."""
    return table(spark, d, "concept_layer", "row_id", "lemmas").select("row_id", folding.canonical_list("lemmas").alias("lemmas"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, row_id, vec): usable vectors, scaled to length 1 in double precision."""
    df = table(spark, d, "para_vectors", "vec_id", "row_id", "embeddings").filter(F.size("embeddings") == WIDTH)
    return df.select("vec_id", "row_id", unit(F.col("embeddings"), WIDTH).alias("vec")).filter("vec IS NOT NULL")


def raw_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, vec): usable vectors as they are stored, of any length."""
    df = table(spark, d, "para_vectors", "row_id", "embeddings").filter(F.size("embeddings") == WIDTH)
    return df.filter(unit(F.col("embeddings"), WIDTH).isNotNull()).select("row_id", F.col("embeddings").alias("vec"))
