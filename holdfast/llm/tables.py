"""Inputs and hand-overs shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


BATCH_KEY, DEFAULT_BATCH, TEXT_BATCH = (
    "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")
BYTES_KEY, DEFAULT_BYTES, BATCH_BYTES = (
    "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def small_batches(spark: SparkSession) -> None:
    """Whole texts make wide rows: hand Python fewer of them at once, unless the session says
    otherwise. A batch lies beside the heap several times over while it is built and sent."""
    if spark.conf.get(BATCH_KEY) == DEFAULT_BATCH:
        spark.conf.set(BATCH_KEY, TEXT_BATCH)
    if spark.conf.get(BYTES_KEY, None) in (None, DEFAULT_BYTES):
        spark.conf.set(BYTES_KEY, BATCH_BYTES)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns never matter."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def packed_rows(docs: DataFrame, key: str) -> DataFrame:
    """(row, key): whole rows as one struct, so that no column name can clash in a join."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       docs[key].alias("key"))
