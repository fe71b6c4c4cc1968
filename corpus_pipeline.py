"""Training-corpus pipeline: language, near-duplicates, test items, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Cases: texts without a letter (null and empty ones among them) end at the first stage; of repeated
rows and rows of one component the smallest id stays, a null id last; an empty table passes all
stages empty; further columns are carried along to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontamination, language, neardup, packing, secrets
from holdfast.llm.queries import vocabulary_path
from holdfast.llm.tables import read_table
from holdfast.session import shared_dir

#: No SQL expresses the model stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without a letter go."""
    held_out = F.crc32(docs["doc_id"].cast("string")) % 3 == 1
    return language.keep_identified(docs, language.train(docs, learn=~held_out))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; n_chars follows the text."""
    kind = docs.schema["n_chars"].dataType
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(kind)).select(
        *docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences of 4096."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("language_id", identified), ("near_dedup", deduplicated),
          ("decontamination", decontaminated), ("secret_scans", redacted),
          ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
