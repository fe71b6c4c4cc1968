"""Unicode normalisation of identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def _is_ascii(value: Column) -> Column:
    return value.rlike(r"\A[\x00-\x7F]*\z")


def normalize_identifier(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """NFC form of `column`: no case folding, no trimming.

    ASCII text is already in normal form, so only the distinct non-ASCII spellings visit
    Python; they come back through a join on the spelling.
    """
    out = out or column
    spelled = (
        df.where(~_is_ascii(F.col(column)))
        .select(F.col(column).alias("_spelling")).distinct()
        .withColumn("_nfc", _nfc("_spelling"))
    )
    joined = df.join(spelled, df[column] == spelled["_spelling"], "left")
    return joined.withColumn(out, F.coalesce("_nfc", column)).drop("_spelling", "_nfc")
