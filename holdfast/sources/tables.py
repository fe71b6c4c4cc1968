"""Reading and writing named tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.schemas import OVERRIDE


class DuplicateKey(ValueError):
    """A table holds two rows for one key."""


def read_table(spark: SparkSession, root: str, name: str,
               schema: T.StructType | None = None) -> DataFrame:
    """One named Parquet table; a declared schema skips footer inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(os.path.join(root, f"{name}.parquet"))


def query(spark: SparkSession, sql: str, **bindings: DataFrame) -> DataFrame:
    """Ad-hoc SQL over DataFrames bound to names, as `FROM {name}` in the text."""
    return spark.sql(sql, **bindings)


def utc(column: str | Column) -> Column:
    """A zone-less source timestamp as an instant in UTC (the session zone)."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("timestamp")


# ------------------------------------------------------------------------------- keys, order
def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    clash = duplicate_keys(df, keys).limit(1).collect()
    if clash:
        raise DuplicateKey(f"duplicate key {clash[0].asDict()} on {list(keys)}")


def write_sorted(df: DataFrame, path: str, sort_key: Sequence[str],
                 partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Range-partitioned, sorted zstd Parquet; a duplicate sort key is an error.

    File k holds keys below file k+1, so min/max statistics prune reads on the key.
    """
    require_unique(df, sort_key)
    order = [F.col(c).asc_nulls_last() for c in sort_key]
    ranged = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    (ranged.sortWithinPartitions(*order)
     .write.mode(mode).option("compression", "zstd").parquet(path))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by `order`, remaining columns as tiebreak.

    A `min` over a struct combines on the map side, so a key that repeats a billion times
    reaches the reducer as one row per input partition.
    """
    rest = [c for c in df.columns if c not in order]
    picked = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c)
                         for c in [*order, *rest]])).alias("row"))
    return picked.select(*[F.col(f"row.{c}.v").alias(c) for c in df.columns])


def merge_parts(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of parts (an existing table may be one), one row per key: an idempotent append."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return keep_first(merged, keys, order)


def write_by_day(df: DataFrame, path: str, day: str = "day", mode: str = "overwrite") -> None:
    """One directory per day, so that a day filter prunes whole directories."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(day).parquet(path)


# ------------------------------------------------------------------------------------ export
def csv_columns(df: DataFrame) -> DataFrame:
    """Report form: doubles as fixed six-decimal text."""
    cols = [F.col(f.name).cast("decimal(38,6)").cast("string").alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, sort_key: Sequence[str]) -> None:
    csv_columns(df).orderBy(*[F.col(c).asc_nulls_last() for c in sort_key]).write.mode(
        "overwrite").option("header", True).csv(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: row count and the sum of 48 hash bits per row.

    The sum does not depend on row order, partitioning or file layout.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 12), 16, 10)
    return df.select(bits.cast("decimal(38,0)").alias("bits")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("bits"), F.lit(0)).cast("string").alias("content_hash"))


# --------------------------------------------------------------------------------- overrides
def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """The append-only operator overrides; no folder yet means no overrides."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath):
        return spark.createDataFrame([], OVERRIDE)
    return spark.read.schema(OVERRIDE).json(path)


def append_overrides(records: DataFrame, path: str) -> None:
    """Append override records; a record that breaks the field bounds is an error."""
    bad = records.where(
        ~(F.length("reason").between(3, 500) & F.length("operator").between(1, 100)
          & (F.col("day") >= 0) & (F.length("decision_id") > 0))
    ).limit(1).collect()
    if bad:
        raise ValueError(f"override out of bounds: {bad[0].asDict()}")
    records.select(*OVERRIDE.fieldNames()).write.mode("append").json(path)
