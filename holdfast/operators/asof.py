"""Backward, inclusive as-of join that survives hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
              values: Sequence[str], slice_seconds: int = 3600) -> DataFrame:
    """Every left row with the `values` of the latest right row at or before `left_ts`.

    Time is cut into slices, so the sort runs per (key, slice) rather than per key: a key
    holding a third of all rows spreads over all its slices. What a slice inherits from
    earlier ones is a single row per (key, slice).
    """
    on = list(on)
    span = F.lit(slice_seconds * 1_000_000)
    lcols = left.columns
    cut = lambda c: F.floor(F.unix_micros(c) / span)
    pick = F.struct(F.col(right_ts).alias("ts"), *[F.col(v).alias(v) for v in values])
    r = right.select(*on, F.col(right_ts).alias("_ts"), cut(right_ts).alias("_slice"),
                     pick.alias("_hit"))
    per_slice = r.groupBy(*on, "_slice").agg(F.max("_hit").alias("_tail"))
    l = left.select(*on, F.col(left_ts).alias("_ts"), cut(left_ts).alias("_slice"),
                    F.struct(*[F.col(c) for c in lcols]).alias("_row"))

    # inside a slice: right rows sort before left rows of the same instant (inclusive)
    both = r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)).withColumn(
        "_side", F.lit(0)).unionByName(
        l.withColumn("_hit", F.lit(None).cast(r.schema["_hit"].dataType)).withColumn(
            "_side", F.lit(1)))
    inside = Window.partitionBy(*on, "_slice").orderBy("_ts", "_side").rowsBetween(
        Window.unboundedPreceding, 0)
    seen = both.withColumn("_own", F.max("_hit").over(inside)).where("_side = 1").select(
        *on, "_slice", "_row", "_own")

    # across slices: the last right row of any earlier slice
    marks = per_slice.unionByName(
        l.select(*on, "_slice").distinct().withColumn(
            "_tail", F.lit(None).cast(r.schema["_hit"].dataType)))
    before = Window.partitionBy(*on).orderBy("_slice").rangeBetween(
        Window.unboundedPreceding, -1)
    carried = marks.groupBy(*on, "_slice").agg(F.max("_tail").alias("_tail")).withColumn(
        "_carry", F.max("_tail").over(before)).select(*on, "_slice", "_carry")
    joined = seen.join(carried, [*on, "_slice"], "left")
    hit = F.coalesce("_own", "_carry")
    return joined.select(*[F.col(f"_row.{c}").alias(c) for c in lcols],
                         *[hit[v].alias(v) for v in values])
