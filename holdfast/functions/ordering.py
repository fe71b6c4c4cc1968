"""Global order without a one-task sort: row numbers, positions, mid-ranks, tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import stage

GRAIN = 4096


def number_rows(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Consecutive numbers 1..n in a total order (surrogate keys).

    Range-partitioned and sorted once; a row's number is its place in its partition plus the
    rows of all earlier partitions. The hand-over to storage pins the partition boundaries, so
    both reads see the same ones. Only the per-partition counts meet in a single task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id())
    pinned = stage(ranged, "numbered")
    part = F.shiftright("_id", 33)
    counts = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off") + 1
    return pinned.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        out, place).drop("_id", "_part", "_off")


def _grain(value: Column, low: float, high: float) -> Column:
    """Order-preserving coarse cell of a bounded double."""
    return F.floor((value - F.lit(low)) / F.lit(high - low) * GRAIN).cast("long")


def _before(cells: DataFrame, group: Sequence[str], count: str) -> DataFrame:
    """Rows before each (cell, value[, slice]) of its group, by two short running sums."""
    coarse = cells.groupBy(*group, "_cell").agg(F.sum(count).alias("_cn"))
    over = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = coarse.select(*group, "_cell", F.coalesce(F.sum("_cn").over(over), F.lit(0))
                         .alias("_base"))
    keys = [c for c in ("_value", "_slice") if c in cells.columns]
    fine = Window.partitionBy(*group, "_cell").orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, -1)
    return cells.join(base, [*group, "_cell"]).withColumn(
        "_before", F.col("_base") + F.coalesce(F.sum(count).over(fine), F.lit(0))).drop("_base")


def value_ranks(df: DataFrame, group: Sequence[str], value: str, low: float = 0.0,
                high: float = 1.0, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct value): n, mid-rank, and the asked sums.

    Equal values collapse on the map side first, so a value held by a third of all rows is one
    row per input partition.
    """
    sums = sums or {}
    cells = df.groupBy(*group, F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    ).withColumn("_cell", _grain(F.col("_value"), low, high))
    placed = _before(cells, group, "n")
    mid = F.col("_before") + (F.col("n") + 1) / F.lit(2.0)
    return placed.select(*group, F.col("_value").alias(value), "n", mid.alias("mid_rank"), *sums)


def positions(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str],
              low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Add `position` (1-based, by value then by the hash of `tie`) and group size `n_rows`.

    Rows are numbered inside (group, value, hash slice) cells; equal values spread over
    slices, so no task sorts one hot value.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(t).cast("string") for t in tie]))
    slices = F.shiftright(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), 2)
    rows = df.withColumn("_value", F.col(value)).withColumn("_tie", digest).withColumn(
        "_slice", slices).withColumn("_cell", _grain(F.col(value), low, high))
    cells = rows.groupBy(*group, "_cell", "_value", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    placed = _before(cells, group, "_n").select(*group, "_value", "_slice", "_before")
    sizes = cells.groupBy(*group).agg(F.sum("_n").alias("n_rows"))
    inner = Window.partitionBy(*group, "_value", "_slice").orderBy("_tie", *tie)
    return (
        rows.join(placed, [*group, "_value", "_slice"]).join(sizes, list(group))
        .withColumn("position", F.col("_before") + F.row_number().over(inner))
        .drop("_value", "_tie", "_slice", "_cell", "_before")
    )


def tile(position: Column, n_rows: Column, bins: int) -> Column:
    """1-based equal-count bin of a position; the first `n mod bins` bins hold one row more."""
    small = F.floor(n_rows / F.lit(bins)).cast("long")
    extra = n_rows % F.lit(bins)
    edge = extra * (small + 1)
    return F.when(position <= edge, F.ceil(position / (small + 1))).otherwise(
        extra + F.ceil((position - edge) / F.greatest(small, F.lit(1)))).cast("long")
