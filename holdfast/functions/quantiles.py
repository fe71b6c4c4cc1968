"""Exact medians by range counts: no task sorts or holds the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096


def weighted_medians(df: DataFrame, value: str, weights: Sequence[Column]) -> list[float | None]:
    """Median of an integer column under each weight (a count of copies), as the mean of the two
    middle copies; None without weight. Null values are left out.

    Each pass counts weights in CELLS equal cells of what range is left to a wanted rank, so three
    passes reach single integers for spans up to 6.8e10, and a pass sends CELLS rows per rank.
    """
    held = df.where(F.col(value).isNotNull())
    head = held.agg(F.min(value).alias("low"), F.max(value).alias("high"), *[
        F.sum(w).cast("long").alias(f"n{k}") for k, w in enumerate(weights)]).first()
    totals = [head[f"n{k}"] or 0 for k in range(len(weights))]
    # (weight, rank wanted from 0) -> (low, width of the range, copies below it)
    open_ = {(k, rank): (head["low"], head["high"] - head["low"] + 1, 0)
             for k, n in enumerate(totals) if n for rank in ((n - 1) // 2, n // 2)}
    found: dict[tuple[int, int], int] = {}
    while open_:
        asked = list(open_.items())
        tries = F.array(*[F.struct(
            F.lit(t).alias("t"), F.floor((F.col(value) - F.lit(low)) / F.lit(-(-width // CELLS)))
            .cast("long").alias("cell"), weights[k].alias("w"),
            F.col(value).between(low, low + width - 1).alias("inside"))
            for t, ((k, _), (low, width, _)) in enumerate(asked)])
        rows = held.select(F.explode(tries).alias("x")).select("x.*").where("inside").groupBy(
            "t", "cell").agg(F.sum("w").alias("n")).collect()
        cells: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            cells.setdefault(r["t"], []).append((r["cell"], int(r["n"])))
        open_ = {}
        for t, (key, (low, width, below)) in enumerate(asked):
            size = -(-width // CELLS)
            for cell, n in sorted(cells[t]):
                if below + n > key[1]:
                    start = low + cell * size
                    if size == 1:
                        found[key] = start
                    else:
                        open_[key] = (start, min(size, low + width - start), below)
                    break
                below += n
    return [(found[k, (n - 1) // 2] + found[k, n // 2]) / 2 if n else None
            for k, n in enumerate(totals)]
