"""Counter-based uniform draws: the same key gives the same number on any executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 52)


def draw_bits(seed: int | str, *parts: Column) -> Column:
    """52 hash bits of `seed|part|part...` as a long."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def uniform(seed: int | str, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw_bits(seed, *parts).cast("double") / F.lit(_SPAN)
