"""Small numeric and date helpers shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def half_even(value: Column, places: int = 6) -> Column:
    return F.bround(value, places)


def ratio(part: Column, whole: Column) -> Column:
    """`part / whole`, null where `whole` is zero."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def share(flag: Column) -> Column:
    """Aggregate: share of rows where `flag` holds (null counts as no)."""
    return ratio(F.count_if(flag), F.count(F.lit(1)))


def day_index(ts: Column, start: date) -> Column:
    """Calendar days from `start` to the date of `ts`."""
    return F.datediff(F.to_date(ts), F.lit(start)).cast("long")


def day_date(day: Column, start: date) -> Column:
    return F.date_add(F.lit(start), day.cast("int"))


def micros_from(ts: Column, start: date) -> Column:
    return F.unix_micros(ts) - F.unix_micros(F.lit(start).cast("timestamp"))


def ceil_div(value: Column, unit: int) -> Column:
    """Exact integer ceiling of `value / unit`."""
    rest = F.pmod(value, F.lit(unit))
    return ((value - rest) / F.lit(unit)).cast("long") + F.when(rest > 0, 1).otherwise(0)
