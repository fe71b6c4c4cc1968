"""Customer-level bootstrap: exact multinomial resamples from hash draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.draws import draw_bits
from holdfast.functions.ordering import number_rows


def index_customers(customers: DataFrame) -> DataFrame:
    """(customer_id, slot): consecutive slots from 0, shorter ids first, then by text."""
    order = [F.length("customer_id"), F.col("customer_id")]
    return number_rows(customers.select("customer_id").distinct(), order, "_n").select(
        "customer_id", (F.col("_n") - 1).alias("slot"))


def draws(indexed: DataFrame, resamples: int, seed: int | str) -> DataFrame:
    """(resample, slot): n draws with replacement per resample, n the number of customers.

    Each indexed customer emits one draw per resample, so the work is spread like the
    customers are; slots are uniform, so nothing downstream is skewed.
    """
    n = indexed.agg(F.count(F.lit(1)).alias("n")).scalar()
    each = indexed.select(F.col("slot").alias("j"), F.explode(
        F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    return each.select("resample", F.pmod(
        draw_bits(seed, F.col("resample"), F.col("j")), n).alias("slot"))


def weights(indexed: DataFrame, resamples: int, seed: int | str) -> DataFrame:
    """(resample, customer, weight): how often each resample drew the customer."""
    counts = draws(indexed, resamples, seed).groupBy("resample", "slot").agg(
        F.count(F.lit(1)).alias("weight"))
    return counts.join(indexed.hint("shuffle_hash"), "slot").select(
        "resample", "customer_id", "weight")


def resampled_totals(indexed: DataFrame, values: DataFrame, columns: Sequence[str],
                     resamples: int, seed: int | str) -> DataFrame:
    """Totals of `columns` (one row per customer in `values`) in every resample.

    The draws are `resamples` times the customers, which no size estimate of an explode tells: the
    hint keeps them out of a broadcast and makes the customers the hashed side.
    """
    slotted = indexed.join(values, "customer_id", "left").select(
        "slot", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    return draws(indexed, resamples, seed).join(slotted.hint("shuffle_hash"), "slot").groupBy(
        "resample").agg(*[F.sum(c).alias(c) for c in columns])


def interval(column: str, level: float) -> list:
    """Percentile interval aggregates `<column>_lo`, `<column>_hi` over resamples."""
    alpha = (1 - level) / 2
    return [F.percentile(column, F.lit(alpha)).alias(f"{column}_lo"),
            F.percentile(column, F.lit(1 - alpha)).alias(f"{column}_hi")]


def per_customer(log: DataFrame, customers: DataFrame, column: str) -> DataFrame:
    """Total per listed customer; absent customers have 0."""
    sums = log.groupBy("customer_id").agg(F.sum(F.col(column).cast("double")).alias(column))
    return customers.select("customer_id").join(sums, "customer_id", "left").select(
        "customer_id", F.coalesce(column, F.lit(0.0)).alias(column))
