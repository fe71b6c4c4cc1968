"""Pricing of decisions against a supplied purchase-probability table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.draws import uniform
from holdfast.operators.policies import RESTRAINT, expected_profit


def probability_maps(table: DataFrame) -> DataFrame:
    """(customer, day, p): the long table (one row per candidate) as one map per context.

    A map holds at most one entry per candidate of the action catalog.
    """
    return table.groupBy("customer_id", "day").agg(F.map_from_entries(
        F.collect_list(F.struct("candidate_id", "probability"))).alias("p"))


def common_draw(settings: Settings = SETTINGS) -> Column:
    """One uniform number per (customer, day), shared by every policy."""
    return uniform(settings.seeds["outcomes"], F.col("day"), F.col("customer_id"))


def chosen(candidates: Column, chosen_id: Column) -> Column:
    return F.get(F.filter(candidates, lambda c: c["candidate_id"] == chosen_id), F.lit(0))


def price(rows: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Outcome of `chosen_id` per row: conversion, profit, what doing nothing would have given
    and the hindsight best survivor.

    Needs `p` (map), judged `candidates` and `survivors`, `margin_rate`, `order_value_cents`.
    """
    df = rows.withColumn("choice", chosen(F.col("candidates"), F.col("chosen_id")))
    value = F.col("order_value_cents").cast("double")
    margin = F.col("margin_rate")
    left = value * (margin - F.col("choice.discount_bps") / F.lit(10_000.0))
    cost = F.col("choice.cost_cents")
    df = df.withColumn("p_action", F.when(F.col("choice.archetype").isin(*RESTRAINT),
                                          F.col("p")["none"]).otherwise(
        F.col("p")[F.col("chosen_id")])).withColumn("p_none", F.col("p")["none"]).withColumn(
        "draw", common_draw(settings))
    df = df.withColumn("converted", F.col("draw") < F.col("p_action")).withColumn(
        "would_buy_anyway", F.col("draw") < F.col("p_none"))
    df = df.withColumn(
        "profit_cents", F.when(F.col("converted"), left).otherwise(F.lit(0.0)) - cost
    ).withColumn(
        "profit_none_cents", F.when(F.col("would_buy_anyway"), value * margin).otherwise(
            F.lit(0.0))
    ).withColumn("expected_profit_cents", F.col("p_action") * left - cost
                 ).withColumn("expected_profit_none_cents", F.col("p_none") * value * margin)
    start = F.struct(F.col("chosen_id").alias("id"),
                     F.col("expected_profit_cents").alias("profit"))

    def better(best: Column, c: Column) -> Column:
        profit = expected_profit(c, F.col("p")[c["candidate_id"]])
        return F.when(profit > best["profit"] + 1e-12, F.struct(
            c["candidate_id"].alias("id"), profit.alias("profit"))).otherwise(best)

    df = df.withColumn("_best", F.aggregate("survivors", start, better))
    return df.withColumn("oracle_best_candidate", F.col("_best.id")).withColumn(
        "regret_cents", F.col("_best.profit") - F.col("expected_profit_cents")).drop("_best")


REPLAY_COLUMNS = (
    "policy", "customer_id", "day", "primary_category", "candidate_id", "archetype",
    "discount_bps", "contact", "n_survivors", "n_filtered", "fired_rules",
    "recent_contacts_7d", "prior_contacts", "p_action", "p_none", "draw", "converted",
    "would_buy_anyway", "order_value_cents", "margin_rate", "profit_cents",
    "profit_none_cents", "expected_profit_cents", "expected_profit_none_cents",
    "oracle_best_candidate", "regret_cents", "decision_id", "confidence", "uplift_estimate",
    "expected_profit_estimate_cents", "needs_human_review", "runner_up", "reasoning",
)


def replay_rows(priced: DataFrame) -> DataFrame:
    """Flat replay log, one row per decision."""
    null = F.lit(None).cast("double")
    made = {
        "candidate_id": F.col("chosen_id"),
        "archetype": F.col("choice.archetype"),
        "discount_bps": F.col("choice.discount_bps"),
        "contact": F.col("choice.contact"),
        "recent_contacts_7d": F.col("contacts_7d"),
        "order_value_cents": F.col("order_value_cents").cast("double"),
    }
    missing = {
        "prior_contacts": F.col("contacts_total"), "decision_id": F.lit(""),
        "confidence": null, "uplift_estimate": null, "expected_profit_estimate_cents": null,
        "needs_human_review": F.size("survivors") == 0, "runner_up": F.lit(""),
        "reasoning": F.lit(""),
    }
    cols = []
    for name in REPLAY_COLUMNS:
        if name in made:
            cols.append(made[name].alias(name))
        elif name in priced.columns:
            cols.append(F.col(name))
        else:
            cols.append(missing[name].alias(name))
    return priced.select(*cols)
