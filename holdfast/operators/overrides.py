"""Operator overrides: admission and pricing.

Decisions, options, contexts and probabilities grow with the customers, and what an explode or a
compressed hand-over yields is many times its size estimate. Hints on the overrides, the smallest
input, make them the hashed side, partition by partition, so none of it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import candidate_rows


def latest_override(overrides: DataFrame) -> DataFrame:
    """The last override of each decision; equal instants go to the larger override id."""
    cols = [c for c in overrides.columns if c != "decision_id"]
    last = overrides.groupBy("decision_id").agg(F.max_by(
        F.struct(*cols), F.struct("created_at", "override_id")).alias("o"))
    return last.select("decision_id", *[F.col(f"o.{c}").alias(c) for c in cols])


def admit(requests: DataFrame, decisions: DataFrame, options: DataFrame) -> DataFrame:
    """Check requests: the decision is current, the candidate known, allowed, and different.

    `decisions` is (decision_id, customer_id, day, chosen_id); `options` the judged candidates
    (RULES may not be overruled, the model may).
    """
    current = decisions.select("customer_id", "day", F.col("decision_id").alias("_current"),
                               "chosen_id")
    opts = options.select("customer_id", "day", F.col("candidate_id").alias("override_candidate"),
                          "allowed", "rule", "detail")
    df = requests.hint("shuffle_hash").join(current, ["customer_id", "day"], "left")
    df = df.hint("shuffle_hash").join(opts, ["customer_id", "day", "override_candidate"], "left")
    reason = (
        F.when(F.col("_current").isNull() | (F.col("_current") != F.col("decision_id")),
               "not the current decision")
        .when(F.col("allowed").isNull(), "unknown action")
        .when(~F.col("allowed"), F.concat(F.lit("excluded by hard rule "), "rule"))
        .when(F.col("override_candidate") == F.col("chosen_id"),
              "the override equals the engine's choice"))
    return df.withColumn("refusal", reason).withColumn(
        "admitted", F.col("refusal").isNull()).withColumn(
        "original_candidate", F.col("chosen_id")).drop("_current", "chosen_id")


def price_overrides(overrides: DataFrame, contexts: DataFrame, probabilities: DataFrame,
                    fallback: DataFrame) -> DataFrame:
    """Expected profit of the engine's choice and of the override, and the difference.

    `contexts` gives margin and order value; where a row is missing, `fallback`
    (customer_id, margin_rate, order_value_cents) does. `probabilities` is long
    (customer, day, candidate_id, probability). An unknown candidate prices as null.
    """
    known = contexts.select("customer_id", "day", "margin_rate", "order_value_cents")
    spare = fallback.select("customer_id", F.col("margin_rate").alias("_m"),
                            F.col("order_value_cents").alias("_v"))
    df = overrides.hint("shuffle_hash").join(known, ["customer_id", "day"], "left")
    df = df.hint("shuffle_hash").join(spare, "customer_id", "left")
    df = df.withColumn("_margin", F.coalesce("margin_rate", "_m", F.lit(0.0))).withColumn(
        "_value", F.coalesce("order_value_cents", "_v", F.lit(0)).cast("double")).drop(
        "margin_rate", "order_value_cents", "_m", "_v")
    facts = {r["candidate_id"]: (r["discount_bps"], r["cost_cents"]) for r in candidate_rows()}
    bps = F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), F.lit(v[0]))])
    cost = F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), F.lit(v[1]))])
    for side in ("original", "override"):
        cand = F.col(f"{side}_candidate")
        table = probabilities.select(
            "customer_id", "day", F.col("candidate_id").alias(f"{side}_candidate"),
            F.col("probability").alias("_p"))
        df = df.hint("shuffle_hash").join(
            table, ["customer_id", "day", f"{side}_candidate"], "left").withColumn(
            f"expected_profit_{side}_cents",
            F.col("_p") * F.col("_value") * (F.col("_margin") - bps[cand] / F.lit(10_000.0))
            - cost[cand]).drop("_p")
    return df.withColumn(
        "override_effect_cents",
        F.col("expected_profit_override_cents") - F.col("expected_profit_original_cents")
    ).drop("_margin", "_value")


def override_totals(priced: DataFrame) -> DataFrame:
    return priced.agg(
        F.count(F.lit(1)).alias("n_overrides"),
        (F.coalesce(F.sum("override_effect_cents"), F.lit(0.0)) / 100).alias("net_effect_eur"))
