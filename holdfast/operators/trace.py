"""Decision records with a nested trace, and the invariants every record must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import CONTRACT_VERSION, SETTINGS, Settings
from holdfast.functions.ids import decision_id
from holdfast.operators.rules import rule_names

REVIEW_REASON = "every candidate, including restraint, was excluded by a hard constraint"
NO_RUNNER = "only one option survived the rules"


def decision_records(explained: DataFrame, policy: str, config_hash: str,
                     model_versions: str = "", settings: Settings = SETTINGS) -> DataFrame:
    """One nested record per context: action, expected outcome, trace, policy, unavailable."""
    best = F.col("best")
    as_of = F.date_add(F.lit(settings.start_date), F.col("day").cast("int")).cast("timestamp")
    estimate = F.round(best["uplift"], 8)
    low = F.least(F.round(best["uplift_low"], 8), estimate)
    high = F.greatest(F.round(best["uplift_high"], 8), estimate)
    scores = F.map_from_entries(F.transform("scored", lambda s: F.struct(
        s["candidate_id"], F.struct(
            F.round(s["score"], 6).alias("score"),
            F.coalesce(F.round(s["uplift"], 8), F.lit(0.0)).alias("uplift"),
            F.coalesce(F.round(s["value_cents"], 4), F.lit(0.0)).alias("value_cents"),
            F.when(s["uplift"].isNull(), F.lit(0.0)).otherwise(s["cost_cents"].cast("double"))
            .alias("cost_cents"),
            F.coalesce(F.round(s["risk_penalty_cents"], 4), F.lit(0.0))
            .alias("risk_penalty_cents")))))
    filtered = F.transform(F.filter("candidates", lambda c: c["rule"].isNotNull()),
                           lambda c: F.struct(c["candidate_id"].alias("action"),
                                              c["rule"].alias("rule"),
                                              c["detail"].alias("detail")))
    ruled = F.lit(f"policy {policy} is rule-based and has no response model")
    unsure = F.lit(f"policy {policy} is rule-based; confidence needs a model ensemble")
    review = F.col("needs_human_review")
    missing = F.map_from_entries(F.filter(F.array(
        F.when(best["uplift"].isNull(), F.struct(
            F.lit("expected_outcome.estimate"), F.when(review, REVIEW_REASON).otherwise(ruled))),
        F.when(best["uplift"].isNull(), F.struct(
            F.lit("expected_outcome.interval"), F.when(review, REVIEW_REASON).otherwise(ruled))),
        F.when(best["win_rate"].isNull(), F.struct(
            F.lit("confidence"), F.when(review, REVIEW_REASON).otherwise(unsure)))),
        lambda x: x.isNotNull()))
    attributions = (F.col("attributions") if "attributions" in explained.columns
                    else F.array().cast("array<struct<feature:string,weight:double>>"))
    picked = F.get(F.filter("candidates", lambda c: c["candidate_id"] == F.col("chosen_id")),
                   F.lit(0))
    return explained.select(
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        decision_id(F.col("customer_id"), as_of, F.lit(policy), F.lit(config_hash),
                    F.lit(model_versions)).alias("decision_id"),
        "customer_id", "day", as_of.alias("as_of"),
        F.struct(picked["archetype"].alias("type"), F.col("chosen_id").alias("candidate_id"),
                 picked["params"].alias("params")).alias("action"),
        F.struct(F.lit("conversion_uplift").alias("metric"), estimate.alias("estimate"),
                 low.alias("interval_low"), high.alias("interval_high"),
                 F.lit(settings.action_horizon_days).alias("horizon_days"),
                 F.round(best["expected_profit_cents"], 4).alias("expected_profit_cents"))
        .alias("expected_outcome"),
        F.round(best["win_rate"], 6).alias("confidence"), "reasoning",
        F.struct(
            F.transform("candidates", lambda c: c["candidate_id"]).alias("candidates_considered"),
            filtered.alias("filtered"),
            F.filter(F.split("fired_rules", ","), lambda r: r != "").alias("fired_rules"),
            scores.alias("scores"),
            F.when(F.col("runner").isNotNull(), F.struct(
                F.col("runner.candidate_id").alias("action"),
                F.col("score_gap").alias("score_gap"))).alias("runner_up"),
            F.when(F.col("runner").isNull(), F.when(
                review, "no candidate survived the rules").otherwise(NO_RUNNER))
            .alias("runner_up_unavailable_reason"),
            attributions.alias("model_attributions")).alias("trace"),
        F.array(*[F.lit(n) for n in rule_names()]).alias("constraints_considered"),
        F.struct(F.lit(policy).alias("name"), F.lit(model_versions).alias("model_versions"),
                 F.lit(config_hash).alias("config_hash")).alias("policy"),
        review.alias("needs_human_review"),
        F.when(review, REVIEW_REASON).alias("review_reason"), missing.alias("unavailable"))


def _broken() -> dict[str, Column]:
    t, a, o = F.col("trace"), F.col("action"), F.col("expected_outcome")
    considered, scored = t["candidates_considered"], F.map_keys(t["scores"])
    filtered = F.transform(t["filtered"], lambda f: f["action"])
    review = F.col("needs_human_review")
    none = lambda x: F.coalesce(x, F.lit(False))
    archetypes = F.transform(considered, lambda c: F.split(c, "__")[0])
    no_reason = lambda path: F.coalesce(F.col("unavailable")[path], F.lit("")) == ""
    return {
        "none not considered": ~F.array_contains(archetypes, "none"),
        "wait not considered": ~F.array_contains(archetypes, "wait"),
        "duplicate candidate": F.size(considered) != F.size(F.array_distinct(considered)),
        "unknown candidate in trace": F.size(F.array_except(
            F.concat(filtered, scored), considered)) > 0,
        "filtered candidate scored": F.size(F.array_intersect(filtered, scored)) > 0,
        "filtering rule did not fire": F.size(F.array_except(
            F.transform(t["filtered"], lambda f: f["rule"]), t["fired_rules"])) > 0,
        "runner-up without reason": t["runner_up"].isNull()
        & t["runner_up_unavailable_reason"].isNull(),
        "runner-up not scored": none(~F.array_contains(scored, t["runner_up"]["action"])),
        "runner-up is the choice": none(t["runner_up"]["action"] == a["candidate_id"]),
        "choice not considered": ~F.array_contains(considered, a["candidate_id"]),
        "choice filtered": F.array_contains(filtered, a["candidate_id"]) & ~review,
        "choice not scored": ~F.array_contains(scored, a["candidate_id"]) & ~review,
        "choice of another archetype": none(F.split(a["candidate_id"], "__")[0] != a["type"]),
        "interval misses estimate": none((o["interval_low"] > o["estimate"] + 1e-12)
                                         | (o["interval_high"] < o["estimate"] - 1e-12)),
        "estimate null without reason": o["estimate"].isNull()
        & no_reason("expected_outcome.estimate"),
        "interval null without reason": o["interval_low"].isNull()
        & no_reason("expected_outcome.interval"),
        "confidence null without reason": F.col("confidence").isNull() & no_reason("confidence"),
        "confidence outside [0, 1]": none(~F.col("confidence").between(0, 1)),
        "review without reason": review & F.col("review_reason").isNull(),
        "blank reasoning": F.trim("reasoning") == "",
    }


def invariant_violations(records: DataFrame) -> DataFrame:
    """(decision_id, invariant) for every broken invariant; empty when all hold."""
    broken = _broken()
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]),
                    lambda x: x.isNotNull())
    return records.select("decision_id", F.explode(hits).alias("invariant"))


def invariant_counts(records: DataFrame) -> DataFrame:
    """One row: records and violations per invariant, in one scan."""
    broken = _broken()
    total = reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in broken.values()])
    return records.agg(F.count(F.lit(1)).alias("records"),
                       F.coalesce(F.sum(total), F.lit(0)).alias("violations"))
