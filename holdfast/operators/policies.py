"""Policies: how a context picks among its surviving candidates.

A policy only ever sees survivors. Scoring turns `survivors` into `scored` (an array sorted
best first); ranking is highest score, then no contact, then catalog order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.draws import uniform

RESTRAINT = ("none", "wait")
SCORE_FIELDS = ("uplift", "uplift_low", "uplift_high", "value_cents", "risk_penalty_cents",
                "win_rate", "expected_profit_cents", "profit_sd_cents")
KEEP_FIELDS = ("candidate_id", "archetype", "discount_bps", "cost_cents",
               "penalty_cents", "penalty_rules")


def has_id(survivors: Column, wanted: Column) -> Column:
    return F.exists(survivors, lambda c: c["candidate_id"] == wanted)


def ranked(scored: Column) -> Column:
    """Sort key fields lead the struct, so the natural struct order is the rank order."""
    return F.sort_array(scored)  # compares entries itself; array_sort calls a comparator each time


def score_entry(c: Column, score: Column, note: Column | None = None, **fields: Column) -> Column:
    null = F.lit(None).cast("double")
    return F.struct(
        (-score).alias("neg_score"), c["contact"].alias("contact"),
        c["catalog_order"].alias("catalog_order"),
        *[c[f].alias(f) for f in KEEP_FIELDS],
        score.alias("score"), *[fields.get(f, null).alias(f) for f in SCORE_FIELDS],
        (note if note is not None else F.lit(None).cast("string")).alias("note"))


# ---------------------------------------------------------------------------- preferred picks
def preferred_none() -> tuple[Column, Column]:
    return F.lit("none"), F.lit("Do-nothing baseline")


def preferred_discount() -> tuple[Column, Column]:
    deals = F.transform(F.filter("survivors", lambda c: c["discount_bps"] > 0),
                        lambda c: F.struct(c["discount_bps"], c["candidate_id"].alias("id")))
    return F.array_max(deals)["id"], F.lit("Always-discount baseline: largest allowed")


def preferred_top_seller(settings: Settings = SETTINGS) -> tuple[Column, Column]:
    return F.lit(settings.top_seller_candidate), F.lit("Top-seller baseline")


def preferred_playbook(settings: Settings = SETTINGS) -> tuple[Column, Column]:
    s = settings
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    deal = (zero("cart_state_units") >= s.playbook_cart_units) & (
        zero("price_sensitivity_proxy") >= s.playbook_price_sensitivity)
    engaged = zero("session_visits_count") >= s.playbook_engaged_sessions
    lapsed = F.coalesce(F.col("rfm_recency_days") >= s.playbook_lapsed_days, F.lit(False))

    def chain(a, b, c, d):
        return F.when(deal, a).when(engaged, b).when(lapsed, c).otherwise(d)

    return (
        chain(s.playbook_discount_candidate, s.playbook_engaged_candidate,
              s.playbook_lapsed_candidate, "none"),
        chain("Playbook: items in cart and buys on discount", "Playbook: engaged browser",
              "Playbook: lapsing customer", "Playbook: no rule matched"),
    )


BASELINES = {
    "do_nothing": preferred_none,
    "always_discount": preferred_discount,
    "top_seller": preferred_top_seller,
    "rules_only": preferred_playbook,
}


def settle(preferred: Column) -> Column:
    """The preferred id if it survived, else `none`."""
    return F.when(F.coalesce(has_id(F.col("survivors"), preferred), F.lit(False)),
                  preferred).otherwise(F.lit("none"))


def preference_scores(judged: DataFrame, preferred: Column, note: Column) -> DataFrame:
    """1 for the preferred survivor (else for `none`), 0 for the rest."""
    fallback = F.concat(note, F.lit("; not allowed now, so doing nothing"))
    df = judged.withColumn("_target", settle(preferred)).withColumn(
        "_note", F.when(F.coalesce(preferred, F.lit("")) == F.col("_target"), note)
        .otherwise(fallback))
    hit = lambda c: c["candidate_id"] == F.col("_target")
    scored = F.transform("survivors", lambda c: score_entry(
        c, F.when(hit(c), F.lit(1.0)).otherwise(F.lit(0.0)), F.when(hit(c), F.col("_note"))))
    return df.withColumn("scored", ranked(scored)).drop("_target", "_note")


def baseline(judged: DataFrame, policy: str) -> DataFrame:
    preferred, note = BASELINES[policy]()
    return preference_scores(judged, preferred, note)


def random_pick(seed: int) -> Column:
    """Uniform pick among survivors, one draw per (customer, day)."""
    u = uniform(seed, F.col("day"), F.col("customer_id"))
    at = F.floor(u * F.size("survivors")).cast("int") + 1
    return F.try_element_at("survivors", at)["candidate_id"]


def expected_profit(c: Column, probability: Column) -> Column:
    """Cents earned on average: p x order value x (margin - discount) - contact cost."""
    left = F.col("margin_rate") - c["discount_bps"] / F.lit(10_000.0)
    return probability * F.col("order_value_cents").cast("double") * left - c["cost_cents"]


def hindsight_pick(probabilities: Column) -> Column:
    """(candidate_id, profit) of the survivor with most expected profit; a later survivor must
    win by more than 1e-12."""
    start = F.struct(F.lit(None).cast("string").alias("candidate_id"),
                     F.lit(None).cast("double").alias("profit"))

    def better(best: Column, c: Column) -> Column:
        profit = expected_profit(c, probabilities[c["candidate_id"]])
        wins = best["profit"].isNull() | (profit > best["profit"] + 1e-12)
        return F.when(wins, F.struct(c["candidate_id"].alias("candidate_id"),
                                     profit.alias("profit"))).otherwise(best)

    return F.aggregate("survivors", start, better)


# ------------------------------------------------------------------------- expected value
def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _sd(values: Column, mean: Column) -> Column:
    """Population standard deviation."""
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(square / F.size(values))


def _quantile(values: Column, q: float, n: int) -> Column:
    """Linear interpolation between order statistics of an array of n values."""
    at = q * (n - 1)
    low = int(at)
    high = min(low + 1, n - 1)
    s = F.sort_array(F.array_compact(values))
    return F.get(s, F.lit(low)) + (F.get(s, F.lit(high)) - F.get(s, F.lit(low))) * F.lit(at - low)


def expected_value_scores(judged: DataFrame, members: str, n_members: int,
                          settings: Settings = SETTINGS) -> DataFrame:
    """Score survivors by mean incremental profit minus risk aversion x ensemble spread.

    `members` is a map column `archetype:bps -> array of member probabilities` holding at
    least `none:0`. Per member: `p V (m - d) - p0 V m - cost - penalty`; restraint prices as
    doing nothing. Confidence is the share of members that rank the candidate first, ties to
    the first survivor. Reported profit and value leave the soft penalty out.
    """
    value, margin = F.col("order_value_cents").cast("double"), F.col("margin_rate")
    p_none = F.col(members)["none:0"]
    q_low, q_high = settings.interval_quantiles

    def armed(c: Column) -> Column:
        arm = F.concat_ws(":", c["archetype"], c["discount_bps"].cast("string"))
        own = F.col(members)[arm]
        acts = ~c["archetype"].isin(*RESTRAINT) & own.isNotNull()
        return F.struct(c.alias("c"), acts.alias("acts"), F.when(acts, own).otherwise(p_none)
                        .alias("p"))

    def priced(x: Column) -> Column:
        c, p = x["c"], x["p"]
        keep = margin - c["discount_bps"] / F.lit(10_000.0)
        gain = F.zip_with(p, p_none, lambda a, b: F.when(
            x["acts"], a * value * keep - b * value * margin).otherwise(F.lit(0.0))
            - c["cost_cents"] - c["penalty_cents"])
        return F.struct(c.alias("c"), gain.alias("gain"),
                        F.zip_with(p, p_none, lambda a, b: a - b).alias("uplift"))

    # found once for each survivor; within `priced` it would be once for each member too
    df = judged.withColumn("_priced", F.transform(F.transform("survivors", armed), priced))
    gains = F.array(*[F.transform("_priced", lambda x: F.get(x["gain"], F.lit(m)))  # noqa: B023
                      for m in range(n_members)])
    df = df.withColumn("_gains", gains)

    def winner(gain: Column) -> Column:
        """Id of the first survivor with the largest gain in a member (of the last without any)."""
        at = F.coalesce(F.array_position(gain, F.array_max(gain)).cast("int"), F.size("_priced"))
        return F.get(F.col("_priced"), at - 1)["c"]["candidate_id"]

    df = df.withColumn("_winners", F.array(*[
        winner(F.get("_gains", F.lit(m))) for m in range(n_members)]))

    def measured(x: Column) -> Column:
        mean = _mean(x["gain"])
        return F.struct(x["c"].alias("c"), x["uplift"].alias("uplift"), mean.alias("mean"),
                        _sd(x["gain"], mean).alias("sd"))

    def entry(x: Column) -> Column:
        c, mean, sd = x["c"], x["mean"], x["sd"]
        wins = F.size(F.filter("_winners", lambda w: w == c["candidate_id"]))
        risk = F.lit(settings.risk_aversion) * sd
        return score_entry(
            c, mean - risk, uplift=_mean(x["uplift"]),
            uplift_low=_quantile(x["uplift"], q_low, n_members),
            uplift_high=_quantile(x["uplift"], q_high, n_members),
            value_cents=mean + c["penalty_cents"] + c["cost_cents"],
            risk_penalty_cents=c["penalty_cents"] + risk,
            win_rate=wins / F.lit(float(n_members)),
            expected_profit_cents=mean + c["penalty_cents"], profit_sd_cents=sd)

    df = df.withColumn("_measured", F.transform("_priced", measured))
    return df.withColumn("scored", ranked(F.transform("_measured", entry))).drop(
        "_priced", "_gains", "_winners", "_measured")


# ----------------------------------------------------------------------------------- choice
def choose(scored: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Add `best`, `runner`, `alternative` and the flags around the choice.

    A best action the ensemble is not confident in falls back to `none` if that survived. The
    alternative is the runner-up, or for a restraint choice the best active candidate. With no
    survivor at all the row goes to human review.
    """
    top = F.get(F.col("scored"), F.lit(0))
    restraint = F.get(F.filter("scored", lambda s: s["archetype"] == "none"), F.lit(0))
    fallback = F.lit(False)
    if min_confidence is not None:
        fallback = F.coalesce(
            (top["win_rate"] < min_confidence) & (top["archetype"] != "none")
            & restraint.isNotNull(), F.lit(False))
    df = scored.withColumn("fallback", fallback).withColumn(
        "best", F.when(F.col("fallback"), restraint).otherwise(top))
    others = F.filter("scored", lambda s: s["candidate_id"] != F.col("best.candidate_id"))
    df = df.withColumn("_others", others)
    active = F.filter("_others", lambda s: ~s["archetype"].isin(*RESTRAINT))
    df = df.withColumn("runner", F.get("_others", F.lit(0)))
    df = df.withColumn("alternative", F.when(
        F.col("best.archetype").isin(*RESTRAINT), F.get(active, F.lit(0))).otherwise(
        F.col("runner")))
    return df.drop("_others").withColumn(
        "needs_human_review", F.size("scored") == 0).withColumn(
        "chosen_id", F.coalesce("best.candidate_id", F.lit("none"))).withColumn(
        "score_gap", F.round(F.greatest(
            F.col("best.score") - F.col("runner.score"), F.lit(0.0)), 6))


def active_arms(specs: Sequence[dict]) -> list[tuple[str, int]]:
    """Distinct (archetype, bps) pairs of a candidate list, `none` first."""
    arms = [("none", 0)]
    for row in specs:
        arm = (row["archetype"], row["discount_bps"])
        if arm not in arms:
            arms.append(arm)
    return arms
