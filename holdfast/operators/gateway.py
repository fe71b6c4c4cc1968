"""Three-way decision on a readout: accept, reject, delay, or human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import AUTONOMY, SETTINGS, Settings


def autonomy_action(verdict: Column, change_type: Column) -> Column:
    """What may happen next: only an accepted change reaches its autonomy tier."""
    tiers = F.create_map(*[F.lit(x) for kv in AUTONOMY.items() for x in kv])
    return (F.when(verdict == "reject", "no_change")
            .when(verdict == "needs_human_review", "human_review")
            .when(verdict == "delay", "keep_collecting")
            .otherwise(F.coalesce(tiers[change_type], F.lit("requires_human_signoff"))))


def _guardrails(settings: Settings) -> tuple[Column, Column]:
    """Names breached (interval wholly below the floor) and at risk (it reaches below)."""
    breached, risky = [], []
    for metric, max_drop in settings.guardrails:
        g = F.col("guardrails")[metric]
        breached.append(F.when(g["ci_high"] < -max_drop, F.lit(metric)))
        risky.append(F.when(g.isNull(), F.lit(f"{metric} (not measured)")).when(
            (g["ci_high"] >= -max_drop) & (g["ci_low"] < -max_drop), F.lit(metric)))
    drop = lambda cols: F.filter(
        F.array(*cols).cast("array<string>"), lambda x: x.isNotNull())
    return drop(breached), drop(risky)


def adjudicate(readouts: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Add verdict, case, reason and autonomy to rows of
    (change_type, point, ci_low, ci_high, guardrails map, days_running)."""
    breached, risky = _guardrails(settings)
    df = readouts.withColumn("_breached", breached).withColumn("_risky", risky)
    low, high, m = F.col("ci_low"), F.col("ci_high"), settings.indifference_margin
    win = (low > 0) & (F.col("point") >= settings.mde)
    # ordered: the first rule that holds decides
    rules = [
        (F.size("_breached") > 0, "reject", "guardrail_breach",
         F.concat(F.lit("guardrail breached: "), F.array_join("_breached", ", "))),
        (high < 0, "reject", "clear_loss",
         F.lit("the whole confidence interval is below zero")),
        ((low >= -m) & (high <= m), "reject", "in_margin",
         F.lit(f"the confidence interval lies inside the +/-{m:g} indifference margin")),
        (win & (F.size("_risky") > 0), "delay", "conflicting_metrics",
         F.concat(F.lit("primary metric wins but guardrail(s) at risk: "),
                  F.array_join("_risky", ", "))),
        (win, "accept", "clear_win",
         F.lit(f"CI above zero and effect >= MDE {settings.mde:g}")),
        (F.lit(True), "delay", "inconclusive",
         F.lit("the confidence interval is too wide to decide")),
    ]
    result = None
    for cond, verdict, case, why in reversed(rules):
        s = F.struct(F.lit(verdict).alias("verdict"), F.lit(case).alias("case"),
                     why.alias("reason"))
        result = s if result is None else F.when(cond, s).otherwise(result)
    df = df.withColumn("_r", result)
    late = (F.col("_r.verdict") == "delay") & (F.col("days_running") >= settings.delay_budget_days)
    verdict = F.when(late, "needs_human_review").otherwise(F.col("_r.verdict"))
    reason = F.when(late, F.concat(
        F.col("_r.reason"), F.lit("; still inconclusive after "),
        F.col("days_running").cast("string"),
        F.lit(f" days (budget {settings.delay_budget_days}), escalated for human review"))
    ).otherwise(F.col("_r.reason"))
    case = F.when(late, F.concat("_r.case", F.lit("_past_budget"))).otherwise(F.col("_r.case"))
    out = df.withColumn("verdict", verdict).withColumn("case", case).withColumn("reason", reason)
    return out.withColumn("autonomy", autonomy_action(
        F.col("verdict"), F.col("change_type"))).drop("_r", "_breached", "_risky")
