"""Policy summaries, readouts and the analysis tables of a replay log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import POLICY_LABELS, SETTINGS, Settings
from holdfast.functions.numbers import day_date, ratio, share
from holdfast.functions.ordering import value_ranks
from holdfast.operators import bootstrap as bs
from holdfast.operators.policies import RESTRAINT
from holdfast.session import stage

OPTIMAL = 1e-9


def customer_totals(log: DataFrame, policies: Sequence[str]) -> DataFrame:
    """One row per customer: profit, expected profit and conversions under each policy."""
    cols = []
    for i, name in enumerate(policies):
        own = F.col("policy") == name
        cols += [F.sum(F.when(own, F.col("profit_cents")).otherwise(0.0)).alias(f"profit_{i}"),
                 F.sum(F.when(own, F.col("expected_profit_cents")).otherwise(0.0))
                 .alias(f"expected_{i}"),
                 F.sum(F.when(own & F.col("converted"), 1.0).otherwise(0.0))
                 .alias(f"conv_{i}")]
    return log.groupBy("customer_id").agg(*cols)


def resampled(log: DataFrame, policies: Sequence[str], settings: Settings = SETTINGS,
              resamples: int | None = None) -> DataFrame:
    """(resample, policy, profit, expected, conv): totals of every policy on the same draws.

    One pass over the draws serves all policies and metrics; differences are taken afterwards
    because totals are linear. The totals (one row per resample) are written once, since
    readers join them with themselves.
    """
    totals = customer_totals(log, policies)
    names = [f"{m}_{i}" for i in range(len(policies)) for m in ("profit", "expected", "conv")]
    wide = bs.resampled_totals(bs.index_customers(log), totals, names,
                               resamples or settings.bootstrap_resamples,
                               settings.seeds["bootstrap"])
    long = F.array(*[F.struct(F.lit(name).alias("policy"), F.col(f"profit_{i}").alias("profit"),
                              F.col(f"expected_{i}").alias("expected"),
                              F.col(f"conv_{i}").alias("conv"))
                     for i, name in enumerate(policies)])
    return stage(wide, "resampled").select("resample", F.inline(long))


def _against(frame: DataFrame, control: str, column: str, out: str) -> DataFrame:
    """Add the difference of `column` to the control policy's value in the same resample."""
    other = frame.where(F.col("policy") == control).select(
        "resample", F.col(column).alias("_control"))
    return frame.join(other, "resample").withColumn(
        out, F.col(column) - F.col("_control")).drop("_control")


def policy_intervals(samples: DataFrame, settings: Settings = SETTINGS,
                     base: str = "do_nothing", rules: str = "rules_only") -> DataFrame:
    both = _against(_against(samples, base, "expected", "vs_base"), rules, "expected", "vs_rules")
    aggs = []
    for c in ("profit", "expected", "vs_base", "vs_rules"):
        aggs += bs.interval(c, settings.ci_level)
    return both.groupBy("policy").agg(*aggs)


def policy_summary(log: DataFrame, policies: Sequence[str], settings: Settings = SETTINGS,
                   base: str = "do_nothing", rules: str = "rules_only",
                   ml_policy: str | None = None, resamples: int | None = None) -> DataFrame:
    """Metrics per policy: rates, profit with intervals, paired differences, waste, regret."""
    deal = F.col("discount_bps") > 0
    off = F.col("order_value_cents") * F.col("discount_bps") / F.lit(10_000.0)
    bought, anyway = F.col("converted"), F.col("would_buy_anyway")
    point = log.groupBy("policy").agg(
        F.count(F.lit(1)).alias("decisions"),
        share(F.col("contact")).alias("contact_rate"),
        share(deal).alias("discount_rate"),
        share(F.col("archetype").isin(*RESTRAINT)).alias("restraint_rate"),
        F.count_if(bought).alias("conversions"),
        share(bought).alias("conversion_rate"),
        (F.sum("profit_cents") / 100).alias("profit_eur"),
        (F.sum("expected_profit_cents") / 100).alias("expected_profit_eur"),
        (F.sum(F.when(bought, off).otherwise(0.0)) / 100).alias("discount_cost_eur"),
        (F.sum(F.when(bought & anyway, off).otherwise(0.0)) / 100)
        .alias("wasted_discount_cost_eur"),
        F.coalesce(ratio(F.count_if(deal & bought & anyway), F.count_if(deal & bought)),
                   F.lit(0.0)).alias("wasted_discount_share"),
        F.coalesce(ratio(F.count_if(anyway & ~deal), F.count_if(anyway)), F.lit(0.0))
        .alias("no_incentive_rate_would_buy_anyway"),
        F.avg("regret_cents").alias("mean_regret_cents"),
        share(F.col("regret_cents") <= OPTIMAL).alias("share_hindsight_optimal"))
    spans = policy_intervals(resampled(log, policies, settings, resamples), settings, base, rules)
    control = lambda name: point.where(F.col("policy") == name).select(
        "expected_profit_eur").scalar()
    labels = F.create_map(*[F.lit(x) for kv in POLICY_LABELS.items() for x in kv])
    joined = point.join(spans, "policy")
    return joined.select(
        "policy", F.coalesce(labels[F.col("policy")], F.col("policy")).alias("label"),
        *[c for c in point.columns if c != "policy"],
        (F.col("profit_lo") / 100).alias("profit_ci_low_eur"),
        (F.col("profit_hi") / 100).alias("profit_ci_high_eur"),
        (F.col("expected_lo") / 100).alias("expected_profit_ci_low_eur"),
        (F.col("expected_hi") / 100).alias("expected_profit_ci_high_eur"),
        (F.col("expected_profit_eur") - control(base)).alias("vs_do_nothing_eur"),
        (F.col("vs_base_lo") / 100).alias("vs_do_nothing_ci_low_eur"),
        (F.col("vs_base_hi") / 100).alias("vs_do_nothing_ci_high_eur"),
        (F.col("expected_profit_eur") - control(rules)).alias("vs_rules_only_eur"),
        (F.col("vs_rules_lo") / 100).alias("vs_rules_only_ci_low_eur"),
        (F.col("vs_rules_hi") / 100).alias("vs_rules_only_ci_high_eur"),
        (F.col("policy") == F.lit(ml_policy or "")).alias("is_ml_policy"))


def readouts(log: DataFrame, candidate: str, controls: Sequence[str], days_running: int,
             settings: Settings = SETTINGS, change_type: str = "policy_promotion",
             resamples: int | None = None) -> DataFrame:
    """Per control: per-decision profit and conversion differences with paired intervals."""
    names = [candidate, *controls]
    samples = resampled(log.where(F.col("policy").isin(*names)), names, settings, resamples)
    mine = samples.where(F.col("policy") == candidate).select(
        "resample", F.col("profit").alias("_p"), F.col("conv").alias("_c"))
    diff = samples.where(F.col("policy") != candidate).join(mine, "resample").select(
        F.col("policy").alias("control"), (F.col("_p") - F.col("profit")).alias("profit"),
        (F.col("_c") - F.col("conv")).alias("conv"))
    spans = diff.groupBy("control").agg(*bs.interval("profit", settings.ci_level),
                                        *bs.interval("conv", settings.ci_level))
    sums = log.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("profit_cents").alias("profit"),
        F.count_if("converted").cast("double").alias("conv"))
    own = sums.where(F.col("policy") == candidate).select(
        F.col("n").alias("n"), F.col("profit").alias("_p"), F.col("conv").alias("_c"),
        F.lit(True).alias("_k"))
    other = sums.where(F.col("policy").isin(*controls)).select(
        F.col("policy").alias("control"), F.col("profit"), F.col("conv"), F.lit(True).alias("_k"))
    point = other.join(own, "_k").join(spans, "control")  # one row per control
    n = F.col("n")
    return point.select(
        F.concat(F.lit(f"{candidate} vs "), "control").alias("comparison"), "control",
        F.lit(change_type).alias("change_type"),
        ((F.col("_p") - F.col("profit")) / n).alias("point"),
        (F.col("profit_lo") / n).alias("ci_low"), (F.col("profit_hi") / n).alias("ci_high"),
        F.create_map(F.lit("conversion_rate"), F.struct(
            ((F.col("_c") - F.col("conv")) / n).alias("point"),
            (F.col("conv_lo") / n).alias("ci_low"),
            (F.col("conv_hi") / n).alias("ci_high"))).alias("guardrails"),
        F.lit(days_running).cast("long").alias("days_running"))


# ------------------------------------------------------------------------------ uplift error
def uplift_error(rows: DataFrame) -> DataFrame:
    """Predicted against true uplift per family for `all` and each archetype.

    `rows` is (family, archetype, truth, predicted). Spearman uses average ranks from distinct
    values; groups below two rows are dropped; a constant side gives null.
    """
    tagged = rows.withColumn("archetype", F.explode(F.array(F.lit("all"), "archetype")))
    key = ["family", "archetype"]
    ranks = {}
    for side in ("truth", "predicted"):
        ranks[side] = value_ranks(tagged, key, side, -1.0, 1.0).select(
            *key, side, F.col("mid_rank").alias(f"rank_{side}"))
    # equal pairs collapse before the two rank joins
    pairs = tagged.groupBy(*key, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(ranks["truth"], [*key, "truth"]).join(ranks["predicted"],
                                                            [*key, "predicted"])
    n, a, b = F.col("n"), F.col("rank_truth"), F.col("rank_predicted")
    moments = both.groupBy(*key).agg(
        F.sum(n).alias("rows"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"),
        F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"),
        F.sum(n * a * b).alias("sab"))
    m = F.col("rows").cast("double")
    cov = m * F.col("sab") - F.col("sa") * F.col("sb")
    var_a = m * F.col("saa") - F.col("sa") * F.col("sa")
    var_b = m * F.col("sbb") - F.col("sb") * F.col("sb")
    spear = moments.select(*key, F.when((var_a > 0) & (var_b > 0),
                                        cov / F.sqrt(var_a) / F.sqrt(var_b)).alias("spearman"))
    gap = F.col("predicted") - F.col("truth")
    basic = tagged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("truth").alias("mean_true_uplift"),
        F.avg("predicted").alias("mean_predicted_uplift"), F.avg(gap).alias("bias"),
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        share(F.signum("predicted") == F.signum("truth")).alias("sign_agreement"))
    return basic.where("rows >= 2").join(spear, key)


# --------------------------------------------------------------------------- analysis tables
def tag(log: DataFrame, segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Add the segment name and the month of each decision."""
    named = segments.select("customer_id", F.col("segment_name").alias("segment"))
    return log.join(named, "customer_id", "left").withColumn(
        "segment", F.coalesce("segment", F.lit("joined_after_snapshot"))).withColumn(
        "month", F.date_format(day_date(F.col("day"), settings.start_date), "yyyy-MM"))


def with_gains(log: DataFrame, policy: str, base: str = "do_nothing",
               discount: str = "always_discount") -> DataFrame:
    """The policy's decisions with their gain over two controls on the same (customer, day).

    One conditional aggregate over the log instead of two self joins.
    """
    val = lambda p: F.max(F.when(F.col("policy") == p, F.col("expected_profit_cents")))
    own = F.max(F.when(F.col("policy") == policy, F.struct(
        *[c for c in log.columns if c not in ("customer_id", "day")])))
    wide = log.where(F.col("policy").isin(policy, base, discount)).groupBy(
        "customer_id", "day").agg(own.alias("o"), val(base).alias("_b"), val(discount).alias("_d"))
    rows = wide.where(F.col("o").isNotNull() & F.col("_b").isNotNull() & F.col("_d").isNotNull())
    return rows.select("customer_id", "day", "o.*", "_b", "_d").withColumn(
        "gain_vs_nothing", F.col("expected_profit_cents") - F.col("_b")).withColumn(
        "gain_vs_discount", F.col("expected_profit_cents") - F.col("_d")).drop("_b", "_d")


def gain_table(gains: DataFrame, by: str) -> DataFrame:
    return gains.groupBy(by).agg(
        F.count(F.lit(1)).alias("decisions"), share(F.col("contact")).alias("contact_rate"),
        (F.sum("gain_vs_nothing") / 100).alias("ml_vs_do_nothing_eur"),
        (F.sum("gain_vs_discount") / 100).alias("ml_vs_always_discount_eur"),
        F.avg("regret_cents").alias("mean_regret_cents"))


def worst(table: DataFrame, by: str) -> DataFrame:
    return table.orderBy(F.col("ml_vs_do_nothing_eur").asc(), F.col(by).asc()).limit(1)


def confidence_bin(value: Column) -> Column:
    """Left-closed bins; a null confidence falls outside all of them."""
    return (F.when(value.isNull() | (value < 0) | (value >= 1.0001), F.lit(None))
            .when(value < 0.5, "[0.0, 0.5)").when(value < 0.75, "[0.5, 0.75)")
            .when(value < 0.9, "[0.75, 0.9)").otherwise("[0.9, 1.0001)"))


def confidence_calibration(gains: DataFrame) -> DataFrame:
    binned = gains.withColumn("confidence_bin", F.coalesce(
        confidence_bin(F.col("confidence")), F.lit("none")))
    return binned.groupBy("confidence_bin").agg(
        F.count(F.lit(1)).alias("decisions"), F.avg("confidence").alias("mean_confidence"),
        share(F.col("regret_cents") <= OPTIMAL).alias("share_hindsight_optimal"),
        F.avg("regret_cents").alias("mean_regret_cents"))


def action_table(gains: DataFrame) -> DataFrame:
    return gains.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.avg("uplift_estimate").alias("mean_predicted_uplift"),
        (F.avg("p_action") - F.avg("p_none")).alias("mean_true_uplift"),
        F.avg("regret_cents").alias("mean_regret_cents"))


def rule_shares(log: DataFrame, policy: str = "always_discount",
                required: Sequence[str] = ("inventory_scarcity_gate", "frequency_cap")) -> DataFrame:
    """Share of the policy's decisions in which each rule fired; required rules always listed."""
    own = log.where(F.col("policy") == policy)
    total = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    fired = own.select(F.explode(F.split("fired_rules", ",")).alias("rule")).where("rule <> ''")
    # the required names ride along as zero counts of the rows themselves
    zero = own.agg(F.count(F.lit(1)).alias("k")).select(
        F.explode(F.array(*[F.lit(r) for r in required])).alias("rule"), F.lit(0).alias("k"))
    counts = fired.groupBy("rule").agg(F.count(F.lit(1)).alias("k")).unionByName(zero)
    return counts.groupBy("rule").agg(F.sum("k").alias("k")).select(
        "rule", ratio(F.col("k"), total).alias("share"))


def review_count(log: DataFrame) -> DataFrame:
    return log.groupBy("policy").agg(F.count_if("needs_human_review").alias("escalations"))


def select_family(selection: DataFrame) -> DataFrame:
    """The family with most validation profit; on a tie logistic."""
    return selection.groupBy("family").agg(F.sum("profit_cents").alias("profit_cents")).orderBy(
        F.col("profit_cents").desc(), (F.col("family") == "logistic").desc()).limit(1)
