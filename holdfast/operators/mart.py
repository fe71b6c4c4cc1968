"""Star schema: dimensions, facts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import POLICY_LABELS, SETTINGS, Settings, candidate_rows
from holdfast.functions.numbers import day_date, day_index, ratio
from holdfast.functions.ordering import number_rows
from holdfast.operators.context import first_item_sku
from holdfast.operators.overrides import latest_override
from holdfast.operators.quality import decode

ACTIVE_DAYS, LAPSING_DAYS = 60, 120
FATIGUE_DAYS, FATIGUE_HIGH, FATIGUE_MEDIUM = 14, 4, 2


# ------------------------------------------------------------------------------- staging
def mart_events(events: DataFrame, catalog: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Typed flat events; the category is that of the first line item."""
    typed = events if "p" in events.columns else decode(events)
    flat = typed.select(
        "customer_id", F.col("type").alias("event_type"),
        day_index(F.col("ts"), settings.start_date).alias("day_index"),
        F.col("p.order_total_cents").alias("order_total_cents"),
        first_item_sku(typed).alias("_sku"))
    return flat.join(catalog.select(F.col("sku").alias("_sku"), "category"), "_sku", "left").select(
        "customer_id", "event_type", "day_index", "order_total_cents", "category")


def mart_categories(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("category").agg(F.avg("margin_rate").alias("margin_rate"),
                                           F.count(F.lit(1)).alias("sku_count"))


# ----------------------------------------------------------------------------- dimensions
def date_columns(day: str, settings: Settings = SETTINGS) -> list:
    d = day_date(F.col(day), settings.start_date)
    return [
        F.date_format(d, "yyyyMMdd").cast("long").alias("date_key"),
        d.alias("calendar_date"), F.col(day).alias("day_index"),
        F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.weekofyear(d).cast("long").alias("iso_week"),
        F.date_format(d, "EEEE").alias("weekday_name"),
        (F.month(d) == 12).alias("is_peak_month"),
        F.when(F.col(day) < settings.train_end_day, "train").when(
            F.col(day) < settings.validation_end_day, "validation").otherwise("test")
        .alias("evaluation_window"),
    ]


def dim_date(spark: SparkSession, settings: Settings = SETTINGS) -> DataFrame:
    """One row per calendar day of the horizon."""
    return spark.range(settings.horizon_days).select(*date_columns("id", settings))


def date_spine(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Days from the first to the last event as a date dimension."""
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        day_index(F.col("lo"), settings.start_date).alias("lo"),
        day_index(F.col("hi"), settings.start_date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select(*date_columns("day", settings))


def dim_action(spark: SparkSession) -> DataFrame:
    """One row per candidate of the catalog."""
    rows = [(r["catalog_order"] + 1, r["candidate_id"], r["archetype"], r["description"],
             r["contact"], r["cost_cents"], r["discount_bps"],
             r["archetype"] in ("none", "wait"), r["discount_bps"] > 0)
            for r in candidate_rows()]
    return spark.createDataFrame(
        rows, "action_key long, candidate_id string, archetype string, description string,"
              "is_contact boolean, cost_cents long, discount_bps long, is_restraint boolean,"
              "is_discount boolean")


def dim_policy(log: DataFrame, ml_policy: str) -> DataFrame:
    """One row per policy in the replay log, keyed by name order.

    Policies are a handful by design, so ranking the distinct names in one task is fine.
    """
    labels = F.create_map(*[F.lit(x) for kv in POLICY_LABELS.items() for x in kv])
    names = log.groupBy().agg(F.array_sort(F.collect_set("policy")).alias("names"))
    ranked = names.select(F.posexplode("names").alias("at", "policy"))
    return ranked.select(
        (F.col("at") + 1).cast("long").alias("policy_key"), "policy",
        F.coalesce(labels[F.col("policy")], F.col("policy")).alias("policy_label"),
        (F.col("policy") == ml_policy).alias("is_ml_policy"),
        (F.col("policy") == "oracle_upper_bound").alias("is_reference_only"))


def customer_facts(events: DataFrame, categories: DataFrame,
                   settings: Settings = SETTINGS) -> DataFrame:
    """Per customer as of the test start: first day, orders, spend, margin, messages.

    One aggregate over the mart events; the category margin arrives by join beforehand.
    """
    start = settings.validation_end_day
    with_margin = events.join(categories.select("category", "margin_rate"), "category", "left")
    order = (F.col("event_type") == "order_placed") & (F.col("day_index") < start) & (
        F.col("margin_rate").isNotNull())
    message = (F.col("event_type") == "campaign_exposure") & (
        F.col("day_index") >= start - FATIGUE_DAYS) & (F.col("day_index") < start)
    return with_margin.groupBy("customer_id").agg(
        F.min("day_index").alias("first_day"),
        F.count_if(order).alias("orders_before_test"),
        F.coalesce(F.sum(F.when(order, F.col("order_total_cents"))), F.lit(0)).alias("revenue"),
        F.coalesce(F.sum(F.when(order, F.col("order_total_cents") * F.col("margin_rate"))),
                   F.lit(0.0)).alias("margin"),
        F.max(F.when(order, F.col("day_index"))).alias("last_order_day"),
        F.count_if(message).alias("messages_last_14d"))


def customer_attributes(facts: DataFrame, segments: DataFrame,
                        settings: Settings = SETTINGS) -> DataFrame:
    start = settings.validation_end_day
    seen = day_date(F.col("first_day"), settings.start_date)
    since = F.lit(start) - F.col("last_order_day")
    months = F.greatest((F.lit(start) - F.col("first_day")) / F.lit(30.0), F.lit(1.0))
    named = segments.select("customer_id", "segment_name")
    return facts.join(named, "customer_id", "left").select(
        "customer_id", seen.alias("first_seen_date"),
        F.date_format(seen, "yyyy-MM").alias("cohort_month"),
        F.coalesce("segment_name", F.lit("unsegmented")).alias("segment_name"),
        "orders_before_test",
        F.round(F.col("revenue") / 100.0, 2).alias("revenue_before_test_eur"),
        F.when(F.col("first_day") >= start, "joined_during_test")
        .when(F.col("last_order_day").isNull(), "never_bought")
        .when(since <= ACTIVE_DAYS, "active").when(since <= LAPSING_DAYS, "lapsing")
        .otherwise("churned").alias("lifecycle_stage"),
        "messages_last_14d",
        F.when(F.col("messages_last_14d") >= FATIGUE_HIGH, "high")
        .when(F.col("messages_last_14d") >= FATIGUE_MEDIUM, "medium").otherwise("low")
        .alias("fatigue_risk"),
        F.round(F.col("margin") / 100.0 / months * 12, 2).alias("clv_12m_estimate_eur"))


def dim_customer(events: DataFrame, categories: DataFrame, segments: DataFrame,
                 settings: Settings = SETTINGS) -> DataFrame:
    """One row per customer; keys follow (id length, id)."""
    rows = customer_attributes(customer_facts(events, categories, settings), segments, settings)
    keyed = number_rows(rows, [F.length("customer_id"), F.col("customer_id")], "customer_key")
    return keyed.select("customer_key", *rows.columns)


# ---------------------------------------------------------------------------------- facts
def _with_keys(log: DataFrame, policy: DataFrame, customer: DataFrame, date: DataFrame,
               action: DataFrame) -> DataFrame:
    return (log.join(F.broadcast(policy.select("policy", "policy_key")), "policy")
            .join(customer.select("customer_id", "customer_key"), "customer_id")
            .join(F.broadcast(date.select(F.col("day_index").alias("day"), "date_key")), "day")
            .join(F.broadcast(action.select("candidate_id", "action_key")), "candidate_id"))


def keyed_replay(log: DataFrame, policy: DataFrame, customer: DataFrame, date: DataFrame,
                 action: DataFrame) -> DataFrame:
    """The replay log with all surrogate keys; both facts project from it.

    Only the dimensions with a fixed size (policies, days, actions) are broadcast.
    """
    keys = [F.col("policy_key"), F.col("day"), F.col("customer_key")]
    return number_rows(_with_keys(log, policy, customer, date, action), keys, "decision_key")


def fct_decisions(keyed: DataFrame, overrides: DataFrame) -> DataFrame:
    last = latest_override(overrides).select(
        "decision_id", "override_candidate", F.col("reason").alias("override_reason"))
    df = keyed.withColumn("_join", F.nullif("decision_id", F.lit(""))).join(
        last.withColumnRenamed("decision_id", "_join"), "_join", "left")
    return df.select(
        "decision_key", "policy_key", "customer_key", "date_key", "action_key", "decision_id",
        "confidence", "uplift_estimate",
        F.round(F.col("expected_profit_estimate_cents") / 100.0, 6)
        .alias("expected_profit_estimate_eur"),
        "n_survivors", "n_filtered", "fired_rules", "needs_human_review", "runner_up",
        "recent_contacts_7d", F.col("override_candidate").isNotNull().alias("is_overridden"),
        "override_candidate", "override_reason", "reasoning")


def fct_outcomes(keyed: DataFrame) -> DataFrame:
    eur = lambda c: F.round(c / 100.0, 6)
    zero = F.lit(0.0)
    bought = F.col("converted")
    return keyed.select(
        "decision_key", "converted", "would_buy_anyway",
        (bought & F.col("would_buy_anyway") & (F.col("discount_bps") > 0))
        .alias("is_wasted_discount"),
        eur(F.when(bought, F.col("order_value_cents")).otherwise(zero)).alias("revenue_eur"),
        eur(F.when(bought, F.col("order_value_cents") * F.col("discount_bps") / 10_000.0)
            .otherwise(zero)).alias("discount_cost_eur"),
        eur(F.col("profit_cents")).alias("profit_eur"),
        eur(F.col("profit_none_cents")).alias("profit_if_nothing_eur"),
        eur(F.col("expected_profit_cents")).alias("expected_profit_eur"),
        eur(F.col("expected_profit_none_cents")).alias("expected_profit_if_nothing_eur"),
        eur(F.col("regret_cents")).alias("regret_eur"),
        (F.col("p_action") - F.col("p_none")).alias("true_uplift"),
        F.col("p_action").alias("true_purchase_probability"))


# -------------------------------------------------------------------------------- reports
def star(decisions: DataFrame, outcomes: DataFrame, policy: DataFrame, action: DataFrame,
         customer: DataFrame | None = None) -> DataFrame:
    """Facts joined to their dimensions, one row per decision."""
    df = decisions.join(outcomes, "decision_key").join(F.broadcast(policy), "policy_key").join(
        F.broadcast(action), "action_key")
    return df if customer is None else df.join(customer, "customer_key")


def rpt_policy_kpis(rows: DataFrame) -> DataFrame:
    avg = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    c = F.col
    return rows.groupBy("policy", "policy_label", "is_ml_policy").agg(
        F.count(F.lit(1)).alias("decisions"), avg(c("is_contact")).alias("contact_rate"),
        avg(c("is_restraint")).alias("restraint_rate"),
        avg(c("is_discount")).alias("discount_rate"),
        F.count_if("converted").alias("conversions"), avg(c("converted")).alias("conversion_rate"),
        F.round(F.sum("profit_eur"), 2).alias("profit_eur"),
        F.round(F.sum(c("expected_profit_eur") - c("expected_profit_if_nothing_eur")), 2)
        .alias("expected_profit_vs_nothing_eur"),
        F.round(F.sum("discount_cost_eur"), 2).alias("discount_cost_eur"),
        F.round(ratio(F.count_if("is_wasted_discount"),
                      F.count_if(c("is_discount") & c("converted"))), 6)
        .alias("wasted_discount_share"),
        F.round(F.avg(F.when(c("would_buy_anyway"), F.when(c("is_discount"), 0.0).otherwise(1.0))),
                6).alias("no_incentive_rate_would_buy_anyway"),
        F.round(F.avg("regret_eur") * 100, 6).alias("mean_regret_cents"),
        F.count_if("is_overridden").alias("overrides"))


def rpt_retention_cohorts(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Share of each first-seen month that ordered in each later month.

    One row per customer and order month first, so that the distinct counts are plain counts.
    """
    month = F.trunc(day_date(F.col("day_index"), settings.start_date), "MM")
    months = events.withColumn("_m", month).groupBy("customer_id", "_m").agg(
        F.count_if(F.col("event_type") == "order_placed").alias("orders"))
    first = months.groupBy("customer_id").agg(F.min("_m").alias("cohort"))
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_customers"))
    ordered = months.where("orders > 0").join(first, "customer_id").groupBy(
        "cohort", F.months_between("_m", "cohort").cast("long").alias("months_since_first_seen")
    ).agg(F.count(F.lit(1)).alias("ordering_customers"))
    return ordered.where("months_since_first_seen >= 0").join(sizes, "cohort").select(
        F.date_format("cohort", "yyyy-MM").alias("cohort_month"), "months_since_first_seen",
        "cohort_customers", "ordering_customers",
        F.round(ratio(F.col("ordering_customers"), F.col("cohort_customers")), 6)
        .alias("retention_rate"))


def rpt_data_quality(landed: DataFrame, rejects: DataFrame,
                     settings: Settings = SETTINGS) -> DataFrame:
    """The overall reject rate and one row per failing gate."""
    named = F.regexp_extract("reason", "'([a-z_]+)'", 1)
    gate = F.when(F.col("reason").startswith("semantic gate "), named).otherwise("contract")
    per_gate = rejects.groupBy("stage", gate.alias("gate")).agg(
        F.count(F.lit(1)).alias("failing_rows"))
    kept = landed.agg(F.count(F.lit(1)).alias("n")).scalar()
    failing = F.col("failing_rows")
    # the total comes from the per-gate counts, so rejects are read once
    totals = per_gate.agg(F.coalesce(F.sum("failing_rows"), F.lit(0)).alias("failing_rows"))
    checked = kept + totals.select("failing_rows").scalar()
    share = ratio(failing, checked)
    overall = totals.select(
        F.lit("reject_rate").alias("check_name"), F.lit("all").alias("stage"), "failing_rows",
        checked.alias("checked_rows"), F.round(share, 6).alias("failing_share"),
        F.lit(settings.max_reject_rate).alias("threshold"),
        (share <= settings.max_reject_rate).alias("passed"))
    gates = per_gate.select(
        F.concat(F.lit("gate:"), "gate").alias("check_name"), "stage", "failing_rows",
        checked.alias("checked_rows"), F.round(share, 6).alias("failing_share"),
        F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("passed"))
    return overall.unionByName(gates)
