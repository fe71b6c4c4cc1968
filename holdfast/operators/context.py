"""Decision contexts: what is known about a customer at the start of a day.

A context on day d sees grid row d, contacts on calendar days before d and the stock left at
the end of day d - 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.numbers import day_date, day_index
from holdfast.operators.quality import decode

WEEK, FORTNIGHT = 7, 14


def grid_rows(grid: DataFrame, days: Iterable[int]) -> DataFrame:
    """Grid rows of the wanted days; on a grid stored by day this prunes directories."""
    return grid.where(F.col("day").isin(*[int(d) for d in days]))


def first_active_day(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return events.groupBy("customer_id").agg(
        F.min(day_index(F.col("ts"), settings.start_date)).alias("first_day"))


def exposure_days(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(customer, exposure day, n): campaign exposures per calendar day."""
    return events.where(F.col("type") == "campaign_exposure").groupBy(
        "customer_id", day_index(F.col("ts"), settings.start_date).alias("exposure_day")).agg(
        F.count(F.lit(1)).alias("n"))


def contact_history(events: DataFrame, settings: Settings = SETTINGS,
                    windows: Sequence[int] = (WEEK, FORTNIGHT)) -> DataFrame:
    """(customer, day) for every day after the first active one: first day seen and contacts
    of the last `windows` days (contacts_7d and so on) and in all, each strictly before `day`.

    Counts per calendar day become steps (+n the day after, -n when the window closes) and a
    running sum per customer, as in the feature grid; no list of contacts is ever built.
    """
    horizon = settings.horizon_days
    daily = events.groupBy(
        "customer_id", day_index(F.col("ts"), settings.start_date).alias("c")).agg(
        F.count_if(F.col("type") == "campaign_exposure").alias("n"))
    c, n, zero = F.col("c"), F.col("n"), F.lit(0).cast("long")
    names = [f"contacts_{w}d" for w in windows]

    def step(day: Column, total: Column, seen: Column, **moves: Column) -> Column:
        return F.struct(F.greatest(day, zero).alias("day"),
                        *[moves.get(name, zero).alias(name) for name in names],
                        total.alias("contacts_total"), seen.alias("first_day"))

    gone = F.lit(None).cast("long")
    opened = {name: F.when(c + w >= 0, n).otherwise(zero) for name, w in zip(names, windows)}
    steps = F.array(step(c + 1, n, c, **opened), *[
        F.when(c + w >= 0, step(c + w + 1, zero, gone, **{name: -n}))
        for name, w in zip(names, windows)])
    sums = (*names, "contacts_total")
    changes = daily.select("customer_id", F.inline(F.filter(
        steps, lambda s: s.isNotNull() & (s["day"] < horizon)))).repartition(
        "customer_id").groupBy("customer_id", "day").agg(
        *[F.sum(s).alias(s) for s in sums], F.min("first_day").alias("first_day"))
    order = Window.partitionBy("customer_id").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = changes.select(
        "customer_id", "day", F.lead("day", 1, horizon).over(order).alias("until"),
        F.min("first_day").over(so_far).alias("first_day"),
        *[F.sum(s).over(so_far).alias(s) for s in sums])
    return running.select(
        "customer_id", "first_day", *sums,
        F.explode(F.sequence("day", F.col("until") - 1)).alias("day"))


def contacts_ago(exposures: DataFrame, days: Iterable[int]) -> DataFrame:
    """Days since each past contact, most recent first, as (days_ago, n) per distinct day.

    Length is bounded by the horizon, however often a customer was contacted on one day.
    """
    wanted = F.array(*[F.lit(int(d)).cast("long") for d in days])
    pairs = exposures.withColumn("day", F.explode(wanted)).where(
        F.col("exposure_day") < F.col("day"))
    entry = F.struct((F.col("day") - F.col("exposure_day") - 1).alias("days_ago"), "n")
    return pairs.groupBy("customer_id", "day").agg(
        F.array_sort(F.collect_list(entry)).alias("contacts_ago"))


def contacts_within(contacts: Column, window_days: int) -> Column:
    """Contacts of the trailing window (`days_ago < window_days`)."""
    recent = F.filter(contacts, lambda c: c["days_ago"] < window_days)
    return F.aggregate(recent, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])


# ---------------------------------------------------------------------------- business state
def category_stock(inventory: DataFrame, catalog: DataFrame) -> DataFrame:
    """(tick, category, units): the scarcest sku of each category at the end of each day.

    An inventory made by an explode is many times what its size estimate tells, so the hint keeps
    it out of a broadcast: the catalog is the hashed side, partition by partition.
    """
    listed = catalog.select("sku", "category").hint("shuffle_hash")
    return inventory.join(listed, "sku").groupBy(
        "tick", "category").agg(F.min("units").alias("units"))


def first_item_sku(events: DataFrame) -> Column:
    return F.get(F.col("p.line_items"), F.lit(0))["sku"]


def category_orders(events: DataFrame, catalog: DataFrame, cutoff_day: int,
                    settings: Settings = SETTINGS) -> DataFrame:
    """Orders before the cutoff by the category of their first line item."""
    typed = events if "p" in events.columns else decode(events)
    orders = typed.where((F.col("type") == "order_placed") & (
        day_index(F.col("ts"), settings.start_date) < cutoff_day))
    lines = orders.select(first_item_sku(orders).alias("sku"),
                          F.col("p.order_total_cents").alias("total"))
    return lines.join(catalog.select("sku", "category"), "sku").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("total")).cast("long").alias("aov"))


def category_reference(events: DataFrame, catalog: DataFrame, cutoff_day: int,
                       settings: Settings = SETTINGS) -> DataFrame:
    """Per category: mean margin, order value (mean price where nothing was ordered), orders."""
    means = catalog.groupBy("category").agg(
        F.round(F.avg("margin_rate"), 6).alias("margin_rate"),
        F.round(F.avg("base_price_cents")).cast("long").alias("mean_price"))
    orders = category_orders(events, catalog, cutoff_day, settings)
    return means.join(orders, "category", "left").select(
        "category", "margin_rate", F.coalesce("aov", "mean_price").alias("order_value_cents"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def top_seller(reference: DataFrame) -> DataFrame:
    """The category with most orders; ties and an empty history go to the first name."""
    return reference.orderBy(F.col("n_orders").desc(), F.col("category").asc()).limit(1).select(
        "category")


def primary_category(affinity: Column) -> Column:
    """Largest share; equal shares go to the first name; null for an empty map."""
    ranked = F.transform(F.map_entries(affinity), lambda e: F.struct(
        (-e["value"]).alias("neg"), e["key"].alias("key")))
    return F.array_min(ranked)["key"]


def is_scarce(units: Column, settings: Settings = SETTINGS) -> Column:
    return F.coalesce(units <= settings.low_stock_threshold, F.lit(False))


def contexts(grid: DataFrame, events: DataFrame, catalog: DataFrame, inventory: DataFrame,
             days: Iterable[int], settings: Settings = SETTINGS,
             windows: Sequence[int] = (WEEK, FORTNIGHT)) -> DataFrame:
    """One wide row per eligible (customer, day); `windows` as in `rules.contact_windows`."""
    reference = category_reference(events, catalog, settings.train_end_day, settings)
    stock = category_stock(inventory, catalog)
    base = grid_rows(grid, days).join(
        contact_history(events, settings, windows), ["customer_id", "day"])  # inner: eligible only
    chosen = F.coalesce(primary_category(F.col("category_affinity")),
                        top_seller(reference).scalar())
    prior = F.greatest(F.col("day") - 1, F.lit(0))
    wide = base.withColumn("primary_category", chosen).withColumn("prior_day", prior)
    placed = wide.join(
        stock.select(F.col("tick").alias("prior_day"), F.col("category").alias(
            "primary_category"), "units"), ["prior_day", "primary_category"], "left"
    ).join(reference.select(F.col("category").alias("primary_category"), "margin_rate",
                            "order_value_cents"), "primary_category", "left")
    month = F.month(day_date(F.col("day"), settings.start_date)).cast("long")
    keep = [c for c in grid.columns if c not in ("customer_id", "day")]
    return placed.select(
        "customer_id", "day", *keep, "primary_category",
        F.coalesce(F.col("category_affinity")[F.col("primary_category")], F.lit(0.0))
        .alias("primary_affinity_share"),
        *[f"contacts_{w}d" for w in windows], "contacts_total", "first_day",
        F.greatest(F.col("day") - F.col("first_day"), F.lit(0)).alias("tenure_days"),
        month.alias("month"),
        F.coalesce("units", F.lit(settings.initial_stock)).alias("stock_units"),
        is_scarce(F.coalesce("units", F.lit(settings.initial_stock)), settings)
        .alias("low_stock"),
        "margin_rate", "order_value_cents")


# ------------------------------------------------------------------------------ model inputs
MODEL_FEATURES = (
    "has_ordered", "rfm_recency_days", "rfm_frequency_count", "rfm_monetary_cents",
    "session_visits_count", "session_depth_mean_views", "price_sensitivity_proxy",
    "message_fatigue_count", "cart_state_units", "abandonment_history_count",
    "dwell_long_count", "dwell_medium_count", "scroll_count", "filter_apply_count",
    "primary_affinity_share", "contacts_7d", "contacts_total", "tenure_days", "month_sin",
    "month_cos", "low_stock",
)


def model_columns(categories: Iterable[str],
                  settings: Settings = SETTINGS) -> dict[str, Column]:
    """The model-facing features by name, all double; training and scoring share this."""
    recency = F.col("rfm_recency_days")
    turn = F.lit(2 * math.pi) * F.col("month").cast("double") / F.lit(12.0)
    special = {
        "has_ordered": F.when(recency.isNull(), 0.0).otherwise(1.0),
        "rfm_recency_days": F.coalesce(
            F.least(recency.cast("double"), F.lit(settings.recency_cap_days)),
            F.lit(settings.recency_cap_days)),
        "month_sin": F.sin(turn),
        "month_cos": F.cos(turn),
        "low_stock": F.when(F.col("low_stock"), 1.0).otherwise(0.0),
    }
    out = {n: special.get(n, F.coalesce(F.col(n).cast("double"), F.lit(0.0)))
           for n in MODEL_FEATURES}
    for category in categories:
        out[f"primary_is_{category}"] = F.when(
            F.col("primary_category") == category, 1.0).otherwise(0.0)
    return out


def action_columns(archetypes: Iterable[str]) -> dict[str, Column]:
    """Action encoding: one indicator per archetype and the discount depth."""
    out = {f"action_is_{a}": F.when(F.col("archetype") == a, 1.0).otherwise(0.0)
           for a in archetypes}
    out["discount_depth"] = F.col("discount_bps") / F.lit(10_000.0)
    return out
