"""Point-in-time customer features: a daily grid and an on-demand lookup.

A grid row at midnight of day d sees events with `ts <= d 00:00` and, inside a window of N
days, `ts > (d - N) 00:00`. An event therefore first counts on day `b = ceil((ts - start) / 1
day)` and, in a window of N days, stops counting on day `b + N`. Each measure is summed per
(customer, b) once, turned into `+v` at b and `-v` at b + N, and read back as one running sum
per customer: cost grows with active days, never with days x window length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.numbers import ceil_div, half_even, micros_from, ratio
from holdfast.functions.text import normalize_identifier
from holdfast.operators.quality import decode

DAY_SECONDS = 86_400
CART_SLICE_SECONDS = 60
AFFINITY_DAYS = 90
SESSION_DAYS = 30


@dataclass(frozen=True)
class Rolling:
    """A windowed count or sum: `value` is the long one event adds."""

    name: str
    window_days: int
    value: Callable[[Column, Column], Column]


ROLLING: dict[str, Rolling] = {}


def register_feature(name: str, window_days: int):
    """Register `fn(type, payload) -> long column` as a rolling measure of the grid."""

    def add(fn: Callable[[Column, Column], Column]):
        if name in ROLLING:
            raise ValueError(f"feature {name!r} is already registered")
        ROLLING[name] = Rolling(name, window_days, fn)
        return fn

    return add


def _one(flag: Column) -> Column:
    return F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("long")


@register_feature("rfm_frequency_count", 90)
def _orders(kind, p):
    return _one(kind == "order_placed")


@register_feature("rfm_monetary_cents", 90)
def _spend(kind, p):
    return F.when(kind == "order_placed", p["order_total_cents"])


@register_feature("session_visits_count", 30)
def _visits(kind, p):
    return _one(kind == "session_start")


@register_feature("views", 30)
def _views(kind, p):
    return _one(kind == "product_view")


@register_feature("dwell_short", 30)
def _dwell_short(kind, p):
    return _one((kind == "dwell") & (p["dwell_class"] == "short"))


@register_feature("dwell_medium", 30)
def _dwell_medium(kind, p):
    return _one((kind == "dwell") & (p["dwell_class"] == "medium"))


@register_feature("dwell_long", 30)
def _dwell_long(kind, p):
    return _one((kind == "dwell") & (p["dwell_class"] == "long"))


@register_feature("items", 90)
def _items(kind, p):
    return F.when(kind == "order_placed", F.greatest(F.size(p["line_items"]), F.lit(0)))


@register_feature("discounted_items", 90)
def _discounted(kind, p):
    return F.when(kind == "order_placed", F.greatest(F.size(F.filter(
        p["line_items"], lambda x: x["discount_cents"] > 0)), F.lit(0)))


@register_feature("message_fatigue_count", 14)
def _messages(kind, p):
    return _one(kind.isin("campaign_exposure", "action_delivered"))


@register_feature("abandonment_history_count", 90)
def _abandons(kind, p):
    return _one(kind == "cart_abandon")


@register_feature("scroll", 30)
def _scroll(kind, p):
    return _one(kind == "scroll")


@register_feature("filter_apply", 30)
def _filter_apply(kind, p):
    return _one(kind == "filter_apply")


@register_feature("dwell", 30)
def _dwell(kind, p):
    return _one(kind == "dwell")


class OutsideSpan(ValueError):
    pass


def span(events: DataFrame, settings: Settings = SETTINGS) -> Settings:
    """Settings with the first day and the horizon of the log: one min/max aggregate."""
    low, high = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    if low is None:
        return settings
    # the last grid day is the midnight after the last event
    return settings.with_(start_date=low, horizon_days=(high - low).days + 2)


def require_span(events: DataFrame, settings: Settings = SETTINGS) -> None:
    """Fail when events lie behind the last grid day: no later step would count them."""
    late = events.agg(F.max("ts").alias("ts")).select(
        (F.col("ts") > F.date_add(F.lit(settings.start_date), settings.horizon_days)).alias("late"),
        "ts").first()
    if late["late"]:
        raise OutsideSpan(f"events until {late['ts']} are past the horizon of "
                          f"{settings.horizon_days} days from {settings.start_date}; see span()")


def first_day_seen(ts: Column, settings: Settings = SETTINGS) -> Column:
    """The first grid day whose midnight is at or after `ts` (may be negative)."""
    return ceil_div(micros_from(ts, settings.start_date), DAY_SECONDS * 1_000_000)


def _typed(events: DataFrame) -> DataFrame:
    return events if "p" in events.columns else decode(events)


def daily_measures(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row per (customer, first-seen day): every rolling measure and the last order.

    Events after the grid end fold into one marker bucket: they name the customer, no more.
    """
    late = F.lit(settings.horizon_days)
    bucket = F.least(first_day_seen(F.col("ts"), settings), late)
    kind, p = F.col("type"), F.col("p")
    sums = [F.coalesce(F.sum(r.value(kind, p)), F.lit(0)).cast("long").alias(r.name)
            for r in ROLLING.values()]
    last_order = F.max(F.when(kind == "order_placed", F.col("ts"))).alias("last_order_ts")
    return _typed(events).withColumn("bucket", bucket).groupBy("customer_id", "bucket").agg(
        *sums, last_order)


def cart_changes(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(customer, day, cart_net, cart_reset): basket units moved since the day's last reset.

    Works in one-minute slices first, so that no task sorts a hot customer's raw events, then
    folds slices into days. A cart event at the very instant of a reset does not count.
    """
    kind, qty = F.col("type"), F.col("p.quantity")
    reset = kind.isin("cart_abandon", "order_placed")
    rows = _typed(events).where(kind.isin(
        "add_to_cart", "cart_remove", "cart_abandon", "order_placed")).select(
        "customer_id", "ts",
        ceil_div(micros_from(F.col("ts"), settings.start_date),
                 CART_SLICE_SECONDS * 1_000_000).alias("slice"),
        F.when(reset, F.col("ts")).alias("reset_ts"),
        F.when(kind == "add_to_cart", qty).when(kind == "cart_remove", -qty).otherwise(0)
        .alias("units"))
    in_slice = Window.partitionBy("customer_id", "slice")
    slices = rows.withColumn("last_reset", F.max("reset_ts").over(in_slice)).groupBy(
        "customer_id", "slice").agg(
        F.sum(F.when(F.col("last_reset").isNull() | (F.col("ts") > F.col("last_reset")),
                     F.col("units")).otherwise(0)).alias("net"),
        F.max("last_reset").isNotNull().alias("has_reset"))
    per_day = DAY_SECONDS // CART_SLICE_SECONDS
    days = slices.withColumn("day", F.greatest(ceil_div(F.col("slice"), per_day), F.lit(0)))
    in_day = Window.partitionBy("customer_id", "day")
    return days.where(F.col("day") < settings.horizon_days).withColumn(
        "reset_slice", F.max(F.when(F.col("has_reset"), F.col("slice"))).over(in_day)
    ).groupBy("customer_id", "day").agg(
        F.sum(F.when(F.col("reset_slice").isNull() | (F.col("slice") >= F.col("reset_slice")),
                     F.col("net")).otherwise(0)).alias("cart_net"),
        F.max("reset_slice").isNotNull().alias("cart_reset"))


def session_changes(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(customer, day, sessions): +1/-1 steps of the distinct sessions started in 30 days.

    A session started on several days covers the union of their windows, counted once.
    """
    starts = events.where(F.col("type") == "session_start").select(
        "customer_id", "session_id", first_day_seen(F.col("ts"), settings).alias("bucket")
    ).where(F.col("bucket") < settings.horizon_days).distinct()
    nxt = F.lead("bucket").over(
        Window.partitionBy("customer_id", "session_id").orderBy("bucket"))
    end = F.least(F.col("bucket") + SESSION_DAYS, F.coalesce(nxt, F.lit(1 << 30)))
    spans = starts.withColumn("end", end).where(F.col("end") > 0)
    steps = F.array(
        F.struct(F.greatest("bucket", F.lit(0)).alias("day"), F.lit(1).alias("sessions")),
        F.struct(F.col("end").alias("day"), F.lit(-1).alias("sessions")))
    return spans.select("customer_id", F.inline(steps)).where(
        F.col("day") < settings.horizon_days).groupBy("customer_id", "day").agg(
        F.sum("sessions").alias("sessions"))


def _steps(daily: DataFrame, settings: Settings) -> DataFrame:
    """Daily measures as signed steps: in on the first-seen day, out when the window closes."""
    horizon = settings.horizon_days
    names = list(ROLLING)
    zero = {n: F.lit(0).cast("long") for n in names}
    no_ts = F.lit(None).cast("timestamp")
    bucket = F.col("bucket")

    def step(day: Column, values: dict[str, Column], last: Column) -> Column:
        filled = {**zero, **values}
        return F.struct(day.cast("long").alias("day"), last.alias("last_order_ts"),
                        *[filled[n].alias(n) for n in names])

    entry = {n: F.when(bucket + r.window_days > 0, F.col(n)).otherwise(F.lit(0).cast("long"))
             for n, r in ROLLING.items()}
    rows = [step(F.greatest(bucket, F.lit(0)), entry, F.col("last_order_ts")),
            step(F.lit(0), {}, no_ts)]  # every customer has a row on day 0
    for width in sorted({r.window_days for r in ROLLING.values()}):
        out = {n: -F.col(n) for n, r in ROLLING.items() if r.window_days == width}
        leaves = (bucket + width > 0) & (bucket + width < horizon)
        rows.append(F.when(leaves, step(bucket + width, out, no_ts)))
    kept = F.filter(F.array(*rows), lambda s: s.isNotNull() & (s["day"] < horizon))
    return daily.select("customer_id", F.inline(kept))


def feature_changes(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row per (customer, day on which anything changes) with running values."""
    events = _typed(events)
    steps = _steps(daily_measures(events, settings), settings)
    for extra in (cart_changes(events, settings), session_changes(events, settings)):
        steps = steps.unionByName(extra, allowMissingColumns=True)
    names = list(ROLLING)
    # one exchange on customer serves the daily sums, the running sums and the caller's join
    changes = steps.repartition("customer_id").groupBy("customer_id", "day").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.max("last_order_ts").alias("last_order_ts"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("cart_net"), F.lit(0)).alias("cart_net"),
        F.coalesce(F.max("cart_reset"), F.lit(False)).alias("cart_reset"))
    order = Window.partitionBy("customer_id").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = changes.select(
        "customer_id", "day", "cart_net", "cart_reset",
        F.lead("day", 1, settings.horizon_days).over(order).alias("until"),
        F.max("last_order_ts").over(so_far).alias("last_order_ts"),
        F.sum("cart_net").over(so_far).alias("cart_total"),
        *[F.sum(n).over(so_far).alias(n) for n in [*names, "sessions"]])
    # units moved before the last reset are taken off again
    base = F.when(F.col("cart_reset"), F.col("cart_total") - F.col("cart_net"))
    return running.withColumn(
        "cart", F.col("cart_total") - F.coalesce(
            F.last(base, ignorenulls=True).over(so_far), F.lit(0)))


def category_affinity(events: DataFrame, settings: Settings = SETTINGS,
                      nfc: bool = True) -> DataFrame:
    """(customer, day, category_affinity): share of product views per category, 90 days."""
    views = _typed(events).where(F.col("type") == "product_view").groupBy(
        "customer_id", F.col("p.category").alias("category"),
        first_day_seen(F.col("ts"), settings).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    horizon = settings.horizon_days
    views = views.where((F.col("bucket") < horizon) & (F.col("bucket") + AFFINITY_DAYS > 0))
    if nfc:
        views = normalize_identifier(views, "category")
    steps = F.array(
        F.struct(F.greatest("bucket", F.lit(0)).alias("day"), F.col("n").alias("n")),
        F.struct((F.col("bucket") + AFFINITY_DAYS).alias("day"), (-F.col("n")).alias("n")))
    changes = views.select("customer_id", "category", F.inline(steps)).where(
        F.col("day") < horizon).repartition("customer_id").groupBy(
        "customer_id", "category", "day").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("customer_id", "category").orderBy("day")
    runs = changes.select(
        "customer_id", "category", "day",
        F.lead("day", 1, horizon).over(order).alias("until"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n")
    ).where("n > 0")
    # at most one entry per category of the catalog and day
    daily = runs.select("customer_id", "category", "n",
                        F.explode(F.sequence("day", F.col("until") - 1)).alias("day"))
    grouped = daily.groupBy("customer_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("category", "n"))).alias("entries"),
        F.sum("n").alias("total"))
    return grouped.select("customer_id", "day", F.map_from_entries(F.transform(
        "entries", lambda e: F.struct(e["category"], half_even(ratio(e["n"], F.col("total"))))
    )).alias("category_affinity"))


def _grid_columns(as_of: Column) -> list[Column]:
    c = F.col
    return [
        F.datediff(F.to_date(as_of), F.to_date("last_order_ts")).cast("long")
        .alias("rfm_recency_days"),
        c("rfm_frequency_count"), c("rfm_monetary_cents"), c("session_visits_count"),
        F.coalesce(half_even(ratio(c("views"), c("sessions"))), F.lit(0.0))
        .alias("session_depth_mean_views"),
        F.to_json(F.struct(c("dwell_short").alias("short"), c("dwell_medium").alias("medium"),
                           c("dwell_long").alias("long"))).alias("session_dwell_counts_json"),
        F.coalesce("category_affinity", F.create_map().cast("map<string,double>"))
        .alias("category_affinity"),
        F.coalesce(half_even(ratio(c("discounted_items"), c("items"))), F.lit(0.0))
        .alias("price_sensitivity_proxy"),
        c("message_fatigue_count"),
        F.greatest(c("cart"), F.lit(0).cast("long")).alias("cart_state_units"),
        c("abandonment_history_count"),
        F.to_json(F.struct(c("scroll"), c("filter_apply"), c("dwell")))
        .alias("micro_conversion_counts_json"),
        c("dwell_medium").alias("dwell_medium_count"), c("dwell_long").alias("dwell_long_count"),
        c("scroll").alias("scroll_count"), c("filter_apply").alias("filter_apply_count"),
    ]


def feature_grid(events: DataFrame, settings: Settings = SETTINGS, nfc: bool = True) -> DataFrame:
    """Every active customer x every grid day, all feature families."""
    events = _typed(events)
    changes = feature_changes(events, settings)
    # values hold until the next change; the fill is a bounded explode, not a join
    filled = changes.withColumn(
        "day", F.explode(F.sequence("day", F.col("until") - 1))).drop("until")
    affinity = category_affinity(events, settings, nfc)
    joined = filled.join(affinity, ["customer_id", "day"], "left")
    as_of = F.date_add(F.lit(settings.start_date), F.col("day").cast("int")).cast("timestamp")
    extra = [F.col(n) for n in ROLLING if n not in _GRID_INPUTS]
    return joined.withColumn("as_of_ts", as_of).select(
        "customer_id", "day", "as_of_ts", *_grid_columns(F.col("as_of_ts")), *extra)


# measures that only feed another column; features registered later appear as they are
_GRID_INPUTS = tuple(ROLLING)


# ----------------------------------------------------------------------------------- lookup
def features_as_of(events: DataFrame, ids: DataFrame, nfc: bool = True) -> DataFrame:
    """Features of `ids (customer_id, as_of)` at arbitrary instants; unknown ids get defaults.

    `as_of` must be an instant (a zone-less column is refused). Any number of ids is allowed:
    the join is an equi join on customer with the time bound as a residual filter.
    """
    kind = ids.schema["as_of"].dataType.typeName()
    if kind != "timestamp":
        raise ValueError(f"as_of must be a timestamp with a zone, got {kind}")
    events = _typed(events)
    keys = ["customer_id", "as_of"]
    reach = ids.join(events.select("customer_id", "session_id", "ts", "type", "p"), "customer_id")
    seen = reach.where(F.col("ts") <= F.col("as_of"))
    age_us = F.unix_micros("as_of") - F.unix_micros("ts")
    within = lambda days: age_us < days * DAY_SECONDS * 1_000_000
    t, p = F.col("type"), F.col("p")
    reset = t.isin("cart_abandon", "order_placed")
    base = seen.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(within(r.window_days), r.value(t, p))), F.lit(0))
          .cast("long").alias(r.name) for r in ROLLING.values()],
        F.max(F.when(t == "order_placed", F.col("ts"))).alias("last_order_ts"),
        F.max(F.when(reset, F.col("ts"))).alias("last_reset"),
        F.count_distinct(F.when((t == "session_start") & within(SESSION_DAYS),
                                F.col("session_id"))).alias("sessions"))
    moved = seen.where(t.isin("add_to_cart", "cart_remove")).join(
        base.select(*keys, "last_reset"), keys).where(
        F.col("last_reset").isNull() | (F.col("ts") > F.col("last_reset"))).groupBy(*keys).agg(
        F.sum(F.when(t == "add_to_cart", p["quantity"]).otherwise(-p["quantity"])).alias("cart"))
    views = seen.where((t == "product_view") & within(AFFINITY_DAYS)).groupBy(
        *keys, p["category"].alias("category")).agg(F.count(F.lit(1)).alias("n"))
    if nfc:
        views = normalize_identifier(views, "category")
    affinity = views.groupBy(*keys, "category").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("category", "n"))).alias("e"),
        F.sum("n").alias("total")).select(*keys, F.map_from_entries(F.transform(
            "e", lambda x: F.struct(x["category"], half_even(ratio(x["n"], F.col("total"))))
        )).alias("category_affinity"))
    full = ids.select(*keys).distinct().join(base, keys, "left").join(moved, keys, "left").join(
        affinity, keys, "left")
    full = full.fillna(0, subset=[*ROLLING, "sessions", "cart"])
    return full.select(*keys, *_grid_columns(F.col("as_of")))


# ------------------------------------------------------------------------------------ splits
def time_split(snapshots: DataFrame, boundary) -> DataFrame:
    """Label rows `train` (`as_of_ts <= boundary`) or `test`; fewer than two distinct instants
    leave nothing to split, so the result is empty (see `time_split_reason`)."""
    bounds = snapshots.agg(F.min("as_of_ts").alias("_lo"), F.max("as_of_ts").alias("_hi"))
    side = F.when(F.col("as_of_ts") <= F.lit(boundary), "train").otherwise("test")
    return snapshots.join(F.broadcast(bounds), F.col("_lo") < F.col("_hi")).drop(
        "_lo", "_hi").withColumn("split", side)


def time_split_reason(snapshots: DataFrame) -> DataFrame:
    """One row: why a split would be empty, or null."""
    return snapshots.agg(
        F.count(F.lit(1)).alias("n"), F.min("as_of_ts").alias("lo"),
        F.max("as_of_ts").alias("hi")).select(
        F.when(F.col("n") == 0, "no snapshots supplied").when(
            F.col("lo") == F.col("hi"), "all snapshots share a single as_of_ts")
        .alias("reason"))
