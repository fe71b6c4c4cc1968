"""Canonical views over the star-schema test tables (customers, parts, orders, events)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import PROB_MULTIPLIER, SETTINGS, Settings
from holdfast.functions.draws import uniform
from holdfast.session import spread
from holdfast.sources.tables import read_table, utc


def catalog(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "part").select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_type").alias("category"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("base_price_cents"),
        (F.lit(0.20) + (F.col("p_size") % 31) / F.lit(100.0)).alias("margin_rate"),
        F.when(F.col("p_size") % 2 == 0, "high").otherwise("low").alias("seasonality_class"),
    )


def inventory(spark: SparkSession, root: str, settings: Settings = SETTINGS) -> DataFrame:
    ticks = F.sequence(F.lit(0).cast("long"), F.lit(settings.horizon_days - 1).cast("long"))
    return spread(read_table(spark, root, "part"), settings.fixture_splits).select(
        F.explode(ticks).alias("tick"),
        F.col("p_partkey").cast("string").alias("sku"), "p_type", "p_partkey",
    ).select(
        "tick", "sku",
        (10 + (F.length("p_type") * 3 + F.col("tick") * 7) % 25 + F.col("p_partkey") % 5)
        .cast("long").alias("units"),
    )


def _event_type(kind: Column, k: Column) -> Column:
    click = reduce(
        lambda acc, pair: acc.when(k % 5 == pair[0], pair[1]),
        [(1, "scroll"), (2, "filter_apply"), (3, "dwell"), (4, "cart_remove")],
        F.when(k % 5 == 0, "add_to_cart"),
    )
    return (F.when(kind == "view", "product_view").when(kind == "purchase", "order_placed")
            .when(kind == "signup", "session_start")
            .when((kind == "error") & (k % 2 == 0), "campaign_exposure")
            .when(kind == "error", "cart_abandon").otherwise(click))


def _pick(k: Column, *names: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[col.alias(name) for name, col in fields.items()]))


def _payload() -> Column:
    k, kind = F.col("k"), F.col("type")
    sku, cents, qty, off = (F.col(c) for c in ("sku", "cents", "quantity", "discount"))
    line = F.struct(sku.alias("sku"), qty.alias("quantity"), cents.alias("unit_price_cents"),
                    off.alias("discount_cents"))
    forms = {
        "product_view": dict(sku=sku, category=F.col("category"), unit_price_cents=cents),
        "add_to_cart": dict(sku=sku, quantity=qty, unit_price_cents=cents),
        "cart_remove": dict(sku=sku, quantity=qty),
        "cart_abandon": dict(cart_value_cents=cents),
        "order_placed": dict(order_id=F.concat(F.lit("o"), F.col("event_id")),
                             line_items=F.array(line), order_total_cents=qty * cents - off),
        "campaign_exposure": dict(campaign_id=F.concat(F.lit("c"), (k % 7).cast("string")),
                                  channel=_pick(k, "email", "push")),
        "scroll": dict(depth_pct=k),
        "filter_apply": dict(facet=_pick(k, "price", "brand", "size"), value=k.cast("string")),
        "dwell": dict(dwell_class=_pick(k, "short", "medium", "long"), sku=sku),
        "session_start": dict(device=_pick(k, "desktop", "mobile", "tablet")),
    }
    out = None
    for name, fields in forms.items():
        made = _json(type=kind, **fields)
        out = F.when(kind == name, made) if out is None else out.when(kind == name, made)
    return out


def events(spark: SparkSession, root: str) -> DataFrame:
    """The canonical event log."""
    raw = spread(read_table(spark, root, "events"), SETTINGS.fixture_splits).select(
        "event_id", utc("ts").alias("ts"), F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    parts = catalog(spark, root).select(F.col("sku").alias("_sku"), "category")
    return (
        raw.select(
            F.col("event_id").cast("string").alias("event_id"), "ts", "customer_id", "k", "cents",
            _event_type(F.col("kind"), F.col("k")).alias("type"),
            F.concat_ws("-", "customer_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            (1 + F.col("k")).cast("string").alias("sku"),
            (1 + F.col("k") % 3).alias("quantity"),
            F.when(F.col("k") % 4 == 0, F.floor(F.col("cents") / 10).cast("long"))
            .otherwise(F.lit(0).cast("long")).alias("discount"),
        )
        .join(parts, F.col("sku") == F.col("_sku"), "left")
        .select("event_id", "customer_id", "session_id", "ts", "type",
                _payload().alias("payload"), F.lit("simulator").alias("source"))
    )


def order_events(spark: SparkSession, root: str) -> DataFrame:
    """`order_placed` events with several line items, from orders and their lines.

    An order without lines keeps an empty list, which the contract rejects.
    """
    lines = read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
        .alias("unit_price_cents"),
        F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")
        .alias("discount_cents"),
    )
    item = ["sku", "quantity", "unit_price_cents", "discount_cents"]
    nested = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", *item))).alias("rows"),
        F.sum(F.col("quantity") * F.col("unit_price_cents") - F.col("discount_cents"))
        .alias("total"),
    )
    orders = read_table(spark, root, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer_id"),
        utc("o_orderdate").alias("ts"))
    plain = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in item]))
    order_id = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    return (
        orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            order_id.alias("event_id"), "customer_id",
            F.concat_ws("-", "customer_id", F.col("o_orderkey").cast("string"))
            .alias("session_id"),
            "ts", F.lit("order_placed").alias("type"),
            _json(type=F.lit("order_placed"), order_id=order_id,
                  line_items=F.coalesce(plain, F.expr(
                      "cast(array() as array<struct<sku:string,quantity:bigint,"
                      "unit_price_cents:bigint,discount_cents:bigint>>)")),
                  order_total_cents=F.coalesce("total", F.lit(0))).alias("payload"),
            F.lit("adapter").alias("source"),
        )
    )


def raw_events(spark: SparkSession, root: str) -> DataFrame:
    """The event log as a producer sends it (text timestamps), with faults mixed in.

    Every event is kept; `event_id % 200` decides which fault, if any, a row carries.
    """
    ev = events(spark, root).withColumn("m", F.col("event_id").cast("long") % 200)
    m, payload = F.col("m"), F.col("payload")
    broken = (
        F.when(m == 0, F.regexp_replace(payload, '_cents":', '_cents":-1'))
        .when(m == 1, F.regexp_replace(payload, '"sku":"[0-9]+"', '"sku":"missing"'))
        .when(m == 5, F.regexp_replace(payload, r'^\{"type"', '{"extra":1,"type"'))
        .when(m == 7, F.regexp_replace(payload, r'"line_items":\[[^\]]*\]', '"line_items":[]'))
        .when(m == 11, F.regexp_replace(payload, '"unit_price_cents":[0-9]+',
                                        '"unit_price_cents":"abc"'))
        .when(m == 12, F.regexp_replace(payload, '"(channel|device|facet|dwell_class)":',
                                        '"$1_x":'))
        .otherwise(payload)
    )
    copies = F.when(m == 3, F.array(F.lit(0), F.lit(1))).when(
        m == 4, F.array(F.lit(0), F.lit(2))).when(
        m == 9, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    rows = ev.select("*", F.explode(copies).alias("copy"))
    shifted = F.when(F.col("copy") == 2, F.col("ts") + F.expr("interval 1 second")).otherwise(
        F.col("ts"))
    zone = F.when(m == 8, "").otherwise("+00:00")
    return rows.select(
        F.when(F.col("copy") == 1, F.concat(F.lit("n"), "event_id")).otherwise(F.col("event_id"))
        .alias("event_id"),
        F.when(m == 6, "").otherwise(F.col("customer_id")).alias("customer_id"),
        "session_id",
        F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone).alias("ts"),
        F.when(m == 2, "teleport").when(m == 10, "scroll").otherwise(F.col("type")).alias("type"),
        broken.alias("payload"), "source",
    )


def base_probability() -> Column:
    return F.lit(0.02) + F.lit(0.03) * uniform("p0", F.col("customer_id"), F.col("day"))


def purchase_probability(candidate: Column, archetype: Column) -> Column:
    """The supplied probability table as an expression over (customer, day, candidate)."""
    arm = F.create_map(*[F.lit(x) for kv in PROB_MULTIPLIER.items() for x in kv])[archetype]
    noise = F.lit(0.8) + F.lit(0.4) * uniform(
        "pa", F.col("customer_id"), F.col("day"), candidate)
    return F.when(archetype.isin("none", "wait"), base_probability()).otherwise(
        F.least(F.lit(1.0), base_probability() * arm * noise))
