import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.config import SETTINGS
from holdfast.operators import asof
from holdfast.operators import features as ft
from holdfast.operators.quality import decode
from holdfast.sources import tables

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SMALL = SETTINGS.with_(horizon_days=12)


def events(spark, rows):
    """rows: (id, customer, session, ts, type, payload json)"""
    return decode(spark.createDataFrame(
        [(i, c, s, t, k, p, "simulator") for i, c, s, t, k, p in rows], schemas.EVENT))


def view(cat="A"):
    return f'{{"type":"product_view","sku":"1","category":"{cat}","unit_price_cents":5}}'


def cart(kind, n):
    return f'{{"type":"{kind}","sku":"1","quantity":{n}}}'


def hot_log(n=3000, seed=5):
    """One customer holds most rows; instants collide and fall on slice and day edges."""
    rng = random.Random(seed)
    kinds = ["product_view", "add_to_cart", "cart_remove", "cart_abandon", "session_start",
             "order_placed", "campaign_exposure"]
    out = []
    for i in range(n):
        customer = "hot" if rng.random() < 0.7 else f"c{rng.randrange(5)}"
        minute = rng.randrange(-2 * 1440, 13 * 1440)
        ts = START + timedelta(minutes=minute, seconds=rng.choice([0, 0, 1, 59]),
                               microseconds=rng.choice([0, 0, 1]))
        kind = rng.choice(kinds)
        qty = rng.randrange(1, 4)
        payload = {"product_view": view(rng.choice("ABC")), "add_to_cart": cart(kind, qty),
                   "cart_remove": cart(kind, qty)}.get(kind, f'{{"type":"{kind}"}}')
        if kind == "order_placed":
            payload = ('{"type":"order_placed","order_id":"o","line_items":[{"sku":"1",'
                       f'"quantity":1,"unit_price_cents":9,"discount_cents":{qty % 2}}}],'
                       f'"order_total_cents":{qty * 10}}}')
        out.append((str(i), customer, f"s{rng.randrange(8)}", ts, kind, payload))
    return out


def brute(rows, customer, as_of):
    import json
    own = [r for r in rows if r[1] == customer and r[3] <= as_of]
    inside = lambda r, d: r[3] > as_of - timedelta(days=d)
    resets = [r[3] for r in own if r[4] in ("cart_abandon", "order_placed")]
    last = max(resets) if resets else None
    units = sum(json.loads(r[5])["quantity"] * (1 if r[4] == "add_to_cart" else -1) for r in own
                if r[4] in ("add_to_cart", "cart_remove") and (last is None or r[3] > last))
    views = sum(r[4] == "product_view" and inside(r, 30) for r in own)
    sessions = len({r[2] for r in own if r[4] == "session_start" and inside(r, 30)})
    return {
        "cart_state_units": max(units, 0),
        "message_fatigue_count": sum(r[4] == "campaign_exposure" and inside(r, 14) for r in own),
        "session_depth_mean_views": round(views / sessions, 6) if sessions else 0.0,
        "rfm_monetary_cents": sum(json.loads(r[5])["order_total_cents"] for r in own
                                  if r[4] == "order_placed" and inside(r, 90)),
    }


def test_grid_against_brute_force_with_a_hot_customer(spark):
    rows = hot_log()
    grid = {(r.customer_id, r.day): r for r in ft.feature_grid(
        events(spark, rows), SMALL).collect()}
    assert len(grid) == 6 * 12
    for (customer, day), got in grid.items():
        want = brute(rows, customer, START + timedelta(days=day))
        for name, value in want.items():
            assert getattr(got, name) == pytest.approx(value, abs=2e-6), (customer, day, name)


def test_lookup_equals_grid(spark):
    ev = events(spark, hot_log(800))
    grid = ft.feature_grid(ev, SMALL)
    looked = ft.features_as_of(ev, grid.select("customer_id", F.col("as_of_ts").alias("as_of")))
    names = ["customer_id", "rfm_frequency_count", "cart_state_units", "session_depth_mean_views",
             "price_sensitivity_proxy", "abandonment_history_count", "message_fatigue_count"]
    a = grid.select(*names, F.col("as_of_ts").alias("as_of"), F.to_json("category_affinity"))
    b = looked.select(*names, "as_of", F.to_json("category_affinity"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_lookahead_and_boundary(spark):
    rows = hot_log(500)
    ev = events(spark, rows)
    base = tables.fingerprint(ft.feature_grid(ev, SMALL).drop("category_affinity")).first()
    far = [(f"f{i}", "hot", "sf", START + timedelta(days=400), "order_placed", rows[0][5])
           for i in range(50)]
    later = tables.fingerprint(ft.feature_grid(
        events(spark, rows + far), SMALL).drop("category_affinity")).first()
    assert base == later
    at = START + timedelta(days=3)
    edge = [("0", "x", "s", at, "session_start", "{}"),
            ("1", "y", "s", at + timedelta(microseconds=1), "session_start", "{}")]
    seen = {(r.customer_id, r.day): r.session_visits_count for r in ft.feature_grid(
        events(spark, edge), SMALL).collect()}
    assert (seen["x", 3], seen["y", 3], seen["y", 4], seen["x", 2]) == (1, 0, 1, 0)


def test_unknown_customer_gets_defaults_and_naive_time_is_refused(spark):
    ev = events(spark, hot_log(50))
    ids = spark.sql("select 'nobody' customer_id, timestamp'2024-01-05' as_of")
    r = ft.features_as_of(ev, ids).first()
    assert r.rfm_recency_days is None and r.rfm_frequency_count == 0
    assert r.session_dwell_counts_json == '{"short":0,"medium":0,"long":0}'
    assert r.category_affinity == {}
    with pytest.raises(ValueError):
        ft.features_as_of(ev, ids.withColumn("as_of", F.col("as_of").cast("timestamp_ntz")))


def test_asof_join_brute_force(spark):
    rng = random.Random(3)
    right = [("k", START + timedelta(seconds=rng.randrange(0, 50_000)), i) for i in range(400)]
    left = [("k" if i % 9 else "z", START + timedelta(seconds=rng.randrange(-100, 60_000)), i)
            for i in range(300)]
    l = spark.createDataFrame(left, "k string, at timestamp, n int")
    r = spark.createDataFrame(right, "k string, ts timestamp, v int").withColumn("seen", F.col("ts"))
    got = {x.n: x.seen for x in asof.asof_join(l, r, ["k"], "at", "ts", ["seen"], 600).collect()}
    assert len(got) == 300
    for k, at, n in left:
        best = max((t for rk, t, _ in right if rk == k and t <= at), default=None)
        have = got[n].replace(tzinfo=timezone.utc) if got[n] else None
        assert have == best


def test_time_split(spark):
    df = spark.sql("select timestamp'2024-01-01' as_of_ts union all select timestamp'2024-01-02'")
    got = {str(r.as_of_ts)[:10]: r.split for r in ft.time_split(df, datetime(2024, 1, 1)).collect()}
    assert got == {"2024-01-01": "train", "2024-01-02": "test"}
    assert ft.time_split(df.limit(1), datetime(2024, 1, 1)).count() == 0
    assert "single" in ft.time_split_reason(df.limit(1)).first().reason
    assert ft.time_split_reason(df.limit(0)).first().reason == "no snapshots supplied"


def test_span_follows_the_log(spark, ws):
    later = ws.events.select("event_id", "customer_id", "session_id", (F.col("ts") + F.expr(
        "INTERVAL 40 DAYS")).alias("ts"), "type", "payload", "source", "p")
    log = ws.events.select(*later.columns).unionByName(later)
    with pytest.raises(ft.OutsideSpan):
        ft.require_span(log)
    found = ft.span(log)
    days = log.select(F.to_date("ts").alias("d")).agg(F.min("d"), F.max("d")).first()
    assert found.start_date == days[0] and found.horizon_days == (days[1] - days[0]).days + 2
    ft.require_span(log, found)
    grid = ft.feature_grid(log, found)
    last = grid.where(F.col("day") == found.horizon_days - 1)
    assert grid.agg(F.max("day")).first()[0] == found.horizon_days - 1
    # every order of the last 90 days is counted on the last day
    at = last.select("as_of_ts").first()[0]
    orders = log.where("type = 'order_placed'").where(
        F.col("ts") > F.lit(at) - F.expr("INTERVAL 90 DAYS")).count()
    assert last.agg(F.sum("rfm_frequency_count")).first()[0] == orders
    assert ft.span(log.limit(0)).horizon_days == 31


def test_inventory_is_never_broadcast(spark):
    """An exploded inventory passes for small; only the catalog may be the hashed side."""
    from holdfast.operators import context

    inventory = spark.range(500).select(F.explode(F.sequence(F.lit(0), F.lit(30))).alias("tick"),
                                        F.col("id").cast("string").alias("sku"),
                                        (F.col("id") + 3).alias("units"))
    catalog = spark.range(500).select(F.col("id").cast("string").alias("sku"),
                                      F.lit("a").alias("category"), F.lit("x" * 50).alias("name"))
    stock = context.category_stock(inventory, catalog)
    plan = stock._jdf.queryExecution().sparkPlan().toString()
    built = [line for line in plan.splitlines() if "HashJoin" in line]
    assert len(built) == 1 and "ShuffledHashJoin" in built[0] and "BuildRight" in built[0]
    assert {(r.tick, r.units) for r in stock.collect()} == {(k, 3) for k in range(31)}
