import json
import uuid

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.config import EVENT_ID_NAMESPACE
from holdfast.functions import ids
from holdfast.operators import quality as q
from holdfast.plans.ingest import ingest
from holdfast.sources import adapters, tables

BASE = {"event_id": "e1", "customer_id": "c1", "session_id": "s1",
        "ts": "2024-01-02T03:04:05+00:00", "type": "product_view", "source": "simulator"}
VIEW = {"type": "product_view", "sku": "1", "category": "A", "unit_price_cents": 5}


def raw(spark, *records):
    rows = []
    for record in records:
        full = {**BASE, **record}
        payload = full.pop("payload", VIEW)
        full["payload"] = payload if isinstance(payload, str) else json.dumps(payload)
        rows.append(tuple(full[c] for c in schemas.RAW_EVENT.fieldNames()))
    return spark.createDataFrame(rows, schemas.RAW_EVENT)


CASES = [
    ({}, None),
    ({"event_id": ""}, "event_id: String should have at least 1 character"),
    ({"ts": "2024-01-02T03:04:05"}, "ts: Value error, ts must carry a UTC offset"),
    ({"ts": "yesterday"}, "ts: Input should be a valid datetime"),
    ({"source": "web"}, "source: Input should be 'simulator' or 'adapter'"),
    ({"payload": {**VIEW, "unit_price_cents": "not-a-number"}},
     "payload.product_view.unit_price_cents: Input should be a valid integer"),
    # an integer must be a JSON integer: numeric text is refused as well
    ({"payload": {**VIEW, "unit_price_cents": "1999"}},
     "payload.product_view.unit_price_cents: Input should be a valid integer"),
    ({"payload": {**VIEW, "unit_price_cents": -1}},
     "payload.product_view.unit_price_cents: Input should be greater than or equal to 0"),
    ({"payload": {**VIEW, "sku": ""}},
     "payload.product_view.sku: String should have at least 1 character"),
    ({"payload": {**VIEW, "x": 1}}, "payload.product_view.x: Extra inputs are not permitted"),
    ({"type": "scroll"}, "<root>: Value error, payload.type does not match event type"),
    ({"type": "scroll", "payload": {"type": "scroll", "depth_pct": 101}},
     "payload.scroll.depth_pct: Input should be less than or equal to 100"),
    ({"type": "override", "payload": {"type": "override", "decision_id": "d",
                                      "chosen_action_type": "none"}},
     "payload.override.manager_note: Field required"),
    ({"type": "session_end", "payload": {"type": "session_end", "duration_s": 0}}, None),
    ({"type": "action_delivered", "payload": {
        "type": "action_delivered", "action_type": "bundle", "params": {"a": 1, "b": "x"}}}, None),
    ({"type": "order_placed", "payload": {
        "type": "order_placed", "order_id": "o", "order_total_cents": 1, "line_items": [
            {"sku": "1", "quantity": 1, "unit_price_cents": 1, "discount_cents": 0},
            {"sku": "2", "quantity": 0, "unit_price_cents": 1, "discount_cents": 0, "y": 2}]}},
     "payload.order_placed.line_items.1.quantity: Input should be greater than 0; "
     "payload.order_placed.line_items.1.y: Extra inputs are not permitted"),
]


def test_contract_reasons(spark):
    df = raw(spark, *[{**c, "session_id": str(i)} for i, (c, _) in enumerate(CASES)])
    got = {int(r.session_id): r.reason for r in q.check_contract(df).select(
        "session_id", q.reason(F.col("errors")).alias("reason")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == (want or ""), CASES[i]


def test_event_id_is_uuid5(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05' a, "
                   "timestamp'2024-01-02 03:04:05.000123' b")
    one = df.select(*[ids.event_id(F.lit("c"), F.lit("s"), F.col(c), F.lit("dwell"), F.lit(7))
                      for c in ("a", "b")]).first()
    for got, iso in zip(one, ("2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000123+00:00")):
        assert got == str(uuid.uuid5(uuid.UUID(EVENT_ID_NAMESPACE), f"c|s|{iso}|dwell|7"))


def catalog(spark):
    return spark.createDataFrame([("1", "A", 5, 0.3, "low")], schemas.CATALOG)


def test_gates_dedupe_and_idempotent(spark):
    df = raw(
        spark,
        {"event_id": "a"}, {"event_id": "b"},                      # tie: b goes
        {"event_id": "c", "session_id": "s2"}, {"event_id": "c", "session_id": "s2"},  # copies
        {"event_id": "d", "session_id": "s3"},
        {"event_id": "d", "session_id": "s3", "ts": "2024-01-02T03:04:06+00:00"},  # same id later
        {"event_id": "e", "session_id": "s4", "payload": {**VIEW, "sku": "9"}})
    first = ingest(df, catalog(spark))
    assert [r.event_id for r in first.events.orderBy("event_id").collect()] == ["a", "d"]
    assert first.events.where("event_id = 'd'").first().ts.second == 5
    s = first.summary.first()
    assert (s.rows_in, s.rows_landed, s.rows_rejected_semantic) == (7, 2, 3)
    assert s.gates_failed == "catalog_referential_integrity,monotonic_session_timestamps"
    again = ingest(df, catalog(spark), existing=first.events, existing_rejects=first.rejects)
    for one, two in ((first.events, again.events), (first.rejects, again.rejects)):
        assert tables.fingerprint(one).first() == tables.fingerprint(two).first()
    with pytest.raises(q.RejectRateExceeded):
        q.require_reject_rate(first.summary)


def test_partitioning_does_not_change_result(spark, ws):
    prints = {tables.fingerprint(ingest(ws.raw.repartition(n), ws.catalog).events).first()
              for n in (1, 5)}
    assert len(prints) == 1


def test_late_rows_across_batches(spark):
    """Every row at or before the stored instant is rejected, not only a session's first."""
    df = q.decode(raw(spark, *[
        {"event_id": str(i), "ts": f"2024-01-02T03:04:0{i}+00:00"} for i in range(4)])
    ).withColumn("ts", q.parse_instant(F.col("ts")))
    last = df.where("event_id = '1'").select("session_id", F.col("ts").alias("last_ts"))
    late = {r.event_id for r in q.late_violations(df, last).collect()}
    assert late == {"0", "1"}
    kept = q.advance_last_seen(last, df.where("event_id = '3'"), 86_400).first()
    assert kept.last_ts.second == 3


def test_registries_refuse_duplicates():
    with pytest.raises(ValueError):
        adapters.register_adapter("simulator")(lambda df: df)
    with pytest.raises(KeyError):
        adapters.get_adapter("nope")
    with pytest.raises(ValueError):
        q.register_gate("non_negative_price")(None)


def test_sorted_write_refuses_duplicate_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(tables.DuplicateKey):
        tables.write_sorted(df, str(tmp_path / "t"), ["k"])


def test_override_bounds(spark, tmp_path):
    row = ("o", "d", "c", 1, "none", "wait", "ok", "op", None)
    with pytest.raises(ValueError):
        tables.append_overrides(spark.createDataFrame([row], schemas.OVERRIDE), str(tmp_path / "o"))
    assert tables.read_overrides(spark, str(tmp_path / "none")).count() == 0
