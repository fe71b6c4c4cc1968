"""Declared schemas; nothing in the package infers one from data."""

from pyspark.sql import types as T

S, L, D, B, TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _fields(**cols) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


RAW_EVENT = _fields(event_id=S, customer_id=S, session_id=S, ts=S, type=S, payload=S, source=S)
EVENT = _fields(event_id=S, customer_id=S, session_id=S, ts=TS, type=S, payload=S, source=S)
REJECT = _fields(reject_id=S, raw_record=S, reason=S, field_path=S, contract_version=S,
                 stage=S, source=S)
CATALOG = _fields(sku=S, category=S, base_price_cents=L, margin_rate=D, seasonality_class=S)
INVENTORY = _fields(tick=L, sku=S, units=L)
OVERRIDE = _fields(override_id=S, decision_id=S, customer_id=S, day=L, original_candidate=S,
                   override_candidate=S, reason=S, operator=S, created_at=TS)
SEGMENT = _fields(customer_id=S, segment_id=L, segment_name=S, method=S, snapshot_day=L)

LINE_ITEM = _fields(sku=S, quantity=L, unit_price_cents=L, discount_cents=L)
# the union of all payload members; a payload fills the fields of its own type only
PAYLOAD = T.StructType(
    _fields(type=S, device=S, duration_s=L, sku=S, category=S, unit_price_cents=L, quantity=L,
            cart_value_cents=L, order_id=S).fields
    + [T.StructField("line_items", T.ArrayType(LINE_ITEM), True)]
    + _fields(order_total_cents=L, campaign_id=S, channel=S, action_type=S).fields
    + [T.StructField("params", T.MapType(S, S), True)]
    + _fields(decision_id=S, chosen_action_type=S, manager_note=S, depth_pct=L, facet=S,
              value=S, dwell_class=S).fields
)

GRID = T.StructType(
    _fields(customer_id=S, day=L, as_of_ts=TS, rfm_recency_days=L, rfm_frequency_count=L,
            rfm_monetary_cents=L, session_visits_count=L, session_depth_mean_views=D,
            session_dwell_counts_json=S).fields
    + [T.StructField("category_affinity", T.MapType(S, D), True)]
    + _fields(price_sensitivity_proxy=D, message_fatigue_count=L, cart_state_units=L,
              abandonment_history_count=L, micro_conversion_counts_json=S).fields
)
