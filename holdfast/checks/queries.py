"""Registered reports: a Spark form of every operator and, where SQL can say it, its twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.checks import duck
from holdfast.checks.workspace import ML_POLICY, REPLAYED, Workspace, workspace
from holdfast.config import (
    EVENT_ID_NAMESPACE,
    MCDA_CRITERIA,
    REJECT_ID_NAMESPACE,
    SETTINGS,
    candidate_rows,
)
from holdfast.functions import draws, ids, ordering
from holdfast.functions.numbers import day_index
from holdfast.functions.text import normalize_identifier
from holdfast.operators import asof, bootstrap, evaluation, gateway, mart, mart_checks, measures
from holdfast.operators import boosting as bo
from holdfast.operators import candidates as ac
from holdfast.operators import context as cx
from holdfast.operators import explain as ex
from holdfast.operators import features as ft
from holdfast.operators import metrics as me
from holdfast.operators import outcomes as oc
from holdfast.operators import overrides as ov
from holdfast.operators import policies as po
from holdfast.operators import quality as q
from holdfast.operators import response as rs
from holdfast.operators import rules as ru
from holdfast.operators import segmentation as sn
from holdfast.operators import segments as sg
from holdfast.operators import trace as tr
from holdfast.plans import ingest as ing
from holdfast.plans import model_evaluation as mo
from holdfast.plans import replay as rp
from holdfast.session import shared_dir, side_by_side, stage
from holdfast.sources import adapters, fixtures, tables
from holdfast.streaming import streams as st

S = SETTINGS


@dataclass(frozen=True)
class Report:
    items: str
    build: Callable[[Workspace], DataFrame]
    sql: str | None


REPORTS: dict[str, Report] = {}


def report(name: str, items: str, sql: str | None = None):
    def add(fn: Callable[[Workspace], DataFrame]):
        if name in REPORTS:
            raise ValueError(f"report {name!r} is already registered")
        REPORTS[name] = Report(items, fn, sql)
        return fn

    return add


def r6(column, name: str | None = None, places: int = 6):
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, places).alias(name or column)


def text_ts(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


DUCK_TS = "'%Y-%m-%d %H:%M:%S.%f'"
KEY = ("customer_id", "day")


def scratch(ws: Workspace, name: str) -> str:
    return f"{shared_dir(ws.spark)}/{name}-{uuid.uuid4().hex}"


# ================================================================== sources and sinks
@report("table_read", "SRC-1", """
SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem GROUP BY ALL""")
def _(ws):
    return ws.table("lineitem").groupBy(
        "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@report("table_query_bindings", "SRC-2", """
SELECT event_type, CAST(ts AS DATE) AS event_date, count(*) AS n_events FROM events GROUP BY ALL""")
def _(ws):
    return tables.query(ws.spark, """
        SELECT event_type, cast(ts AS date) AS event_date, count(*) AS n_events
        FROM {log} GROUP BY event_type, cast(ts AS date)""", log=ws.table("events"))


@report("event_scan_decoded", "SRC-3", """
SELECT type, count(*) AS n_events, CAST(coalesce(sum(qty), 0) AS BIGINT) AS quantity,
  CAST(coalesce(sum(total), 0) AS BIGINT) AS order_total, CAST(coalesce(sum(items), 0) AS BIGINT) AS items,
  count(DISTINCT first_sku) AS first_skus
FROM typed GROUP BY type""")
def _(ws):
    p = F.col("p")
    return q.decode(fixtures.events(ws.spark, ws.root)).groupBy("type").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.sum(p["quantity"]), F.lit(0)).alias("quantity"),
        F.coalesce(F.sum(p["order_total_cents"]), F.lit(0)).alias("order_total"),
        F.coalesce(F.sum(F.size(p["line_items"])), F.lit(0)).cast("long").alias("items"),
        F.count_distinct(F.get(p["line_items"], F.lit(0))["sku"]).alias("first_skus"))


@report("adapter_orders", "SRC-4", """
SELECT 'order-' || o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  coalesce(l.n, 0) AS n_items, CAST(coalesce(l.total, 0) AS BIGINT) AS order_total_cents, 'adapter' AS source
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)
      * CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT)
    - CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS total
  FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def _(ws):
    raw = adapters.get_adapter("shop_orders")(fixtures.order_events(ws.spark, ws.root))
    return q.decode(raw).select(
        "event_id", "customer_id", F.size("p.line_items").cast("long").alias("n_items"),
        F.col("p.order_total_cents").alias("order_total_cents"), "source")


@report("date_spine", "SRC-5", """
SELECT d.date_key, d.calendar_date, d.day_index, d.iso_week, d.weekday_name, d.evaluation_window,
  count(t.event_id) AS n_events
FROM d_date d JOIN (SELECT min(day) AS lo, max(day) AS hi FROM typed) b ON d.day_index BETWEEN lo AND hi
LEFT JOIN typed t ON t.day = d.day_index GROUP BY ALL""")
def _(ws):
    daily = ws.events.groupBy(day_index(F.col("ts"), S.start_date).alias("day_index")).agg(
        F.count(F.lit(1)).alias("n"))
    return mart.date_spine(ws.events).join(daily, "day_index", "left").select(
        "date_key", "calendar_date", "day_index", "iso_week", "weekday_name",
        "evaluation_window", F.coalesce("n", F.lit(0)).alias("n_events"))


@report("parameters_joined", "SRC-6", f"""
SELECT CASE WHEN day < {S.train_end_day} THEN 'train' WHEN day < {S.validation_end_day} THEN 'validation' ELSE 'test' END AS evaluation_window,
  type, count(*) AS n_events, {S.max_discount_bps} AS ceiling_bps FROM typed GROUP BY ALL""")
def _(ws):
    params = ws.spark.createDataFrame(
        [(S.train_end_day, S.validation_end_day, S.max_discount_bps)],
        "train_end int, validation_end int, ceiling_bps int")
    one = lambda c: params.select(c).scalar()
    day = day_index(F.col("ts"), S.start_date)
    window = F.when(day < one("train_end"), "train").when(
        day < one("validation_end"), "validation").otherwise("test")
    return ws.events.groupBy(window.alias("evaluation_window"), "type").agg(
        F.count(F.lit(1)).alias("n_events")).withColumn("ceiling_bps", one("ceiling_bps"))


@report("overrides_round_trip", "SRC-7, SNK-5", """
SELECT override_id, decision_id, customer_id, day, original_candidate, override_candidate, reason
FROM ovr""")
def _(ws):
    path = scratch(ws, "overrides")
    late = F.col("reason").endswith("2")
    tables.append_overrides(ws.overrides.where(~late), path)
    tables.append_overrides(ws.overrides.where(late), path)
    return tables.read_overrides(ws.spark, path).select(
        "override_id", "decision_id", "customer_id", "day", "original_candidate",
        "override_candidate", "reason")


@report("sorted_table_write", "SNK-1", """
SELECT customer_id, count(*) AS n_events, min(event_id) AS first_event,
  CAST(0 AS BIGINT) AS duplicate_keys FROM ev GROUP BY customer_id""")
def _(ws):
    path = scratch(ws, "sorted")
    key = ["customer_id", "ts", "event_id"]
    tables.write_sorted(ws.events.select(*q.EVENT_COLUMNS), path, key)
    back = ws.spark.read.parquet(path)
    clash = tables.duplicate_keys(back, key).agg(F.count(F.lit(1))).scalar()
    return back.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event")
    ).withColumn("duplicate_keys", clash)


@report("parts_merged", "SNK-2", """
SELECT event_id, customer_id, session_id, type FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY customer_id, ts, event_id, session_id, type) AS rn FROM (
    SELECT event_id, customer_id, session_id, ts, type FROM ev
    UNION ALL SELECT event_id, '0', session_id, ts, 'late' FROM ev)) WHERE rn = 1""")
def _(ws):
    cols = ["event_id", "customer_id", "session_id", "ts", "type"]
    first = ws.events.select(*cols)
    again = first.withColumn("customer_id", F.lit("0")).withColumn("type", F.lit("late"))
    return tables.merge_parts([first, again, first], ["event_id"],
                              ["customer_id", "ts", "event_id"]).drop("ts")


@report("day_partitions", "SNK-3", """
SELECT day, count(*) AS n_rows, CAST(sum(rfm_monetary_cents) AS BIGINT) AS spend FROM grid GROUP BY day""")
def _(ws):
    path = scratch(ws, "by-day")
    tables.write_by_day(ws.grid.select("customer_id", "day", "rfm_monetary_cents"), path)
    return ws.spark.read.parquet(path).groupBy(F.col("day").cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("rfm_monetary_cents").alias("spend"))


@report("csv_export", "SNK-4", """
SELECT category, CAST(sku_count AS VARCHAR) AS sku_count,
  CAST(CAST(round(margin_rate, 6) AS DECIMAL(38, 6)) AS VARCHAR) AS margin_rate FROM m_category""")
def _(ws):
    path = scratch(ws, "csv")
    rows = mart.mart_categories(ws.catalog).withColumn("margin_rate", F.round("margin_rate", 6))
    tables.export_csv(rows, path, ["category"])
    return ws.spark.read.schema("category string, margin_rate string, sku_count string").option(
        "header", True).csv(path).select("category", "sku_count", "margin_rate")


@report("table_fingerprint", "SNK-6", """
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', customer_id, event_id, payload,
  session_id, source, type)), 1, 12)) AS BIGINT)) AS VARCHAR) AS content_hash FROM ev""")
def _(ws):
    return tables.fingerprint(ws.events.select(
        "customer_id", "event_id", "payload", "session_id", "source", "type"))


# ================================================================== quality
@report("contract_errors", "DQ-1, DQ-2", """
SELECT event_id, ts, reason, coalesce(first_path, '') AS field_path FROM judged_raw WHERE reason IS NOT NULL""")
def _(ws):
    bad = ws.checked.where(F.size("errors") > 0)
    return bad.select("event_id", "ts", q.reason(F.col("errors")).alias("reason"),
                      F.coalesce(q.first_path(F.col("errors")), F.lit("")).alias("field_path"))


@report("contract_split", "DQ-1", """
SELECT type, reason IS NULL AS accepted, count(*) AS n_rows FROM judged_raw GROUP BY ALL""")
def _(ws):
    return q.check_contract(ws.raw).groupBy(
        "type", (F.size("errors") == 0).alias("accepted")).agg(F.count(F.lit(1)).alias("n_rows"))


_ISO = ("regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') || '+00:00'")


@report("event_ids_derived", "DQ-3", f"""
SELECT event_id, {duck.uuid5(EVENT_ID_NAMESPACE, f"customer_id || '|' || session_id || '|' || {_ISO} || '|' || type || '|0'")} AS derived_id
FROM ev""")
def _(ws):
    return ws.events.select("event_id", ids.event_id(
        F.col("customer_id"), F.col("session_id"), F.col("ts"), F.col("type"), F.lit(0))
        .alias("derived_id"))


@report("reject_ids_derived", "DQ-4", f"""
SELECT event_id, ts, {duck.uuid5(REJECT_ID_NAMESPACE, "raw_record || '|' || reason || '|contract'")} AS reject_id
FROM (SELECT event_id, ts, reason, CAST(json_object('customer_id', customer_id, 'event_id', event_id, 'payload', payload,
    'session_id', session_id, 'source', 'simulator', 'ts', ts, 'type', type) AS VARCHAR) AS raw_record
  FROM judged_raw WHERE reason IS NOT NULL)""")
def _(ws):
    rows = q.contract_rejects(ws.checked)
    return rows.select("event_id", F.get_json_object("raw_record", "$.ts").alias("ts"), "reject_id")


@report("gate_price", "DQ-5", "SELECT event_id, detail FROM price_faults")
def _(ws):
    return q.price_violations(q.decode(ws.raw))


@report("gate_catalog", "DQ-6", "SELECT event_id, detail FROM sku_faults")
def _(ws):
    return q.catalog_violations(ws.good, ws.catalog)


@report("gate_session_order", "DQ-7", "SELECT event_id, detail FROM tie_faults")
def _(ws):
    return q.tie_violations(ws.good)


@report("gate_session_order_across_batches", "DQ-7", """
SELECT event_id FROM (SELECT event_id, ts, max(CASE WHEN day < 15 THEN ts END) OVER (PARTITION BY customer_id) AS last_ts
  FROM typed) WHERE ts <= last_ts""")
def _(ws):
    # sessions here are whole customers, so that sessions do span the two batches
    ev = ws.events.withColumn("session_id", F.col("customer_id"))
    early = day_index(F.col("ts"), S.start_date) < 15
    last = ev.where(early).groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    return q.late_violations(ev, last).select("event_id")


@report("gates_decisive", "DQ-8", "SELECT event_id, gate, detail FROM decisive")
def _(ws):
    return q.decisive_gate(ws.violations)


@report("gate_violation_counts", "DQ-8", "SELECT gate, count(*) AS n_events FROM gate_faults GROUP BY gate")
def _(ws):
    return ws.violations.groupBy("gate").agg(F.count(F.lit(1)).alias("n_events"))


@report("landed_events", "DQ-9", f"""
SELECT event_id, customer_id, session_id, strftime(ts, {DUCK_TS}) AS ts, type, payload FROM landed""")
def _(ws):
    return ing.ingest(ws.raw, ws.catalog).events.select(
        "event_id", "customer_id", "session_id", text_ts("ts").alias("ts"), "type", "payload")


@report("landing_twice", "DQ-9", """
SELECT (SELECT count(*) FROM landed) AS n_events, (SELECT count(DISTINCT event_id) FROM landed) AS n_ids""")
def _(ws):
    again = ing.ingest(ws.raw, ws.catalog, existing=ws.landed, existing_rejects=ws.rejects)
    return again.events.agg(F.count(F.lit(1)).alias("n_events"),
                            F.count_distinct("event_id").alias("n_ids"))


@report("ingest_summary", "DQ-10", """
SELECT rows_in, rows_landed, rows_rejected_contract, rows_rejected_semantic,
  rows_rejected_contract + rows_rejected_semantic AS rows_quarantined,
  round((rows_rejected_contract + rows_rejected_semantic) / CAST(rows_in AS DOUBLE), 6) AS reject_rate,
  (SELECT string_agg(gate, ',' ORDER BY gate) FROM (SELECT DISTINCT gate FROM gate_faults)) AS gates_failed,
  'non_negative_price' AS gates_passed
FROM ingest_totals""")
def _(ws):
    out = ing.ingest_summary(ws.checked, ws.landed, ws.violations, ws.decisive)
    return out.withColumn("reject_rate", F.round("reject_rate", 6))


@report("reject_rate_gate", "DQ-11", f"""
SELECT rows_in, rows_rejected_contract + rows_rejected_semantic AS rows_quarantined,
  round((rows_rejected_contract + rows_rejected_semantic) / CAST(rows_in AS DOUBLE), 6) AS reject_rate,
  {S.max_reject_rate}::DOUBLE AS max_reject_rate,
  (rows_rejected_contract + rows_rejected_semantic) / CAST(rows_in AS DOUBLE) <= {S.max_reject_rate} AS passed
FROM ingest_totals""")
def _(ws):
    summary = ing.ingest_summary(ws.checked, ws.landed, ws.violations, ws.decisive)
    return ing.reject_rate_gate(summary).withColumn("reject_rate", F.round("reject_rate", 6))


@report("events_in_total_order", "DQ-12", """
SELECT event_id, row_number() OVER (ORDER BY customer_id, ts, event_id) AS place FROM ev""")
def _(ws):
    order = [F.col(c) for c in ("customer_id", "ts", "event_id")]
    return ordering.number_rows(ws.events.select("event_id", "customer_id", "ts"), order,
                                "place").select("event_id", "place")


@report("timestamps_normalised", "DQ-13", f"""
SELECT event_id, ts, CASE WHEN ts LIKE '%+00:00' THEN strftime(CAST(ts AS TIMESTAMP), {DUCK_TS}) ELSE '' END AS utc
FROM raw""")
def _(ws):
    return ws.raw.select("event_id", "ts", F.coalesce(
        F.date_format(q.parse_instant(F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
        .alias("utc"))


@report("identifiers_normalised", "DQ-14", """
SELECT p_partkey, spelled, nfc_normalize(spelled) AS identifier FROM (
  SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type || ' cafe' || chr(769)
    WHEN 1 THEN p_type || ' caf' || chr(233) ELSE p_type END AS spelled FROM part)""")
def _(ws):
    kind = F.col("p_size") % 3
    spelled = F.when(kind == 0, F.concat("p_type", F.lit(" café"))).when(
        kind == 1, F.concat("p_type", F.lit(" café"))).otherwise(F.col("p_type"))
    rows = ws.table("part").select("p_partkey", spelled.alias("spelled"))
    return normalize_identifier(rows, "spelled", "identifier")


# ================================================================== streams
FILES = S.fixture_splits


def _files(ws: Workspace, name: str, *parts: DataFrame) -> str:
    """A folder with the parts appended one after another, FILES files each: a micro-batch each,
    read in as many tasks."""
    path = scratch(ws, name)
    for part in parts:
        part.repartition(FILES).write.mode("append").parquet(path)
    return path


def _drained(ws: Workspace, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into a table."""
    path = scratch(ws, name)
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return ws.spark.read.schema(stream.schema).parquet(path)


def _source(ws: Workspace, df: DataFrame, path: str) -> DataFrame:
    return ws.spark.readStream.schema(df.schema).option(
        "maxFilesPerTrigger", FILES).parquet(path)


@report("stream_contract_split", "ST-1", f"""
SELECT DISTINCT 'landed' AS outcome, event_id AS id FROM good UNION ALL
SELECT DISTINCT 'rejected', {duck.uuid5(REJECT_ID_NAMESPACE, "raw_record || '|' || reason || '|contract'")}
FROM (SELECT reason, CAST(json_object('customer_id', customer_id, 'event_id', event_id, 'payload', payload,
    'session_id', session_id, 'source', 'simulator', 'ts', ts, 'type', type) AS VARCHAR) AS raw_record
  FROM judged_raw WHERE reason IS NOT NULL)""")
def _(ws):
    raw = ws.raw
    third = F.pmod(F.hash("event_id"), F.lit(3))
    source = _files(ws, "raw-files", *[raw.where(third == k) for k in range(3)])
    events, rejects, log = (scratch(ws, n) for n in ("landing", "quarantine", "split-log"))
    st.split_stream(st.read_raw_stream(ws.spark, source, FILES), events, rejects, log).awaitTermination()
    landed, refused = ws.spark.read.parquet(events), ws.spark.read.parquet(rejects)
    return landed.select(F.lit("landed").alias("outcome"), F.col("event_id").alias("id")).unionByName(
        refused.select(F.lit("rejected").alias("outcome"), F.col("reject_id").alias("id")).distinct())


@report("stream_deduplicated", "ST-2", "SELECT event_id, type FROM ev")
def _(ws):
    rows = ws.events.select("event_id", "type", "ts")
    stream = _source(ws, rows, _files(ws, "twice", rows, rows))
    return _drained(ws, st.dedupe_stream(stream), "once").select("event_id", "type")


@report("stream_session_order", "ST-3", """
SELECT event_id, row_number() OVER (PARTITION BY session_id, ts ORDER BY event_id) = 1 AS accepted FROM ev""")
def _(ws):
    rows = ws.events.select("event_id", "customer_id", "session_id", "ts")
    day = day_index(F.col("ts"), S.start_date)
    cuts = [day < 10, (day >= 10) & (day < 20), day >= 20]
    stream = _source(ws, rows, _files(ws, "sessions", *[rows.where(c) for c in cuts]))
    return _drained(ws, st.session_order_stream(stream), "ordered").select("event_id", "accepted")


@report("stream_message_fatigue", "ST-4", f"""
SELECT customer_id, strftime(window_start, {DUCK_TS}) AS window_start, count(*) AS message_fatigue_count FROM (
  SELECT customer_id, date_trunc('day', ts) - to_days(CAST(unnest(range(0, 14)) AS INTEGER)) AS window_start
  FROM ev WHERE type IN ('campaign_exposure', 'action_delivered')) GROUP BY ALL""")
def _(ws):
    rows = ws.events.select("customer_id", "type", "ts")
    # a later message of nobody's closes every window
    closing = rows.agg(F.lit("").alias("customer_id"), F.lit("campaign_exposure").alias("type"),
                       (F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    stream = _source(ws, rows, _files(ws, "messages", rows, closing))
    return _drained(ws, st.fatigue_stream(stream), "fatigue").where("customer_id <> ''").select(
        "customer_id", text_ts("window_start").alias("window_start"), "message_fatigue_count")


@report("stream_reject_alarm", "ST-5", f"""
SELECT count(*) AS rows_in, count(*) FILTER (reason IS NOT NULL) AS rows_rejected,
  count(*) FILTER (reason IS NOT NULL) / count(*) > {S.max_reject_rate} AS alarm FROM judged_raw""")
def _(ws):
    source = _files(ws, "watched", ws.raw)
    watched = st.observed(q.check_contract(st.read_raw_stream(ws.spark, source, FILES)))
    path = scratch(ws, "watched-out")
    query = watched.select("event_id").writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["ingest"] for p in query.recentProgress
            if p["observedMetrics"].get("ingest")]
    total = [int(sum(m[c] for m in seen)) for c in ("rows_in", "rows_rejected")]
    alarm = st.reject_alarm({"observedMetrics": {"ingest": dict(zip(
        ("rows_in", "rows_rejected"), total))}})
    return ws.spark.createDataFrame([(*total, alarm)],
                                    "rows_in long, rows_rejected long, alarm boolean")


# ================================================================== features
def _feature(name: str, item: str, column: str, sql: str):
    @report(name, item, f"SELECT customer_id, day, {sql} AS {column} FROM grid")
    def _(ws):
        value = F.col(column)
        if column == "rfm_recency_days":
            value = F.coalesce(value, F.lit(-1))
        return ws.grid.select(*KEY, value.alias(column))


_feature("feature_recency", "FT-1", "rfm_recency_days", "coalesce(rfm_recency_days, -1)")
_feature("feature_frequency", "FT-2", "rfm_frequency_count", "rfm_frequency_count")
_feature("feature_monetary", "FT-3", "rfm_monetary_cents", "rfm_monetary_cents")
_feature("feature_visits", "FT-4", "session_visits_count", "session_visits_count")
_feature("feature_session_depth", "FT-5", "session_depth_mean_views", "session_depth_mean_views")
_feature("feature_dwell", "FT-6", "session_dwell_counts_json",
         "CAST(json_object('short', dwell_short, 'medium', dwell_medium, 'long', dwell_long) AS VARCHAR)")
_feature("feature_price_sensitivity", "FT-8", "price_sensitivity_proxy", "price_sensitivity_proxy")
_feature("feature_message_fatigue", "FT-9", "message_fatigue_count", "message_fatigue_count")
_feature("feature_cart_state", "FT-10", "cart_state_units", "cart_state_units")
_feature("feature_abandonment", "FT-11", "abandonment_history_count", "abandonment_history_count")
_feature("feature_micro_conversions", "FT-12", "micro_conversion_counts_json",
         "CAST(json_object('scroll', scrolls, 'filter_apply', filters, 'dwell', dwells) AS VARCHAR)")


@report("feature_category_affinity", "FT-7", "SELECT customer_id, day, category, share FROM affinity")
def _(ws):
    return ft.category_affinity(ws.events).select(
        *KEY, F.explode("category_affinity").alias("category", "share"))


@report("feature_grid", "FT-13", """
SELECT customer_id, day, coalesce(rfm_recency_days, -1) AS rfm_recency_days, rfm_frequency_count,
  rfm_monetary_cents, session_visits_count, session_depth_mean_views, price_sensitivity_proxy,
  message_fatigue_count, cart_state_units, abandonment_history_count FROM grid""")
def _(ws):
    g = ft.feature_grid(ws.events)
    return g.select(*KEY, F.coalesce("rfm_recency_days", F.lit(-1)).alias("rfm_recency_days"),
                    "rfm_frequency_count", "rfm_monetary_cents", "session_visits_count",
                    "session_depth_mean_views", "price_sensitivity_proxy",
                    "message_fatigue_count", "cart_state_units", "abandonment_history_count")


def _during(days: int, test: str) -> str:
    return f"FILTER ({test} AND ts > as_of - INTERVAL {days} DAY)"


# every family at instants inside a day, for known and unknown customers
_ASKED = """(SELECT customer_id, max(ts) - INTERVAL 36 HOUR AS as_of FROM typed GROUP BY customer_id
  UNION ALL SELECT 'x' || c_custkey, TIMESTAMP '2024-01-10 12:00:00' FROM customer)"""


@report("features_on_demand", "FT-14", f"""
WITH reached AS (
  SELECT i.customer_id, i.as_of, t.* EXCLUDE (customer_id),
    max(t.ts) FILTER (t.type IN ('order_placed', 'cart_abandon')) OVER (PARTITION BY i.customer_id, i.as_of) AS last_reset
  FROM {_ASKED} i LEFT JOIN typed t ON t.customer_id = i.customer_id AND t.ts <= i.as_of),
shares AS (SELECT customer_id, as_of, category, round_even(n / CAST(sum(n) OVER (PARTITION BY customer_id, as_of) AS DOUBLE), 6) AS share FROM (
  SELECT customer_id, as_of, nfc_normalize(category) AS category, count(*) AS n FROM reached
  WHERE type = 'product_view' AND ts > as_of - INTERVAL 90 DAY GROUP BY ALL)),
listed AS (SELECT customer_id, as_of, string_agg(category || ':' || CAST(round(share * 1000000) AS BIGINT), ';' ORDER BY category) AS affinity
  FROM shares GROUP BY ALL)
SELECT r.customer_id, strftime(r.as_of, '%Y-%m-%d %H:%M:%S.%f') AS as_of,
  coalesce(date_diff('day', max(ts) FILTER (type = 'order_placed'), r.as_of), -1) AS rfm_recency_days,
  count(*) {_during(90, "type = 'order_placed'")} AS rfm_frequency_count,
  CAST(coalesce(sum(total) {_during(90, "type = 'order_placed'")}, 0) AS BIGINT) AS rfm_monetary_cents,
  count(*) {_during(30, "type = 'session_start'")} AS session_visits_count,
  coalesce(round_even(count(*) {_during(30, "type = 'product_view'")}
    / CAST(nullif(count(DISTINCT session_id) {_during(30, "type = 'session_start'")}, 0) AS DOUBLE), 6), 0.0) AS session_depth_mean_views,
  CAST(json_object('short', count(*) {_during(30, "dwell_class = 'short'")}, 'medium', count(*) {_during(30, "dwell_class = 'medium'")},
    'long', count(*) {_during(30, "dwell_class = 'long'")}) AS VARCHAR) AS session_dwell_counts_json,
  coalesce(any_value(l.affinity), '') AS category_affinity,
  coalesce(round_even(CAST(sum(cheap_items) {_during(90, "type = 'order_placed'")} AS DOUBLE)
    / CAST(nullif(sum(items) {_during(90, "type = 'order_placed'")}, 0) AS DOUBLE), 6), 0.0) AS price_sensitivity_proxy,
  count(*) {_during(14, "type IN ('campaign_exposure', 'action_delivered')")} AS message_fatigue_count,
  greatest(CAST(coalesce(sum(CASE type WHEN 'add_to_cart' THEN qty WHEN 'cart_remove' THEN -qty END)
    FILTER (last_reset IS NULL OR ts > last_reset), 0) AS BIGINT), 0) AS cart_state_units,
  count(*) {_during(90, "type = 'cart_abandon'")} AS abandonment_history_count,
  CAST(json_object('scroll', count(*) {_during(30, "type = 'scroll'")}, 'filter_apply', count(*) {_during(30, "type = 'filter_apply'")},
    'dwell', count(*) {_during(30, "type = 'dwell'")}) AS VARCHAR) AS micro_conversion_counts_json
FROM reached r LEFT JOIN listed l ON l.customer_id = r.customer_id AND l.as_of = r.as_of
GROUP BY r.customer_id, r.as_of""".replace("ts > as_of", "ts > r.as_of").replace("AND ts > r.as_of - INTERVAL 90 DAY GROUP BY ALL", "AND ts > as_of - INTERVAL 90 DAY GROUP BY ALL"))
def _(ws):
    known = ws.events.groupBy("customer_id").agg(
        (F.max("ts") - F.expr("interval 36 hours")).alias("as_of"))
    strangers = ws.table("customer").select(
        F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.lit("2024-01-10 12:00:00").cast("timestamp").alias("as_of"))
    out = ft.features_as_of(ws.events, known.unionByName(strangers))
    shares = F.transform(F.array_sort(F.map_entries("category_affinity")), lambda e: F.concat_ws(
        ":", e["key"], F.round(e["value"] * 1_000_000).cast("long").cast("string")))
    return out.select(
        "customer_id", text_ts("as_of").alias("as_of"),
        F.coalesce("rfm_recency_days", F.lit(-1)).alias("rfm_recency_days"),
        "rfm_frequency_count", "rfm_monetary_cents", "session_visits_count",
        "session_depth_mean_views", "session_dwell_counts_json",
        F.array_join(shares, ";").alias("category_affinity"), "price_sensitivity_proxy",
        "message_fatigue_count", "cart_state_units", "abandonment_history_count",
        "micro_conversion_counts_json")


@report("as_of_join", "FT-15", f"""
SELECT g.customer_id, g.day, coalesce(strftime(e.ts, {DUCK_TS}), '') AS anchor_ts
FROM gridkey g ASOF LEFT JOIN ev e ON g.customer_id = e.customer_id AND g.as_of >= e.ts""")
def _(ws):
    anchors = ws.events.select("customer_id", "ts", F.col("ts").alias("anchor_ts"))
    joined = asof.asof_join(ws.grid.select(*KEY, "as_of_ts"), anchors, ["customer_id"],
                            "as_of_ts", "ts", ["anchor_ts"])
    return joined.select(*KEY, F.coalesce(text_ts("anchor_ts"), F.lit("")).alias("anchor_ts"))


@report("time_aware_split", "FT-16", f"""
SELECT customer_id, day, CASE WHEN day <= {S.train_end_day} THEN 'train' ELSE 'test' END AS split FROM grid""")
def _(ws):
    boundary = F.date_add(F.lit(S.start_date), S.train_end_day).cast("timestamp")
    return ft.time_split(ws.grid, boundary).select(*KEY, "split")


# ================================================================== contexts
@report("day_index", "CX-1", "SELECT event_id, day FROM typed")
def _(ws):
    return ws.events.select("event_id", day_index(F.col("ts"), S.start_date).alias("day"))


@report("grid_days", "CX-2", f"""
SELECT customer_id, day, rfm_frequency_count FROM grid WHERE day IN ({duck.DAYS})""")
def _(ws):
    return cx.grid_rows(ws.grid, S.decision_days).select(*KEY, "rfm_frequency_count")


@report("first_active_day", "CX-3", "SELECT customer_id, min(day) AS first_day FROM typed GROUP BY customer_id")
def _(ws):
    return cx.first_active_day(ws.events)


@report("contact_history", "CX-4", """
SELECT customer_id, day, first_day, contacts_7d, contacts_14d, contacts_total FROM contacts""")
def _(ws):
    return cx.contact_history(ws.events).select(
        *KEY, "first_day", "contacts_7d", "contacts_14d", "contacts_total")


@report("eligible_customers", "CX-5", f"""
SELECT customer_id, day, row_number() OVER (PARTITION BY day ORDER BY length(customer_id), customer_id) AS place
FROM dctx""")
def _(ws):
    order = [F.col("day"), F.length("customer_id"), F.col("customer_id")]
    numbered = ordering.number_rows(ws.contexts.select(*KEY), order, "n")
    first = numbered.groupBy("day").agg(F.min("n").alias("base"))
    return numbered.join(first, "day").select(
        *KEY, (F.col("n") - F.col("base") + 1).alias("place"))


@report("category_stock", "CX-6, PR-1", "SELECT tick, category, units FROM stock")
def _(ws):
    return cx.category_stock(ws.inventory, ws.catalog)


@report("category_reference", "CX-7", """
SELECT category, margin_rate, order_value_cents, n_orders,
  category = (SELECT category FROM top_cat) AS is_top_seller FROM reference""")
def _(ws):
    ref = cx.category_reference(ws.events, ws.catalog, S.train_end_day)
    return ref.withColumn("is_top_seller", F.col("category") == cx.top_seller(ref).scalar())


@report("primary_category", "CX-8", "SELECT customer_id, day, primary_category FROM dctx")
def _(ws):
    return ws.contexts.select(*KEY, "primary_category")


@report("derived_context_features", "CX-9", """
SELECT customer_id, day, dwell_long AS dwell_long_count, dwell_medium AS dwell_medium_count,
  scrolls AS scroll_count, filters AS filter_apply_count, primary_affinity_share, contacts_7d,
  contacts_total, tenure_days, CAST(month AS BIGINT) AS month FROM dctx""")
def _(ws):
    return ws.contexts.select(*KEY, "dwell_long_count", "dwell_medium_count", "scroll_count",
                              "filter_apply_count", "primary_affinity_share", "contacts_7d",
                              "contacts_total", "tenure_days", "month")


@report("days_since_contacts", "CX-10", f"""
SELECT customer_id, CAST(d AS BIGINT) AS day, place, days_ago, n FROM (
  SELECT t.customer_id, d, d - t.day - 1 AS days_ago, count(*) AS n,
    row_number() OVER (PARTITION BY t.customer_id, d ORDER BY d - t.day - 1) - 1 AS place
  FROM typed t JOIN unnest([{duck.DAYS}]) AS u(d) ON t.day < d
  WHERE t.type = 'campaign_exposure' GROUP BY t.customer_id, d, t.day)""")
def _(ws):
    ago = cx.contacts_ago(cx.exposure_days(ws.events), S.decision_days)
    return ago.select(*KEY, F.posexplode("contacts_ago").alias("place", "c")).select(
        *KEY, F.col("place").cast("long").alias("place"), "c.days_ago", "c.n")


@report("contacts_within_windows", "CX-10", f"""
SELECT t.customer_id, CAST(d AS BIGINT) AS day, count(*) FILTER (d - t.day - 1 < 7) AS within_7,
  count(*) FILTER (d - t.day - 1 < 14) AS within_14
FROM typed t JOIN unnest([{duck.DAYS}]) AS u(d) ON t.day < d WHERE t.type = 'campaign_exposure'
GROUP BY t.customer_id, d""")
def _(ws):
    ago = cx.contacts_ago(cx.exposure_days(ws.events), S.decision_days)
    c = F.col("contacts_ago")
    return ago.select(*KEY, cx.contacts_within(c, 7).alias("within_7"),
                      cx.contacts_within(c, 14).alias("within_14"))


@report("scarcity", "CX-11", "SELECT customer_id, day, stock_units, low_stock FROM dctx")
def _(ws):
    return ws.contexts.select(*KEY, "stock_units", cx.is_scarce(F.col("stock_units")).alias("low_stock"))


_Z_COLUMNS = {
    "has_ordered": "rfm_recency_days IS NOT NULL", "rfm_recency_days": "least(coalesce(rfm_recency_days, 365), 365)",
    "dwell_long_count": "dwell_long", "dwell_medium_count": "dwell_medium", "scroll_count": "scrolls",
    "filter_apply_count": "filters", "month_sin": "sin(2 * pi() * month / 12)", "month_cos": "cos(2 * pi() * month / 12)"}


def _z_sql(**own: str) -> str:
    """The model's features as a list: plain columns, then one flag per category."""
    columns = {n: _Z_COLUMNS.get(n, n) for n in cx.MODEL_FEATURES} | own
    return ("list_concat([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns.values()) + "], list_transform("
            "(SELECT list(category ORDER BY category) FROM (SELECT DISTINCT category FROM catalog)), "
            "lambda k: CAST(primary_category = k AS DOUBLE)))")


def _entries(design):
    """(place, value) of the entries that are not zero."""
    return F.filter(F.transform(design, lambda v, i: F.struct(
        i.cast("long").alias("place"), F.round(v, 6).alias("value"))), lambda e: e["value"] != 0)


_ENTRIES_SQL = """
SELECT customer_id, day, {extra} place - 1 AS place, round(value, 6) AS value
FROM (SELECT customer_id, day, {extra} unnest(v) AS value, unnest(range(1, len(v) + 1)) AS place FROM ({rows}))
WHERE round(value, 6) <> 0"""


@report("model_feature_row", "CX-12", _ENTRIES_SQL.format(
    extra="", rows=f"SELECT customer_id, day, {_z_sql()} AS v FROM dctx"))
def _(ws):
    columns = F.array(*cx.model_columns(ws.categories).values())
    return ws.contexts.select(*KEY, F.inline(_entries(columns)))


_FLAGS = ", ".join(f"CASE WHEN archetype = '{a}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS action_is_{a}"
                   for a in rs.ARCHETYPES)


@report("action_encoding", "CX-13", f"""
SELECT o.customer_id, o.day, o.candidate_id, {_FLAGS}, discount_bps / 10000.0::DOUBLE AS discount_depth
FROM options o JOIN dctx USING (customer_id, day)""")
def _(ws):
    enc = cx.action_columns(rs.ARCHETYPES)
    return ru.options_view(ws.judged).select(
        *KEY, "candidate_id", *[c.alias(n) for n, c in enc.items()])


# ================================================================== candidates, rules
@report("candidates_expanded", "AC-1", """
SELECT c.customer_id, c.day, a.catalog_order, a.candidate_id, a.archetype, a.contact, a.cost_cents, a.discount_bps
FROM dctx c, actions a""")
def _(ws):
    return ac.with_candidates(ws.contexts).select(*KEY, F.inline("candidates")).drop("params")


@report("candidates_from_providers", "AC-2", """
SELECT customer_id, day, list(candidate_id ORDER BY place) AS ids_list, count(*) AS n FROM (
  SELECT customer_id, day, catalog_order AS place, candidate_id FROM dctx, actions
  UNION ALL SELECT customer_id, day, 100, 'discount_low__' || (100 * (day % 5 + 1)) || 'bps' FROM dctx
  WHERE 100 * (day % 5 + 1) <> 500) GROUP BY customer_id, day""".replace(
    "list(candidate_id ORDER BY place) AS ids_list", "string_agg(candidate_id, ',' ORDER BY place) AS ids"))
def _(ws):
    if "day_deal" not in ac._PROVIDERS:
        @ac.register_provider("day_deal")
        def day_deal():
            bps = (F.lit(100) * (F.col("day") % 5 + 1)).cast("long")
            c = ac.candidate("x", "discount_low", True, 10, discount_bps=bps)
            named = F.concat(F.lit("discount_low__"), bps.cast("string"), F.lit("bps"))
            return F.array(c.withField("candidate_id", named))
    df = ac.with_candidates(ws.contexts, ["catalog", "day_deal"])
    names = F.transform("candidates", lambda c: c["candidate_id"])
    return df.select(*KEY, F.array_join(names, ",").alias("ids"),
                     F.size(names).cast("long").alias("n"))


def _rule(name: str, item: str, rule: str, sql: str):
    @report(name, item, f"""
SELECT o.customer_id, o.day, o.candidate_id, {sql} AS violated FROM options o JOIN dctx USING (customer_id, day)""")
    def _(ws):
        spec = [s for s in ru.ordered() if s[0] == rule]
        only = ru.apply_rules(ac.with_candidates(ws.contexts), spec)
        view = ru.options_view(only)
        hit = F.col("penalty_cents") > 0 if spec[0][2] == "soft" else ~F.col("allowed")
        return view.select(*KEY, "candidate_id", hit.alias("violated"))


_rule("rule_discount_ceiling", "RU-1", "discount_ceiling", "over_ceiling")
_rule("rule_margin_floor", "RU-2", "margin_floor", "thin")
_rule("rule_inventory_scarcity", "RU-3", "inventory_scarcity_gate", "scarce")
_rule("rule_frequency_cap", "RU-4", "frequency_cap", "contact AND o.contacts_7d >= 2")
_rule("rule_fatigue_penalty", "RU-5", "fatigue_penalty", "contact AND o.contacts_14d > 0")


@report("rules_applied", "RU-6, RU-9", """
SELECT o.customer_id, o.day, o.candidate_id, rule IS NULL AS allowed, coalesce(rule, '') AS rule,
  CASE rule WHEN 'discount_ceiling' THEN discount_bps || ' bps exceeds the 2000 bps ceiling'
    WHEN 'inventory_scarcity_gate' THEN 'stock for ' || o.primary_category || ' is ' || o.stock_units || ' units, at or below the 20-unit threshold'
    WHEN 'frequency_cap' THEN o.contacts_7d || ' contacts in the last 7 days (cap 2)'
    WHEN 'margin_floor' THEN 'margin after discount ' || CAST(round_even((o.margin_rate - discount_bps / 10000.0::DOUBLE) * 100, 0) AS BIGINT) || '% is below the 20% floor'
    ELSE '' END AS detail, penalty_cents
FROM options o JOIN dctx USING (customer_id, day)""")
def _(ws):
    return ru.options_view(ws.judged).select(
        *KEY, "candidate_id", "allowed", F.coalesce("rule", F.lit("")).alias("rule"),
        F.coalesce("detail", F.lit("")).alias("detail"), "penalty_cents")


@report("rules_fired", "RU-7", """
SELECT customer_id, day, concat_ws(',',
  CASE WHEN bool_or(coalesce(rule = 'discount_ceiling', false)) THEN 'discount_ceiling' END,
  CASE WHEN bool_or(coalesce(rule = 'margin_floor', false)) THEN 'margin_floor' END,
  CASE WHEN bool_or(coalesce(rule = 'inventory_scarcity_gate', false)) THEN 'inventory_scarcity_gate' END,
  CASE WHEN bool_or(coalesce(rule = 'frequency_cap', false)) THEN 'frequency_cap' END,
  CASE WHEN bool_or(penalty_cents > 0) THEN 'fatigue_penalty' END) AS fired_rules,
  count(*) FILTER (rule IS NULL) AS n_survivors
FROM options JOIN (SELECT customer_id, day FROM dctx) d USING (customer_id, day) GROUP BY customer_id, day""")
def _(ws):
    return ws.judged.select(*KEY, "fired_rules", "n_survivors")


@report("rule_extension", "RU-8", """
SELECT o.customer_id, o.day, o.candidate_id, rule IS NULL AND NOT (contact AND coalesce(d.rfm_recency_days < 3, false)) AS allowed
FROM options o JOIN dctx d USING (customer_id, day)""")
def _(ws):
    specs = [*ru.CONSTRAINTS, ("quiet", "quiet_after_purchase", "hard", "campaign", {"days": 3})]
    return ru.options_view(ru.apply_rules(ac.with_candidates(ws.contexts), specs)).select(
        *KEY, "candidate_id", "allowed")


# ================================================================== policies
_PICK = """
SELECT w.customer_id, w.day, CASE WHEN bool_or(o.candidate_id = w.id) THEN any_value(w.id) ELSE 'none' END AS chosen_id
FROM pick_open w JOIN options o USING (customer_id, day) JOIN (SELECT customer_id, day FROM dctx) d USING (customer_id, day)
WHERE o.rule IS NULL AND w.policy = '{policy}' GROUP BY w.customer_id, w.day"""


def _baseline(name: str, item: str, policy: str):
    @report(name, item, _PICK.format(policy=policy))
    def _(ws):
        return po.choose(po.baseline(ws.judged, policy)).select(*KEY, "chosen_id")


_baseline("policy_do_nothing", "PO-1, PO-2", "do_nothing")
_baseline("policy_always_discount", "PO-3", "always_discount")
_baseline("policy_top_seller", "PO-4", "top_seller")
_baseline("policy_rules_only", "PO-5", "rules_only")


# a fixed ensemble for the exact checks: member m reads the probability table with its own shift
SHIFTS = (0.94, 0.98, 1.0, 1.03)


def _fixed_members(ws: Workspace) -> DataFrame:
    df = ws.with_probabilities(ws.judged)
    first = {}
    for r in candidate_rows():
        first.setdefault((r["archetype"], r["discount_bps"]), r["candidate_id"])
    pairs = []
    for (archetype, bps), cid in first.items():
        base = F.col("p")[cid]
        shifts = SHIFTS if archetype != "none" else tuple(2 - s for s in SHIFTS)
        pairs += [F.lit(f"{archetype}:{bps}"), F.array(*[base * F.lit(s) for s in shifts])]
    return df.withColumn("members", F.create_map(*pairs))


def _ev_scored(ws: Workspace) -> DataFrame:
    return po.expected_value_scores(_fixed_members(ws), "members", len(SHIFTS))


_M = ", ".join(f"({i}, {s}::DOUBLE, {2 - s}::DOUBLE)" for i, s in enumerate(SHIFTS))
duck.CTES.update({
    "arm_first": """
SELECT customer_id, day, archetype, discount_bps, arg_min(p, catalog_order) AS arm_p
FROM options GROUP BY ALL""",
    "ev_member": f"""
SELECT o.customer_id, o.day, o.candidate_id, o.catalog_order, o.contact, o.cost_cents, o.penalty_cents, m, 
  CASE WHEN o.archetype IN ('none', 'wait') THEN 0.0::DOUBLE ELSE
    a.arm_p * s1 * o.order_value_cents * (o.margin_rate - o.discount_bps / 10000.0::DOUBLE)
    - o.p_none * s0 * o.order_value_cents * o.margin_rate END - o.cost_cents - o.penalty_cents AS gain,
  CASE WHEN o.archetype IN ('none', 'wait') THEN 0.0::DOUBLE ELSE a.arm_p * s1 - o.p_none * s0 END AS uplift
FROM options o JOIN arm_first a USING (customer_id, day, archetype, discount_bps)
JOIN (SELECT customer_id, day FROM dctx) d USING (customer_id, day),
  (VALUES {_M}) AS v(m, s1, s0) WHERE o.rule IS NULL""",
    "ev_wins": """
SELECT customer_id, day, candidate_id, count(*) AS wins FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, day, m ORDER BY gain DESC, catalog_order) AS rn FROM ev_member)
WHERE rn = 1 GROUP BY ALL""",
    "ev_score": """
SELECT e.customer_id, e.day, e.candidate_id, any_value(e.contact) AS contact, any_value(e.catalog_order) AS catalog_order,
  avg(gain) - stddev_pop(gain) AS score, avg(uplift) AS uplift,
  quantile_cont(uplift, 0.1) AS uplift_low, quantile_cont(uplift, 0.9) AS uplift_high,
  avg(gain) + any_value(penalty_cents) AS expected_profit_cents,
  avg(gain) + any_value(penalty_cents) + any_value(cost_cents) AS value_cents,
  any_value(penalty_cents) + stddev_pop(gain) AS risk_penalty_cents,
  coalesce(any_value(w.wins), 0) / 4.0::DOUBLE AS win_rate
FROM ev_member e LEFT JOIN ev_wins w USING (customer_id, day, candidate_id)
GROUP BY e.customer_id, e.day, e.candidate_id""",
    "ev_rank": """
SELECT *, row_number() OVER (PARTITION BY customer_id, day ORDER BY round(score, 9) DESC, contact, catalog_order) AS place
FROM ev_score""",
})


@report("expected_value_scores", "PO-6, PO-7, PO-8", """
SELECT customer_id, day, candidate_id, round(score, 6) AS score, round(uplift, 8) AS uplift,
  round(uplift_low, 8) AS uplift_low, round(uplift_high, 8) AS uplift_high, round(value_cents, 6) AS value_cents,
  round(risk_penalty_cents, 6) AS risk_penalty_cents, round(expected_profit_cents, 6) AS expected_profit_cents,
  win_rate FROM ev_score""")
def _(ws):
    rows = _ev_scored(ws).select(*KEY, F.inline("scored"))
    return rows.select(*KEY, "candidate_id", r6("score"), r6("uplift", places=8),
                       r6("uplift_low", places=8), r6("uplift_high", places=8), r6("value_cents"),
                       r6("risk_penalty_cents"), r6("expected_profit_cents"), "win_rate")


@report("candidates_ranked", "PO-9", "SELECT customer_id, day, candidate_id, place FROM ev_rank")
def _(ws):
    return _ev_scored(ws).select(*KEY, F.posexplode("scored").alias("at", "s")).select(
        *KEY, F.col("s.candidate_id").alias("candidate_id"),
        (F.col("at") + 1).cast("long").alias("place"))


@report("choice_with_fallback", "PO-10, PO-11", f"""
SELECT customer_id, day, CASE WHEN fallback THEN 'none' ELSE top END AS chosen_id, fallback, 
  coalesce(CASE WHEN fallback THEN top ELSE second END, '') AS runner_up
FROM (SELECT customer_id, day, max(candidate_id) FILTER (place = 1) AS top, max(candidate_id) FILTER (place = 2) AS second,
    max(win_rate) FILTER (place = 1) < {S.min_confidence} AND max(candidate_id) FILTER (place = 1) <> 'none' AS fallback
  FROM ev_rank GROUP BY customer_id, day)""")
def _(ws):
    return po.choose(_ev_scored(ws), S.min_confidence).select(
        *KEY, "chosen_id", "fallback",
        F.coalesce("runner.candidate_id", F.lit("")).alias("runner_up"))


@report("human_review", "PO-12, EV-24", """
SELECT customer_id, day, count(*) FILTER (rule IS NULL AND cost_cents >= 5 AND discount_bps = 0) = 0 AS needs_human_review
FROM options JOIN (SELECT customer_id, day FROM dctx) d USING (customer_id, day) GROUP BY customer_id, day""")
def _(ws):
    # survivors narrowed to plain paid contacts, so that some contexts have none left
    only = F.filter("survivors", lambda c: (c["cost_cents"] >= 5) & (c["discount_bps"] == 0))
    narrowed = ws.judged.withColumn("survivors", only)
    return po.choose(po.baseline(narrowed, "top_seller")).select(*KEY, "needs_human_review")


@report("decision_ids", "PO-13", f"""
SELECT customer_id, day, policy, {duck.DECISION} AS decision_id FROM replay WHERE policy = 'rules_only'""")
def _(ws):
    return ws.log.where("policy = 'rules_only'").select(*KEY, "policy", "decision_id")


def _records(ws: Workspace) -> DataFrame:
    chosen = ex.explain(po.choose(_ev_scored(ws), S.min_confidence))
    return tr.decision_records(chosen, "expected_value", rp.CONFIG_HASH)


@report("decision_records", "PO-14")
def _(ws):
    r = _records(ws)
    return r.select("decision_id", *KEY, "action.candidate_id", "action.type",
                    "expected_outcome.estimate", "expected_outcome.interval_low",
                    "expected_outcome.interval_high", "confidence",
                    F.size("trace.candidates_considered").alias("considered"),
                    F.size("trace.filtered").alias("filtered"),
                    F.size("trace.scores").alias("scored"), "trace.runner_up.score_gap")


@report("decision_invariants", "PO-15", "SELECT count(*) AS records, CAST(0 AS BIGINT) AS violations FROM dctx")
def _(ws):
    return tr.invariant_counts(_records(ws)).select("records", F.col("violations").cast("long"))


@report("hindsight_choice", "PO-16, PR-2", """
SELECT customer_id, day, arg_max(candidate_id, (exp_profit, -catalog_order)) AS candidate_id,
  round(max(exp_profit), 6) AS profit
FROM options JOIN (SELECT customer_id, day FROM dctx) d USING (customer_id, day) WHERE rule IS NULL GROUP BY customer_id, day""")
def _(ws):
    return ws.with_probabilities(ws.judged).select(
        *KEY, po.hindsight_pick(F.col("p")).alias("h")).select(
        *KEY, "h.candidate_id", r6("h.profit", "profit"))


@report("top_attributions", "PO-17", """
SELECT customer_id, day, place, feature, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, day ORDER BY abs(w) DESC, feature) - 1 AS place, round(w, 6) AS weight FROM (
    SELECT customer_id, day, 'contacts_total' AS feature, -0.02::DOUBLE * contacts_total AS w FROM dctx
    UNION ALL SELECT customer_id, day, 'price_sensitivity_proxy', 0.01::DOUBLE * price_sensitivity_proxy FROM dctx
    UNION ALL SELECT customer_id, day, 'cart_state_units', 0.05::DOUBLE * cart_state_units FROM dctx
    UNION ALL SELECT customer_id, day, 'action:recommend', 0.2::DOUBLE FROM dctx) WHERE w <> 0)
WHERE place < 3""")
def _(ws):
    made = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("weight")) for n, c in (
        ("contacts_total", F.lit(-0.02) * F.col("contacts_total")),
        ("price_sensitivity_proxy", F.lit(0.01) * F.col("price_sensitivity_proxy")),
        ("cart_state_units", F.lit(0.05) * F.col("cart_state_units")),
        ("action:recommend", F.lit(0.2)))])
    top = ws.contexts.select(*KEY, F.posexplode(rs.top_attributions(made, 3)).alias("place", "a"))
    return top.select(*KEY, F.col("place").cast("long").alias("place"), "a.feature", "a.weight")


@report("explanations", "PO-18")
def _(ws):
    return ex.explain(po.choose(po.baseline(ws.judged, "rules_only"))).select(
        *KEY, "chosen_id", "reasoning")


@report("decisions_for_customers", "PO-19")
def _(ws):
    wanted = ws.table("customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    today = ws.contexts.where(F.col("day") == S.validation_end_day).join(
        wanted, "customer_id", "left_semi")
    chosen = po.choose(po.baseline(ru.apply_rules(ac.with_candidates(today)), "rules_only"))
    return ex.explain(chosen).select(*KEY, "chosen_id", "reasoning")


@report("customer_profiles", "PO-20", f"""
SELECT c.customer_id, c.day, coalesce(s.segment_name, '') AS segment, c.contacts_7d AS contacts_last_7_days,
  c.contacts_total, f.feature, f.value
FROM (UNPIVOT (SELECT customer_id, day, CAST(cart_state_units AS DOUBLE) AS cart_state_units,
    CAST(tenure_days AS DOUBLE) AS tenure_days, price_sensitivity_proxy FROM dctx WHERE day = {S.validation_end_day})
  ON cart_state_units, tenure_days, price_sensitivity_proxy INTO NAME feature VALUE value) f
JOIN dctx c USING (customer_id, day) LEFT JOIN segments s USING (customer_id)""")
def _(ws):
    names = ["cart_state_units", "tenure_days", "price_sensitivity_proxy"]
    rows = ws.contexts.where(F.col("day") == S.validation_end_day).join(
        ws.segments, "customer_id", "left").select(
        *KEY, F.coalesce("segment_name", F.lit("")).alias("segment"),
        F.col("contacts_7d").alias("contacts_last_7_days"), "contacts_total",
        *[F.col(n).cast("double").alias(n) for n in names])
    return rows.unpivot([*KEY, "segment", "contacts_last_7_days", "contacts_total"], names,
                        "feature", "value")


# ================================================================== models
@report("standardiser", "ML-1", """
SELECT 'contacts_total' AS feature, round(avg(contacts_total), 6) AS mean, round(stddev_pop(contacts_total), 6) AS scale FROM dctx
UNION ALL SELECT 'tenure_days', round(avg(tenure_days), 6), round(stddev_pop(tenure_days), 6) FROM dctx
UNION ALL SELECT 'month', round(avg(month), 6), 1.0 FROM dctx""")
def _(ws):
    return rs.standardiser(ws.contexts, ["contacts_total", "tenure_days", "month"]).select(
        "feature", r6("mean"), r6("scale"))


_LOGGED = f"""
SELECT r.customer_id, r.day, r.archetype, r.discount_bps / 10000.0::DOUBLE AS depth,
  {_z_sql(contacts_7d='r.recent_contacts_7d', contacts_total='r.prior_contacts', low_stock='c.low_stock',
          primary_affinity_share='c.primary_affinity_share').replace('primary_category = k', 'c.primary_category = k')} AS z
FROM replay r JOIN ctx c USING (customer_id, day) WHERE r.policy = 'random'"""
_ACTS = "[" + ", ".join(f"CAST(archetype = '{a}' AS DOUBLE)" for a in rs.ARCHETYPES if a != "none") + "]"
_ARM = "[CAST(list_position([" + ", ".join(f"'{a}'" for a in rs.ARCHETYPES) + "], archetype) - 1 AS DOUBLE), depth]"


@report("logistic_design", "ML-2", _ENTRIES_SQL.format(extra="archetype,", rows=f"""
SELECT customer_id, day, archetype, list_concat(z, flags, flatten(list_transform(flags, lambda f: list_transform(z, lambda x: x * f))),
  [depth], list_transform(z, lambda x: x * depth)) AS v FROM (SELECT *, {_ACTS} AS flags FROM ({_LOGGED}))"""))
def _(ws):
    names = list(cx.model_columns(ws.categories))
    n = len(names)
    df = ws.experiment.withColumn("z", rs.z_array(names, [0.0] * n, [1.0] * n))
    return rs.logistic_design(df).select(*KEY, "archetype", F.inline(_entries(
        vector_to_array("design"))))


@report("tree_design", "ML-3", _ENTRIES_SQL.format(
    extra="archetype,", rows=f"SELECT customer_id, day, archetype, list_concat(z, {_ARM}) AS v FROM ({_LOGGED})"))
def _(ws):
    names = list(cx.model_columns(ws.categories))
    return rs.TreeEnsemble(names).design(ws.experiment).select(
        *KEY, "archetype", F.inline(_entries(vector_to_array("design"))))


@report("member_weights", "ML-4", f"""
SELECT c.customer_id, m AS member, coalesce(w.n, 0)::DOUBLE AS weight
FROM (SELECT customer_id, row_number() OVER (ORDER BY length(customer_id), customer_id) - 1 AS slot
      FROM (SELECT DISTINCT customer_id FROM ev)) c
CROSS JOIN range(0, {S.ensemble_size}) AS t(m) LEFT JOIN (
  SELECT m2 AS member, slot2, count(*) AS n FROM (
    SELECT m2, {duck.bits(S.seeds['models'], 'm2', 'j')} % (SELECT count(DISTINCT customer_id) FROM ev) AS slot2
    FROM (SELECT row_number() OVER (ORDER BY length(customer_id), customer_id) - 1 AS j
          FROM (SELECT DISTINCT customer_id FROM ev)), range(0, {S.ensemble_size}) AS r(m2)) GROUP BY ALL) w
  ON w.member = m AND w.slot2 = c.slot""")
def _(ws):
    w = rs.member_weights(ws.events, S.ensemble_size, S.seeds["models"])
    return w.select("customer_id", F.posexplode("w").alias("member", "weight")).select(
        "customer_id", F.col("member").cast("long").alias("member"), "weight")


def _fitted(ws: Workspace) -> rs.LogisticEnsemble:
    if not hasattr(ws, "_logistic"):
        ws._logistic = rs.fit_logistic(ws.experiment, list(cx.model_columns(ws.categories)))
    return ws._logistic


def _arms() -> list[tuple[str, int]]:
    return po.active_arms(candidate_rows())


def _predicted(ws: Workspace) -> DataFrame:
    model = _fitted(ws)
    cols = {f: F.col(f) for f in model.features}
    return model.members(ws.experiment, cols, _arms())


@report("logistic_predictions", "ML-5, ML-7, ML-8")
def _(ws):
    arm = F.concat_ws(":", "archetype", F.col("discount_bps").cast("string"))
    return _predicted(ws).select(*KEY, "split", "archetype", rs.mean_probability(
        F.col("members")[arm]).alias("p"), F.col("converted").alias("y"))


def _trees(ws: Workspace) -> rs.TreeEnsemble:
    if not hasattr(ws, "_boosted"):
        ws._boosted = rs.fit_trees(ws.experiment, list(cx.model_columns(ws.categories)))
    return ws._boosted


@report("tree_predictions", "ML-6")
def _(ws):
    return _trees(ws).score(ws.experiment).select(*KEY, "split", "archetype", rs.mean_probability(
        F.col("p")).alias("p"))


@report("tree_attributions", "ML-11")
def _(ws):
    rows = ws.experiment.where("split = 'test' AND archetype <> 'none'")
    return _trees(ws).attributions(rows).select(*KEY, "archetype", F.inline(
        rs.top_attributions(F.col("attributions"))))


# One tree written out by hand: restraint or not, then few contacts or many. Half of what a part
# changes counts where it comes first, half where it comes last.
_MANY, _HERE = "prior_contacts > 2", "CASE WHEN prior_contacts > 2 THEN -0.25 ELSE 0.5 END"


@report("literal_tree_attributions", "ML-11", f"""
SELECT customer_id, day, archetype, 'contacts_total' AS feature,
  round(CASE WHEN archetype IN ('none', 'wait') THEN 0.0 ELSE ({_HERE} - 0.3125) / 2 END, 6) AS weight
FROM replay WHERE policy = 'random' UNION ALL
SELECT customer_id, day, archetype, 'action:' || archetype,
  round(CASE WHEN archetype IN ('none', 'wait') THEN 0.0 ELSE (0.3125 + 1 + {_HERE} + 1) / 2 END, 6)
FROM replay WHERE policy = 'random'""")
def _(ws):
    tree = bo.Tree.root()
    tree.cover[0] = 100.0
    arms = np.isin(np.arange(bo.BINS), [rs.ARCHETYPES.index(a) for a in ("none", "wait")])
    _, right = tree.split(0, 2, arms, (-1.0, 0.0), (60.0, 40.0))
    tree.split(right, 0, np.arange(bo.BINS) < 1, (0.5, -0.25), (30.0, 10.0))
    model = rs.TreeEnsemble(["contacts_total"], bo.Boosted([[2.0], []], [0.0], [[tree]]),
                            [(1.0, 0.0)])
    return model.attributions(ws.experiment).select(*KEY, "archetype", F.inline(
        "attributions")).withColumn("weight", r6("weight"))


@report("predicted_uplift", "ML-9")
def _(ws):
    arm = F.concat_ws(":", "archetype", F.col("discount_bps").cast("string"))
    return _predicted(ws).select(*KEY, "archetype", rs.predicted_uplift(
        F.col("members"), arm).alias("uplift"))


@report("uplift_attributions", "ML-10")
def _(ws):
    model = _fitted(ws)
    z = rs.z_array(model.features, model.mean, model.scale)
    rows = ws.experiment.where(F.col("archetype") != "none").withColumn("z", z)
    return rows.select(*KEY, "archetype", F.inline(rs.top_attributions(model.attributions(
        F.col("z"), F.col("archetype"), F.col("discount_bps") / F.lit(10_000.0)))))


_METRICS = """
SELECT g.family, g.split, g.archetype, count(*) AS rows, round(avg(y::INT), 6) AS positive_rate,
  round(avg(p), 6) AS mean_predicted, round(avg((p - y::INT) ** 2), 6) AS brier,
  round(avg(-CASE WHEN y THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss,
  round(1 - avg((p - y::INT) ** 2) / nullif(avg(y::INT) * (1 - avg(y::INT)), 0), 6) AS brier_skill_vs_base_rate,
  round((sum(CASE WHEN y THEN rk END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2)
    / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0), 6) AS roc_auc
FROM (SELECT *, avg(rn) OVER (PARTITION BY family, split, archetype, p) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY family, split, archetype ORDER BY p) AS rn FROM (
      SELECT family, split, archetype, p, y FROM scored UNION ALL SELECT family, split, 'all', p, y FROM scored))) g
GROUP BY g.family, g.split, g.archetype"""


@report("prediction_metrics", "ML-12, ML-13", f"""
SELECT family, split, archetype, rows, positive_rate, mean_predicted, brier, log_loss,
  coalesce(brier_skill_vs_base_rate, 0.0) AS brier_skill_vs_base_rate, coalesce(roc_auc, -1.0) AS roc_auc FROM ({_METRICS})""")
def _(ws):
    m = me.prediction_metrics(me.with_all_group(ws.scored), ["family", "split", "archetype"],
                              ["customer_id", "day"])
    return m.select("family", "split", "archetype", "rows", r6("positive_rate"),
                    r6("mean_predicted"), r6("brier"), r6("log_loss"),
                    r6("brier_skill_vs_base_rate"),
                    F.coalesce(F.round("roc_auc", 6), F.lit(-1.0)).alias("roc_auc"))


duck.CTES["rel_bins"] = f"""
SELECT family, split, bin, avg(p) AS bin_mean_predicted, avg(y::INT) AS bin_observed_rate, count(*) AS bin_count FROM (
  SELECT *, ntile({S.reliability_bins}) OVER (PARTITION BY family, split ORDER BY p, md5(customer_id || '|' || day), customer_id, day) AS bin
  FROM scored) GROUP BY family, split, bin"""


@report("reliability_bins", "ML-14", """
SELECT family, split, bin, round(bin_mean_predicted, 6) AS bin_mean_predicted,
  round(bin_observed_rate, 6) AS bin_observed_rate, bin_count FROM rel_bins""")
def _(ws):
    return me.reliability_table(ws.scored, ["family", "split"], ["customer_id", "day"]).select(
        "family", "split", "bin", r6("bin_mean_predicted"), r6("bin_observed_rate"), "bin_count")


_ECE = ("SELECT family, split, sum(bin_count * abs(bin_mean_predicted - bin_observed_rate)) "
        "/ sum(bin_count) AS ece FROM rel_bins GROUP BY family, split")


@report("calibration_error", "ML-15", f"SELECT family, split, round(ece, 6) AS ece FROM ({_ECE})")
def _(ws):
    group = ["family", "split"]
    return me.calibration_error(me.reliability_table(ws.scored, group, list(KEY)), group).select(
        *group, r6("ece"))


@report("calibration_gate", "ML-16", f"""
SELECT family, split, ece > {S.max_ece} AS failed FROM ({_ECE}) WHERE split = 'test'""")
def _(ws):
    group = ["family", "split"]
    ece = me.calibration_error(me.reliability_table(ws.scored, group, list(KEY)), group)
    return ece.where("split = 'test'").select(
        *group, (F.col("ece") > S.max_ece).alias("failed"))


@report("global_importance", "ML-17")
def _(ws):
    return rs.global_importance(ws.experiment, _fitted(ws))


@report("family_selection", "ML-18", f"""
SELECT family, round(profit, 4) AS profit_cents FROM (
  SELECT CASE policy WHEN 'top_seller' THEN 'logistic' ELSE 'gbm' END AS family, sum(profit_cents) AS profit
  FROM test_log WHERE policy IN ('top_seller', 'rules_only') GROUP BY 1)
ORDER BY profit DESC, family = 'logistic' DESC LIMIT 1""")
def _(ws):
    # two rule-based replays stand in for the families' validation replays
    rows = ws.log.where(F.col("policy").isin("top_seller", "rules_only")).withColumn(
        "family", F.when(F.col("policy") == "top_seller", "logistic").otherwise("gbm"))
    return evaluation.select_family(rows).select("family", r6("profit_cents", places=4))


@report("model_policy_replay", "EV-7, PO-6")
def _(ws):
    model = _fitted(ws)
    cols = cx.model_columns(ws.categories)
    score = lambda df: po.expected_value_scores(
        model.members(df, cols, _arms()), "members", model.n_members)
    return rp.replay_with_model(ws.with_probabilities(ws.contexts), "expected_value_logistic",
                                score, days=S.decision_days, min_confidence=S.min_confidence).drop("reasoning")


# ------------------------------------------------------------------ both families, end to end
def _families(ws: Workspace) -> dict[str, rs.LogisticEnsemble | rs.TreeEnsemble]:
    ws.experiment  # noqa: B018 (made once, before both read it)
    return side_by_side({"logistic": lambda: _fitted(ws), "gbm": lambda: _trees(ws)})


def _fitted_scores(ws: Workspace) -> DataFrame:
    if not hasattr(ws, "_fitted_scores"):
        ws._fitted_scores = mo.fitted_scores(ws.experiment, _families(ws), _arms())
    return ws._fitted_scores


def _models(ws: Workspace) -> mo.ModelRun:
    if not hasattr(ws, "_models"):
        ws.experiment  # noqa: B018 (and with it the contexts, before all read them)
        made = side_by_side({"log": lambda: ws.log, "models": lambda: _families(ws)})
        ws._models = mo.run_models(ws.with_probabilities(ws.all_contexts), made["log"],
                                   made["models"], cx.model_columns(ws.categories), _arms())
    return ws._models


def _model_gains(ws: Workspace) -> DataFrame:
    run = _models(ws)
    return evaluation.with_gains(evaluation.tag(run.log, ws.segments), run.policy)


@report("fitted_metrics", "ML-12, ML-13, ML-14, ML-15")
def _(ws):
    return mo.fitted_metrics(_fitted_scores(ws))


@report("fitted_calibration_gate", "ML-16")
def _(ws):
    return me.calibration_failures(mo.fitted_metrics(_fitted_scores(ws))).select("family", "ece")


@report("model_selection", "ML-18")
def _(ws):
    run = _models(ws)
    return run.selection.withColumn("selected", F.col("family") == run.selected)


@report("model_policy_summary", "EV-7, EV-11, MA-5")
def _(ws):
    run = _models(ws)
    names = [*REPLAYED, *[mo.policy_of(f) for f in _families(ws)]]
    return evaluation.policy_summary(run.log, names, ml_policy=run.policy)


@report("model_gains", "EV-20")
def _(ws):
    return evaluation.gain_table(_model_gains(ws), "segment")


@report("model_confidence", "EV-21")
def _(ws):
    return evaluation.confidence_calibration(_model_gains(ws))


@report("model_actions", "EV-22")
def _(ws):
    return evaluation.action_table(_model_gains(ws))


# ================================================================== segmentation
@report("segment_snapshot", "SG-1", """
SELECT customer_id, coalesce(rfm_recency_days, -1) AS rfm_recency_days, rfm_monetary_cents, contacts_total FROM snap""")
def _(ws):
    return sg.snapshot(ws.grid, ws.events, S.train_end_day).select(
        "customer_id", F.coalesce("rfm_recency_days", F.lit(-1)).alias("rfm_recency_days"),
        "rfm_monetary_cents", "contacts_total")


@report("segments_rfm", "SG-2", "SELECT customer_id, CAST(segment_id AS BIGINT) AS segment_id, segment_name FROM segments")
def _(ws):
    return sg.rfm_segments(ws.snapshot).select("customer_id", "segment_id", "segment_name")


_LOGS = ", ".join(f"ln(1 + {'least(coalesce(' + n + ', 365), 365)' if n == 'rfm_recency_days' else n}) AS x{i}"
                  for i, n in enumerate(S.segment_features))
duck.CTES["seg_matrix"] = "SELECT customer_id, " + ", ".join(
    f"(x{i} - avg(x{i}) OVER ()) / coalesce(nullif(stddev_pop(x{i}) OVER (), 0), 1) AS x{i}"
    for i in range(len(S.segment_features))) + f" FROM (SELECT customer_id, {_LOGS} FROM snap)"


@report("segment_matrix", "SG-3", "SELECT customer_id, " + ", ".join(
    f"round(x{i}, 6) AS {n}" for i, n in enumerate(S.segment_features)) + " FROM seg_matrix")
def _(ws):
    return sg.segment_matrix(ws.snapshot).select(
        "customer_id", *[r6(n) for n in S.segment_features])


@report("segments_kmeans", "SG-4")
def _(ws):
    return sg.kmeans_labels(sg.segment_matrix(ws.snapshot), S.kmeans_k, S.seeds["models"])


@report("segment_balance", "SG-5", f"""
SELECT round(-sum(s * ln(s)) / nullif(ln(count(*)), 0), 6) AS size_balance, count(*) AS n_segments,
  round(min(s), 6) AS min_share, count(*) <= {S.max_segments} AND min(s) >= {S.min_segment_share} AS viable
FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM segments GROUP BY segment_id)""")
def _(ws):
    return sg.viability(sg.size_balance(ws.segments)).select(
        r6("size_balance"), "n_segments", r6("min_share"), "viable")


_ARI_PAIRS = """SELECT CASE WHEN rfm_recency_days <= 60 THEN 1 ELSE 0 END AS a, CASE WHEN rfm_monetary_cents > 50000 THEN 1 ELSE 0 END AS b FROM snap"""


@report("segment_agreement", "SG-6", f"""
SELECT round((both_n - sa * sb / tot) / ((sa + sb) / 2 - sa * sb / tot), 6) AS ari FROM (
  SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM ({_ARI_PAIRS}) GROUP BY a, b)) AS both_n,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM ({_ARI_PAIRS}) GROUP BY a)) AS sa,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM ({_ARI_PAIRS}) GROUP BY b)) AS sb,
    (SELECT count(*) * (count(*) - 1) / 2 FROM snap) AS tot)""")
def _(ws):
    pairs = ws.snapshot.select(
        F.when(F.col("rfm_recency_days") <= 60, 1).otherwise(0).alias("a"),
        F.when(F.col("rfm_monetary_cents") > 50_000, 1).otherwise(0).alias("b"))
    return sg.adjusted_rand(pairs).select(r6("ari"))


_DIST = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(len(S.segment_features)))


@report("segment_silhouette", "SG-7", f"""
SELECT round(avg(CASE WHEN own_n < 2 THEN 0 ELSE (other - own) / greatest(other, own) END), 6) AS silhouette FROM (
  SELECT customer_id, max(n) FILTER (k = mine) AS own_n, max(total / nullif(n - 1, 0)) FILTER (k = mine) AS own, min(total / n) FILTER (k <> mine) AS other FROM (
    SELECT a.customer_id, sa.segment_id AS mine, sb.segment_id AS k, sum({_DIST}) AS total, count(*) AS n
    FROM seg_matrix a, seg_matrix b, segments sa, segments sb
    WHERE sa.customer_id = a.customer_id AND sb.customer_id = b.customer_id GROUP BY ALL) GROUP BY customer_id)""")
def _(ws):
    points = sg.segment_matrix(ws.snapshot).join(ws.segments, "customer_id")
    return sg.silhouette(points).select(r6("silhouette"))


# Labels and refits given by rules, so that the choice among them has a twin in SQL.
_GIVEN = {
    "rfm_rules": None, "kmeans_k3": "least(session_visits_count, 2)",
    "kmeans_k4": "least(contacts_total, 3)",
    "kmeans_k5": "CASE WHEN rfm_monetary_cents > 10000000 THEN 1 ELSE 0 END"}
_COPIES = ("1 + session_visits_count % 2", "contacts_total % 3")
_REFITS = ("CASE WHEN rfm_frequency_count % 2 = 1 THEN 0 ELSE segment_id END",
           "CASE WHEN contacts_total > 4 THEN segment_id + 1 ELSE segment_id END")
duck.CTES["seg_given"] = f"""
SELECT *, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _COPIES)}] AS w, [{', '.join(f'CAST({c} AS BIGINT)' for c in _REFITS)}] AS refits FROM (
  {' UNION ALL '.join(f"SELECT s.*, '{m}' AS method, CAST({c or 'g.segment_id'} AS BIGINT) AS segment_id FROM snap s JOIN segments g USING (customer_id)" for m, c in _GIVEN.items())})"""
duck.CTES["seg_stable"] = """
SELECT method, avg(coalesce((both_n - sa * sb / nullif(tot, 0)) / nullif((sa + sb) / 2 - sa * sb / nullif(tot, 0), 0), 1.0)) AS stability FROM (
  SELECT method, r, sum(n * (n - 1) / 2) AS both_n, any_value(sa) AS sa, any_value(sb) AS sb, sum(n) * (sum(n) - 1) / 2 AS tot FROM (
    SELECT method, r, a, b, sum(w) AS n FROM seg_pairs GROUP BY ALL)
  JOIN (SELECT method, r, sum(n * (n - 1) / 2) AS sa FROM (SELECT method, r, a, sum(w) AS n FROM seg_pairs GROUP BY ALL) GROUP BY ALL) USING (method, r)
  JOIN (SELECT method, r, sum(n * (n - 1) / 2) AS sb FROM (SELECT method, r, b, sum(w) AS n FROM seg_pairs GROUP BY ALL) GROUP BY ALL) USING (method, r)
  GROUP BY method, r) GROUP BY method"""
duck.CTES["seg_pairs"] = """
SELECT method, r, segment_id AS a, refits[r] AS b, w[r] AS w FROM seg_given, range(1, 3) AS t(r) WHERE w[r] > 0"""


def _given(ws: Workspace) -> DataFrame:
    frame = ws.snapshot.join(ws.segments.select("customer_id", F.col("segment_id").alias("rfm")),
                             "customer_id")
    made = [frame.withColumn("method", F.lit(m)).withColumn(
        "segment_id", F.expr(c or "rfm").cast("long")) for m, c in _GIVEN.items()]
    array = lambda parts, kind: F.array(*[F.expr(c).cast(kind) for c in parts])
    return reduce(DataFrame.unionByName, made).select(
        "method", "customer_id", "segment_id", array(_COPIES, "double").alias("w"),
        array(_REFITS, "long").alias("refits"))


@report("segment_stability", "SG-6", "SELECT method, round(stability, 6) AS stability FROM seg_stable")
def _(ws):
    return sn.stability(_given(ws)).select("method", r6("stability"))


_CRITERIA_SQL = "(VALUES " + ", ".join(f"('{c}', {w!r}::DOUBLE)" for c, (w, _) in MCDA_CRITERIA.items()) + ") AS k(criterion, weight)"


@report("segmentation_choice", "SG-8, SG-9, SG-10", f"""
WITH bal AS (SELECT method, coalesce(-sum(s * ln(s)) / nullif(ln(count(*)), 0), 0.0) AS size_balance, count(*) AS n_segments, min(s) AS min_share,
    count(*) <= {S.max_segments} AND min(s) >= {S.min_segment_share} AS viable
  FROM (SELECT method, count(*) / sum(count(*)) OVER (PARTITION BY method) AS s FROM seg_given GROUP BY method, segment_id) GROUP BY method),
sil AS (SELECT method, avg(CASE WHEN n_own IS NULL OR others = 0 THEN -1 WHEN n_own < 2 THEN 0 ELSE coalesce((other - own) / nullif(greatest(other, own), 0), 0) END) AS silhouette FROM (
  SELECT method, customer_id, max(n) FILTER (k = mine) AS n_own, max(total / nullif(n - 1, 0)) FILTER (k = mine) AS own, min(total / n) FILTER (k <> mine) AS other, count(*) FILTER (k <> mine) AS others FROM (
    SELECT ga.method, a.customer_id, ga.segment_id AS mine, gb.segment_id AS k, sum({_DIST}) AS total, count(*) AS n
    FROM seg_given ga JOIN seg_matrix a USING (customer_id) JOIN seg_given gb ON gb.method = ga.method JOIN seg_matrix b ON b.customer_id = gb.customer_id GROUP BY ALL) GROUP BY ALL) GROUP BY method),
card AS (SELECT bal.*, silhouette, stability, CASE WHEN method = 'rfm_rules' THEN 1.0 ELSE 0.5 END::DOUBLE AS interpretability FROM bal JOIN sil USING (method) JOIN seg_stable USING (method)),
card_long AS (SELECT method, criterion, weight / sum(weight) OVER (PARTITION BY method) AS weight,
    CASE criterion WHEN 'silhouette' THEN silhouette WHEN 'size_balance' THEN size_balance WHEN 'stability' THEN stability ELSE interpretability END AS value
  FROM card, {_CRITERIA_SQL} WHERE viable),
card_scored AS (SELECT method, sqrt(sum((v - hi) ** 2)) AS dp, sqrt(sum((v - lo) ** 2)) AS dm FROM (
  SELECT *, max(v) OVER (PARTITION BY criterion) AS hi, min(v) OVER (PARTITION BY criterion) AS lo FROM (
    SELECT method, criterion, weight * value / coalesce(nullif(sqrt(sum(value * value) OVER (PARTITION BY criterion)), 0), 1) AS v FROM card_long)) GROUP BY method),
close AS (SELECT method, coalesce(dm / nullif(dp + dm, 0), 0.0) AS closeness FROM card_scored),
card_ranked AS (SELECT *, row_number() OVER (ORDER BY round(closeness, 12) DESC, method) AS rank FROM close)
SELECT method, n_segments, round(min_share, 6) AS min_share, viable, round(size_balance, 6) AS size_balance, round(silhouette, 6) AS silhouette,
  round(stability, 6) AS stability, interpretability, round(coalesce(closeness, -1.0), 6) AS closeness, coalesce(rank, -1) AS rank, coalesce(rank = 1, false) AS chosen
FROM card LEFT JOIN card_ranked USING (method)""")
def _(ws):
    given = _given(ws)
    return _card(sn.scorecard(given, sg.segment_matrix(ws.snapshot), sn.stability(given),
                              sn.interpretability(S.interpretability)))


def _card(card: DataFrame) -> DataFrame:
    return card.select(
        "method", "n_segments", r6("min_share"), "viable", r6("size_balance"), r6("silhouette"),
        r6("stability"), "interpretability",
        F.round(F.coalesce("closeness", F.lit(-1.0)), 6).alias("closeness"),
        F.coalesce("rank", F.lit(-1)).alias("rank"), "chosen")


@report("segmentation_run", "SG-4, SG-6, SG-8")
def _(ws):
    return _card(sn.run_segmentation(ws.snapshot).card)


# a ranking of categories per day: four criteria from the event log
DAY_CRITERIA = {"abandons": (0.2, "cost"), "orders": (0.3, "benefit"), "revenue": (0.3, "benefit"),
                "views": (0.2, "benefit")}
duck.CTES["day_values"] = """
SELECT t.day AS grp, coalesce(t.category, c.category) AS alternative, k.criterion,
  CAST(sum(CASE k.criterion WHEN 'views' THEN (t.type = 'product_view')::INT WHEN 'orders' THEN (t.type = 'order_placed')::INT
    WHEN 'revenue' THEN coalesce(t.total, 0) ELSE (t.type = 'product_view' AND (t.payload ->> '$.unit_price_cents')::BIGINT > 5000)::INT END) AS DOUBLE) AS value
FROM typed t LEFT JOIN catalog c ON c.sku = t.first_sku,
  (VALUES ('views'), ('orders'), ('revenue'), ('abandons')) AS k(criterion)
WHERE coalesce(t.category, c.category) IS NOT NULL GROUP BY ALL"""


def _topsis_sql(weights: str, source: str = "day_values") -> str:
    return f"""SELECT grp, alternative, coalesce(dm / nullif(dp + dm, 0), 0.0) AS closeness FROM (
  SELECT grp, alternative, sqrt(sum((v - hi) ** 2)) AS dp, sqrt(sum((v - lo) ** 2)) AS dm FROM (
    SELECT *, max(v) OVER (PARTITION BY grp, criterion) AS hi, min(v) OVER (PARTITION BY grp, criterion) AS lo FROM (
      SELECT grp, alternative, criterion, CASE WHEN criterion = 'abandons' THEN -1 ELSE 1 END * {weights} * value
        / coalesce(nullif(sqrt(sum(value * value) OVER (PARTITION BY grp, criterion)), 0), 1) AS v FROM {source}))
  GROUP BY grp, alternative)"""


_W = "(CASE criterion WHEN 'abandons' THEN 0.2::DOUBLE WHEN 'orders' THEN 0.3::DOUBLE WHEN 'revenue' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END)"


def _day_values(ws: Workspace) -> DataFrame:
    p, kind = F.col("p"), F.col("type")
    first = ws.catalog.select(F.col("sku").alias("_sku"), F.col("category").alias("_category"))
    rows = ws.events.join(first, cx.first_item_sku(ws.events) == F.col("_sku"), "left").withColumn(
        "alternative", F.coalesce(p["category"], "_category")).where("alternative IS NOT NULL")
    wide = rows.groupBy(day_index(F.col("ts"), S.start_date).alias("grp"), "alternative").agg(
        F.count_if(kind == "product_view").cast("double").alias("views"),
        F.count_if(kind == "order_placed").cast("double").alias("orders"),
        F.coalesce(F.sum(p["order_total_cents"]), F.lit(0)).cast("double").alias("revenue"),
        F.count_if((kind == "product_view") & (p["unit_price_cents"] > 5000)).cast("double")
        .alias("abandons"))
    return wide.unpivot(["grp", "alternative"], list(DAY_CRITERIA), "criterion", "value")


@report("topsis_closeness", "SG-9", f"SELECT grp, alternative, round(closeness, 6) AS closeness FROM ({_topsis_sql(_W)})")
def _(ws):
    return sg.topsis(_day_values(ws), DAY_CRITERIA, ["grp"]).select(
        "grp", "alternative", r6("closeness"))


@report("topsis_ranking", "SG-10", f"""
SELECT grp, alternative, row_number() OVER (PARTITION BY grp ORDER BY round(closeness, 12) DESC, alternative) AS rank FROM ({_topsis_sql(_W)})""")
def _(ws):
    scores = sg.topsis(_day_values(ws), DAY_CRITERIA, ["grp"])
    return sg.rank_alternatives(scores, ["grp"]).select("grp", "alternative", "rank")


def _sens_sql() -> str:
    parts = []
    for c in sorted(DAY_CRITERIA):
        for f in (0.5, 1.5):
            w = {n: DAY_CRITERIA[n][0] * (f if n == c else 1.0) for n in DAY_CRITERIA}
            t = sum(w.values())
            case = "(CASE criterion " + " ".join(
                f"WHEN '{n}' THEN {v!r}::DOUBLE / {t!r}::DOUBLE" for n, v in w.items()) + " END)"
            parts.append(f"SELECT grp, '{c}' AS criterion, {f}::DOUBLE AS weight_factor, "
                         f"arg_min(alternative, (-round(closeness, 12), alternative)) AS winner "
                         f"FROM ({_topsis_sql(case)}) GROUP BY grp")
    base = (f"SELECT grp, arg_min(alternative, (-round(closeness, 12), alternative)) AS top FROM "
            f"({_topsis_sql(_W)}) GROUP BY grp")
    return (f"SELECT s.grp, criterion, weight_factor, winner, winner = top AS winner_unchanged FROM "
            f"({' UNION ALL '.join(parts)}) s JOIN ({base}) b USING (grp)")


@report("topsis_sensitivity", "SG-10", _sens_sql())
def _(ws):
    return sg.sensitivity(_day_values(ws), DAY_CRITERIA, group=["grp"])


@report("cluster_names", "SG-11", """
SELECT segment_id, CASE WHEN b AND r = 1 THEN 'buyers' WHEN b THEN 'buyers_' || r
  WHEN r = 1 THEN 'engaged_browsers' WHEN r = 2 THEN 'occasional_browsers' WHEN r = 3 THEN 'light_browsers' ELSE 'browsers_' || r END AS segment_name
FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY visits DESC, segment_id) AS r FROM (
  SELECT CAST(hash_id AS BIGINT) AS segment_id, avg((rfm_recency_days IS NOT NULL)::INT) >= 0.5 AS b, avg(session_visits_count) AS visits
  FROM (SELECT *, length(customer_id) * 2 + (contacts_total > 3)::INT AS hash_id FROM snap) GROUP BY hash_id))""")
def _(ws):
    label = (F.length("customer_id") * 2 + (F.col("contacts_total") > 3).cast("int")).cast("long")
    return sg.name_clusters(ws.snapshot.withColumn("segment_id", label))


# ================================================================== experiment, evaluation
@report("random_assignment", "EV-1, EV-2, EV-3", f"""
SELECT customer_id, day, CASE WHEN day < {S.train_end_day} THEN 'train' WHEN day < {S.validation_end_day} THEN 'validation' ELSE 'test' END AS split,
  primary_category, candidate_id, archetype, discount_bps, contact, n_survivors, prior_contacts, converted
FROM replay WHERE policy = 'random'""")
def _(ws):
    features = cx.model_columns(ws.categories)
    log = rp.experiment_log(ws.with_probabilities(ws.all_contexts), features)
    return log.select(*KEY, "split", "primary_category", "candidate_id", "archetype",
                      "discount_bps", "contact", "n_survivors", "prior_contacts", "converted")


@report("common_random_numbers", "EV-4", f"""
SELECT customer_id, day, {duck.u(7002, 'day', 'customer_id')} AS draw FROM dctx""")
def _(ws):
    return ws.contexts.select(*KEY, oc.common_draw().alias("draw"))


@report("outcomes_priced", "EV-5", """
SELECT policy, customer_id, day, candidate_id, round(p_action, 8) AS p_action, round(p_none, 8) AS p_none,
  converted, would_buy_anyway, round(profit_cents, 6) AS profit_cents, round(profit_none_cents, 6) AS profit_none_cents,
  round(expected_profit_cents, 6) AS expected_profit_cents, round(expected_profit_none_cents, 6) AS expected_profit_none_cents
FROM test_log""")
def _(ws):
    return ws.log.select("policy", *KEY, "candidate_id", r6("p_action", places=8),
                         r6("p_none", places=8), "converted", "would_buy_anyway",
                         r6("profit_cents"), r6("profit_none_cents"), r6("expected_profit_cents"),
                         r6("expected_profit_none_cents"))


@report("hindsight_regret", "EV-6", """
SELECT policy, customer_id, day, oracle_best_candidate, round(regret_cents, 6) AS regret_cents FROM test_log""")
def _(ws):
    return ws.log.select("policy", *KEY, "oracle_best_candidate", r6("regret_cents"))


@report("policy_replay", "EV-7", """
SELECT policy, customer_id, day, candidate_id, recent_contacts_7d, prior_contacts, n_survivors, n_filtered,
  fired_rules, runner_up FROM test_log""")
def _(ws):
    return rp.replay(ws.with_probabilities(ws.contexts), REPLAYED).select(
        "policy", *KEY, "candidate_id", "recent_contacts_7d", "prior_contacts", "n_survivors",
        "n_filtered", "fired_rules", "runner_up")


@report("bootstrap_weights", "EV-8", """
SELECT resample, customer_id, count(*) AS weight FROM draws JOIN slots USING (slot) GROUP BY ALL""")
def _(ws):
    w = bootstrap.weights(bootstrap.index_customers(ws.log), S.bootstrap_resamples,
                          S.seeds["bootstrap"])
    return w.select(F.col("resample").cast("long").alias("resample"), "customer_id", "weight")


@report("bootstrap_intervals", "EV-9", """
SELECT policy, round(quantile_cont(profit, 0.025), 3) AS profit_lo, round(quantile_cont(profit, 0.975), 3) AS profit_hi,
  round(quantile_cont(expected, 0.025), 3) AS expected_lo, round(quantile_cont(expected, 0.975), 3) AS expected_hi
FROM boot GROUP BY policy""")
def _(ws):
    spans = evaluation.policy_intervals(evaluation.resampled(ws.log, REPLAYED))
    return spans.select("policy", *[r6(c, places=3) for c in (
        "profit_lo", "profit_hi", "expected_lo", "expected_hi")])


@report("per_customer_totals", "EV-10", """
SELECT c.customer_id, round(coalesce(sum(r.profit_cents), 0), 6) AS profit_cents
FROM (SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer) c
LEFT JOIN (SELECT * FROM test_log WHERE policy = 'rules_only') r USING (customer_id) GROUP BY c.customer_id""")
def _(ws):
    listed = ws.table("customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    own = ws.log.where("policy = 'rules_only'")
    return bootstrap.per_customer(own, listed, "profit_cents").select(
        "customer_id", r6("profit_cents"))


_Q = ", ".join(
    f"round(quantile_cont({c}, {a}) / 100, 5) AS {n}" for c, a, n in (
        ("profit", 0.025, "profit_ci_low_eur"), ("profit", 0.975, "profit_ci_high_eur"),
        ("expected", 0.025, "expected_profit_ci_low_eur"),
        ("expected", 0.975, "expected_profit_ci_high_eur"),
        ("expected - b", 0.025, "vs_do_nothing_ci_low_eur"),
        ("expected - b", 0.975, "vs_do_nothing_ci_high_eur"),
        ("expected - q", 0.025, "vs_rules_only_ci_low_eur"),
        ("expected - q", 0.975, "vs_rules_only_ci_high_eur")))
_EUR = "sum(expected_profit_cents) FILTER (policy = '{}') / 100"


@report("policy_summary", "EV-11", f"""
SELECT p.* EXCLUDE (raw_eur), i.* EXCLUDE (policy),
  round(raw_eur - (SELECT {_EUR.format('do_nothing')} FROM test_log), 5) AS vs_do_nothing_eur,
  round(raw_eur - (SELECT {_EUR.format('rules_only')} FROM test_log), 5) AS vs_rules_only_eur
FROM (SELECT policy, count(*) AS decisions, round(avg(contact::INT), 6) AS contact_rate,
    round(avg((discount_bps > 0)::INT), 6) AS discount_rate, round(avg((archetype IN ('none', 'wait'))::INT), 6) AS restraint_rate,
    count(*) FILTER (converted) AS conversions, round(avg(converted::INT), 6) AS conversion_rate,
    round(sum(profit_cents) / 100, 5) AS profit_eur, round(sum(expected_profit_cents) / 100, 5) AS expected_profit_eur, sum(expected_profit_cents) / 100 AS raw_eur,
    round(coalesce(sum(order_value_cents * discount_bps / 10000.0::DOUBLE) FILTER (converted), 0) / 100, 5) AS discount_cost_eur,
    round(coalesce(sum(order_value_cents * discount_bps / 10000.0::DOUBLE) FILTER (converted AND would_buy_anyway), 0) / 100, 5) AS wasted_discount_cost_eur,
    round(coalesce(avg(would_buy_anyway::INT) FILTER (discount_bps > 0 AND converted), 0.0), 6) AS wasted_discount_share,
    round(coalesce(avg((discount_bps = 0)::INT) FILTER (would_buy_anyway), 0.0), 6) AS no_incentive_rate_would_buy_anyway,
    round(avg(regret_cents), 6) AS mean_regret_cents, round(avg((regret_cents <= 1e-9)::INT), 6) AS share_hindsight_optimal
  FROM test_log GROUP BY policy) p
JOIN (SELECT policy, {_Q} FROM (SELECT a.*, b.expected AS b, q.expected AS q FROM boot a
  JOIN boot b ON b.resample = a.resample AND b.policy = 'do_nothing'
  JOIN boot q ON q.resample = a.resample AND q.policy = 'rules_only') GROUP BY policy) i USING (policy)""")
def _(ws):
    out = evaluation.policy_summary(ws.log, REPLAYED)
    keep = ("policy", "decisions", "conversions")
    eur = [c for c in out.columns if c.endswith("_eur")]
    return out.drop("label", "is_ml_policy").select(*[
        F.col(c) if c in keep else r6(c, places=5 if c in eur else 6)
        for c in out.columns if c not in ("label", "is_ml_policy")])


_READ = """
SELECT a.policy AS control, (c.profit - a.profit) / c.n AS point, (c.conv - a.conv) / c.n AS conv_point,
  quantile_cont(d.profit, 0.025) / c.n AS ci_low, quantile_cont(d.profit, 0.975) / c.n AS ci_high,
  quantile_cont(d.conv, 0.025) / c.n AS conv_low, quantile_cont(d.conv, 0.975) / c.n AS conv_high
FROM (SELECT policy, sum(profit_cents) AS profit, count(*) FILTER (converted) AS conv FROM test_log GROUP BY policy) a
JOIN (SELECT x.policy AS pol, y.profit - x.profit AS profit, y.conv - x.conv AS conv FROM boot x
  JOIN boot y ON y.resample = x.resample AND y.policy = 'top_seller') d ON d.pol = a.policy,
  (SELECT count(*) AS n, sum(profit_cents) AS profit, count(*) FILTER (converted) AS conv FROM test_log WHERE policy = 'top_seller') c
WHERE a.policy IN ('rules_only', 'do_nothing') GROUP BY a.policy, a.profit, a.conv, c.n, c.profit, c.conv"""
_READ_ROUND = ", ".join(f"round({c}, 5) AS {c}" for c in (
    "point", "ci_low", "ci_high", "conv_point", "conv_low", "conv_high"))


def _readouts(ws: Workspace) -> DataFrame:
    return evaluation.readouts(ws.log, "top_seller", ["rules_only", "do_nothing"], 8)


def _flat_readout() -> list:
    g = F.col("guardrails")["conversion_rate"]
    return [r6("point", places=5), r6("ci_low", places=5), r6("ci_high", places=5),
            r6(g["point"], "conv_point", 5), r6(g["ci_low"], "conv_low", 5),
            r6(g["ci_high"], "conv_high", 5)]


@report("experiment_readout", "EV-12", f"SELECT control, {_READ_ROUND} FROM ({_READ})")
def _(ws):
    return _readouts(ws).select("control", *_flat_readout())


_VERDICT = f"""
SELECT control, CASE WHEN conv_high < -0.002 THEN 'guardrail_breach' WHEN ci_high < 0 THEN 'clear_loss'
  WHEN ci_low >= -{S.indifference_margin} AND ci_high <= {S.indifference_margin} THEN 'in_margin'
  WHEN ci_low > 0 AND point >= {S.mde} AND conv_low < -0.002 THEN 'conflicting_metrics'
  WHEN ci_low > 0 AND point >= {S.mde} THEN 'clear_win' ELSE 'inconclusive' END AS base_case FROM ({{}})"""
_TIER = """
SELECT {key}, verdict, autonomy, base_case AS "case" FROM (SELECT *, CASE base_case WHEN 'clear_win' THEN 'requires_human_signoff'
  WHEN 'conflicting_metrics' THEN 'keep_collecting' WHEN 'inconclusive' THEN 'keep_collecting' ELSE 'no_change' END AS autonomy,
  CASE base_case WHEN 'clear_win' THEN 'accept' WHEN 'conflicting_metrics' THEN 'delay' WHEN 'inconclusive' THEN 'delay' ELSE 'reject' END AS verdict
  FROM ({body}))"""


@report("gateway_verdicts", "EV-13, EV-14", _TIER.format(key="control", body=_VERDICT.format(_READ)))
def _(ws):
    return gateway.adjudicate(_readouts(ws)).select("control", "verdict", "case", "autonomy")


@report("gateway_by_customer", "EV-13", _TIER.format(key="control", body=_VERDICT.format("""
SELECT customer_id AS control, avg(profit_cents - 40) AS point, avg(profit_cents) - 100 AS ci_low, avg(profit_cents) + 10 AS ci_high,
  avg(converted::INT) - 0.1 AS conv_point, avg(converted::INT) - 0.12 AS conv_low, avg(converted::INT) - 0.001 AS conv_high
FROM test_log WHERE policy = 'rules_only' GROUP BY customer_id""")))
def _(ws):
    conv = F.avg(F.when(F.col("converted"), 1.0).otherwise(0.0))
    rows = ws.log.where("policy = 'rules_only'").groupBy(F.col("customer_id").alias("control")).agg(
        F.avg(F.col("profit_cents") - 40).alias("point"),
        (F.avg("profit_cents") - 100).alias("ci_low"), (F.avg("profit_cents") + 10).alias("ci_high"),
        F.create_map(F.lit("conversion_rate"), F.struct(
            (conv - 0.1).alias("point"), (conv - 0.12).alias("ci_low"),
            (conv - 0.001).alias("ci_high"))).alias("guardrails"))
    rows = rows.withColumn("change_type", F.lit("policy_promotion")).withColumn(
        "days_running", F.lit(8))
    return gateway.adjudicate(rows).select("control", "verdict", "case", "autonomy")


@report("uplift_error", "EV-15", """
WITH t AS (SELECT 'table' AS family, archetype, p_action - p_none AS truth, p_action * 1.1::DOUBLE - 0.03::DOUBLE AS predicted
  FROM replay WHERE policy = 'random' AND archetype NOT IN ('none', 'wait')),
a AS (SELECT * FROM t UNION ALL SELECT family, 'all', truth, predicted FROM t),
k AS (SELECT *, avg(r1) OVER (PARTITION BY archetype, truth) AS k1, avg(r2) OVER (PARTITION BY archetype, predicted) AS k2 FROM (
  SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY truth) AS r1, row_number() OVER (PARTITION BY archetype ORDER BY predicted) AS r2 FROM a))
SELECT family, archetype, count(*) AS rows, round(avg(truth), 6) AS mean_true_uplift, round(avg(predicted), 6) AS mean_predicted_uplift,
  round(avg(predicted - truth), 6) AS bias, round(avg(abs(predicted - truth)), 6) AS mae, round(sqrt(avg((predicted - truth) ** 2)), 6) AS rmse,
  round(corr(k1, k2), 6) AS spearman, round(avg((sign(predicted) = sign(truth))::INT), 6) AS sign_agreement
FROM k GROUP BY family, archetype HAVING count(*) >= 2""")
def _(ws):
    rows = ws.random_log.where(~F.col("archetype").isin("none", "wait")).select(
        F.lit("table").alias("family"), "archetype",
        (F.col("p_action") - F.col("p_none")).alias("truth"),
        (F.col("p_action") * F.lit(1.1) - F.lit(0.03)).alias("predicted"))
    out = evaluation.uplift_error(rows)
    return out.select("family", "archetype", "rows", *[r6(c) for c in out.columns if c not in (
        "family", "archetype", "rows")])


def _requests(ws: Workspace) -> DataFrame:
    return ws.overrides.where(F.col("reason").endswith("1")).select(
        "decision_id", "customer_id", "day", "override_candidate", "reason", "operator")


@report("override_admission", "EV-16", """
SELECT v.decision_id, v.customer_id, v.day, CASE WHEN v.decision_id <> r.decision_id THEN 'not the current decision'
  WHEN o.rule IS NOT NULL THEN 'excluded by hard rule ' || o.rule WHEN r.candidate_id = 'email_delayed' THEN 'the override equals the engine''s choice'
  ELSE '' END AS refusal
FROM ovr v JOIN test_log r ON r.policy = 'rules_only' AND r.customer_id = v.customer_id AND r.day = v.day
JOIN options o ON o.customer_id = v.customer_id AND o.day = v.day AND o.candidate_id = 'email_delayed' WHERE v.rank = 1""")
def _(ws):
    current = ws.log.where("policy = 'rules_only'").select(
        "decision_id", *KEY, F.col("candidate_id").alias("chosen_id"))
    out = ov.admit(_requests(ws), current, ru.options_view(ws.judged))
    return out.select("decision_id", *KEY, F.coalesce("refusal", F.lit("")).alias("refusal"))


def _probability_rows(ws: Workspace) -> DataFrame:
    p = ws.with_probabilities(ws.contexts)
    return p.select(*KEY, F.explode("p").alias("candidate_id", "probability"))


_OVR_PRICE = """
SELECT v.override_id, v.decision_id, a.exp_profit AS o, b.exp_profit AS n
FROM ovr v JOIN priced_cand a ON a.customer_id = v.customer_id AND a.day = v.day AND a.candidate_id = v.original_candidate
JOIN priced_cand b ON b.customer_id = v.customer_id AND b.day = v.day AND b.candidate_id = v.override_candidate"""


def _priced_overrides(ws: Workspace) -> DataFrame:
    ref = cx.category_reference(ws.events, ws.catalog, S.train_end_day)
    spare = ws.contexts.select("customer_id", "primary_category").groupBy("customer_id").agg(
        F.min("primary_category").alias("category")).join(ref, "category").select(
        "customer_id", "margin_rate", "order_value_cents")
    return ov.price_overrides(ws.overrides, ws.contexts, _probability_rows(ws), spare)


@report("overrides_priced", "EV-17", f"""
SELECT override_id, round(o, 6) AS expected_profit_original_cents, round(n, 6) AS expected_profit_override_cents,
  round(n - o, 6) AS override_effect_cents FROM ({_OVR_PRICE})""")
def _(ws):
    return _priced_overrides(ws).select(
        "override_id", r6("expected_profit_original_cents"), r6("expected_profit_override_cents"),
        r6("override_effect_cents"))


@report("override_totals", "EV-18", f"""
SELECT count(*) AS n_overrides, round(sum(n - o) / 100, 6) AS net_effect_eur FROM ({_OVR_PRICE})""")
def _(ws):
    return ov.override_totals(_priced_overrides(ws)).select("n_overrides", r6("net_effect_eur"))


def _tagged(ws: Workspace) -> DataFrame:
    return evaluation.with_gains(evaluation.tag(ws.log, ws.segments), ML_POLICY)


duck.CTES["gains"] = f"""
SELECT r.*, coalesce(s.segment_name, 'joined_after_snapshot') AS segment, strftime({duck.START} + CAST(r.day AS INTEGER), '%Y-%m') AS month,
  r.expected_profit_cents - b.expected_profit_cents AS g0, r.expected_profit_cents - d.expected_profit_cents AS g1
FROM test_log r JOIN test_log b ON b.policy = 'do_nothing' AND b.customer_id = r.customer_id AND b.day = r.day
JOIN test_log d ON d.policy = 'always_discount' AND d.customer_id = r.customer_id AND d.day = r.day
LEFT JOIN segments s ON s.customer_id = r.customer_id WHERE r.policy = 'rules_only'"""


@report("decisions_tagged", "EV-19", "SELECT customer_id, day, segment, month FROM gains")
def _(ws):
    return evaluation.tag(ws.log.where(F.col("policy") == ML_POLICY), ws.segments).select(
        *KEY, "segment", "month")


def _gain_report(by: str):
    @report(f"gains_by_{by}", "EV-20", f"""
SELECT {by}, count(*) AS decisions, round(avg(contact::INT), 6) AS contact_rate, round(sum(g0) / 100, 5) AS ml_vs_do_nothing_eur,
  round(sum(g1) / 100, 5) AS ml_vs_always_discount_eur, round(avg(regret_cents), 6) AS mean_regret_cents FROM gains GROUP BY {by}""")
    def _(ws):
        return evaluation.gain_table(_tagged(ws), by).select(
            by, "decisions", r6("contact_rate"), r6("ml_vs_do_nothing_eur", places=5),
            r6("ml_vs_always_discount_eur", places=5), r6("mean_regret_cents"))


_gain_report("segment")
_gain_report("month")


@report("gains_worst_segment", "EV-20", """
SELECT segment, count(*) AS decisions FROM gains GROUP BY segment ORDER BY sum(g0), segment LIMIT 1""")
def _(ws):
    return evaluation.worst(evaluation.gain_table(_tagged(ws), "segment"), "segment").select(
        "segment", "decisions")


@report("confidence_calibration", "EV-21", """
SELECT CASE WHEN c < 0.5 THEN '[0.0, 0.5)' WHEN c < 0.75 THEN '[0.5, 0.75)' WHEN c < 0.9 THEN '[0.75, 0.9)' WHEN c < 1.0001 THEN '[0.9, 1.0001)' ELSE 'none' END AS confidence_bin,
  count(*) AS decisions, round(coalesce(avg(c), -1.0), 6) AS mean_confidence, round(avg((regret_cents <= 1e-9)::INT), 6) AS share_hindsight_optimal
FROM (SELECT regret_cents, CASE WHEN draw < 0.9 THEN round(draw * 1.1, 6) END AS c FROM gains) GROUP BY 1""")
def _(ws):
    rows = _tagged(ws).withColumn("confidence", F.when(
        F.col("draw") < 0.9, F.round(F.col("draw") * 1.1, 6)))
    return evaluation.confidence_calibration(rows).select(
        "confidence_bin", "decisions",
        F.round(F.coalesce("mean_confidence", F.lit(-1.0)), 6).alias("mean_confidence"),
        r6("share_hindsight_optimal"))


@report("chosen_actions", "EV-22", """
SELECT candidate_id, count(*) AS decisions, round(avg(p_none), 6) AS mean_predicted_uplift,
  round(avg(p_action) - avg(p_none), 6) AS mean_true_uplift, round(avg(regret_cents), 6) AS mean_regret_cents FROM gains GROUP BY candidate_id""")
def _(ws):
    rows = _tagged(ws).withColumn("uplift_estimate", F.col("p_none"))
    return evaluation.action_table(rows).select(
        "candidate_id", "decisions", r6("mean_predicted_uplift"), r6("mean_true_uplift"),
        r6("mean_regret_cents"))


@report("rule_shares", "EV-23", """
SELECT rule, round(sum(n) / CAST((SELECT count(*) FROM test_log WHERE policy = 'always_discount') AS DOUBLE), 6) AS share FROM (
  SELECT unnest(string_split(fired_rules, ',')) AS rule, 1 AS n FROM test_log WHERE policy = 'always_discount'
  UNION ALL SELECT 'inventory_scarcity_gate', 0 UNION ALL SELECT 'frequency_cap', 0) WHERE rule <> '' GROUP BY rule""")
def _(ws):
    return evaluation.rule_shares(ws.log).select("rule", r6("share"))


@report("review_counts", "EV-24", "SELECT policy, CAST(0 AS BIGINT) AS escalations FROM test_log GROUP BY policy")
def _(ws):
    return evaluation.review_count(ws.log)


# ================================================================== mart
@report("mart_events", "MA-1", """
SELECT customer_id, event_type, day_index, coalesce(order_total_cents, -1) AS order_total_cents, coalesce(category, '') AS category FROM m_events""")
def _(ws):
    return ws.mart_events.select(
        "customer_id", "event_type", "day_index",
        F.coalesce("order_total_cents", F.lit(-1)).alias("order_total_cents"),
        F.coalesce("category", F.lit("")).alias("category"))


@report("mart_categories", "MA-2", "SELECT category, round(margin_rate, 6) AS margin_rate, sku_count FROM m_category")
def _(ws):
    return mart.mart_categories(ws.catalog).select("category", r6("margin_rate"), "sku_count")


@report("mart_dates_used", "MA-3", """
SELECT d.*, count(t.event_id) AS n_events FROM d_date d LEFT JOIN typed t ON t.day = d.day_index GROUP BY ALL""")
def _(ws):
    daily = ws.events.groupBy(day_index(F.col("ts"), S.start_date).alias("day_index")).agg(
        F.count(F.lit(1)).alias("n"))
    return mart.dim_date(ws.spark).join(daily, "day_index", "left").withColumn(
        "n_events", F.coalesce("n", F.lit(0))).drop("n")


@report("mart_actions_used", "MA-4", """
SELECT a.*, count(r.day) AS n_decisions FROM d_action a LEFT JOIN test_log r USING (candidate_id) GROUP BY ALL""")
def _(ws):
    used = ws.log.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    return mart.dim_action(ws.spark).join(used, "candidate_id", "left").withColumn(
        "n_decisions", F.coalesce("n", F.lit(0))).drop("n")


@report("mart_policies", "MA-5", "SELECT * FROM d_policy")
def _(ws):
    return mart.dim_policy(ws.log, ML_POLICY)


@report("mart_customers", "MA-6, MA-12", "SELECT * FROM d_customer")
def _(ws):
    return mart.dim_customer(ws.mart_events, mart.mart_categories(ws.catalog), ws.segments)


@report("mart_decisions", "MA-7, MA-12", "SELECT * FROM f_decisions")
def _(ws):
    return ws.tables["fct_decisions"].select(
        "decision_key", "policy_key", "customer_key", "date_key", "action_key", "decision_id",
        "n_survivors", "n_filtered", "fired_rules", "runner_up", "recent_contacts_7d",
        "is_overridden", F.coalesce("override_candidate", F.lit("")).alias("override_candidate"),
        F.coalesce("override_reason", F.lit("")).alias("override_reason"))


@report("mart_outcomes", "MA-8", """
SELECT * REPLACE (round(true_uplift, 8) AS true_uplift, round(true_purchase_probability, 8) AS true_purchase_probability) FROM f_outcomes""")
def _(ws):
    return ws.tables["fct_outcomes"].withColumn("true_uplift", F.round("true_uplift", 8)).withColumn(
        "true_purchase_probability", F.round("true_purchase_probability", 8))


@report("mart_policy_kpis", "MA-9", """
SELECT policy, policy_label, is_ml_policy, count(*) AS decisions, round(avg(is_contact::INT), 6) AS contact_rate,
  round(avg(is_restraint::INT), 6) AS restraint_rate, round(avg(is_discount::INT), 6) AS discount_rate,
  count(*) FILTER (converted) AS conversions, round(avg(converted::INT), 6) AS conversion_rate, round(sum(profit_eur), 2) AS profit_eur,
  round(sum(expected_profit_eur - expected_profit_if_nothing_eur), 2) AS expected_profit_vs_nothing_eur, round(sum(discount_cost_eur), 2) AS discount_cost_eur,
  coalesce(round(count(*) FILTER (is_wasted_discount) / nullif(count(*) FILTER (is_discount AND converted), 0)::DOUBLE, 6), -1.0) AS wasted_discount_share,
  coalesce(round(avg((NOT is_discount)::INT) FILTER (would_buy_anyway), 6), -1.0) AS no_incentive_rate_would_buy_anyway,
  round(avg(regret_eur) * 100, 6) AS mean_regret_cents, count(*) FILTER (is_overridden) AS overrides
FROM star GROUP BY policy, policy_label, is_ml_policy""")
def _(ws):
    out = mart.rpt_policy_kpis(ws.star)
    for c in ("wasted_discount_share", "no_incentive_rate_would_buy_anyway"):
        out = out.withColumn(c, F.coalesce(c, F.lit(-1.0)))
    return out


@report("mart_retention_cohorts", "MA-10", """
WITH f AS (SELECT customer_id, date_trunc('month', DATE '2024-01-01' + CAST(min(day_index) - 400 * (CAST(customer_id AS BIGINT) % 3) // 10 AS INTEGER)) AS cohort FROM m_events GROUP BY customer_id),
o AS (SELECT DISTINCT customer_id, date_trunc('month', DATE '2024-01-01' + CAST(day_index AS INTEGER)) AS m FROM m_events WHERE event_type = 'order_placed')
SELECT strftime(f.cohort, '%Y-%m') AS cohort_month, date_diff('month', f.cohort, o.m) AS months_since_first_seen, any_value(s.n) AS cohort_customers,
  count(DISTINCT o.customer_id) AS ordering_customers, round(count(DISTINCT o.customer_id) / any_value(s.n)::DOUBLE, 6) AS retention_rate
FROM f JOIN o USING (customer_id) JOIN (SELECT cohort, count(*) AS n FROM f GROUP BY cohort) s ON s.cohort = f.cohort
WHERE o.m >= f.cohort GROUP BY f.cohort, o.m""")
def _(ws):
    # an earlier visit per customer spreads the cohorts over several months
    back = F.floor(F.lit(400) * (F.col("customer_id").cast("long") % 3) / 10).cast("long")
    first = ws.mart_events.groupBy("customer_id").agg(F.min("day_index").alias("d")).select(
        "customer_id", F.lit("session_start").alias("event_type"),
        (F.col("d") - back).alias("day_index"), F.lit(None).cast("long").alias("order_total_cents"),
        F.lit(None).cast("string").alias("category"))
    return mart.rpt_retention_cohorts(ws.mart_events.unionByName(first))


@report("retention_from_orders", "MA-10", """
WITH f AS (SELECT o_custkey, min(date_trunc('month', CAST(o_orderdate AS DATE))) AS cohort FROM orders GROUP BY o_custkey),
o AS (SELECT DISTINCT o_custkey, date_trunc('month', CAST(o_orderdate AS DATE)) AS m FROM orders)
SELECT strftime(f.cohort, '%Y-%m') AS cohort_month, date_diff('month', f.cohort, o.m) AS months_since_first_seen, any_value(s.n) AS cohort_customers,
  count(*) AS ordering_customers, round(count(*) / any_value(s.n)::DOUBLE, 6) AS retention_rate
FROM f JOIN o USING (o_custkey) JOIN (SELECT cohort, count(*) AS n FROM f GROUP BY cohort) s ON s.cohort = f.cohort GROUP BY f.cohort, o.m""")
def _(ws):
    rows = fixtures.order_events(ws.spark, ws.root)
    return mart.rpt_retention_cohorts(mart.mart_events(rows, ws.catalog))


@report("mart_data_quality", "MA-11", f"""
WITH t AS (SELECT rows_landed AS n, (SELECT count(*) FROM reject_rows) AS r FROM ingest_totals)
SELECT 'reject_rate' AS check_name, 'all' AS stage, r AS failing_rows, n + r AS checked_rows, round(r / (n + r)::DOUBLE, 6) AS failing_share,
  {S.max_reject_rate}::DOUBLE AS threshold, CASE WHEN r / (n + r)::DOUBLE <= {S.max_reject_rate} THEN 'true' ELSE 'false' END AS passed FROM t
UNION ALL SELECT 'gate:' || gate, stage, count(*), any_value(n + r), round(count(*) / any_value(n + r)::DOUBLE, 6), -1.0, '' FROM reject_rows, t GROUP BY gate, stage""")
def _(ws):
    out = mart.rpt_data_quality(ws.landed, ws.rejects)
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(-1.0))).withColumn(
        "passed", F.coalesce(F.col("passed").cast("string"), F.lit("")))


duck.CTES["reject_rows"] = """
SELECT DISTINCT 'contract' AS stage, 'contract' AS gate, event_id, customer_id, session_id, ts, type, payload FROM judged_raw WHERE reason IS NOT NULL
UNION ALL SELECT 'semantic', gate, event_id, '', '', '', '', '' FROM decisive"""


@report("mart_gate", "MA-13", """
SELECT * FROM (VALUES ('violations:test_unique_keys', 0), ('violations:test_not_null_keys', 0), ('violations:test_referential_integrity', 0),
  ('violations:test_row_counts', 0), ('violations:test_business_rules', 0)) AS v(item, n)
UNION ALL SELECT 'rows:dim_action', count(*) FROM d_action UNION ALL SELECT 'rows:dim_customer', count(*) FROM d_customer
UNION ALL SELECT 'rows:dim_date', count(*) FROM d_date UNION ALL SELECT 'rows:dim_policy', count(*) FROM d_policy
UNION ALL SELECT 'rows:fct_decisions', count(*) FROM f_decisions UNION ALL SELECT 'rows:fct_outcomes', count(*) FROM f_outcomes
UNION ALL SELECT 'rows:replay', count(*) FROM test_log UNION ALL SELECT 'rows:rpt_policy_kpis', count(*) FROM d_policy""")
def _(ws):
    return mart_checks.gate_report(ws.tables)


def _faulty(ws: Workspace) -> mart_checks.Tables:
    """The mart with faults over whole tables: doubled rows, lost rows, nulls, bad links."""
    t = dict(ws.tables)
    d = t["fct_decisions"]
    low = uniform_key(d, "decision_key")
    t["fct_decisions"] = d.unionByName(d.where(low < 0.01)).withColumn(
        "action_key", F.when(low.between(0.02, 0.03), None).otherwise(F.col("action_key"))
    ).withColumn("customer_key", F.when(low.between(0.05, 0.06), F.lit(-1)).otherwise(
        F.col("customer_key")))
    o = t["fct_outcomes"]
    odd = uniform_key(o, "decision_key").between(0.1, 0.11)
    t["fct_outcomes"] = o.withColumn(
        "is_wasted_discount", odd | F.col("is_wasted_discount")).withColumn(
        "converted", ~odd & F.col("converted"))
    return t


def uniform_key(df: DataFrame, key: str):
    return draws.uniform("fault", F.col(key))


duck.CTES["bad_decisions"] = f"""
SELECT decision_key, policy_key, CASE WHEN x BETWEEN 0.05 AND 0.06 THEN -1 ELSE customer_key END AS customer_key, date_key,
  CASE WHEN x BETWEEN 0.02 AND 0.03 THEN NULL ELSE action_key END AS action_key
FROM (SELECT *, {duck.u('fault', 'decision_key')} AS x FROM f_decisions), range(0, 2) AS r(c) WHERE c = 0 OR x < 0.01"""
_ODD = f"({duck.u('fault', 'decision_key')} BETWEEN 0.1 AND 0.11)"


@report("check_unique_keys", "TS-1", """
SELECT 'fct_decisions' AS check_name, CAST(decision_key AS VARCHAR) AS key FROM bad_decisions GROUP BY decision_key HAVING count(*) > 1
UNION ALL SELECT 'fct_decisions_grain', policy_key || '|' || customer_key || '|' || date_key FROM bad_decisions
GROUP BY policy_key, customer_key, date_key HAVING count(*) > 1""")
def _(ws):
    return mart_checks.unique_keys(_faulty(ws))


@report("check_not_null_keys", "TS-2", """
SELECT 'fct_decisions' AS check_name, CAST(decision_key AS VARCHAR) AS key FROM bad_decisions WHERE action_key IS NULL""")
def _(ws):
    return mart_checks.not_null_keys(_faulty(ws))


@report("check_referential_integrity", "TS-3", """
SELECT 'fct_decisions.customer_key' AS check_name, CAST(decision_key AS VARCHAR) AS key FROM bad_decisions WHERE customer_key = -1
UNION ALL SELECT 'fct_decisions.action_key', CAST(decision_key AS VARCHAR) FROM bad_decisions WHERE action_key IS NULL""")
def _(ws):
    return mart_checks.referential_integrity(_faulty(ws))


@report("check_row_counts", "TS-4", """
SELECT 'fct_decisions vs source' AS check_name, (SELECT count(*) FROM bad_decisions) AS mart_rows, (SELECT count(*) FROM test_log) AS source_rows
UNION ALL SELECT 'fct_outcomes vs fct_decisions', (SELECT count(*) FROM f_outcomes), (SELECT count(*) FROM bad_decisions)""")
def _(ws):
    return mart_checks.row_counts(_faulty(ws))


@report("check_business_rules", "TS-5", f"""
SELECT 'wasted discount not redeemed' AS check_name, CAST(decision_key AS VARCHAR) AS key FROM f_outcomes WHERE {_ODD}""")
def _(ws):
    return mart_checks.business_rules(_faulty(ws))


# ================================================================== BI measures
_BI = {
    "bi_volume": ("BI-1", ["decisions", "contact_rate", "restraint_rate", "discount_rate"],
                  "count(*) AS decisions, round(avg(is_contact::INT), 6) AS contact_rate, round(avg(is_restraint::INT), 6) AS restraint_rate, round(avg(is_discount::INT), 6) AS discount_rate"),
    "bi_outcomes": ("BI-2", ["conversions", "conversion_rate", "profit", "expected_profit", "profit_vs_doing_nothing", "discount_cost"],
                    "count(*) FILTER (converted) AS conversions, round(avg(converted::INT), 6) AS conversion_rate, round(sum(profit_eur), 5) AS profit, round(sum(expected_profit_eur), 5) AS expected_profit, round(sum(expected_profit_eur) - sum(expected_profit_if_nothing_eur), 5) AS profit_vs_doing_nothing, round(sum(discount_cost_eur), 5) AS discount_cost"),
    "bi_uplift": ("BI-3", ["avg_predicted_uplift", "avg_true_uplift", "uplift_error_pp"],
                  "round(avg(true_purchase_probability / 10), 6) AS avg_predicted_uplift, round(avg(true_uplift), 6) AS avg_true_uplift, round((avg(true_purchase_probability / 10) - avg(true_uplift)) * 100, 6) AS uplift_error_pp"),
    "bi_restraint": ("BI-4", ["wasted_discount_share", "no_incentive_rate", "mean_regret_cents"],
                     "coalesce(round(count(*) FILTER (is_wasted_discount) / nullif(count(*) FILTER (converted AND is_discount), 0)::DOUBLE, 6), -1.0) AS wasted_discount_share, coalesce(round(count(*) FILTER (would_buy_anyway AND NOT is_discount) / nullif(count(*) FILTER (would_buy_anyway), 0)::DOUBLE, 6), -1.0) AS no_incentive_rate, round(avg(regret_eur) * 100, 6) AS mean_regret_cents"),
    "bi_governance": ("BI-5", ["overrides", "override_rate", "avg_confidence"],
                      "count(*) FILTER (is_overridden) AS overrides, round(avg(is_overridden::INT), 6) AS override_rate, coalesce(round(avg(CASE WHEN is_contact THEN true_purchase_probability END), 6), -1.0) AS avg_confidence"),
}


def _bi(name: str, item: str, wanted: list[str], sql: str):
    @report(name, item, f"SELECT policy, archetype, {sql} FROM star GROUP BY policy, archetype")
    def _(ws):
        # rule-based replays have no estimates; the probability stands in so that both are read
        rows = ws.star.withColumn("uplift_estimate", F.col("true_purchase_probability") / 10).withColumn(
            "confidence", F.when(F.col("is_contact"), F.col("true_purchase_probability")))
        out = measures.measures(rows, "policy", "archetype", names=wanted)
        eur = ("profit", "expected_profit", "profit_vs_doing_nothing", "discount_cost")
        return out.select("policy", "archetype", *[
            F.col(c) if c in ("decisions", "conversions", "overrides") else
            F.coalesce(F.round(c, 5 if c in eur else 6), F.lit(-1.0)).alias(c) for c in wanted])


for _name, (_item, _wanted, _sql) in _BI.items():
    _bi(_name, _item, _wanted, _sql)


@report("bi_model_quality", "BI-6", f"""
SELECT round(avg((p - y::INT) ** 2), 6) AS brier_test,
  (SELECT round(ece, 6) FROM ({_ECE}) WHERE split = 'test') AS ece_test FROM scored WHERE split = 'test'""")
def _(ws):
    m = me.prediction_metrics(me.with_all_group(ws.scored), ["family", "split", "archetype"],
                              ["customer_id", "day"])
    out = measures.measures(m, catalog=measures.model_measures())
    return out.select(r6("brier_test"), r6("ece_test"))


@report("bi_customers", "BI-7", """
SELECT lifecycle_stage, fatigue_risk, count(*) AS customers_listed, round(avg(clv_12m_estimate_eur), 6) AS avg_clv_estimate
FROM d_customer GROUP BY ALL""")
def _(ws):
    return measures.measures(ws.tables["dim_customer"], "lifecycle_stage", "fatigue_risk",
                             catalog=measures.customer_measures()).select(
        "lifecycle_stage", "fatigue_risk", "customers_listed", r6("avg_clv_estimate"))


@report("bi_customers_decided", "BI-7", "SELECT policy, archetype, count(DISTINCT customer_key) AS customers FROM star GROUP BY ALL")
def _(ws):
    return measures.measures(ws.star, "policy", "archetype", names=["customers"])


# ================================================================== flagship
@report("playbook_actions", "SRC-1, FT-13, PO-5", f"""
SELECT day, CASE WHEN cart_state_units >= 1 AND price_sensitivity_proxy >= 0.25 THEN 'discount_low__1000bps'
  WHEN session_visits_count >= 4 THEN 'recommend__affinity' WHEN rfm_recency_days >= 60 THEN 'email_delayed' ELSE 'none' END AS preferred,
  count(*) AS customers, CAST(sum(rfm_frequency_count) AS BIGINT) AS orders_90d, CAST(sum(rfm_monetary_cents) AS BIGINT) AS spend_90d
FROM grid WHERE day IN ({duck.DAYS}) GROUP BY ALL""")
def _(ws):
    grid = cx.grid_rows(ft.feature_grid(fixtures.events(ws.spark, ws.root)), S.decision_days)
    return grid.groupBy("day", po.preferred_playbook()[0].alias("preferred")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("rfm_frequency_count").alias("orders_90d"),
        F.sum("rfm_monetary_cents").alias("spend_90d"))


# ================================================================== public surface
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(rep: Report):
        return lambda spark, root: rep.build(workspace(spark, root))

    return {name: bind(rep) for name, rep in REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck.compose(rep.sql) for name, rep in REPORTS.items() if rep.sql}
