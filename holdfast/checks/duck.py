"""The same views and operators as literal SQL, for comparison on DuckDB.

Written from the definitions (correlated joins, recursion), not from the Spark plans.
`compose` prefixes a SELECT with exactly the common table expressions it needs.
"""

from __future__ import annotations

import re

from holdfast.config import (
    DECISION_ID_NAMESPACE,
    POLICY_LABELS,
    PROB_MULTIPLIER,
    SETTINGS,
    candidate_rows,
)

START = f"DATE '{SETTINGS.start_date.isoformat()}'"
START_TS = f"TIMESTAMP '{SETTINGS.start_date.isoformat()} 00:00:00'"
H = SETTINGS.horizon_days
DAYS = ", ".join(str(d) for d in SETTINGS.decision_days)


def u(seed, *parts: str) -> str:
    key = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def bits(seed, *parts: str) -> str:
    key = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT)"


def uuid5(namespace: str, name: str) -> str:
    s = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return (f"(substr({s}, 1, 8) || '-' || substr({s}, 9, 4) || '-5' || substr({s}, 14, 3) || '-' || "
            f"substr('89ab', CAST(1 + (CAST(('0x' || substr({s}, 17, 1)) AS BIGINT) & 3) AS BIGINT), 1)"
            f" || substr({s}, 18, 3) || '-' || substr({s}, 21, 12))")


def _actions() -> str:
    return ", ".join(
        f"({r['catalog_order']}, '{r['candidate_id']}', '{r['archetype']}', "
        f"'{r['description'].replace(chr(39), chr(39) * 2)}', {str(r['contact']).lower()}, "
        f"{r['cost_cents']}, {r['discount_bps']})" for r in candidate_rows())


def _labels() -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POLICY_LABELS.items())


DECISION = uuid5(DECISION_ID_NAMESPACE,
                 f"customer_id || '|' || strftime({START_TS} + day * INTERVAL 1 DAY, "
                 "'%Y-%m-%dT%H:%M:%S') || '+00:00|' || policy || '|settings-v1|'")
_MULT = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PROB_MULTIPLIER.items())

CTES: dict[str, str] = {
    "catalog": """
SELECT CAST(p_partkey AS VARCHAR) AS sku, p_type AS category,
       CAST(round(p_retailprice * 100) AS BIGINT) AS base_price_cents,
       0.20::DOUBLE + (p_size % 31) / 100.0::DOUBLE AS margin_rate,
       CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END AS seasonality_class
FROM part""",
    "inventory": f"""
SELECT t AS tick, CAST(p_partkey AS VARCHAR) AS sku,
       CAST(10 + (length(p_type) * 3 + t * 7) % 25 + p_partkey % 5 AS BIGINT) AS units
FROM part, range(0, {H}) AS r(t)""",
    "ev": """
SELECT e.event_id, e.customer_id, e.session_id, e.ts, e.type, 'simulator' AS source,
  CAST(CASE e.type
    WHEN 'product_view' THEN json_object('type', e.type, 'sku', e.sku, 'category', c.category,
                                         'unit_price_cents', e.cents)
    WHEN 'add_to_cart' THEN json_object('type', e.type, 'sku', e.sku, 'quantity', e.quantity,
                                        'unit_price_cents', e.cents)
    WHEN 'cart_remove' THEN json_object('type', e.type, 'sku', e.sku, 'quantity', e.quantity)
    WHEN 'cart_abandon' THEN json_object('type', e.type, 'cart_value_cents', e.cents)
    WHEN 'order_placed' THEN json_object('type', e.type, 'order_id', 'o' || e.event_id,
      'line_items', json_array(json_object('sku', e.sku, 'quantity', e.quantity,
         'unit_price_cents', e.cents, 'discount_cents', e.discount)),
      'order_total_cents', e.quantity * e.cents - e.discount)
    WHEN 'campaign_exposure' THEN json_object('type', e.type, 'campaign_id', 'c' || (e.k % 7),
      'channel', CASE e.k % 2 WHEN 0 THEN 'email' ELSE 'push' END)
    WHEN 'scroll' THEN json_object('type', e.type, 'depth_pct', e.k)
    WHEN 'filter_apply' THEN json_object('type', e.type, 'facet',
      CASE e.k % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'brand' ELSE 'size' END,
      'value', CAST(e.k AS VARCHAR))
    WHEN 'dwell' THEN json_object('type', e.type, 'dwell_class',
      CASE e.k % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END, 'sku', e.sku)
    ELSE json_object('type', e.type, 'device',
      CASE e.k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END)
  END AS VARCHAR) AS payload
FROM (
  SELECT *, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
    CAST(user_id AS VARCHAR) AS customer_id, CAST(1 + k AS VARCHAR) AS sku, 1 + k % 3 AS quantity,
    CASE WHEN k % 4 = 0 THEN cents // 10 ELSE 0 END AS discount,
    CASE event_type WHEN 'view' THEN 'product_view' WHEN 'purchase' THEN 'order_placed'
      WHEN 'signup' THEN 'session_start'
      WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'campaign_exposure' ELSE 'cart_abandon' END
      ELSE CASE k % 5 WHEN 0 THEN 'add_to_cart' WHEN 1 THEN 'scroll' WHEN 2 THEN 'filter_apply'
        WHEN 3 THEN 'dwell' ELSE 'cart_remove' END END AS type
  FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, ts, user_id, event_type,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(round(value * 100) AS BIGINT) AS cents FROM events)
) e LEFT JOIN catalog c ON c.sku = e.sku""",
    "typed": f"""
SELECT event_id, customer_id, session_id, ts, type, payload,
  date_diff('day', {START}, CAST(ts AS DATE)) AS day,
  CAST(payload ->> '$.order_total_cents' AS BIGINT) AS total,
  payload ->> '$.line_items[0].sku' AS first_sku,
  payload ->> '$.category' AS category,
  CAST(payload ->> '$.quantity' AS BIGINT) AS qty,
  payload ->> '$.dwell_class' AS dwell_class,
  CAST(json_array_length(payload, '$.line_items') AS BIGINT) AS items,
  len(list_filter(CAST(json_extract(payload, '$.line_items[*].discount_cents') AS BIGINT[]),
                  lambda x: x > 0)) AS cheap_items
FROM ev""",
    "raw": """
SELECT CASE WHEN copy = 1 THEN 'n' || event_id ELSE event_id END AS event_id,
  CASE WHEN m = 6 THEN '' ELSE customer_id END AS customer_id, session_id,
  strftime(CASE WHEN copy = 2 THEN ts + INTERVAL 1 SECOND ELSE ts END, '%Y-%m-%dT%H:%M:%S.%f')
    || CASE WHEN m = 8 THEN '' ELSE '+00:00' END AS ts,
  CASE m WHEN 2 THEN 'teleport' WHEN 10 THEN 'scroll' ELSE type END AS type,
  CASE m WHEN 0 THEN replace(payload, '_cents":', '_cents":-1')
    WHEN 1 THEN regexp_replace(payload, '"sku":"[0-9]+"', '"sku":"missing"', 'g')
    WHEN 5 THEN regexp_replace(payload, '^\\{"type"', '{"extra":1,"type"')
    WHEN 7 THEN regexp_replace(payload, '"line_items":\\[[^\\]]*\\]', '"line_items":[]', 'g')
    WHEN 11 THEN regexp_replace(payload, '"unit_price_cents":[0-9]+',
                                '"unit_price_cents":"abc"', 'g')
    WHEN 12 THEN regexp_replace(payload, '"(channel|device|facet|dwell_class)":', '"\\1_x":', 'g')
    ELSE payload END AS payload, source
FROM (SELECT *, CAST(event_id AS BIGINT) % 200 AS m FROM ev),
  LATERAL (SELECT unnest(CASE WHEN m = 3 THEN [0, 1] WHEN m = 4 THEN [0, 2]
                              WHEN m = 9 THEN [0, 3] ELSE [0] END) AS copy)""",
    # ----------------------------------------------------------------- quality
    "spec": """
SELECT * FROM (VALUES
  ('session_start', 1, 'device', 'choice', ['desktop', 'mobile', 'tablet']),
  ('session_end', 1, 'duration_s', 'ge0', []),
  ('product_view', 1, 'sku', 'text', []), ('product_view', 2, 'category', 'text', []),
  ('product_view', 3, 'unit_price_cents', 'ge0', []),
  ('add_to_cart', 1, 'sku', 'text', []), ('add_to_cart', 2, 'quantity', 'gt0', []),
  ('add_to_cart', 3, 'unit_price_cents', 'ge0', []),
  ('cart_remove', 1, 'sku', 'text', []), ('cart_remove', 2, 'quantity', 'gt0', []),
  ('cart_abandon', 1, 'cart_value_cents', 'ge0', []),
  ('order_placed', 1, 'order_id', 'text', []), ('order_placed', 2, 'line_items', 'items', []),
  ('order_placed', 3, 'order_total_cents', 'ge0', []),
  ('campaign_exposure', 1, 'campaign_id', 'text', []),
  ('campaign_exposure', 2, 'channel', 'text', []),
  ('scroll', 1, 'depth_pct', 'pct', []),
  ('filter_apply', 1, 'facet', 'text', []), ('filter_apply', 2, 'value', 'text', []),
  ('dwell', 1, 'dwell_class', 'choice', ['short', 'medium', 'long']),
  ('dwell', 2, 'sku', 'text', [])
) AS s(kind, pos, field, rule, choices)""",
    "item_spec": """
SELECT * FROM (VALUES (1, 'sku', 'text'), (2, 'quantity', 'gt0'), (3, 'unit_price_cents', 'ge0'),
  (4, 'discount_cents', 'ge0')) AS s(pos, field, rule)""",
    "numbered": """
SELECT row_number() OVER () AS rid, *, payload ->> '$.type' AS kind FROM raw""",
    "field_faults": """
SELECT rid, 10 + (ord * 10) AS place, path, CASE
    WHEN jt IS NULL THEN 'Field required'
    WHEN rule IN ('ge0', 'gt0', 'pct') AND jt NOT IN ('BIGINT', 'UBIGINT')
      THEN 'Input should be a valid integer'
    WHEN rule = 'gt0' AND CAST(v AS BIGINT) <= 0 THEN 'Input should be greater than 0'
    WHEN rule IN ('ge0', 'pct') AND CAST(v AS BIGINT) < 0
      THEN 'Input should be greater than or equal to 0'
    WHEN rule = 'pct' AND CAST(v AS BIGINT) > 100
      THEN 'Input should be less than or equal to 100'
    WHEN rule = 'text' AND v = '' THEN 'String should have at least 1 character'
    WHEN rule = 'items' AND json_array_length(v) < 1
      THEN 'List should have at least 1 item after validation, not 0'
    WHEN rule = 'choice' AND NOT list_contains(choices, v)
      THEN 'Input should be ''' || array_to_string(choices[1:-2], ''', ''') || ''' or '''
           || choices[-1] || ''''
  END AS message
FROM (
  SELECT n.rid, s.pos AS ord, 'payload.' || s.kind || '.' || s.field AS path, s.rule, s.choices,
    json_type(n.payload, '$.' || s.field) AS jt,
    json_extract_string(n.payload, '$.' || s.field) AS v
  FROM numbered n JOIN spec s ON s.kind = n.kind
  UNION ALL
  SELECT n.rid, 100 + i * 10 + s.pos,
    'payload.order_placed.line_items.' || i || '.' || s.field, s.rule, [],
    json_type(n.payload, '$.line_items[' || i || '].' || s.field),
    json_extract_string(n.payload, '$.line_items[' || i || '].' || s.field)
  FROM numbered n, item_spec s, range(0, 20) AS r(i)
  WHERE n.kind = 'order_placed' AND i < coalesce(json_array_length(n.payload, '$.line_items'), 0)
)""",
    "faults": """
SELECT rid, 1 AS place, 'event_id' AS path, 'String should have at least 1 character' AS message
FROM numbered WHERE event_id = ''
UNION ALL SELECT rid, 2, 'customer_id', 'String should have at least 1 character'
FROM numbered WHERE customer_id = ''
UNION ALL SELECT rid, 3, 'session_id', 'String should have at least 1 character'
FROM numbered WHERE session_id = ''
UNION ALL SELECT rid, 4, 'ts', 'Value error, ts must carry a UTC offset'
FROM numbered WHERE NOT regexp_matches(ts, '(Z|[+-][0-9]{2}:?[0-9]{2})$')
UNION ALL SELECT rid, 5, 'type', 'Input should be ''session_start'', ''session_end'', ''product_view'', ''add_to_cart'', ''cart_remove'', ''cart_abandon'', ''order_placed'', ''campaign_exposure'', ''action_delivered'', ''override'', ''scroll'', ''filter_apply'' or ''dwell'''
FROM numbered WHERE type = 'teleport'
UNION ALL SELECT rid, place, path, message FROM field_faults WHERE message IS NOT NULL
UNION ALL
SELECT rid, 100000, 'payload.' || kind || '.' || k, 'Extra inputs are not permitted'
FROM (SELECT rid, kind, unnest(json_keys(payload)) AS k FROM numbered) x
WHERE k <> 'type' AND NOT EXISTS (SELECT 1 FROM spec s WHERE s.kind = x.kind AND s.field = x.k)""",
    "verdicts": """
SELECT n.rid, n.event_id, n.customer_id, n.session_id, n.ts, n.type, n.payload, n.kind,
  coalesce(f.n_faults, 0) AS n_faults, f.reason, f.first_path
FROM numbered n LEFT JOIN (
  SELECT rid, count(*) AS n_faults, string_agg(path || ': ' || message, '; ' ORDER BY place) AS reason,
         arg_min(path, place) AS first_path FROM faults GROUP BY rid) f USING (rid)""",
    "judged_raw": """
SELECT * EXCLUDE (reason, first_path),
  CASE WHEN n_faults > 0 THEN reason WHEN type <> kind
    THEN '<root>: Value error, payload.type does not match event type' END AS reason,
  CASE WHEN n_faults > 0 THEN first_path END AS first_path
FROM verdicts""",
    "good": """
SELECT event_id, customer_id, session_id, CAST(ts AS TIMESTAMP) AS ts, type, payload
FROM judged_raw WHERE reason IS NULL""",
    "price_faults": """
SELECT event_id, string_agg(path || '=' || v, '; ' ORDER BY pos) AS detail, rid FROM (
  SELECT rid, event_id, 0 AS pos, f AS path, CAST(payload ->> ('$.' || f) AS BIGINT) AS v
  FROM numbered, (VALUES ('product_view', 'unit_price_cents'), ('add_to_cart', 'unit_price_cents'),
    ('cart_abandon', 'cart_value_cents'), ('order_placed', 'order_total_cents')) AS p(k, f)
  WHERE type = k AND json_type(payload, '$.' || f) IN ('BIGINT', 'UBIGINT')
  UNION ALL
  SELECT rid, event_id, 1 + i * 2 + j, 'line_items[' || i || '].' || f,
    CASE WHEN json_type(payload, '$.line_items[' || i || '].' || f) IN ('BIGINT', 'UBIGINT')
      THEN CAST(payload ->> ('$.line_items[' || i || '].' || f) AS BIGINT) END
  FROM numbered, range(0, 20) AS r(i),
    (VALUES (0, 'unit_price_cents'), (1, 'discount_cents')) AS p(j, f)
  WHERE type = 'order_placed' AND i < coalesce(json_array_length(payload, '$.line_items'), 0)
) WHERE v < 0 GROUP BY rid, event_id""",
    "sku_faults": """
SELECT event_id, string_agg(path || '=''' || sku || ''' not present in catalog', '; ' ORDER BY pos) AS detail
FROM (
  SELECT DISTINCT event_id, 0 AS pos, 'sku' AS path, payload ->> '$.sku' AS sku FROM good
  WHERE type IN ('product_view', 'add_to_cart', 'cart_remove', 'dwell')
  UNION
  SELECT event_id, i, 'line_items[' || i || '].sku', payload ->> ('$.line_items[' || i || '].sku')
  FROM good, range(0, 20) AS r(i)
  WHERE type = 'order_placed' AND i < coalesce(json_array_length(payload, '$.line_items'), 0)
) x WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.sku = x.sku) GROUP BY event_id""",
    "tie_faults": """
SELECT DISTINCT event_id, 'session ''' || session_id || ''' timestamp does not strictly increase within the batch (previous='
  || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+00:00, this=' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+00:00)' AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ts ORDER BY event_id) AS rn FROM good)
WHERE rn > 1""",
    "gate_faults": """
SELECT event_id, 0 AS gate_order, 'non_negative_price' AS gate, detail FROM price_faults
WHERE rid IN (SELECT rid FROM judged_raw WHERE reason IS NULL)
UNION ALL SELECT event_id, 1, 'monotonic_session_timestamps', detail FROM tie_faults
UNION ALL SELECT event_id, 2, 'catalog_referential_integrity', detail FROM sku_faults""",
    "decisive": """
SELECT event_id, gate, detail FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gate_order) AS rn FROM gate_faults)
WHERE rn = 1""",
    "landed": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY customer_id, ts, event_id) AS rn
  FROM good WHERE event_id NOT IN (SELECT event_id FROM decisive)) WHERE rn = 1""",
    "ingest_totals": """
SELECT (SELECT count(*) FROM raw) AS rows_in,
  (SELECT count(*) FROM judged_raw WHERE reason IS NOT NULL) AS rows_rejected_contract,
  (SELECT count(*) FROM landed) AS rows_landed,
  (SELECT count(*) FROM decisive) AS rows_rejected_semantic""",
    # ----------------------------------------------------------------- features
    "gridkey": f"""
SELECT c.customer_id, d AS day, {START_TS} + d * INTERVAL 1 DAY AS as_of
FROM (SELECT DISTINCT customer_id FROM ev) c, range(0, {H}) AS r(d)""",
    "windowed": """
SELECT g.customer_id, g.day, g.as_of,
  max(e.ts) FILTER (e.type = 'order_placed') AS last_order,
  max(e.ts) FILTER (e.type IN ('order_placed', 'cart_abandon')) AS last_reset,
  count(*) FILTER (e.type = 'order_placed' AND e.ts > g.as_of - INTERVAL 90 DAY) AS orders,
  coalesce(sum(e.total) FILTER (e.ts > g.as_of - INTERVAL 90 DAY), 0) AS spend,
  count(*) FILTER (e.type = 'session_start' AND e.ts > g.as_of - INTERVAL 30 DAY) AS visits,
  count(DISTINCT e.session_id) FILTER (e.type = 'session_start' AND e.ts > g.as_of - INTERVAL 30 DAY) AS sessions,
  count(*) FILTER (e.type = 'product_view' AND e.ts > g.as_of - INTERVAL 30 DAY) AS views,
  count(*) FILTER (e.dwell_class = 'short' AND e.ts > g.as_of - INTERVAL 30 DAY) AS dwell_short,
  count(*) FILTER (e.dwell_class = 'medium' AND e.ts > g.as_of - INTERVAL 30 DAY) AS dwell_medium,
  count(*) FILTER (e.dwell_class = 'long' AND e.ts > g.as_of - INTERVAL 30 DAY) AS dwell_long,
  coalesce(sum(e.items) FILTER (e.type = 'order_placed' AND e.ts > g.as_of - INTERVAL 90 DAY), 0) AS items,
  coalesce(sum(e.cheap_items) FILTER (e.type = 'order_placed' AND e.ts > g.as_of - INTERVAL 90 DAY), 0) AS cheap_items,
  count(*) FILTER (e.type IN ('campaign_exposure', 'action_delivered') AND e.ts > g.as_of - INTERVAL 14 DAY) AS messages,
  count(*) FILTER (e.type = 'cart_abandon' AND e.ts > g.as_of - INTERVAL 90 DAY) AS abandons,
  count(*) FILTER (e.type = 'scroll' AND e.ts > g.as_of - INTERVAL 30 DAY) AS scrolls,
  count(*) FILTER (e.type = 'filter_apply' AND e.ts > g.as_of - INTERVAL 30 DAY) AS filters,
  count(*) FILTER (e.type = 'dwell' AND e.ts > g.as_of - INTERVAL 30 DAY) AS dwells
FROM gridkey g LEFT JOIN typed e ON e.customer_id = g.customer_id AND e.ts <= g.as_of
GROUP BY g.customer_id, g.day, g.as_of""",
    "carts": """
SELECT w.customer_id, w.day,
  greatest(coalesce(sum(CASE e.type WHEN 'add_to_cart' THEN e.qty ELSE -e.qty END), 0), 0) AS units
FROM windowed w LEFT JOIN typed e ON e.customer_id = w.customer_id AND e.ts <= w.as_of
  AND e.type IN ('add_to_cart', 'cart_remove') AND (w.last_reset IS NULL OR e.ts > w.last_reset)
GROUP BY w.customer_id, w.day""",
    "affinity": """
SELECT customer_id, day, category,
  round_even(n / CAST(sum(n) OVER (PARTITION BY customer_id, day) AS DOUBLE), 6) AS share
FROM (SELECT g.customer_id, g.day, nfc_normalize(e.category) AS category, count(*) AS n
      FROM gridkey g JOIN typed e ON e.customer_id = g.customer_id AND e.ts <= g.as_of
        AND e.ts > g.as_of - INTERVAL 90 DAY AND e.type = 'product_view'
      GROUP BY ALL)""",
    "grid": """
SELECT w.customer_id, w.day, w.as_of,
  CAST(date_diff('day', w.last_order, w.as_of) AS BIGINT) AS rfm_recency_days,
  CAST(w.orders AS BIGINT) AS rfm_frequency_count, CAST(w.spend AS BIGINT) AS rfm_monetary_cents,
  CAST(w.visits AS BIGINT) AS session_visits_count,
  coalesce(round_even(w.views / CAST(nullif(w.sessions, 0) AS DOUBLE), 6), 0.0) AS session_depth_mean_views,
  w.dwell_short, w.dwell_medium, w.dwell_long,
  coalesce(round_even(CAST(w.cheap_items AS DOUBLE) / CAST(nullif(w.items, 0) AS DOUBLE), 6), 0.0) AS price_sensitivity_proxy,
  CAST(w.messages AS BIGINT) AS message_fatigue_count, CAST(c.units AS BIGINT) AS cart_state_units,
  CAST(w.abandons AS BIGINT) AS abandonment_history_count, w.scrolls, w.filters, w.dwells
FROM windowed w JOIN carts c USING (customer_id, day)""",
    # ----------------------------------------------------------------- contexts
    "contacts": f"""
SELECT f.customer_id, d AS day, f.first_day,
  count(e.day) FILTER (d - e.day <= 7) AS contacts_7d,
  count(e.day) FILTER (d - e.day <= 14) AS contacts_14d, count(e.day) AS contacts_total
FROM (SELECT customer_id, min(day) AS first_day FROM typed GROUP BY customer_id) f
JOIN range(0, {H}) AS r(d) ON d > f.first_day
LEFT JOIN typed e ON e.customer_id = f.customer_id AND e.type = 'campaign_exposure' AND e.day < d
GROUP BY f.customer_id, d, f.first_day""",
    "stock": """
SELECT tick, category, min(units) AS units FROM inventory JOIN catalog USING (sku)
GROUP BY tick, category""",
    "cat_orders": f"""
SELECT c.category, count(*) AS n_orders, CAST(round(avg(t.total)) AS BIGINT) AS aov
FROM typed t JOIN catalog c ON c.sku = t.first_sku
WHERE t.type = 'order_placed' AND t.day < {SETTINGS.train_end_day} GROUP BY c.category""",
    "reference": """
SELECT m.category, m.margin_rate, coalesce(o.aov, m.mean_price) AS order_value_cents,
  coalesce(o.n_orders, 0) AS n_orders
FROM (SELECT category, round(avg(margin_rate), 6) AS margin_rate,
        CAST(round(avg(base_price_cents)) AS BIGINT) AS mean_price
      FROM catalog GROUP BY category) m LEFT JOIN cat_orders o USING (category)""",
    "top_cat": "SELECT category FROM reference ORDER BY n_orders DESC, category LIMIT 1",
    "primary_cat": """
SELECT customer_id, day, category, share FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, day ORDER BY share DESC, category) AS rn
  FROM affinity) WHERE rn = 1""",
    "ctx": f"""
SELECT g.*, coalesce(p.category, (SELECT category FROM top_cat)) AS primary_category,
  coalesce(p.share, 0.0) AS primary_affinity_share, h.contacts_7d, h.contacts_14d,
  h.contacts_total, h.first_day, greatest(g.day - h.first_day, 0) AS tenure_days,
  month({START} + CAST(g.day AS INTEGER)) AS month,
  coalesce(s.units, {SETTINGS.initial_stock}) AS stock_units,
  coalesce(s.units, {SETTINGS.initial_stock}) <= {SETTINGS.low_stock_threshold} AS low_stock,
  r.margin_rate, r.order_value_cents
FROM grid g JOIN contacts h USING (customer_id, day)
LEFT JOIN primary_cat p USING (customer_id, day)
LEFT JOIN reference r ON r.category = coalesce(p.category, (SELECT category FROM top_cat))
LEFT JOIN stock s ON s.tick = greatest(g.day - 1, 0)
  AND s.category = coalesce(p.category, (SELECT category FROM top_cat))""",
    "dctx": f"SELECT * FROM ctx WHERE day IN ({DAYS})",
    # ------------------------------------------------------- candidates and rules
    "actions": f"""
SELECT CAST(a.o AS BIGINT) AS catalog_order, a.candidate_id, a.archetype, a.description, a.contact,
  CAST(a.c AS BIGINT) AS cost_cents, CAST(a.b AS BIGINT) AS discount_bps
FROM (VALUES {_actions()}) AS a(o, candidate_id, archetype, description, contact, c, b)""",
    "cand": f"""
SELECT c.customer_id, c.day, c.primary_category, c.contacts_7d, c.contacts_14d, c.margin_rate,
  c.order_value_cents, c.low_stock, c.stock_units, a.*,
  a.discount_bps > 2000 AS over_ceiling,
  a.discount_bps > 0 AND c.margin_rate - a.discount_bps / 10000.0::DOUBLE < 0.20::DOUBLE - 1e-12 AS thin,
  a.archetype IN ('discount_low', 'discount_high', 'bundle') AND c.low_stock AS scarce,
  {u('p0', 'c.customer_id', 'c.day')} * 0.03::DOUBLE + 0.02::DOUBLE AS p_none,
  {u('pa', 'c.customer_id', 'c.day', 'a.candidate_id')} AS pa
FROM ctx c, actions a WHERE c.day >= {SETTINGS.warmup_days}""",
    "priced_cand": f"""
SELECT *, p * order_value_cents * (margin_rate - discount_bps / 10000.0::DOUBLE) - cost_cents AS exp_profit
FROM (SELECT *, NOT (over_ceiling OR thin OR scarce) AS base_ok,
  CASE WHEN archetype IN ('none', 'wait') THEN p_none ELSE
    least(1.0::DOUBLE, p_none * (CASE archetype {_MULT} END) * (0.8::DOUBLE + 0.4::DOUBLE * pa)) END AS p
  FROM cand)""",
    "options": """
SELECT *, CASE WHEN over_ceiling THEN 'discount_ceiling' WHEN thin THEN 'margin_floor'
    WHEN scarce THEN 'inventory_scarcity_gate'
    WHEN contact AND contacts_7d >= 2 THEN 'frequency_cap' END AS rule,
  CASE WHEN contact THEN contacts_14d * 15.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty_cents
FROM priced_cand""",
    # ---------------------------------------------------------------- policy picks
    "wish": """
SELECT c.customer_id, c.day, p.policy, CASE p.policy
  WHEN 'do_nothing' THEN 'none' WHEN 'top_seller' THEN 'recommend__top_seller'
  WHEN 'rules_only' THEN CASE
    WHEN c.cart_state_units >= 1 AND c.price_sensitivity_proxy >= 0.25 THEN 'discount_low__1000bps'
    WHEN c.session_visits_count >= 4 THEN 'recommend__affinity'
    WHEN c.rfm_recency_days >= 60 THEN 'email_delayed' ELSE 'none' END END AS wanted
FROM ctx c, (VALUES ('do_nothing'), ('always_discount'), ('top_seller'), ('rules_only'),
  ('oracle_upper_bound'), ('random')) AS p(policy)""",
    "pick_open": f"""
SELECT w.policy, w.customer_id, w.day, CASE
  WHEN w.policy = 'always_discount' THEN coalesce(
    arg_max(o.candidate_id, (o.discount_bps, o.candidate_id)) FILTER (o.discount_bps > 0), 'none')
  WHEN w.policy = 'oracle_upper_bound' THEN arg_max(o.candidate_id, (o.exp_profit, -o.catalog_order))
  WHEN w.policy = 'random' THEN list(o.candidate_id ORDER BY o.catalog_order)[
    CAST(floor({u(7001, 'w.day', 'w.customer_id')} * count(*)) AS BIGINT) + 1]
  WHEN bool_or(o.candidate_id = w.wanted) THEN any_value(w.wanted) ELSE 'none' END AS id
FROM wish w JOIN priced_cand o USING (customer_id, day) WHERE o.base_ok
GROUP BY w.policy, w.customer_id, w.day""",
    "pick_shut": f"""
SELECT w.policy, w.customer_id, w.day, CASE
  WHEN w.policy = 'always_discount' THEN 'none'
  WHEN w.policy = 'oracle_upper_bound' THEN arg_max(o.candidate_id, (o.exp_profit, -o.catalog_order))
  WHEN w.policy = 'random' THEN list(o.candidate_id ORDER BY o.catalog_order)[
    CAST(floor({u(7001, 'w.day', 'w.customer_id')} * count(*)) AS BIGINT) + 1]
  WHEN bool_or(o.candidate_id = w.wanted) THEN any_value(w.wanted) ELSE 'none' END AS id
FROM wish w JOIN priced_cand o USING (customer_id, day) WHERE o.base_ok AND NOT o.contact
GROUP BY w.policy, w.customer_id, w.day""",
    "pick_both": f"""
SELECT o.policy, o.customer_id, o.day, o.id AS open_id, s.id AS shut_id, c.contacts_7d,
  a.contact AS open_contact, b.contact AS shut_contact,
  row_number() OVER (PARTITION BY o.policy, o.customer_id ORDER BY o.day) AS rn
FROM pick_open o JOIN pick_shut s USING (policy, customer_id, day)
JOIN ctx c USING (customer_id, day) JOIN actions a ON a.candidate_id = o.id
JOIN actions b ON b.candidate_id = s.id
WHERE o.policy = 'random' OR o.day IN ({DAYS})""",
    "walk": """
SELECT policy, customer_id, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS day,
  CAST([] AS BIGINT[]) AS made, CAST([] AS BIGINT[]) AS made_before, '' AS id
FROM (SELECT DISTINCT policy, customer_id FROM pick_both)
UNION ALL
SELECT n.policy, n.customer_id, n.rn, n.day,
  CASE WHEN (CASE WHEN n.full THEN n.shut_contact ELSE n.open_contact END)
    THEN list_append(n.made, n.day) ELSE n.made END, n.made,
  CASE WHEN n.full THEN n.shut_id ELSE n.open_id END
FROM (SELECT p.*, w.made, p.contacts_7d + len(list_filter(w.made, lambda x: p.day - x <= 7)) >= 2 AS full
      FROM walk w JOIN pick_both p ON p.policy = w.policy AND p.customer_id = w.customer_id
        AND p.rn = w.rn + 1) n""",
    "steps": """
SELECT w.policy, w.customer_id, w.day, w.id AS candidate_id,
  c.contacts_7d + len(list_filter(w.made_before, lambda x: w.day - x <= 7)) AS c7,
  c.contacts_14d + len(list_filter(w.made_before, lambda x: w.day - x <= 14)) AS c14,
  c.contacts_total + len(w.made_before) AS prior_contacts
FROM walk w JOIN ctx c USING (customer_id, day) WHERE w.rn > 0""",
    "step_opts": """
SELECT s.policy, s.customer_id, s.day, s.c7, s.c14, s.prior_contacts, s.candidate_id AS chosen,
  o.catalog_order, o.candidate_id, o.archetype, o.contact, o.cost_cents, o.discount_bps, o.p,
  o.p_none, o.exp_profit, o.margin_rate, o.order_value_cents, o.primary_category,
  CASE WHEN o.over_ceiling THEN 'discount_ceiling' WHEN o.thin THEN 'margin_floor'
    WHEN o.scarce THEN 'inventory_scarcity_gate'
    WHEN o.contact AND s.c7 >= 2 THEN 'frequency_cap' END AS rule,
  o.contact AND s.c14 > 0 AS fined
FROM steps s JOIN priced_cand o USING (customer_id, day)""",
    "replay": f"""
SELECT policy, customer_id, day, primary_category, chosen AS candidate_id, archetype, discount_bps,
  contact, n_survivors, n_filtered, fired_rules, c7 AS recent_contacts_7d, prior_contacts,
  p AS p_action, p_none, draw, draw < p AS converted, draw < p_none AS would_buy_anyway,
  CAST(order_value_cents AS DOUBLE) AS order_value_cents, margin_rate,
  CASE WHEN draw < p THEN order_value_cents * (margin_rate - discount_bps / 10000.0::DOUBLE) ELSE 0.0 END - cost_cents AS profit_cents,
  CASE WHEN draw < p_none THEN order_value_cents * margin_rate ELSE 0.0::DOUBLE END AS profit_none_cents,
  exp_profit AS expected_profit_cents, p_none * order_value_cents * margin_rate AS expected_profit_none_cents,
  CASE WHEN best > exp_profit + 1e-12 THEN best_id ELSE chosen END AS oracle_best_candidate,
  greatest(best, exp_profit) - exp_profit AS regret_cents,
  CASE WHEN policy IN ('random', 'oracle_upper_bound') THEN '' ELSE runner END AS runner_up,
  CASE WHEN policy IN ('random', 'oracle_upper_bound') THEN '' ELSE {DECISION} END AS decision_id
FROM (
  SELECT policy, customer_id, day, chosen, any_value(primary_category) AS primary_category,
    any_value(c7) AS c7, any_value(prior_contacts) AS prior_contacts,
    any_value(order_value_cents) AS order_value_cents, any_value(margin_rate) AS margin_rate,
    any_value(p_none) AS p_none, {u(7002, 'day', 'customer_id')} AS draw,
    max(archetype) FILTER (candidate_id = chosen) AS archetype,
    max(discount_bps) FILTER (candidate_id = chosen) AS discount_bps,
    bool_or(contact) FILTER (candidate_id = chosen) AS contact,
    max(cost_cents) FILTER (candidate_id = chosen) AS cost_cents,
    max(p) FILTER (candidate_id = chosen) AS p, max(exp_profit) FILTER (candidate_id = chosen) AS exp_profit,
    count(*) FILTER (rule IS NULL) AS n_survivors, count(*) FILTER (rule IS NOT NULL) AS n_filtered,
    max(exp_profit) FILTER (rule IS NULL) AS best,
    arg_max(candidate_id, (exp_profit, -catalog_order)) FILTER (rule IS NULL) AS best_id,
    coalesce(arg_min(candidate_id, (contact, catalog_order)) FILTER (rule IS NULL AND candidate_id <> chosen), '') AS runner,
    concat_ws(',',
      CASE WHEN bool_or(coalesce(rule = 'discount_ceiling', false)) THEN 'discount_ceiling' END,
      CASE WHEN bool_or(coalesce(rule = 'margin_floor', false)) THEN 'margin_floor' END,
      CASE WHEN bool_or(coalesce(rule = 'inventory_scarcity_gate', false)) THEN 'inventory_scarcity_gate' END,
      CASE WHEN bool_or(coalesce(rule = 'frequency_cap', false)) THEN 'frequency_cap' END,
      CASE WHEN bool_or(fined) THEN 'fatigue_penalty' END) AS fired_rules
  FROM step_opts GROUP BY policy, customer_id, day, chosen)""",
    "test_log": "SELECT * FROM replay WHERE policy <> 'random'",
    # ---------------------------------------------------------------- bootstrap
    "slots": """
SELECT customer_id, row_number() OVER (ORDER BY length(customer_id), customer_id) - 1 AS slot
FROM (SELECT DISTINCT customer_id FROM test_log)""",
    "draws": f"""
SELECT r AS resample, {bits(SETTINGS.seeds['bootstrap'], 'r', 's.slot')} % (SELECT count(*) FROM slots) AS slot
FROM slots s, range(0, {SETTINGS.bootstrap_resamples}) AS t(r)""",
    "boot": """
SELECT d.resample, t.policy, sum(t.profit) AS profit, sum(t.expected) AS expected, sum(t.conv) AS conv
FROM draws d JOIN slots s USING (slot) JOIN (
  SELECT policy, customer_id, sum(profit_cents) AS profit, sum(expected_profit_cents) AS expected,
    count(*) FILTER (converted) AS conv FROM test_log GROUP BY ALL) t USING (customer_id)
GROUP BY d.resample, t.policy""",
    # ------------------------------------------------------------------- mart
    "segments": f"""
SELECT customer_id, CASE WHEN rfm_recency_days IS NULL THEN 0 WHEN rfm_recency_days > 60 THEN 1
    WHEN rfm_monetary_cents > cut THEN 3 ELSE 2 END AS segment_id,
  CASE WHEN rfm_recency_days IS NULL THEN 'new_or_browsing' WHEN rfm_recency_days > 60 THEN 'lapsed_buyer'
    WHEN rfm_monetary_cents > cut THEN 'loyal_high_value' ELSE 'active_buyer' END AS segment_name
FROM snap, (SELECT coalesce(quantile_cont(rfm_monetary_cents, 0.5), 0.0) AS cut FROM snap
            WHERE rfm_recency_days <= 60)""",
    "snap": f"""
SELECT g.*, coalesce(x.n, 0) AS contacts_total FROM grid g
LEFT JOIN (SELECT customer_id, count(*) AS n FROM typed
  WHERE type = 'campaign_exposure' AND day < {SETTINGS.train_end_day} GROUP BY customer_id) x USING (customer_id)
WHERE g.day = {SETTINGS.train_end_day} AND g.customer_id IN
  (SELECT customer_id FROM typed WHERE day < {SETTINGS.train_end_day})""",
    "m_events": """
SELECT t.customer_id, t.type AS event_type, t.day AS day_index, t.total AS order_total_cents, c.category
FROM typed t LEFT JOIN catalog c ON c.sku = t.first_sku""",
    "m_category": """
SELECT category, avg(margin_rate) AS margin_rate, count(*) AS sku_count FROM catalog GROUP BY category""",
    "d_date": f"""
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d AS calendar_date, i AS day_index,
  CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month, strftime(d, '%Y-%m') AS year_month,
  CAST(weekofyear(d) AS BIGINT) AS iso_week, strftime(d, '%A') AS weekday_name, month(d) = 12 AS is_peak_month,
  CASE WHEN i < {SETTINGS.train_end_day} THEN 'train' WHEN i < {SETTINGS.validation_end_day} THEN 'validation' ELSE 'test' END AS evaluation_window
FROM (SELECT i, {START} + CAST(i AS INTEGER) AS d FROM range(0, {H}) AS r(i))""",
    "d_action": """
SELECT catalog_order + 1 AS action_key, candidate_id, archetype, description, contact AS is_contact,
  cost_cents, discount_bps, archetype IN ('none', 'wait') AS is_restraint, discount_bps > 0 AS is_discount
FROM actions""",
    "d_policy": f"""
SELECT row_number() OVER (ORDER BY policy) AS policy_key, policy,
  CASE policy {_labels()} ELSE policy END AS policy_label, policy = 'rules_only' AS is_ml_policy,
  policy = 'oracle_upper_bound' AS is_reference_only
FROM (SELECT DISTINCT policy FROM test_log)""",
    "d_customer": f"""
SELECT row_number() OVER (ORDER BY length(f.customer_id), f.customer_id) AS customer_key, f.customer_id,
  {START} + CAST(f.first_day AS INTEGER) AS first_seen_date,
  strftime({START} + CAST(f.first_day AS INTEGER), '%Y-%m') AS cohort_month,
  coalesce(s.segment_name, 'unsegmented') AS segment_name, coalesce(o.n, 0) AS orders_before_test,
  round(coalesce(o.revenue, 0) / 100.0::DOUBLE, 2) AS revenue_before_test_eur,
  CASE WHEN f.first_day >= {SETTINGS.validation_end_day} THEN 'joined_during_test'
    WHEN o.last_day IS NULL THEN 'never_bought'
    WHEN {SETTINGS.validation_end_day} - o.last_day <= 60 THEN 'active'
    WHEN {SETTINGS.validation_end_day} - o.last_day <= 120 THEN 'lapsing' ELSE 'churned' END AS lifecycle_stage,
  coalesce(m.n, 0) AS messages_last_14d,
  CASE WHEN coalesce(m.n, 0) >= 4 THEN 'high' WHEN coalesce(m.n, 0) >= 2 THEN 'medium' ELSE 'low' END AS fatigue_risk,
  round(coalesce(o.margin, 0.0) / 100.0::DOUBLE
    / greatest(({SETTINGS.validation_end_day} - f.first_day) / 30.0::DOUBLE, 1.0::DOUBLE) * 12, 2) AS clv_12m_estimate_eur
FROM (SELECT customer_id, min(day_index) AS first_day FROM m_events GROUP BY customer_id) f
LEFT JOIN (SELECT e.customer_id, count(*) AS n, sum(e.order_total_cents) AS revenue,
    sum(e.order_total_cents * c.margin_rate) AS margin, max(e.day_index) AS last_day
  FROM m_events e JOIN m_category c USING (category)
  WHERE e.event_type = 'order_placed' AND e.day_index < {SETTINGS.validation_end_day} GROUP BY e.customer_id) o USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM m_events WHERE event_type = 'campaign_exposure'
    AND day_index >= {SETTINGS.validation_end_day - 14} AND day_index < {SETTINGS.validation_end_day}
  GROUP BY customer_id) m USING (customer_id)
LEFT JOIN segments s USING (customer_id)""",
    "m_keyed": """
SELECT row_number() OVER (ORDER BY p.policy_key, r.day, c.customer_key) AS decision_key,
  p.policy_key, c.customer_key, d.date_key, a.action_key, r.*
FROM test_log r JOIN d_policy p USING (policy) JOIN d_customer c USING (customer_id)
JOIN d_date d ON d.day_index = r.day JOIN d_action a USING (candidate_id)""",
    "ovr": f"""
SELECT decision_id || '#' || rank AS override_id, decision_id, policy, customer_id, day,
  candidate_id AS original_candidate, 'email_delayed' AS override_candidate, rank,
  'manager call ' || rank AS reason
FROM test_log, (VALUES (1), (2)) AS v(rank)
WHERE decision_id <> '' AND {u('ov', 'decision_id')} < 0.05
  AND (rank = 1 OR {u('ov2', 'decision_id')} < 0.1)""",
    "f_decisions": """
SELECT k.decision_key, k.policy_key, k.customer_key, k.date_key, k.action_key, k.decision_id, k.n_survivors,
  k.n_filtered, k.fired_rules, k.runner_up, k.recent_contacts_7d,
  o.override_candidate IS NOT NULL AS is_overridden, coalesce(o.override_candidate, '') AS override_candidate,
  coalesce(o.reason, '') AS override_reason
FROM m_keyed k LEFT JOIN (SELECT decision_id, arg_max(override_candidate, rank) AS override_candidate,
    arg_max(reason, rank) AS reason FROM ovr GROUP BY decision_id) o
  ON o.decision_id = k.decision_id""",
    "f_outcomes": """
SELECT decision_key, converted, would_buy_anyway,
  converted AND would_buy_anyway AND discount_bps > 0 AS is_wasted_discount,
  round(CASE WHEN converted THEN order_value_cents ELSE 0.0 END / 100.0::DOUBLE, 6) AS revenue_eur,
  round(CASE WHEN converted THEN order_value_cents * discount_bps / 10000.0::DOUBLE ELSE 0.0::DOUBLE END / 100.0::DOUBLE, 6) AS discount_cost_eur,
  round(profit_cents / 100.0::DOUBLE, 6) AS profit_eur,
  round(profit_none_cents / 100.0::DOUBLE, 6) AS profit_if_nothing_eur,
  round(expected_profit_cents / 100.0::DOUBLE, 6) AS expected_profit_eur,
  round(expected_profit_none_cents / 100.0::DOUBLE, 6) AS expected_profit_if_nothing_eur,
  round(regret_cents / 100.0::DOUBLE, 6) AS regret_eur, p_action - p_none AS true_uplift,
  p_action AS true_purchase_probability
FROM m_keyed""",
    "star": """
SELECT f.*, o.* EXCLUDE (decision_key), p.policy, p.policy_label, p.is_ml_policy, a.is_contact,
  a.is_restraint, a.is_discount, a.archetype
FROM f_decisions f JOIN f_outcomes o USING (decision_key) JOIN d_policy p USING (policy_key)
JOIN d_action a USING (action_key)""",
    # ------------------------------------------------------------ scored predictions
    "scored": f"""
SELECT 'table' AS family, CASE WHEN day < {SETTINGS.train_end_day} THEN 'train'
    WHEN day < {SETTINGS.validation_end_day} THEN 'validation' ELSE 'test' END AS split,
  customer_id, day, archetype, p_action AS p, converted AS y
FROM replay WHERE policy = 'random'""",
}


def compose(select: str) -> str:
    """`WITH` the needed expressions (in dependency order) before `select`."""
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        words = set(re.findall(r"[a-z_]+", re.sub(r"'(?:[^']|'')*'", "", text)))
        for name in CTES:
            if name in words and name != own and name not in needed and name not in busy:
                busy.add(name)
                visit(CTES[name], name)
                needed.append(name)

    busy: set[str] = set()
    visit(select)
    if not needed:
        return select
    parts = []
    for name in needed:
        hint = "" if name == "walk" else " MATERIALIZED"
        parts.append(f"{name} AS{hint} ({CTES[name].strip()})")
    body = select.strip()
    if body.upper().startswith("WITH "):  # the select brings expressions of its own
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
