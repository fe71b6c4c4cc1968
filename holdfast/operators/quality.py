"""Contract validation, semantic gates and quarantine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.config import CONTRACT_VERSION, EVENT_TYPES, SETTINGS, SOURCES, Settings
from holdfast.functions.ids import canonical_json, reject_id
from holdfast.sources.tables import keep_first

# ------------------------------------------------------- fixed values: the payload contract
# field kinds: str = non-empty text; int>=0, int>0, pct = bounded integers; a tuple = choices
ITEM_FIELDS = {"sku": "str", "quantity": "int>0", "unit_price_cents": "int>=0",
               "discount_cents": "int>=0"}
PAYLOAD_FIELDS: dict[str, dict[str, object]] = {
    "session_start": {"device": ("desktop", "mobile", "tablet")},
    "session_end": {"duration_s": "int>=0"},
    "product_view": {"sku": "str", "category": "str", "unit_price_cents": "int>=0"},
    "add_to_cart": {"sku": "str", "quantity": "int>0", "unit_price_cents": "int>=0"},
    "cart_remove": {"sku": "str", "quantity": "int>0"},
    "cart_abandon": {"cart_value_cents": "int>=0"},
    "order_placed": {"order_id": "str", "line_items": "items", "order_total_cents": "int>=0"},
    "campaign_exposure": {"campaign_id": "str", "channel": "str"},
    "action_delivered": {"action_type": "str", "params": "map"},
    "override": {"decision_id": "str", "chosen_action_type": "str", "manager_note": "str"},
    "scroll": {"depth_pct": "pct"},
    "filter_apply": {"facet": "str", "value": "str"},
    "dwell": {"dwell_class": ("short", "medium", "long"), "sku": "str"},
}
PRICE_FIELDS = {"product_view": "unit_price_cents", "add_to_cart": "unit_price_cents",
                "cart_abandon": "cart_value_cents", "order_placed": "order_total_cents"}
SKU_TYPES = ("product_view", "add_to_cart", "cart_remove", "dwell")

MSG_REQUIRED = "Field required"
MSG_EXTRA = "Extra inputs are not permitted"
MSG_EMPTY = "String should have at least 1 character"
MSG_STRING = "Input should be a valid string"
MSG_INT = "Input should be a valid integer"
MSG_GE0 = "Input should be greater than or equal to 0"
MSG_GT0 = "Input should be greater than 0"
MSG_LE100 = "Input should be less than or equal to 100"
MSG_LIST = "List should have at least 1 item after validation, not 0"
MSG_MAP = "Input should be a valid dictionary"
MSG_DATETIME = "Input should be a valid datetime"
MSG_NAIVE = "Value error, ts must carry a UTC offset"
MSG_TAG = "Input tag does not match any of the expected tags"
MSG_MISMATCH = "Value error, payload.type does not match event type"
ZONE_SUFFIX = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
# --------------------------------------------------------------------- end of fixed values


def choice_message(choices: tuple[str, ...]) -> str:
    quoted = [f"'{c}'" for c in choices]
    return "Input should be " + ", ".join(quoted[:-1]) + " or " + quoted[-1]


def _error(bad: Column, path: Column | str, message: str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(bad, F.struct(path.alias("path"), F.lit(message).alias("message")))


def _int_checks(value: Column, present: Column, kind: str, path) -> list[Column]:
    checks = [_error(~present, path, MSG_REQUIRED),
              _error(present & value.isNull(), path, MSG_INT)]
    if kind == "int>0":
        checks.append(_error(value <= 0, path, MSG_GT0))
    else:
        checks.append(_error(value < 0, path, MSG_GE0))
    if kind == "pct":
        checks.append(_error(value > 100, path, MSG_LE100))
    return checks


def _text_checks(value: Column, present: Column, path) -> list[Column]:
    return [_error(~present, path, MSG_REQUIRED),
            _error(present & value.isNull(), path, MSG_STRING),
            _error(value == "", path, MSG_EMPTY)]


def _item_errors(items: Column, keys: Column) -> Column:
    """Errors of every line item, in item then field order."""

    def one(index: Column) -> Column:
        item = F.get(items, index)
        names = F.get(keys, index)
        at = lambda f: F.concat_ws(".", F.lit("payload.order_placed.line_items"),
                                   index.cast("string"), f)
        found: list[Column] = []
        for field, kind in ITEM_FIELDS.items():
            present = F.coalesce(F.array_contains(names, field), F.lit(False))
            check = _text_checks if kind == "str" else (
                lambda v, p, path, k=kind: _int_checks(v, p, k, path))
            found += check(item[field], present, at(F.lit(field)))
        extra = F.array_except(names, F.array(*[F.lit(f) for f in ITEM_FIELDS]))
        return F.concat(F.array(*found), F.transform(
            extra, lambda x: F.struct(at(x).alias("path"), F.lit(MSG_EXTRA).alias("message"))))

    span = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.flatten(F.transform(span, one))


def _payload_errors(kind: str, fields: dict[str, object]) -> Column:
    p, keys = F.col("p"), F.col("_keys")
    found: list[Column] = []
    tail: list[Column] = []
    for field, rule in fields.items():
        path = f"payload.{kind}.{field}"
        present = F.array_contains(keys, field)
        if rule == "items":
            found += [_error(~present, path, MSG_REQUIRED),
                      _error(present & (F.coalesce(F.size(p[field]), F.lit(0)) < 1), path,
                             MSG_LIST)]
            item_keys = F.transform(
                F.from_json(F.get_json_object("payload", "$.line_items"),
                            "array<map<string,string>>"), lambda x: F.map_keys(x))
            tail.append(_item_errors(p[field], item_keys))
        elif rule == "map":
            found += [_error(~present, path, MSG_REQUIRED),
                      _error(present & p[field].isNull(), path, MSG_MAP)]
        elif isinstance(rule, tuple):
            found += [_error(~present, path, MSG_REQUIRED),
                      _error(present & ~F.coalesce(p[field].isin(*rule), F.lit(False)), path,
                             choice_message(rule))]
        elif rule == "str":
            found += _text_checks(p[field], present, path)
        else:
            found += _int_checks(p[field], present, str(rule), path)
    extra = F.transform(
        F.array_except(keys, F.array(*[F.lit(f) for f in ("type", *fields)])),
        lambda x: F.struct(F.concat(F.lit(f"payload.{kind}."), x).alias("path"),
                           F.lit(MSG_EXTRA).alias("message")))
    return F.concat(F.array(*found), *tail, extra)


def _field_sound(value: Column, rule: object) -> Column:
    if rule == "items":
        one = lambda x: F.coalesce(
            (x["sku"] != "") & (x["quantity"] > 0) & (x["unit_price_cents"] >= 0)
            & (x["discount_cents"] >= 0), F.lit(False))
        named = F.from_json(F.get_json_object("payload", "$.line_items"),
                            "array<map<string,string>>")
        return (F.size(value) > 0) & F.forall(value, one) & F.forall(
            named, lambda x: F.size(x) == len(ITEM_FIELDS))
    if rule == "map":
        return value.isNotNull()
    if isinstance(rule, tuple):
        return value.isin(*rule)
    return {"str": value != "", "int>=0": value >= 0, "int>0": value > 0,
            "pct": value.between(0, 100)}[str(rule)]


def _sound() -> Column:
    """True only for rows without any error: one test per field and a count of keys, so that the
    error texts are worked out for the other rows alone."""
    p = F.col("p")
    body = F.lit(False)
    for kind, fields in PAYLOAD_FIELDS.items():
        test = F.size("_keys") == len(fields) + 1
        for name, rule in fields.items():
            test &= _field_sound(p[name], rule)
        body = F.when(p["type"] == kind, test).otherwise(body)
    ids = (F.col("event_id") != "") & (F.col("customer_id") != "") & (F.col("session_id") != "")
    return F.coalesce(ids & F.col("ts_utc").isNotNull() & F.col("source").isin(*SOURCES) & (
        F.col("type") == p["type"]) & body, F.lit(False))


def decode(events: DataFrame) -> DataFrame:
    """Add `p`, the payload parsed once into the union struct."""
    return events.withColumn("p", F.from_json("payload", schemas.PAYLOAD))


def parse_instant(ts: Column) -> Column:
    """UTC instant of ISO text that carries a zone; null for naive or unreadable text."""
    return F.when(ts.rlike(ZONE_SUFFIX), F.try_to_timestamp(ts))


def check_contract(raw: DataFrame) -> DataFrame:
    """Add `ts_utc`, `p` and `errors`: every broken field of the envelope and the payload.

    One narrow projection: no shuffle, no Python. An integer must be a JSON integer; text
    such as "1999" is not one.
    """
    df = decode(raw).withColumn("_keys", F.coalesce(
        F.json_object_keys("payload"), F.array().cast("array<string>")))
    # each text is parsed once; the checks below read the parsed columns
    df = df.withColumn("_instant", F.try_to_timestamp("ts")).withColumn(
        "_zoned", F.col("ts").rlike(ZONE_SUFFIX)).withColumn(
        "ts_utc", F.when(F.col("_zoned"), F.col("_instant")))
    p_type = F.col("p.type")
    known = p_type.isin(*EVENT_TYPES)
    envelope = [
        _error(F.coalesce(F.col(c), F.lit("")) == "", c, MSG_EMPTY)
        for c in ("event_id", "customer_id", "session_id")
    ] + [
        _error(~F.col("_zoned") & F.col("_instant").isNotNull(), "ts", MSG_NAIVE),
        _error(F.col("_instant").isNull(), "ts", MSG_DATETIME),
        _error(~F.coalesce(F.col("type").isin(*EVENT_TYPES), F.lit(False)), "type",
               choice_message(EVENT_TYPES)),
        _error(~F.coalesce(known, F.lit(False)), "payload", MSG_TAG),
    ]
    empty = F.array().cast("array<struct<path:string,message:string>>")
    body = empty
    for kind, fields in PAYLOAD_FIELDS.items():
        body = F.when(p_type == kind, _payload_errors(kind, fields)).otherwise(body)
    source = [_error(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "source",
                     choice_message(SOURCES))]
    listed = F.filter(F.concat(F.array(*envelope), body, F.array(*source)),
                      lambda e: e.isNotNull())
    df = df.withColumn("_sound", _sound()).withColumn(
        "errors", F.when(F.col("_sound"), empty).otherwise(listed))
    # the cross-field check runs only on rows whose fields are all sound
    root = F.array(F.struct(F.lit("<root>").alias("path"), F.lit(MSG_MISMATCH).alias("message")))
    return df.withColumn("errors", F.when(
        ~F.col("_sound") & (F.size("errors") == 0) & (F.col("type") != p_type), root).otherwise(
        F.col("errors"))).drop("_keys", "_instant", "_zoned", "_sound")


def reason(errors: Column) -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat_ws(
        ": ", e["path"], e["message"])), "; ")


def first_path(errors: Column) -> Column:
    return F.nullif(F.element_at(errors, 1)["path"], F.lit("<root>"))


def _raw_json(ts: str) -> Column:
    return canonical_json(event_id=F.col("event_id"), customer_id=F.col("customer_id"),
                          session_id=F.col("session_id"), ts=F.col(ts).cast("string"),
                          type=F.col("type"), payload=F.col("payload"), source=F.col("source"))


def _reject_rows(df: DataFrame, stage: str, why: Column, path: Column, ts: str) -> DataFrame:
    staged = df.select(_raw_json(ts).alias("raw_record"), why.alias("reason"),
                       path.cast("string").alias("field_path"), "event_id", "source")
    return staged.select(
        reject_id(F.col("raw_record"), F.col("reason"), F.lit(stage)).alias("reject_id"),
        "raw_record", "reason", "field_path", F.lit(CONTRACT_VERSION).alias("contract_version"),
        F.lit(stage).alias("stage"), "source", "event_id")


def contract_rejects(checked: DataFrame) -> DataFrame:
    return _reject_rows(checked.where(F.size("errors") > 0), "contract",
                        reason(F.col("errors")), first_path(F.col("errors")), "ts")


def contract_survivors(checked: DataFrame) -> DataFrame:
    """Rows in canonical form: typed instant, payload text, parsed payload `p`."""
    return checked.where(F.size("errors") == 0).select(
        "event_id", "customer_id", "session_id", F.col("ts_utc").alias("ts"), "type", "payload",
        "source", "p")


# ------------------------------------------------------------------------------------- gates
def price_violations(events: DataFrame) -> DataFrame:
    """(event_id, detail): every cents field below zero, line items included. Narrow."""
    p = F.col("p")
    single = None
    for kind, field in PRICE_FIELDS.items():
        named = F.struct(F.lit(field).alias("path"), p[field].alias("value"))
        single = F.when(F.col("type") == kind, named) if single is None else single.when(
            F.col("type") == kind, named)
    items = F.flatten(F.transform(p["line_items"], lambda x, i: F.array(*[
        F.struct(F.concat(F.lit("line_items["), i.cast("string"), F.lit(f"].{f}")).alias("path"),
                 x[f].alias("value")) for f in ("unit_price_cents", "discount_cents")])))
    none = F.array().cast("array<struct<path:string,value:bigint>>")
    fields = F.concat(F.array(single), F.when(
        F.col("type") == "order_placed", F.coalesce(items, none)).otherwise(none))
    below = F.filter(fields, lambda f: f["value"] < 0)
    text = F.array_join(F.transform(below, lambda f: F.concat_ws(
        "=", f["path"], f["value"].cast("string"))), "; ")
    return events.select("event_id", text.alias("detail")).where(F.col("detail") != "")


def sku_references(events: DataFrame) -> DataFrame:
    """One row per referenced sku: (event_id, position, path, sku)."""
    p = F.col("p")
    own = F.array(F.struct(F.lit(0).alias("position"), F.lit("sku").alias("path"),
                           p["sku"].alias("sku")))
    items = F.transform(p["line_items"], lambda x, i: F.struct(
        i.alias("position"),
        F.concat(F.lit("line_items["), i.cast("string"), F.lit("].sku")).alias("path"),
        x["sku"].alias("sku")))
    refs = F.when(F.col("type").isin(*SKU_TYPES), own).when(
        F.col("type") == "order_placed", items)
    return events.select("event_id", F.inline(refs))


def catalog_violations(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """(event_id, detail): every referenced sku the catalog lacks.

    Misses are found by an anti join (Spark broadcasts the catalog when its size allows, and
    splits hot skus otherwise); only the misses, not the events, are regrouped by event.
    """
    missing = sku_references(events).join(catalog.select("sku"), "sku", "left_anti")
    one = F.struct("position", F.concat(
        "path", F.lit("='"), "sku", F.lit("' not present in catalog")).alias("text"))
    # an event sent twice lists each of its misses once
    return missing.groupBy("event_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda m: m["text"]), "; ")
        .alias("detail"))


def session_tie_groups(events: DataFrame) -> DataFrame:
    """(session_id, ts) shared by several rows: distinct ids, rows and the id that stays."""
    ids = events.groupBy("session_id", "ts", "event_id").agg(F.count(F.lit(1)).alias("copies"))
    return ids.groupBy("session_id", "ts").agg(
        F.min("event_id").alias("first_id"), F.sum("copies").alias("n_rows"),
        F.min_by("copies", "event_id").alias("first_copies"),
    ).where("n_rows > 1")


def tie_violations(events: DataFrame) -> DataFrame:
    """(event_id, detail): later rows of a (session, ts) tie, smallest event id first.

    Group sizes come from two-step counts that combine on the map side, so no task ever sorts
    a hot session; the join back is a plain equi join that AQE may split.
    """
    ties = session_tie_groups(events)
    hit = events.select("session_id", "ts", "event_id").join(ties, ["session_id", "ts"]).where(
        (F.col("event_id") != F.col("first_id")) | (F.col("first_copies") > 1))
    when = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    text = F.concat(F.lit("session '"), "session_id",
                    F.lit("' timestamp does not strictly increase within the batch (previous="),
                    when, F.lit(", this="), when, F.lit(")"))
    return hit.groupBy("event_id").agg(F.min(text).alias("detail"))


def late_violations(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Across batches: every row at or before the session's stored last instant.

    `last_seen` is `(session_id, last_ts)`. All such rows are rejected, not only the first of
    the session in the batch.
    """
    hit = events.select("session_id", "ts", "event_id").join(last_seen, "session_id").where(
        F.col("ts") <= F.col("last_ts"))
    text = F.concat(F.lit("session '"), "session_id", F.lit("' timestamp "),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                    F.lit(" does not strictly advance past "),
                    F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return hit.groupBy("event_id").agg(F.min(text).alias("detail"))


def advance_last_seen(last_seen: DataFrame, events: DataFrame, span_seconds: int) -> DataFrame:
    """Next `(session_id, last_ts)`: maxima kept, sessions older than the batch start minus
    the span dropped."""
    floor = events.agg((F.min("ts") - F.make_interval(secs=F.lit(span_seconds))).alias("floor"))
    merged = last_seen.unionByName(events.select("session_id", F.col("ts").alias("last_ts")))
    maxima = merged.groupBy("session_id").agg(F.max("last_ts").alias("last_ts"))
    return maxima.join(F.broadcast(floor), F.col("last_ts") >= F.col("floor")).drop("floor")


@dataclass(frozen=True)
class GateInputs:
    catalog: DataFrame
    last_seen: DataFrame | None = None


Gate = Callable[[DataFrame, GateInputs], DataFrame]
GATES: dict[str, Gate] = {}


def register_gate(name: str) -> Callable[[Gate], Gate]:
    def add(fn: Gate) -> Gate:
        if name in GATES:
            raise ValueError(f"gate {name!r} is already registered")
        GATES[name] = fn
        return fn

    return add


@register_gate("non_negative_price")
def _gate_price(events: DataFrame, _inputs: GateInputs) -> DataFrame:
    return price_violations(events).groupBy("event_id").agg(F.min("detail").alias("detail"))


@register_gate("monotonic_session_timestamps")
def _gate_order(events: DataFrame, inputs: GateInputs) -> DataFrame:
    found = tie_violations(events)
    if inputs.last_seen is not None:
        late = late_violations(events, inputs.last_seen)
        found = found.unionByName(late).groupBy("event_id").agg(F.min("detail").alias("detail"))
    return found


@register_gate("catalog_referential_integrity")
def _gate_catalog(events: DataFrame, inputs: GateInputs) -> DataFrame:
    return catalog_violations(events, inputs.catalog)


def gate_violations(events: DataFrame, inputs: GateInputs,
                    settings: Settings = SETTINGS) -> DataFrame:
    """All gates, in configured order: (event_id, gate_order, gate, detail)."""
    out = None
    for order, name in enumerate(settings.semantic_gates):
        if name not in GATES:
            raise KeyError(f"gate {name!r} has no implementation; available: {sorted(GATES)}")
        part = GATES[name](events, inputs).select(
            "event_id", F.lit(order).alias("gate_order"), F.lit(name).alias("gate"), "detail")
        out = part if out is None else out.unionByName(part)
    return out


def decisive_gate(violations: DataFrame) -> DataFrame:
    """One row per violating event: the first gate in order."""
    return violations.groupBy("event_id").agg(
        F.min(F.struct("gate_order", "gate", "detail")).alias("g")
    ).select("event_id", "g.gate", "g.detail")


def gate_rejects(events: DataFrame, decisive: DataFrame) -> DataFrame:
    rows = events.join(decisive, "event_id")
    why = F.concat(F.lit("semantic gate '"), "gate", F.lit("' failed: "), "detail")
    return keep_first(_reject_rows(rows, "semantic", why, F.lit(None), "ts"), ["event_id"],
                      ["raw_record"])


EVENT_COLUMNS = ("event_id", "customer_id", "session_id", "ts", "type", "payload", "source")


def landed_events(events: DataFrame, decisive: DataFrame,
                  existing: DataFrame | None = None) -> DataFrame:
    """Survivors, one row per event id, merged into what is already there."""
    rows = events.select(*EVENT_COLUMNS).join(decisive, "event_id", "left_anti")
    if existing is not None:
        rows = rows.unionByName(existing.select(*EVENT_COLUMNS))
    # only ids move to find those met twice; whole rows move for these alone
    twice = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "event_id")
    once = rows.join(twice, "event_id", "left_anti").select(*EVENT_COLUMNS)
    return once.unionByName(keep_first(rows.join(twice, "event_id", "left_semi").select(
        *EVENT_COLUMNS), ["event_id"], ["customer_id", "ts", "event_id"]))


class RejectRateExceeded(RuntimeError):
    pass


def require_reject_rate(summary: DataFrame, settings: Settings = SETTINGS) -> None:
    """Fail the run when the reject rate passes the ceiling; the ceiling itself passes."""
    row = summary.select("reject_rate", "rows_rejected_contract", "rows_rejected_semantic").first()
    if row.reject_rate > settings.max_reject_rate:
        raise RejectRateExceeded(
            f"reject rate {row.reject_rate:.6f} exceeds {settings.max_reject_rate:.6f} "
            f"(contract={row.rows_rejected_contract}, semantic={row.rows_rejected_semantic})")
