"""Hard and soft rules over candidate arrays.

A rule kind builds columns for one candidate struct `c`; it may read any context column. The
whole rule set is one narrow projection per context row: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import CONSTRAINTS, PRECEDENCE, SETTINGS


@dataclass(frozen=True)
class Verdict:
    violated: Column
    detail: Column
    penalty_cents: Column | None = None


Kind = Callable[[Column, dict], Verdict]
_KINDS: dict[str, Kind] = {}


def register_rule(kind: str) -> Callable[[Kind], Kind]:
    def add(fn: Kind) -> Kind:
        if kind in _KINDS:
            raise ValueError(f"constraint kind {kind!r} is already registered")
        _KINDS[kind] = fn
        return fn

    return add


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _percent(value: Column) -> Column:
    return F.concat(F.bround(value * 100, 0).cast("long").cast("string"), F.lit("%"))


@register_rule("discount_ceiling")
def discount_ceiling(c: Column, params: dict) -> Verdict:
    ceiling = int(params["max_discount_bps"])
    return Verdict(c["discount_bps"] > ceiling,
                   _text(c["discount_bps"], f" bps exceeds the {ceiling} bps ceiling"))


@register_rule("margin_floor")
def margin_floor(c: Column, params: dict) -> Verdict:
    floor = float(params["min_margin_rate_after_discount"])
    left = F.col("margin_rate") - c["discount_bps"] / F.lit(10_000.0)
    return Verdict((c["discount_bps"] > 0) & (left < floor - 1e-12),
                   _text("margin after discount ", _percent(left), " is below the ",
                         f"{floor:.0%}", " floor"))


@register_rule("inventory_scarcity")
def inventory_scarcity(c: Column, params: dict) -> Verdict:
    return Verdict(c["archetype"].isin(*params["archetypes"]) & F.col("low_stock"),
                   _text("stock for ", F.col("primary_category"), " is ", F.col("stock_units"),
                         f" units, at or below the {SETTINGS.low_stock_threshold}-unit"
                         " threshold"))


def _recent(window_days: int) -> Column:
    return F.col(f"contacts_{window_days}d")


def contact_windows(specs: Sequence[tuple] = CONSTRAINTS) -> tuple[int, ...]:
    """Window lengths in days that the rules count contacts over; 7 and 14 are always kept, as
    features and reports read them."""
    asked = {int(s[4]["window_days"]) for s in specs if "window_days" in s[4]}
    return tuple(sorted(asked | {7, 14}))


@register_rule("frequency_cap")
def frequency_cap(c: Column, params: dict) -> Verdict:
    cap, window = int(params["max_contacts"]), int(params["window_days"])
    recent = _recent(window)
    return Verdict(c["contact"] & (recent >= cap),
                   _text(recent, f" contacts in the last {window} days (cap {cap})"))


@register_rule("fatigue_penalty")
def fatigue_penalty(c: Column, params: dict) -> Verdict:
    window = int(params["window_days"])
    recent = _recent(window)
    cents = recent.cast("double") * F.lit(float(params["penalty_cents_per_recent_contact"]))
    return Verdict(c["contact"] & (recent > 0),
                   _text(recent, f" contacts in the last {window} days"), cents)


@register_rule("quiet_after_purchase")
def quiet_after_purchase(c: Column, params: dict) -> Verdict:
    """Example extension: no contact for some days after an order; never ordered passes."""
    days = int(params["days"])
    recency = F.col("rfm_recency_days")
    return Verdict(c["contact"] & F.coalesce(recency < days, F.lit(False)),
                   _text("bought ", recency, f" days ago (quiet for {days})"))


def ordered(specs: Sequence[tuple] = CONSTRAINTS) -> list[tuple]:
    """Rules by precedence class, stable inside a class."""
    for name, kind, _mode, _precedence, _params in specs:
        if kind not in _KINDS:
            raise KeyError(f"constraint {name!r} names unregistered kind {kind!r}; "
                           f"registered: {sorted(_KINDS)}")
    return sorted(specs, key=lambda s: PRECEDENCE.index(s[3]))


def rule_names(specs: Sequence[tuple] = CONSTRAINTS) -> list[str]:
    return [s[0] for s in ordered(specs)]


def judge(c: Column, specs: Sequence[tuple] = CONSTRAINTS) -> Column:
    """Candidate `c` with `rule`, `detail` of its decisive exclusion and its soft penalty."""
    rule, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    penalty = F.lit(0.0)
    soft: list[Column] = []
    for name, kind, mode, _precedence, params in reversed(ordered(specs)):
        v = _KINDS[kind](c, params)
        if mode == "hard":
            rule = F.when(v.violated, F.lit(name)).otherwise(rule)
            detail = F.when(v.violated, v.detail).otherwise(detail)
        else:
            cents = F.when(v.violated, v.penalty_cents).otherwise(F.lit(0.0))
            penalty = penalty + cents
            soft.insert(0, F.when(cents > 0, F.lit(name)))
    applied = F.filter(F.array(*soft).cast("array<string>"), lambda x: x.isNotNull())
    return F.struct(
        *[c[f].alias(f) for f in ("catalog_order", "candidate_id", "archetype", "contact",
                                  "cost_cents", "discount_bps", "params")],
        rule.alias("rule"), detail.alias("detail"), penalty.alias("penalty_cents"),
        applied.alias("penalty_rules"))


def apply_rules(contexts: DataFrame, specs: Sequence[tuple] = CONSTRAINTS) -> DataFrame:
    """Judge every candidate; add `survivors`, counts and the rules that fired.

    A fired rule excluded some candidate as the decisive one, or penalised any candidate,
    including one that another rule excluded.
    """
    judged = contexts.withColumn("candidates", F.transform(
        "candidates", lambda c: judge(c, specs)))
    names = F.array(*[F.lit(n) for n in rule_names(specs)])
    hit = F.array_union(
        F.transform("candidates", lambda c: c["rule"]),
        F.flatten(F.transform("candidates", lambda c: c["penalty_rules"])))
    survivors = F.filter("candidates", lambda c: c["rule"].isNull())
    return judged.withColumn("survivors", survivors).withColumn(
        "n_survivors", F.size("survivors").cast("long")).withColumn(
        "n_filtered", (F.size("candidates") - F.size("survivors")).cast("long")).withColumn(
        "fired_rules", F.array_join(F.array_intersect(names, hit), ","))


def options_view(judged: DataFrame) -> DataFrame:
    """One row per (context, candidate): allowed or not, and by which rule."""
    return judged.select("customer_id", "day", F.inline("candidates")).select(
        "customer_id", "day", "catalog_order", "candidate_id", "archetype", "discount_bps",
        "contact", F.col("rule").isNull().alias("allowed"), "rule", "detail", "penalty_cents")
