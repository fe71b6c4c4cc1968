"""Business settings: the values every operator takes as parameters.

Everything here is a fixed value that decides results (catalog, thresholds, word lists).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

# --------------------------------------------------------------------------- fixed values
CONTRACT_VERSION = "1.0.0"
EVENT_ID_NAMESPACE = "7c1de923-3e3a-4b0a-9b3b-1f7b6d6a9b3e"
REJECT_ID_NAMESPACE = "b8f6a6a0-2e9f-4a7a-9b2d-6b7c0f9a3e11"
DECISION_ID_NAMESPACE = "6f1c2d4e-8a8b-4c51-9a8e-6e6578746d76"

EVENT_TYPES = (
    "session_start", "session_end", "product_view", "add_to_cart", "cart_remove",
    "cart_abandon", "order_placed", "campaign_exposure", "action_delivered", "override",
    "scroll", "filter_apply", "dwell",
)
SOURCES = ("simulator", "adapter")

# (archetype, description, contact, cost_cents, [(suffix, params), ...])
ACTION_CATALOG = (
    ("none", "Do nothing this cycle.", False, 0, [(None, {})]),
    ("wait", "Hold any contact and re-evaluate after the wait window.", False, 0,
     [(None, {"wait_hours": "24"})]),
    ("recommend", "Personalised product recommendation in the next session.", True, 5,
     [("top_seller", {"placement": "top_seller"}),
      ("affinity", {"placement": "affinity_category"})]),
    ("bundle", "Premium bundle offer by email, no price reduction.", True, 10,
     [(None, {"channel": "email"})]),
    ("discount_low", "Small discount code.", True, 10,
     [("500bps", {"discount_bps": "500"}), ("1000bps", {"discount_bps": "1000"})]),
    ("discount_high", "Large discount code.", True, 10,
     [("2000bps", {"discount_bps": "2000"}), ("3000bps", {"discount_bps": "3000"})]),
    ("email_now", "Content email sent immediately.", True, 5,
     [(None, {"channel": "email", "send_delay_hours": "0"})]),
    ("email_delayed", "Content email sent in the customer's usual engagement window.", True, 5,
     [(None, {"channel": "email", "send_delay_hours": "6"})]),
)

# (name, kind, mode, precedence, params)
CONSTRAINTS = (
    ("discount_ceiling", "discount_ceiling", "hard", "compliance", {"max_discount_bps": 2000}),
    ("margin_floor", "margin_floor", "hard", "compliance",
     {"min_margin_rate_after_discount": 0.20}),
    ("inventory_scarcity_gate", "inventory_scarcity", "hard", "inventory",
     {"archetypes": ("discount_low", "discount_high", "bundle")}),
    ("frequency_cap", "frequency_cap", "hard", "campaign",
     {"max_contacts": 2, "window_days": 7}),
    ("fatigue_penalty", "fatigue_penalty", "soft", "preference",
     {"penalty_cents_per_recent_contact": 15, "window_days": 14}),
)
PRECEDENCE = ("compliance", "inventory", "campaign", "preference")

POLICY_LABELS = {
    "do_nothing": "Do nothing",
    "always_discount": "Always discount",
    "top_seller": "Top-seller recommendation",
    "rules_only": "Rules-only playbook",
    "expected_value_logistic": "Decision engine (logistic)",
    "expected_value_gbm": "Decision engine (GBM)",
    "oracle_upper_bound": "Hindsight oracle (upper bound, not deployable)",
}

AUTONOMY = {
    "variant_assignment": "auto_apply",
    "ranking_weight_nudge": "auto_apply",
    "policy_promotion": "requires_human_signoff",
    "model_promotion": "requires_human_signoff",
    "segment_redefinition": "requires_human_signoff",
    "price_change": "human_only",
    "discount_ceiling_change": "human_only",
}

MCDA_CRITERIA = {  # criterion -> (weight, direction)
    "interpretability": (0.20, "benefit"),
    "silhouette": (0.30, "benefit"),
    "size_balance": (0.20, "benefit"),
    "stability": (0.30, "benefit"),
}

# outcome multipliers of the supplied probability table (fixture)
PROB_MULTIPLIER = {
    "recommend": 1.10, "bundle": 1.15, "discount_low": 1.20, "discount_high": 1.35,
    "email_now": 1.08, "email_delayed": 1.05,
}
# --------------------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class Settings:
    start_date: date = date(2024, 1, 1)
    horizon_days: int = 31
    train_end_day: int = 20
    validation_end_day: int = 23
    warmup_days: int = 14
    decision_days: tuple[int, ...] = tuple(range(23, 31))
    initial_stock: int = 250
    low_stock_threshold: int = 20
    max_reject_rate: float = 0.001
    max_discount_bps: int = 2000
    session_max_span_seconds: int = 86_400
    semantic_gates: tuple[str, ...] = (
        "non_negative_price", "monotonic_session_timestamps", "catalog_referential_integrity",
    )
    recency_cap_days: float = 365.0
    action_horizon_days: int = 7
    # policies
    top_seller_candidate: str = "recommend__top_seller"
    playbook_cart_units: int = 1
    playbook_price_sensitivity: float = 0.25
    playbook_discount_candidate: str = "discount_low__1000bps"
    playbook_engaged_sessions: int = 4
    playbook_engaged_candidate: str = "recommend__affinity"
    playbook_lapsed_days: int = 60
    playbook_lapsed_candidate: str = "email_delayed"
    risk_aversion: float = 1.0
    min_confidence: float = 0.5
    interval_quantiles: tuple[float, float] = (0.1, 0.9)
    attribution_top_k: int = 5
    # models
    ensemble_size: int = 8
    logistic_c: float = 0.1
    logistic_max_iter: int = 3000
    gbm_rounds: int = 250
    gbm_step: float = 0.05
    gbm_min_leaf_rows: int = 300
    gbm_row_share: float = 0.8
    gbm_feature_share: float = 0.8
    gbm_leaves: int = 15
    gbm_l2: float = 5.0
    reliability_bins: int = 10
    max_ece: float = 0.01
    # evaluation
    bootstrap_resamples: int = 1000
    ci_level: float = 0.95
    mde: float = 0.5
    indifference_margin: float = 0.25
    guardrails: tuple[tuple[str, float], ...] = (("conversion_rate", 0.002),)
    delay_budget_days: int = 28
    seeds: dict = field(default_factory=lambda: {
        "experiment": 7001, "outcomes": 7002, "bootstrap": 7003, "models": 7004,
        "segments": 7005})
    # segmentation
    segment_features: tuple[str, ...] = (
        "rfm_recency_days", "rfm_frequency_count", "rfm_monetary_cents",
        "session_visits_count", "price_sensitivity_proxy", "contacts_total",
    )
    kmeans_k: tuple[int, ...] = (3, 4, 5, 6)
    kmeans_starts: int = 10
    stability_resamples: int = 5
    interpretability: dict = field(default_factory=lambda: {"rfm_rules": 1.0, "kmeans": 0.5})
    min_segment_share: float = 0.05
    max_segments: int = 6
    fixture_splits: int = 8  # exchange width of the single-file test tables
    sensitivity_factor: float = 0.5
    lapsed_after_days: int = 60

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @property
    def experiment_days(self) -> tuple[int, ...]:
        return tuple(range(self.warmup_days, self.horizon_days))


SETTINGS = Settings()


def candidate_rows() -> list[dict]:
    """The action catalog as rows, in catalog order; id is `archetype__suffix`."""
    rows = []
    for archetype, description, contact, cost, variants in ACTION_CATALOG:
        for suffix, params in variants:
            rows.append({
                "catalog_order": len(rows),
                "candidate_id": archetype if suffix is None else f"{archetype}__{suffix}",
                "archetype": archetype,
                "description": description,
                "contact": contact,
                "cost_cents": cost,
                "discount_bps": int(params.get("discount_bps", 0)),
                "params": params,
            })
    return rows
