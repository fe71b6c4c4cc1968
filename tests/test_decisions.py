import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.config import CONSTRAINTS, SETTINGS, candidate_rows
from holdfast.operators import candidates as ac
from holdfast.operators import explain as ex
from holdfast.operators import policies as po
from holdfast.operators import rules as ru
from holdfast.operators import trace as tr

FIELDS = ("customer_id string, day long, primary_category string, rfm_recency_days long,"
          "session_visits_count long, price_sensitivity_proxy double, cart_state_units long,"
          "contacts_7d long, contacts_14d long, contacts_total long, stock_units long,"
          "low_stock boolean, margin_rate double, order_value_cents long")


def context(cid, stock=100, ago=(), cart=0, margin=0.45):
    return (cid, 60, "fashion_apparel", 20, 3, 0.3, cart, sum(d < 7 for d in ago),
            sum(d < 14 for d in ago), len(ago), stock, stock <= 20, margin, 3049)


GOLDEN = [context(str(i), s, ago, cart) for i, (s, ago, cart) in enumerate(
    [(150, (), 0), (150, (3,), 2), (4, (), 2), (150, (0, 1), 0), (60, (9,), 1)])]

# fixed values: the stub model of the golden cases (logit per archetype, shifts per member)
BASE = {"none": -3.2, "wait": -3.2, "recommend": -3.0, "bundle": -3.1, "discount_low": -3.05,
        "discount_high": -2.9, "email_now": -3.15, "email_delayed": -3.18}
SHIFTS = (-0.05, 0.0, 0.05, 0.1)


def judged(spark, rows):
    return ru.apply_rules(ac.with_candidates(spark.createDataFrame(rows, FIELDS)))


def stub_members(df):
    pairs = []
    for archetype, bps in po.active_arms(candidate_rows()):
        logit = (F.lit(BASE[archetype]) + 0.01 * F.col("price_sensitivity_proxy")
                 - 0.02 * F.col("contacts_total") + 2.0 * bps / 10_000)
        pairs += [F.lit(f"{archetype}:{bps}"),
                  F.array(*[F.round(1 / (1 + F.exp(-(logit + s))), 9) for s in SHIFTS])]
    return df.withColumn("members", F.create_map(*pairs))


def stub_decisions(spark):
    chosen = po.choose(po.expected_value_scores(
        stub_members(judged(spark, GOLDEN)), "members", 4), 0.5)
    target = F.when(F.col("best.archetype").isin("none", "wait"), F.col("alternative.archetype")
                    ).otherwise(F.col("best.archetype"))
    base = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])
    shown = F.array(*[F.struct(f.alias("feature"), F.round(w, 6).alias("weight")) for f, w in (
        (F.lit("price_sensitivity_proxy"), 0.01 * F.col("price_sensitivity_proxy")),
        (F.lit("contacts_total"), -0.02 * F.col("contacts_total")),
        (F.concat(F.lit("action:"), target), base[target] - BASE["none"]))])
    from holdfast.operators.response import top_attributions
    return chosen.withColumn("attributions", F.when(
        target.isNotNull(), top_attributions(shown, 3)))


def test_golden_expected_value(spark):
    rows = {r.customer_id: r for r in ex.explain(stub_decisions(spark)).collect()}
    want = ["recommend__top_seller", "none", "recommend__top_seller", "none", "none"]
    assert [rows[str(i)].chosen_id for i in range(5)] == want
    assert rows["0"].best.uplift == pytest.approx(0.00848372, abs=5e-9)
    assert rows["0"].best.uplift_low == pytest.approx(0.00802348, abs=5e-9)
    assert rows["0"].best.uplift_high == pytest.approx(0.00895028, abs=5e-9)
    assert rows["0"].best.expected_profit_cents == pytest.approx(6.6401, abs=5e-5)
    assert all(rows[str(i)].best.win_rate == 1.0 for i in range(5))
    runners = [rows[str(i)].runner.candidate_id for i in range(5)]
    assert runners == ["recommend__affinity", "wait", "recommend__affinity", "wait", "wait"]
    assert rows["0"].reasoning == (
        "Recommendation: Personalised product recommendation in the next session. It is expected "
        "to change their purchase chance by +0.8 percentage points (plausible range +0.8 to +0.9)"
        ", worth €+0.07 in expected profit after costs. Main factors in favour of this action: "
        "their history of buying on discount. Options ruled out by business rules: the maximum "
        "discount allowed (1 option). Confidence: 100% of model resamples rank this option first.")
    assert rows["1"].reasoning == (
        "Recommendation: Do nothing this cycle. No action is expected to add profit for this "
        "customer right now: the best alternative, personalised product recommendation in the "
        "next session, would change their purchase chance by +0.8 percentage points and expected "
        "profit by €+0.06 after costs. Main factors in favour of the alternative: their history "
        "of buying on discount; against it: how many messages they have received overall. Options "
        "ruled out by business rules: the maximum discount allowed (1 option). Confidence: 100% of "
        "model resamples rank this option first.")
    assert rows["3"].reasoning == (
        "Recommendation: Do nothing this cycle. Every option that would contact this customer is "
        "ruled out by business rules right now, so holding back is the only choice. Options ruled "
        "out by business rules: the maximum discount allowed (1 option) and the weekly contact "
        "limit (8 options). Confidence: 100% of model resamples rank this option first.")


def test_golden_playbook(spark):
    rows = {r.customer_id: r for r in ex.explain(po.choose(po.baseline(
        judged(spark, GOLDEN), "rules_only"))).collect()}
    want = ["none", "discount_low__1000bps", "none", "none", "discount_low__1000bps"]
    assert [rows[str(i)].chosen_id for i in range(5)] == want
    assert [rows[str(i)].score_gap for i in range(5)] == [1.0] * 5
    assert rows["1"].fired_rules == "discount_ceiling,fatigue_penalty"
    assert rows["3"].fired_rules == "discount_ceiling,frequency_cap,fatigue_penalty"
    assert rows["1"].reasoning == (
        "Recommendation: Small discount code (10% off). This follows a fixed rule (playbook: items "
        "in cart and buys on discount). Options ruled out by business rules: the maximum discount "
        "allowed (1 option). Scores were reduced for the cost of messaging a recently contacted "
        "customer. No confidence score: this policy uses fixed rules, not a model.")
    assert "not allowed now, so doing nothing" in rows["2"].reasoning


def test_records_hold_invariants(spark):
    records = tr.decision_records(ex.explain(stub_decisions(spark)), "ev_stub", "golden-config",
                                  "response_model=stub-1")
    assert tr.invariant_violations(records).count() == 0
    assert tr.invariant_counts(records).first().violations == 0
    broken = records.withColumn("confidence", F.lit(1.5))
    assert {r.invariant for r in tr.invariant_violations(broken).collect()} == {
        "confidence outside [0, 1]"}


def test_ten_thousand_random_contexts(spark):
    """An independent plain-Python reading of the rules agrees on every candidate."""
    rng = random.Random(11)
    rows, facts = [], {}
    for i in range(10_000):
        ago = [rng.randrange(61) for _ in range(rng.randrange(7))]
        row = context(str(i), rng.randrange(301), ago, margin=round(rng.uniform(0.05, 0.9), 4))
        rows.append(row)
        facts[str(i)] = row
    got = ru.options_view(judged(spark, rows)).select(
        "customer_id", "candidate_id", "rule", "penalty_cents").collect()
    cat = {r["candidate_id"]: r for r in candidate_rows()}
    assert len(got) == 110_000
    for r in got:
        f, c = facts[r.customer_id], cat[r.candidate_id]
        bps = c["discount_bps"]
        if bps > 2000:
            want = "discount_ceiling"
        elif bps > 0 and f[12] - bps / 10_000 < 0.20 - 1e-12:
            want = "margin_floor"
        elif c["archetype"] in ("discount_low", "discount_high", "bundle") and f[10] <= 20:
            want = "inventory_scarcity_gate"
        elif c["contact"] and f[7] >= 2:
            want = "frequency_cap"
        else:
            want = None
        assert r.rule == want
        assert r.penalty_cents == (15.0 * f[8] if c["contact"] else 0.0)


def test_no_survivor_goes_to_review(spark):
    none = judged(spark, GOLDEN).withColumn("survivors", F.filter(
        "survivors", lambda c: F.lit(False)))
    rows = ex.explain(po.choose(po.baseline(none, "do_nothing"))).collect()
    assert all(r.needs_human_review and r.chosen_id == "none" for r in rows)
    assert rows[0].reasoning.startswith("Every available option, including doing nothing")


def test_low_confidence_falls_back(spark):
    scored = po.expected_value_scores(stub_members(judged(spark, GOLDEN[:1])), "members", 4)
    r = po.choose(scored, 1.1).first()
    assert r.fallback and r.chosen_id == "none"


def test_registries_refuse_duplicates_and_unknown_kinds():
    with pytest.raises(ValueError):
        ru.register_rule("margin_floor")(None)
    with pytest.raises(ValueError):
        ac.register_provider("catalog")(None)
    with pytest.raises(KeyError):
        ru.ordered([*CONSTRAINTS, ("x", "nope", "hard", "campaign", {})])


def test_quantile_is_linear(spark):
    values = [0.3, -1.0, 2.0, 0.7, 5.0]
    got = spark.range(1).select(po._quantile(F.array(*[F.lit(v) for v in values]), 0.1, 5)).first()[0]
    s = sorted(values)
    assert math.isclose(got, s[0] + 0.4 * (s[1] - s[0]))
    assert SETTINGS.interval_quantiles == (0.1, 0.9)


def test_contact_rules_of_any_window(spark, ws):
    """A cap over ten days and a penalty over three, against counts from the raw exposures."""
    from holdfast.config import SETTINGS
    from holdfast.functions.numbers import day_index
    from holdfast.operators import context as cx
    from holdfast.operators import rules as ru
    from holdfast.plans import replay as rp

    specs = (("cap", "frequency_cap", "hard", "campaign", {"max_contacts": 1, "window_days": 10}),
             ("tired", "fatigue_penalty", "soft", "preference",
              {"penalty_cents_per_recent_contact": 5, "window_days": 3}))
    assert ru.contact_windows(specs) == (3, 7, 10, 14)
    ctx = cx.contexts(ws.grid, ws.events, ws.catalog, ws.inventory, SETTINGS.decision_days[:3],
                      windows=ru.contact_windows(specs)).cache()
    sent = ws.events.where("type = 'campaign_exposure'").select("customer_id", day_index(
        F.col("ts"), SETTINGS.start_date).alias("sent"))
    gap = F.col("day") - F.col("sent")
    want = ctx.select("customer_id", "day").join(sent, "customer_id", "left").groupBy(
        "customer_id", "day").agg(*[F.count_if(gap.between(1, w)).alias(f"want_{w}")
                                    for w in (3, 10)])
    both = ctx.join(want, ["customer_id", "day"])
    assert both.where("contacts_3d <> want_3 OR contacts_10d <> want_10").count() == 0
    assert both.where("contacts_10d > contacts_7d").count() > 0
    log = rp.replay(ws.with_probabilities(ctx), ["always_discount"], specs=specs)
    again = F.lag("day").over(Window.partitionBy("customer_id").orderBy("day"))
    made = log.where("contact").withColumn("before", again)
    assert made.count() > 0 and made.where("day - before <= 10").count() == 0


def _hash_joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line]


def test_options_are_never_broadcast(spark):
    """Exploded options pass for small; only the requests may be the hashed side."""
    from holdfast.operators import overrides as ov

    made = spark.range(100).select(F.concat(F.lit("d"), "id").alias("decision_id"), F.col("id").cast(
        "string").alias("customer_id"), F.lit(1).cast("long").alias("day"))
    options = made.select("customer_id", "day", F.explode(F.array(F.lit("a"), F.lit("b"))).alias(
        "candidate_id"), F.lit(True).alias("allowed"), F.lit("r").alias("rule"),
        F.lit("").alias("detail"))
    requests = made.withColumn("override_candidate", F.when(
        F.col("customer_id") < "5", F.lit("a")).otherwise(F.lit("b")))
    out = ov.admit(requests, made.withColumn("chosen_id", F.lit("a")), options)
    joins = _hash_joins(out)
    assert len(joins) == 2 and all("ShuffledHashJoin" in j and "BuildLeft" in j for j in joins)
    assert out.where("admitted").count() == requests.where("override_candidate = 'b'").count() > 0
    assert out.count() == 100


def test_prices_of_overrides_are_never_broadcast(spark):
    """Exploded probabilities pass for small; only the overrides may be the hashed side."""
    from holdfast.operators import overrides as ov

    keys = spark.range(100).select(F.col("id").cast("string").alias("customer_id"),
                                   F.lit(1).cast("long").alias("day"))
    asked = keys.select(F.concat_ws("#", "customer_id").alias("override_id"), "customer_id", "day",
                        F.lit("none").alias("original_candidate"),
                        F.lit("email_delayed").alias("override_candidate"))
    contexts = keys.where("customer_id <> '7'").select(
        "*", F.lit(0.5).alias("margin_rate"), F.lit(1000).alias("order_value_cents"))
    spare = keys.select("customer_id", F.lit(0.4).alias("margin_rate"),
                        F.lit(1000).alias("order_value_cents"))
    odds = keys.select("customer_id", "day", F.explode(F.create_map(
        F.lit("none"), F.lit(0.1), F.lit("email_delayed"), F.lit(0.2))).alias(
        "candidate_id", "probability"))
    priced = ov.price_overrides(asked, contexts, odds, spare)
    joins = _hash_joins(priced)
    assert len(joins) == 4 and all("ShuffledHashJoin" in j and "BuildLeft" in j for j in joins)
    effect = {r.customer_id: r.override_effect_cents for r in priced.collect()}
    assert len(effect) == 100 and effect["3"] == pytest.approx(45) and effect["7"] == pytest.approx(35)
    assert ov.override_totals(priced).first().n_overrides == 100


def test_ranking_calls_no_comparator(spark):
    """array_sort evaluates a comparator expression for each pair, sort_array compares entries."""
    rows = spark.createDataFrame([context("c1", margin=0.5)], FIELDS)
    judged = ru.apply_rules(ac.with_candidates(rows))
    arms = po.active_arms(candidate_rows())
    members = F.create_map(*[x for k, (a, b) in enumerate(arms) for x in (
        F.lit(f"{a}:{b}"), F.array(*[F.lit(0.01 * (k + 1) + 0.002 * ((m * 7 + k) % 4))
                                     for m in range(4)]))])
    scored = po.expected_value_scores(judged.withColumn("members", members), "members", 4)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    entries = scored.first().scored
    assert [e.neg_score for e in entries] == sorted(e.neg_score for e in entries)
    for e in entries:
        own = [0.01 * (k + 1) + 0.002 * ((m * 7 + k) % 4) for m in range(4)
               for k, (a, b) in enumerate(arms) if (a, b) == (e.archetype, e.discount_bps)]
        none = [0.01 + 0.002 * (m * 7 % 4) for m in range(4)]
        if e.archetype not in ("none", "wait"):
            assert math.isclose(e.uplift, sum(a - b for a, b in zip(own, none)) / 4)
    assert math.isclose(sum(e.win_rate for e in entries), 1.0)
