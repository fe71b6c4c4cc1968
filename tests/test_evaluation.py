import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.config import SETTINGS
from holdfast.functions import ordering
from holdfast.operators import bootstrap, gateway, mart_checks
from holdfast.operators import metrics as me
from holdfast.operators import segments as sg
from holdfast.plans import replay as rp

MDE, MARGIN, BUDGET = SETTINGS.mde, SETTINGS.indifference_margin, SETTINGS.delay_budget_days
GUARD, DROP = SETTINGS.guardrails[0]
TICK = 1e-6


def guard(low, high):
    return {GUARD: ((low + high) / 2, low, high)}


SAFE = guard(-DROP / 2, DROP)
# each case stands on, or one tick beside, a boundary
CASES = [
    ("at the effect wanted", (MDE, TICK, 3 * MDE), SAFE, 1, "accept", "clear_win"),
    ("a tick below it", (MDE - TICK, TICK, 3 * MDE), SAFE, 1, "delay", "inconclusive"),
    ("interval touches zero from above", (2 * MDE, 0.0, 4 * MDE), SAFE, 1, "delay",
     "inconclusive"),
    ("interval touches zero from below", (-2 * MDE, -4 * MDE, 0.0), SAFE, 1, "delay",
     "inconclusive"),
    ("interval ends a tick below zero", (-2 * MDE, -4 * MDE, -TICK), SAFE, 1, "reject",
     "clear_loss"),
    ("interval is the margin", (0.0, -MARGIN, MARGIN), SAFE, BUDGET + 9, "reject", "in_margin"),
    ("interval is a tick wider", (0.0, -MARGIN, MARGIN + TICK), SAFE, 1, "delay", "inconclusive"),
    ("guardrail ends at its floor", (2 * MDE, MDE, 3 * MDE), guard(-3 * DROP, -DROP), 1, "delay",
     "conflicting_metrics"),
    ("guardrail ends a tick below", (2 * MDE, MDE, 3 * MDE), guard(-3 * DROP, -DROP - TICK), 1,
     "reject", "guardrail_breach"),
    ("guardrail starts at its floor", (2 * MDE, MDE, 3 * MDE), guard(-DROP, DROP), 1, "accept",
     "clear_win"),
    ("guardrail unknown", (2 * MDE, MDE, 3 * MDE), {}, 1, "delay", "conflicting_metrics"),
    ("breach outranks a loss", (-2 * MDE, -3 * MDE, -MDE), guard(-9 * DROP, -2 * DROP), 1,
     "reject", "guardrail_breach"),
    ("open on the last day", (0.0, -MDE, MDE), SAFE, BUDGET - 1, "delay", "inconclusive"),
    ("open when days run out", (0.0, -MDE, MDE), SAFE, BUDGET, "needs_human_review",
     "inconclusive_past_budget"),
    ("conflict when days run out", (2 * MDE, MDE, 3 * MDE), {}, BUDGET, "needs_human_review",
     "conflicting_metrics_past_budget"),
]
SCHEMA = ("name string, change_type string, point double, ci_low double, ci_high double, "
          "guardrails map<string, struct<point:double, ci_low:double, ci_high:double>>, "
          "days_running long")


def test_gateway_cases(spark):
    rows = [(n, "ranking_weight_nudge", *p, g, d) for n, p, g, d, _, _ in CASES]
    got = {r.name: r for r in gateway.adjudicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    for name, _, _, _, verdict, case in CASES:
        assert (got[name].verdict, got[name].case) == (verdict, case)
    assert str(BUDGET) in got["open when days run out"].reason


@pytest.mark.parametrize(("change", "action"), [
    ("ranking_weight_nudge", "auto_apply"), ("policy_promotion", "requires_human_signoff"),
    ("discount_ceiling_change", "human_only"), ("other", "requires_human_signoff")])
def test_autonomy(spark, change, action):
    row = ("w", change, 2 * MDE, MDE, 3 * MDE, SAFE, 7)
    assert gateway.adjudicate(spark.createDataFrame([row], SCHEMA)).first().autonomy == action


# fixed values: a published scorecard (criteria per alternative, closeness, winners)
SCORECARD = {
    "kmeans_k3": (0.5, 0.5012646477990575, 0.8041091265402222, 0.9706135480156061),
    "kmeans_k4": (0.5, 0.3985803802152827, 0.9270305454182959, 0.9769868734480054),
    "kmeans_k5": (0.5, 0.4257207306952777, 0.9223127994480188, 0.9646223891236028),
    "rfm_rules": (1.0, 0.15607027589803288, 0.6991054474831653, 0.9967326387847933),
}
CLOSENESS = {"kmeans_k3": 0.632300400285661, "kmeans_k4": 0.5312387227154138,
             "kmeans_k5": 0.5676257428369264, "rfm_rules": 0.3599310200364423}


def scorecard(spark):
    names = ("interpretability", "silhouette", "size_balance", "stability")
    rows = [("g", a, c, v) for a, vs in SCORECARD.items() for c, v in zip(names, vs)]
    return spark.createDataFrame(rows, "group string, alternative string, criterion string, "
                                       "value double")


def test_topsis_scorecard(spark):
    scores = sg.topsis(scorecard(spark))
    got = {r.alternative: r.closeness for r in scores.collect()}
    assert got == pytest.approx(CLOSENESS, abs=1e-12)
    ranked = {r["rank"]: r.alternative for r in sg.rank_alternatives(scores).collect()}
    assert [ranked[i] for i in range(1, 5)] == ["kmeans_k3", "kmeans_k5", "kmeans_k4", "rfm_rules"]


def test_topsis_sensitivity(spark):
    rows = sg.sensitivity(scorecard(spark)).collect()
    assert len(rows) == 8
    for r in rows:
        odd = r.criterion == "silhouette" and r.weight_factor == 0.5
        assert r.winner == ("rfm_rules" if odd else "kmeans_k3")
        assert r.winner_unchanged == (not odd)


def test_kmeans_separates_and_silhouette(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0.0, 5.0, 10.0)])
    small = SETTINGS.with_(segment_features=("a", "b"))
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "customer_id string, a double, b double")
    labels = sg.kmeans_labels(df, (3,), 1, small).drop("k")
    pairs = labels.withColumn("b", F.floor(F.col("customer_id").cast("int") / 30)).select(
        F.col("segment_id").alias("a"), "b")
    assert sg.adjusted_rand(pairs).first().ari == pytest.approx(1.0)
    labelled = df.join(labels, "customer_id")
    kinds = {r.customer_id: r.segment_id for r in labels.collect()}
    mine = np.array([kinds[str(i)] for i in range(len(pts))])
    far = ((pts[:, None] - pts[None]) ** 2).sum(axis=2)
    own = np.array([far[i, mine == mine[i]].sum() / (sum(mine == mine[i]) - 1)
                    for i in range(len(pts))])
    other = np.array([min(far[i, mine == k].mean() for k in set(mine) - {mine[i]})
                      for i in range(len(pts))])
    want = ((other - own) / np.maximum(own, other)).mean()
    assert sg.silhouette(labelled, small).first().silhouette == pytest.approx(want, abs=1e-9)
    assert sg.viability(sg.size_balance(labels), small).first().viable


def test_metrics_on_hot_value(spark):
    """A third of rows share one probability; ranks, bins and AUC match numpy."""
    rng = np.random.default_rng(1)
    n = 3000
    p = np.where(np.arange(n) % 3 == 0, 0.05, np.round(rng.uniform(0.01, 0.2, n), 3))
    y = rng.uniform(size=n) < p
    df = spark.createDataFrame([("f", str(i), float(a), bool(b)) for i, (a, b) in
                                enumerate(zip(p, y))], "g string, id string, p double, y boolean")
    got = me.prediction_metrics(df, ["g"], ["id"]).first()
    pos, neg = p[y], p[~y]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert got.roc_auc == pytest.approx(float(auc), abs=1e-12)
    assert got.brier == pytest.approx(float(np.mean((p - y) ** 2)), abs=1e-12)
    bins = me.reliability_table(df, ["g"], ["id"], 7).orderBy("bin").collect()
    assert [r.bin_count for r in bins] == [len(c) for c in np.array_split(np.arange(n), 7)]
    want = [float(c.mean()) for c in np.array_split(np.sort(p), 7)]
    assert [r.bin_mean_predicted for r in bins] == pytest.approx(want, abs=1e-12)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("f", "1", 0.1, False), ("f", "2", 0.2, False)],
                               "g string, id string, p double, y boolean")
    assert me.prediction_metrics(df, ["g"], ["id"], 2).first().roc_auc is None


def test_row_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordering.number_rows(df, [F.col("k")], "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 1) for i in range(1000)]


def test_bootstrap_draws_are_whole(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("customer_id"))
    w = bootstrap.weights(bootstrap.index_customers(df), 5, 1)
    assert [r.s for r in w.groupBy("resample").agg(F.sum("weight").alias("s")).collect()] == [40] * 5


def test_replay_feedback_respects_the_cap(ws):
    """No contact ever follows two contacts within seven days, own and business ones alike."""
    log = ws.log
    bad = log.where("contact and recent_contacts_7d >= 2").count()
    assert bad == 0
    assert log.where("policy = 'always_discount' and contact").count() > 0
    grew = log.groupBy("policy", "customer_id").agg(
        (F.max("prior_contacts") - F.min("prior_contacts")).alias("d"))
    assert grew.agg(F.max("d")).first()[0] > 0


def test_round_based_replay_equals_the_fold(ws):
    """The day-by-day replay used for models gives what the fold gives for a rule policy."""
    from holdfast.operators import policies as po

    ctx = ws.with_probabilities(ws.contexts)
    days = SETTINGS.decision_days[:3]
    rounds = rp.replay_with_model(ctx, "rules_only", lambda df: po.baseline(df, "rules_only"),
                                  days=days)
    keep = ["customer_id", "day", "candidate_id", "recent_contacts_7d", "prior_contacts",
            "n_survivors", "fired_rules", "runner_up", "converted"]
    fold = ws.log.where((F.col("policy") == "rules_only") & F.col("day").isin(*days)).select(*keep)
    assert rounds.select(*keep).exceptAll(fold).count() == 0
    assert fold.count() == rounds.count()


def test_experiment_log_has_no_truth(ws):
    forbidden = {"p_action", "p_none", "draw", "would_buy_anyway", "regret_cents",
                 "expected_profit_cents", "oracle_best_candidate", "p"}
    assert not forbidden & set(ws.experiment.columns)


def test_mart_gate_is_clean_and_fires(ws):
    mart_checks.require_clean(ws.tables)
    broken = dict(ws.tables)
    broken["fct_outcomes"] = broken["fct_outcomes"].where("decision_key > 1")
    with pytest.raises(mart_checks.MartTestFailure):
        mart_checks.require_clean(broken)
    assert json.dumps(sorted(mart_checks.CHECKS))


def test_resampled_draws_are_never_broadcast(spark):
    """200 customers times 1,000 resamples: only the customers may be a hashed side."""
    customers = spark.range(200).select(F.col("id").cast("string").alias("customer_id"))
    indexed = bootstrap.index_customers(customers)
    values = indexed.select("customer_id", F.lit(1.0).alias("v"))
    totals = bootstrap.resampled_totals(indexed, values, ["v"], 1000, 1)
    assert {(r.resample, r.v) for r in totals.collect()} == {(k, 200.0) for k in range(1000)}
    for df in (totals, bootstrap.weights(indexed, 1000, 1)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        built = [line for line in plan.splitlines() if "HashJoin" in line and "[slot" in line]
        assert len(built) == 1 and "ShuffledHashJoin" in built[0]
