"""Both fitted families through scores, selection and replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.checks.queries import _arms
from holdfast.config import SETTINGS
from holdfast.operators import context as cx
from holdfast.operators import evaluation
from holdfast.operators import response as rs
from holdfast.plans import model_evaluation as mo

SMALL = SETTINGS.with_(ensemble_size=2, gbm_min_leaf_rows=20, decision_days=(23, 24),
                       train_end_day=20, validation_end_day=22)


@pytest.fixture(scope="module")
def models(ws):
    names = list(cx.model_columns(ws.categories))
    return {"logistic": rs.fit_logistic(ws.experiment, names, SMALL),
            "gbm": rs.fit_trees(ws.experiment, names, SMALL, rounds=4)}


def test_fitted_scores_are_the_models_own(ws, models):
    scores = mo.fitted_scores(ws.experiment, models, _arms())
    assert scores.count() == 2 * ws.experiment.count()
    rows = {(r.customer_id, r.day): r.p for r in scores.where("family = 'gbm'").collect()}
    for r in models["gbm"].score(ws.experiment.limit(30)).collect():
        assert rows[r.customer_id, r.day] == pytest.approx(np.mean(r.p))
    table = mo.fitted_metrics(scores).where("split = 'train' AND archetype = 'all'").collect()
    assert {r["family"] for r in table} == set(models)
    base = scores.where("split = 'train'").agg(F.avg(F.col("y").cast("double"))).first()[0]
    assert all(r["positive_rate"] == pytest.approx(base) for r in table)


def test_selection_and_logs(ws, models):
    contexts = ws.with_probabilities(ws.all_contexts)
    baselines = ws.log.where(F.col("day").isin(*SMALL.decision_days))
    run = mo.run_models(contexts, baselines, models, cx.model_columns(ws.categories), _arms(), SMALL)
    profit = {r["family"]: r["profit_cents"] for r in run.selection.collect()}
    assert run.selected == max(profit, key=lambda f: (profit[f], f == "logistic"))
    per = {r["policy"]: r["count"] for r in run.log.groupBy("policy").count().collect()}
    assert per["expected_value_logistic"] == per["expected_value_gbm"] == per["rules_only"] > 0
    own = run.log.where(F.col("policy") == run.policy)
    assert own.where("confidence BETWEEN 0 AND 1").count() == own.count()
    gains = evaluation.with_gains(evaluation.tag(run.log, ws.segments), run.policy)
    assert gains.count() == own.count()


def test_families_go_side_by_side(ws, models, monkeypatch):
    """Days of a family follow each other; the other family does not wait for them."""
    import threading

    met, order = threading.Barrier(2, timeout=300), []

    def replayed(contexts, policy, score, settings, days, min_confidence):
        order.append((policy, list(days)))
        if days[0] == SMALL.train_end_day:
            met.wait()  # both families are there at once
        return ws.log.limit(5)

    monkeypatch.setattr(mo.rp, "replay_with_model", replayed)
    mo.run_models(ws.with_probabilities(ws.all_contexts), ws.log, models,
                  cx.model_columns(ws.categories), _arms(), SMALL)
    for family in models:
        own = [days for policy, days in order if policy == mo.policy_of(family)]
        assert own == [[20, 21], [23, 24]]


def test_an_error_beside_another_step_is_raised():
    from holdfast.session import side_by_side

    assert side_by_side({"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    with pytest.raises(ZeroDivisionError):
        side_by_side({"a": lambda: 1 / 0, "b": lambda: 2})
