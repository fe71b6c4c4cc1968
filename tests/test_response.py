import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.config import SETTINGS
from holdfast.operators import context as cx
from holdfast.operators import response as rs


@pytest.fixture(scope="module")
def fitted(ws):
    return rs.fit_logistic(ws.experiment, list(cx.model_columns(ws.categories)))


def design(model, rows):
    """The full design of a few rows, in plain numpy."""
    z = (np.array([[r[f] for f in model.features] for r in rows]) - model.mean) / model.scale
    flags = np.array([[float(r.archetype == a) for a in model.actions] for r in rows])
    depth = np.array([[r.discount_bps / 10_000.0] for r in rows])
    inter = np.einsum("nk,np->nkp", flags, z).reshape(len(rows), -1)
    return np.hstack([z, flags, inter, depth, z * depth])


def test_every_member_is_at_its_optimum(spark, ws, fitted):
    """The penalised gradient of each resample is zero."""
    train = ws.experiment.where("split = 'train'")
    weights = {r.customer_id: r.w for r in rs.member_weights(
        train, SETTINGS.ensemble_size, SETTINGS.seeds["models"]).collect()}
    rows = train.collect()
    x, y = design(fitted, rows), np.array([float(r.converted) for r in rows])
    w = np.array([weights[r.customer_id] for r in rows])
    for m, member in enumerate(fitted.members_):
        p = 1 / (1 + np.exp(-(x @ member.coef + member.intercept)))
        grad = SETTINGS.logistic_c * (x.T @ (w[:, m] * (y - p))) - member.coef
        assert np.abs(grad).max() < 1e-6
        assert abs((w[:, m] * (y - p)).sum()) < 1e-6


def test_calibration_keeps_the_mean(spark, ws, fitted):
    rows = ws.experiment.where("split = 'validation'").collect()
    x, y = design(fitted, rows), np.array([float(r.converted) for r in rows])
    for member in fitted.members_:
        a, b = member.platt
        raw = x @ member.coef + member.intercept
        assert (1 / (1 + np.exp(-(a * raw + b)))).mean() == pytest.approx(y.mean(), abs=1e-6)


def test_scores_of_both_paths_agree(spark, ws, fitted):
    """Probabilities by arm equal those of the full design."""
    rows = ws.experiment.where("split = 'test'").limit(50)
    arms = sorted({(r.archetype, r.discount_bps) for r in rows.collect()})
    cols = {f: F.col(f) for f in fitted.features}
    for r in fitted.members(rows, cols, arms).collect():
        x = design(fitted, [r])[0]
        want = [1 / (1 + np.exp(-(m.platt[0] * (x @ m.coef + m.intercept) + m.platt[1])))
                for m in fitted.members_]
        assert r.members[f"{r.archetype}:{r.discount_bps}"] == pytest.approx(want, abs=1e-9)


def test_fit_that_does_not_converge_fails(ws):
    with pytest.raises(RuntimeError, match="after 1 steps"):
        rs.fit_logistic(ws.experiment, ["contacts_7d", "tenure_days"], max_iter=1)
