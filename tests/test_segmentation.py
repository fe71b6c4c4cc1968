"""Resampled k-means, exact medians, stability and the choice of a segmentation."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.config import SETTINGS
from holdfast.functions import quantiles
from holdfast.functions.quantiles import weighted_medians
from holdfast.operators import segmentation as sn
from holdfast.operators import segments as sg
from holdfast.operators.clustering import nearest, weighted_kmeans


def lloyd(x, w, centres):
    """One weighted fit from given centres, until nothing moves."""
    while True:
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(x[at == k], axis=0, weights=w[at == k])
                        if w[at == k].sum() else centres[k] for k in range(len(centres))])
        if np.abs(new - centres).max() < 1e-12:
            return new
        centres = new


def cost(x, w, centres):
    return (w * ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)).sum()


def test_resampled_fits_equal_single_fits(spark):
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(c, 0.3, (80, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    w = np.column_stack([np.ones(240), draw.poisson(1, 240), draw.poisson(1, 240)]).astype(float)
    points = spark.createDataFrame([(x[k].tolist(), w[k].tolist(), k) for k in range(240)],
                                   "x array<double>, w array<double>, key long").repartition(5)
    found = weighted_kmeans(points, (2, 3, 4), 3, seed=3, starts=4)
    assert set(found) == {(k, r) for k in (2, 3, 4) for r in range(3)}
    for (k, r), centres in found.items():
        assert lloyd(x, w[:, r], centres) == pytest.approx(centres, abs=1e-6)  # a fixed point
        tries = [lloyd(x, w[:, r], x[draw.choice(240, k, replace=False, p=w[:, r] / w[:, r].sum())])
                 for _ in range(12)]
        best = min(cost(x, w[:, r], c) for c in tries)
        assert cost(x, w[:, r], centres) <= best * (1.001 if k == 3 else 1.1)
    labels = points.select("key", nearest(F.col("x"), [found[3, 0]]).alias("l")).collect()
    groups = {}
    for row in labels:
        groups.setdefault(row["key"] // 80, set()).add(row["l"][0])
    assert sorted(map(len, groups.values())) == [1, 1, 1]


def test_fewer_distinct_points_than_centres(spark):
    points = spark.createDataFrame([([1.0], [1.0], k) for k in range(5)],
                                   "x array<double>, w array<double>, key long")
    assert weighted_kmeans(points, (3,), 1, 1, 2)[3, 0] == pytest.approx(np.ones((3, 1)))
    assert weighted_kmeans(points.limit(0), (3,), 1, 1) == {}


@pytest.mark.parametrize("cells", [4096, 3])
def test_medians_by_range_counts(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(-10**12, 10**12) | st.integers(-3, 3) | st.none(),
                              st.integers(0, 3)), max_size=30))
    def check(rows):
        df = spark.createDataFrame(rows, "v long, n long")
        one, many = weighted_medians(df, "v", [F.lit(1), F.col("n")])
        plain = [v for v, _ in rows if v is not None]
        copies = [v for v, n in rows if v is not None for _ in range(n)]
        assert one == (np.median(plain) if plain else None)
        assert many == (np.median(copies) if copies else None)

    check()


def test_median_of_one_hot_value_moves_few_rows(spark):
    df = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("v"))
    values = np.where(np.arange(200_000) % 3 == 0, 77, np.arange(200_000))
    assert weighted_medians(df, "v", [F.lit(1)]) == [np.median(values)]


def rand_index(a, b):
    both = np.array([[np.sum((a == i) & (b == j)) for j in np.unique(b)] for i in np.unique(a)])
    two = lambda n: n * (n - 1) / 2
    sa, sb = two(both.sum(axis=1)).sum(), two(both.sum(axis=0)).sum()
    expected = sa * sb / two(both.sum())
    top = (sa + sb) / 2
    return (two(both).sum() - expected) / (top - expected) if top != expected else 1.0


@pytest.fixture(scope="module")
def run(ws):
    small = SETTINGS.with_(kmeans_k=(3, 4), kmeans_starts=3, stability_resamples=3)
    labels = sn.candidate_labels(ws.snapshot, small)
    return small, labels


def test_stability_is_the_mean_index_of_refits(ws, run):
    _, labels = run
    rows = labels.collect()
    for r in sn.stability(labels).collect():
        own = [x for x in rows if x["method"] == r["method"]]
        each = []
        for k in range(3):
            copies = np.array([int(x["w"][k]) for x in own])
            a = np.repeat([x["segment_id"] for x in own], copies)
            b = np.repeat([x["refits"][k] for x in own], copies)
            each.append(rand_index(a, b))
        assert r["stability"] == pytest.approx(np.mean(each), abs=1e-9)
    copies = [sum(x["w"][k] for x in rows if x["method"] == "rfm_rules") for k in range(3)]
    assert copies == [ws.snapshot.count()] * 3


def test_choice_and_fallback(ws, run):
    small, labels = run
    matrix = sg.segment_matrix(ws.snapshot)
    stable = sn.stability(labels)
    readable = sn.interpretability(small.interpretability)
    easy = small.with_(min_segment_share=0.0)
    card = {r["method"]: r for r in sn.scorecard(labels, matrix, stable, readable, easy).collect()}
    assert set(card) == {"rfm_rules", "kmeans_k3", "kmeans_k4"}
    best = max(card.values(), key=lambda r: r["closeness"])
    assert best["chosen"] and sum(r["chosen"] for r in card.values()) == 1
    strict = small.with_(min_segment_share=0.9)
    rows = sn.scorecard(labels, matrix, stable, readable, strict).collect()
    assert [r["method"] for r in rows if r["chosen"]] == [sn.ONE_SEGMENT]
    out = sn.run_segmentation(ws.snapshot, strict)
    assert out.chosen == sn.ONE_SEGMENT
    names = out.segments.groupBy("segment_id", "segment_name").count().collect()
    assert [tuple(r) for r in names] == [(0, sn.ONE_SEGMENT, ws.snapshot.count())]
