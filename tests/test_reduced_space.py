"""Reduced feature spaces against numpy, without regard to the signs of components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.operators.neighbours import knn, pca_scores
from arealens.operators.scaling import percent_explained, zscore

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(120, 2))
    mixed = base @ rng.normal(size=(2, 5)) + 0.3 * rng.normal(size=(120, 5))
    return mixed * [1, 10, 0.1, 5, 2] + [0, 100, -3, 7, 1]


@pytest.mark.parametrize("kept", [2, 3, 5])
def test_distances_in_a_reduced_space_equal_numpy(spark, table, kept):
    rows = [(i, *map(float, r)) for i, r in enumerate(table)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in NAMES))
    scores, ratios = pca_scores(zscore(frame, NAMES), "id", NAMES, kept)

    z = (table - table.mean(0)) / table.std(0)
    sizes, axes = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(-sizes)
    projected = z @ axes[:, order[:kept]]
    apart = np.sqrt(((projected[:, None] - projected[None]) ** 2).sum(2))

    assert np.asarray(ratios)[:kept] == pytest.approx((sizes[order] / sizes.sum())[:kept])
    assert percent_explained(ratios, kept) == pytest.approx(100 * sizes[order[:kept]].sum() / sizes.sum(), abs=0.06)
    found = knn(scores, "id", "scores", 4).collect()
    assert len(found) == 120 * 5
    for r in found:
        assert r.distance == pytest.approx(np.sort(apart[r.query_id])[r["rank"] - 1], abs=1e-8)
        assert apart[r.query_id, r.neighbour_id] == pytest.approx(r.distance, abs=1e-8)


def test_all_components_explain_everything(spark, table):
    rows = [(i, *map(float, r)) for i, r in enumerate(table)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in NAMES))
    _, ratios = pca_scores(zscore(frame, NAMES), "id", NAMES, 5)
    shares = [percent_explained(ratios, k) for k in range(1, 6)]
    assert shares == sorted(shares) and shares[-1] == pytest.approx(100)
    assert F is not None
