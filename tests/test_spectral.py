"""Grid smoothing by passes against the dense solver on whole grids."""

import numpy as np
import pytest

from rasterloom.operators import spectral as X
from rasterloom.operators import temporal as S


@pytest.mark.parametrize("n", [1, 2, 5, 8, 33])
def test_cosine_transform(n):
    x = np.random.default_rng(n).normal(size=(3, n))
    np.testing.assert_allclose(X.dct(x), x @ S.cosine_basis(n).T, atol=1e-12)
    np.testing.assert_allclose(X.idct(X.dct(x)), x, atol=1e-12)


def grids(spark, shapes, holes=0.0):
    g = np.random.default_rng(5)
    held, rows = {}, []
    for k, (n, m) in enumerate(shapes):
        y = np.add.outer(np.sin(np.arange(n) / 4), np.cos(np.arange(m) / 3)) + g.normal(0, 0.1 * (k + 1), (n, m))
        y[g.random((n, m)) < holes] = np.nan
        held[k] = y
        rows += [(k, i, j, None if np.isnan(y[i, j]) else float(y[i, j])) for i in range(n) for j in range(m)]
    return held, spark.createDataFrame(rows, "scene_id int, r int, c int, v double")


def test_fixed_and_chosen_strength(spark):
    held, df = grids(spark, [(20, 13), (7, 40)])
    for s in (3.0, None):
        got = {(r.scene_id, r.r, r.c): r.v for r in X.smooth_grids(df, "v", ["scene_id"], s).collect()}
        for k, y in held.items():
            want, _, _ = S.spline_smooth(y, np.ones_like(y), s, None)
            np.testing.assert_allclose([got[k, i, j] for i, j in np.ndindex(y.shape)], want.ravel(), atol=1e-4 if s is None else 1e-10)


def test_nulls_are_filled(spark):
    held, df = grids(spark, [(9, 8)], 0.2)
    df = df.unionByName(spark.createDataFrame([(9, 0, 0, None), (9, 1, 1, None)], df.schema))
    got = {(r.scene_id, r.r, r.c): r.v for r in X.smooth_grids(df, "v", ["scene_id"], 0.5).collect()}
    want, _, _ = S.spline_smooth(held[0], np.ones_like(held[0]), 0.5, None, tol=1e-9, rounds=2000)
    np.testing.assert_allclose([got[0, i, j] for i, j in np.ndindex(want.shape)], want.ravel(), atol=2e-2)
    assert got[9, 0, 0] is None and len(got) == 74


def test_passes_deal_lines_not_groups(spark):
    _, df = grids(spark, [(5, 4)])
    plan = X.transform(df, ["scene_id"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") >= 2
