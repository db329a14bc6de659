"""Scene-wide systems solved by tiles and ranges: the same answers as on whole scenes, in groups of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import retrieval as T

NAMES = [1, 2, 3]
PRIOR = "scene_id int, bi int, bj int, cos_sza double, cos_vza double, cos_raa double, ele double, tco3 double, aot_prior double, tcwv_prior double, aot_unc double, tcwv_unc double"


def scene(spark, n, m, seed=3, seen=0.8):
    """Observations of a surface under an atmosphere that varies, with blocks that nobody saw."""
    g = np.random.default_rng(seed)
    obs, prior = [], []
    for i in range(n):
        for j in range(m):
            prior.append((1, i, j, 0.8, 0.95, 0.3, 0.0, 0.3, 0.2, 2.0, 0.4, 1.0))
            if g.random() > seen:
                continue
            aot, tcwv = 0.3 + 0.2 * np.sin(i / 3), 2.5 + np.cos(j / 2)
            for b in NAMES:
                k = b - 1
                a, bb, c = 1.1 + 0.3 / (1 + k) * aot + 0.02 * (1 + k) * tcwv, 0.01 + 0.12 / (1 + k) * aot, 0.05 + 0.1 / (1 + k) * aot
                for toa in g.uniform(0.05, 0.5, 2):
                    y = a * toa - bb
                    obs.append((1, b, i, j, float(toa), float(y / (1 + c * y) + g.normal(0, 0.002)), 0.01))
    bands = spark.createDataFrame([(1, 469), (2, 645), (3, 859)], "band int, wavelength_nm int")
    o = spark.createDataFrame(obs, "scene_id int, band int, bi int, bj int, toa double, boa double, unc double")
    return o, spark.createDataFrame(prior, PRIOR), bands


def field(df):
    rows = df.collect()
    assert all(r.converged for r in rows)
    return {(r.bi, r.bj): (r.aot, r.tcwv) for r in rows}


def test_tiles_give_the_scene_minimum(spark):
    o, p, bands = scene(spark, 11, 7)
    models = T.linear_models(NAMES)
    whole = field(T.retrieve(o, p, bands, models, gamma=2.0, tol=1e-5))
    tiles = field(T.retrieve(o, p, bands, models, gamma=2.0, tol=1e-5, tile=4, halo=3))
    assert whole.keys() == tiles.keys() and len(whole) == 77
    worst = max(abs(np.subtract(whole[k], tiles[k])).max() for k in whole)
    assert worst < 1e-4


def test_the_minimum_has_no_gradient(spark):
    """Without bounds in play, the gradient of the whole cost vanishes at the answer."""
    o, p, bands = scene(spark, 6, 5, seed=4)
    models, gamma = T.linear_models(NAMES), 2.0
    got = T.retrieve(o, p, bands, models, gamma=gamma, tol=1e-6, tile=3, halo=2)
    sums = {(r.bi, r.bj): r for r in T.normal_sums(o, got.drop("moved", "converged"), T.band_weights(bands), NAMES, models).collect()}
    x = np.zeros((2, 6, 5))
    for r in got.collect():
        x[:, r.bi, r.bj] = r.aot, r.tcwv
    grad = np.zeros_like(x)
    for (i, j), r in sums.items():
        if r.n > 1:
            grad[:, i, j] = r.g0 + (x[0, i, j] - 0.2) / 0.4**2, r.g1 + (x[1, i, j] - 2.0)
    for axis in (1, 2):
        d = gamma**2 * np.diff(x, axis=axis)
        lead, lag = [slice(None)] * 3, [slice(None)] * 3
        lead[axis], lag[axis] = slice(None, -1), slice(1, None)
        grad[tuple(lead)] -= d
        grad[tuple(lag)] += d
    assert abs(grad).max() < 5e-3


def test_no_group_holds_a_scene(spark):
    cells = spark.range(200 * 150).select(F.lit(1).alias("scene_id"), F.expr("cast(id div 150 as int)").alias("bi"), F.expr("cast(id % 150 as int)").alias("bj"))
    sizes = T.tiled(cells, 20, 5).groupBy("scene_id", "ti", "tj").count()
    assert sizes.agg(F.max("count")).first()[0] == 30 * 30


def test_holes_are_no_neighbours(spark):
    o, p, bands = scene(spark, 5, 5)
    gap = p.where("bi <> 2")
    got = field(T.retrieve(o.where("bi <> 2"), gap, bands, T.linear_models(NAMES), gamma=2.0, tol=1e-6))
    alone = field(T.retrieve(o.where("bi < 2"), p.where("bi < 2"), bands, T.linear_models(NAMES), gamma=2.0, tol=1e-6))
    assert max(abs(np.subtract(got[k], alone[k])).max() for k in alone) < 1e-5


@pytest.mark.parametrize("rows", [1, 2, 7])
def test_posterior_ranges_equal_the_dense_inverse(spark, rows):
    g, cells = np.random.default_rng(1), []
    for s, n, m in ((1, 5, 4), (2, 1, 1), (3, 7, 1)):
        cells += [(s, i, j, float(g.uniform(0, 40)) if g.random() < 0.7 else None, float("nan") if j == 2 else 3.0, 0.4, float(g.uniform(0.1, 1)) if i else 0.0) for i in range(n) for j in range(m)]
    df = spark.createDataFrame(cells, "scene_id int, bi int, bj int, info_aot double, info_tcwv double, aot_prior_unc double, tcwv_prior_unc double").repartition(4)
    got = {(r.scene_id, r.bi, r.bj): (r.aot_unc, r.tcwv_unc) for r in T.posterior(df, 2.0, rows).collect()}
    assert len(got) == len(cells)
    for s in (1, 2, 3):
        mine = sorted(c for c in cells if c[0] == s)
        for k, (info, unc) in enumerate(((3, 5), (4, 6))):
            d = np.array([np.nan_to_num(float(c[info] or 0)) + (1 / c[unc] ** 2 if c[unc] > 0 else 0.0) for c in mine])
            np.testing.assert_allclose([got[c[:3]][k] for c in mine], T.chain_uncertainty(d, 2.0), rtol=1e-9)


def test_long_ranges_do_not_overflow():
    a = np.full((20_000, 1), 1e6)
    m = T._product(a, -4.0)
    assert np.isfinite(m).all() and np.isclose(m[0, 0] / m[1, 0], T._pivots(a, -4.0, np.array([[1.0], [0.0]]))[-1]).all()
