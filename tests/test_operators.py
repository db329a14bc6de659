"""Brute force, closed forms and recovery of planted values for operators that SQL does not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import angles as A
from rasterloom.functions import grid as G
from rasterloom.functions import radiometry as R
from rasterloom.operators import emulator as E
from rasterloom.operators import kernel_fit as K
from rasterloom.operators import neighborhood as N
from rasterloom.operators import pixels as P
from rasterloom.operators import psf as X
from rasterloom.operators import regrid as D
from rasterloom.operators import retrieval as T
from rasterloom.operators import temporal as S


def image(spark, a, name="dn"):
    rows = [(1, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"scene_id int, r int, c int, {name} double")


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["r"], r["c"]] = r[name]
    return out


def test_kernels_vanish_at_nadir_and_gradients_match_differences(spark):
    z = F.lit(0.0)
    row = spark.range(1).select(
        *[A.normalised(k, z, z, z).alias(n) for n, k in (("ross", A.ross), ("sparse", A.li_sparse), ("dense", A.li_dense), ("transit", A.li_transit), ("roujean", A.roujean))]).first()
    assert all(abs(v) < 1e-9 for v in row)
    e = 1e-6
    f = lambda t, d: R.surface_reflectance(F.lit(t), F.lit(1.2 + 0.3 * d), F.lit(0.05 + 0.1 * d), F.lit(0.08 + 0.2 * d))
    got = spark.range(1).select(
        R.surface_gradient(F.lit(0.4), F.lit(1.2), F.lit(0.05), F.lit(0.08), F.lit(0.3), F.lit(0.1), F.lit(0.2)).alias("g"), ((f(0.4, e) - f(0.4, -e)) / (2 * e)).alias("n"),
        R.toa_gradient(F.lit(0.4), F.lit(1.2), F.lit(0.05), F.lit(0.08)).alias("t"), ((f(0.4 + e, 0) - f(0.4 - e, 0)) / (2 * e)).alias("m")).first()
    assert got.g == pytest.approx(got.n, abs=1e-6) and got.t == pytest.approx(got.m, abs=1e-6)


def test_black_sky_integrals_match_direct_sums(spark):
    got = {r.sza: (r.bsa_vol, r.bsa_geo) for r in K.albedo_integrals(spark, 30).collect()}
    mu, w = np.polynomial.legendre.leggauss(200)
    mu, w = (mu + 1) / 2, w / 2
    phi = (np.arange(400) + 0.5) * 2 * np.pi / 400
    m, p = np.meshgrid(mu, phi, indexing="ij")
    for sza in (0, 30, 60):
        s, v = np.radians(sza), np.arccos(m)
        c = np.clip(np.cos(v) * np.cos(s) + np.sin(v) * np.sin(s) * np.cos(p), -1, 1)
        x = np.arccos(c)
        ross = ((np.pi / 2 - x) * c + np.sin(x)) / (np.cos(v) + np.cos(s))
        want = (m * ross * w[:, None]).sum() * 2 * np.pi / 400 / np.pi
        assert got[sza][0] == pytest.approx(want, abs=2e-3)
    assert K.white_sky(K.albedo_integrals(spark, 5)).first().wsa_vol - math.pi / 4 == pytest.approx(0.189, abs=0.01)


def test_robust_smoothing(spark):
    g = np.random.default_rng(3)
    y, w = g.normal(0.3, 0.02, (40, 33)), g.choice([0.0, 0.38, 0.618, 1.0], (40, 33))
    y[:, 10] += 2
    y[0], w[1] = 0.5, 0.0
    x, nw = S.robust_smooth(y, w)
    d = np.diff(np.eye(33), axis=0)
    lam = 2.0
    t = math.sqrt(1 + 16 * lam)
    h = math.sqrt(1 + t) / math.sqrt(2) / t
    for k in range(40):
        if w[k].sum() <= 1e-6:
            assert (x[k] == y[k]).all()
            continue
        now = w[k]
        for _ in range(3):
            z = np.linalg.solve(np.diag(now) + lam * d.T @ d, now * y[k])
            r = np.abs(z - y[k])
            u = r / (1.4826 * max(np.median(r[w[k] > 0]), 1e-5)) / math.sqrt(1 - h)
            now = (1 - (u / 4.685) ** 2) ** 2 * (u / 4.685 < 1)
        np.testing.assert_allclose(x[k], z, atol=1e-9)
        np.testing.assert_allclose(nw[k], now, atol=1e-9)
    np.testing.assert_allclose(x[0], 0.5, atol=1e-9)
    rows = [(i, 1, y[i].tolist(), w[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "cell_id int, band int, f array<double>, weight array<double>")
    for parts in (1, 7):
        got = {r.cell_id: r.f for r in S.smooth_series(df.repartition(parts), ["f"]).collect()}
        np.testing.assert_allclose([got[i] for i in range(40)], x, atol=1e-12)


def test_spline_smoothing():
    i = np.arange(60)
    g = np.random.default_rng(0)
    clean = np.sin(i / 8)
    y = clean + g.normal(0, 0.05, 60)
    y[20] += 3
    z, w, s = S.spline_smooth(y, np.ones(60))
    assert np.sqrt(np.mean((z - clean) ** 2)) < 0.05 and w[20] < 0.1 and s > 0
    np.testing.assert_allclose(S.spline_smooth(np.full(30, 2.5), np.ones(30))[0], 2.5, atol=1e-8)
    m = S.cosine_basis(16)
    np.testing.assert_allclose(m @ m.T, np.eye(16), atol=1e-12)
    d = np.diff(np.eye(20), 2, axis=0)
    lap = np.diff(np.eye(20), axis=0).T @ np.diff(np.eye(20), axis=0)
    fixed, _, _ = S.spline_smooth(y[:20], np.ones(20), s=5.0, robust=None, rounds=500, tol=1e-12)
    np.testing.assert_allclose(fixed, np.linalg.solve(np.eye(20) + 5.0 * lap @ lap, y[:20]), atol=1e-6)
    assert d.shape == (18, 20)
    for kind in ("cauchy", "talworth"):
        assert np.isfinite(S.spline_smooth(np.outer(clean[:20], clean[:12]), np.ones((20, 12)), robust=kind)[0]).all()


def test_gaussian_image_smoothing(spark):
    a = np.random.default_rng(1).normal(size=(14, 11))
    got = back(N.smooth(image(spark, a), 1.3, 1.7, 14, 11), "dn", a.shape)

    def one(v, std):
        n = math.ceil(4 * std)
        w = np.exp(-0.5 * (np.arange(-n, n + 1) / std) ** 2)
        return np.convolve(np.pad(v, n, "symmetric"), w / w.sum(), "valid")

    want = np.apply_along_axis(one, 1, np.apply_along_axis(one, 0, a, 1.3), 1.7)
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert (back(N.smooth(image(spark, a), 0.5, 0.5, 14, 11), "dn", a.shape) == a).all()


def test_morphology_order_and_plans(spark):
    g = np.random.default_rng(5)
    a = (g.random((24, 24)) > 0.8).astype(float)
    mask = image(spark, a).select("scene_id", "r", "c", (F.col("dn") > 0).alias("mask"))
    grown, shrunk = N.dilate(mask, 2), N.erode(mask, 1)
    m, d, e = ({(r.r, r.c) for r in x.where("mask").collect()} for x in (mask, grown, shrunk))
    assert e <= m <= d
    holes = image(spark, np.where(g.random((20, 20)) > 0.1, np.nan, 1.0))
    plan = N.nearest_fill(holes, "dn")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_spline_matrix():
    n = np.arange(9.0)
    m = D.spline_matrix(9, 30)
    t = np.minimum(np.arange(30) / 30 * 9, 8)
    for f in (lambda x: 2 * x - 1, lambda x: x**2, lambda x: x**3 - 4 * x):
        np.testing.assert_allclose(m @ f(n), f(t), atol=1e-8)
    np.testing.assert_allclose(D.spline_matrix(3, 6) @ np.array([0.0, 1.0, 2.0]), [0, 0.5, 1, 1.5, 2, 2], atol=1e-12)


def test_network_derivatives_match_differences():
    g = np.random.default_rng(2)
    layers = [(g.normal(size=(7, 12)), g.normal(size=12)), (g.normal(size=(12, 9)), g.normal(size=9)), (g.normal(size=(9, 2)), g.normal(size=2))]
    x = g.normal(size=(50, 7))
    y, j = E.forward(x, layers, True)
    for k in range(7):
        d = np.zeros(7)
        d[k] = 1e-6
        num = (E.forward(x + d, layers)[0] - E.forward(x - d, layers)[0]).sum(1) / 2e-6
        np.testing.assert_allclose(j[:, k], num, atol=1e-4)
    assert y.shape == (50, 2)


def test_models_from_a_table(spark):
    layers = E_layers = T.linear_models([1])[1, "a"]
    rows = [("s2", 1, "a", k, w.tolist(), b.tolist()) for k, (w, b) in enumerate(layers)]
    models = E.load_models(spark.createDataFrame(rows, "sensor string, band int, coef string, layer int, w array<array<double>>, b array<double>"), "s2")
    x = np.abs(np.random.default_rng(0).normal(size=(5, 7)))
    np.testing.assert_allclose(E.forward(x, models[1, "a"])[0], E.forward(x, E_layers)[0])


def test_planted_shift_is_found(spark):
    g = np.random.default_rng(4)
    a = np.cumsum(np.cumsum(g.normal(size=(60, 60)), 0), 1)
    points = [(1, 4 * i + 12, 4 * j + 12, float(a[4 * i + 12 + 4, 4 * j + 12 - 3])) for i in range(9) for j in range(9)]
    p = spark.createDataFrame(points, "scene_id int, hx int, hy int, boa double")
    for full in (True, False):
        got = X.search_shift(p, image(spark, a), 10, 5, exhaustive=full).first()
        assert (got.xs, got.ys) == (4, -3) and got.r > 0.999


def test_width_search_recovers_the_planted_widths(spark):
    g = np.random.default_rng(8)
    planted, seen, rows = {1: (2.0, 2.7), 2: (2.6, 1.7)}, None, []
    for k, std in planted.items():
        a = g.normal(size=(36, 36))
        rows += [(k, i, j, float(a[i, j])) for i in range(36) for j in range(36)]
        own = spark.createDataFrame([(k, i, j, float(a[i, j])) for i in range(36) for j in range(36)], "scene_id int, r int, c int, dn double")
        points = spark.createDataFrame([(k, 3 * i, 3 * j) for i in range(8) for j in range(8)], "scene_id int, r int, c int")
        part = N.psf_average(points, own, N.gaussian(*std)).select("scene_id", F.col("r").alias("hx"), F.col("c").alias("hy"), F.col("dn").alias("boa"))
        seen = part if seen is None else seen.unionByName(part)
    img = spark.createDataFrame(rows, "scene_id int, r int, c int, dn double")
    found = X.search_width(seen, img, starts=6, rounds=6, keep=1, bounds=((1.6, 3.0), (1.6, 3.0), (-1.0, 1.0), (-0.4, 0.4), (-0.4, 0.4)))
    best = found.groupBy("scene_id").agg(F.min_by(F.struct("std_row", "std_col", "cost"), F.struct("cost", "k")).alias("b")).collect()
    assert len(best) == 2
    for r in best:
        assert r.b.cost < 0.01 and np.allclose((r.b.std_row, r.b.std_col), planted[r.scene_id], atol=0.15)


def test_keyed_permutations_are_bijections_that_differ(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(*[X.permuted(F.col("id"), n, key).alias(f"p{key}") for key in (1, 2)])
        a, b = (np.array([r[k] for r in df.collect()]) for k in (0, 1))
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.1 and abs(np.corrcoef(a, b)[0, 1]) < 0.1


def test_latin_hypercube_and_inflation(spark):
    n = 40
    rows = X.latin_hypercube(spark, n, [(0.0, 1.0), (-2.0, 2.0), (5.0, 6.0)], 3)
    v = np.array([[r.x0, (r.x1 + 2) / 4, r.x2 - 5] for r in rows.collect()])
    assert all(sorted((v[:, k] * n).astype(int).tolist()) == list(range(n)) for k in range(3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert 1 <= P.variance_inflation(rows, ["x0", "x1", "x2"]) < 3


def test_hot_spot_width_is_recovered(spark):
    g = np.random.default_rng(6)
    rows = [(1, float(v), float(s), float(a)) for v, s, a in zip(g.uniform(-60, 60, 200), g.uniform(20, 50, 200), g.uniform(0, 360, 200), strict=True)]
    base = spark.createDataFrame(rows, "pixel int, vza double, sza double, raa double")
    grid = K.hot_spot_grid(spark, 10)
    truth = grid.collect()[4].xi
    made = K.with_kernels(base, hot_spot=truth).withColumn("refl", 0.3 + 0.2 * F.col("k_vol") + 0.05 * F.col("k_geo")).drop("k_vol", "k_geo")
    best = K.hot_spot_search(made, ["pixel"], grid).first()
    assert best.xi == pytest.approx(truth) and best.f_vol == pytest.approx(0.2, abs=1e-6) and best.rmse < 1e-6
    curve = K.principal_plane(spark.createDataFrame([(1, best.f_iso, best.f_vol, best.f_geo, best.xi)], "pixel int, f_iso double, f_vol double, f_geo double, xi double"))
    assert curve.count() == 141


def test_burn_day_and_fraction(spark):
    wl = {0: 648.0, 1: 858.0, 2: 470.0, 3: 555.0, 4: 1240.0, 5: 1640.0, 6: 2130.0}
    g = np.random.default_rng(9)
    pre = {0: 0.08, 1: 0.35, 2: 0.04, 3: 0.07, 4: 0.33, 5: 0.25, 6: 0.14}
    span = K.BURN_LIMIT - K.BURN_OFFSET
    lk = {b: (w - 400) - (w - 400) ** 2 / (2 * span) for b, w in wl.items()}
    top = max(lk.values())
    rows = []
    for doy in range(0, 160, 2):
        v, s, a = g.uniform(-50, 50), g.uniform(20, 50), g.uniform(0, 360)
        for b in wl:
            burnt = 0.02 + 0.08 * lk[b] / top
            refl = pre[b] if doy <= 80 else 0.6 * pre[b] + 0.4 * burnt
            rows.append((1, b, doy, float(v), float(s), float(a), refl + float(g.normal(0, 1e-4))))
    s = K.with_kernels(spark.createDataFrame(rows, "pixel int, band int, doy int, vza double, sza double, raa double, refl double"))
    got = K.detect_step(s, wl, 30).first()
    steps = K.solve_steps(K.step_sums(s, ["pixel", "band"], spark.createDataFrame([(1, 80)], "pixel int, dos int"))).collect()
    assert {r.band: round(r.p[6], 2) for r in steps} == {b: round(0.4 * (0.02 + 0.08 * lk[b] / top - pre[b]), 2) for b in wl}
    assert 0 <= got.fcc <= 1 and abs(got.dos - 80) <= 12


def test_retrieval_recovers_planted_atmosphere(spark):
    names = [1, 2, 3]
    bands = spark.createDataFrame([(1, 469), (2, 645), (3, 859)], "band int, wavelength_nm int")
    models = T.linear_models(names)
    n, g = 6, np.random.default_rng(11)
    aot = 0.3 + 0.02 * np.add.outer(np.arange(n), np.arange(n))
    tcwv = np.full((n, n), 2.5)
    obs, prior = [], []
    for i in range(n):
        for j in range(n):
            prior.append((1, i, j, 0.8, 0.95, 0.3, 0.0, 0.3, 0.2, 2.0, 2.0, 5.0))
            for b in names:
                k = b - 1
                a, bb, c = 1.1 + 0.3 / (1 + k) * aot[i, j] + 0.02 * (1 + k) * tcwv[i, j], 0.01 + 0.12 / (1 + k) * aot[i, j], 0.05 + 0.1 / (1 + k) * aot[i, j]
                for toa in g.uniform(0.05, 0.5, 30):
                    y = a * toa - bb
                    obs.append((1, b, i, j, float(toa), float(y / (1 + c * y)), 0.002))
    o = spark.createDataFrame(obs, "scene_id int, band int, bi int, bj int, toa double, boa double, unc double")
    p = spark.createDataFrame(prior, "scene_id int, bi int, bj int, cos_sza double, cos_vza double, cos_raa double, ele double, tco3 double, aot_prior double, tcwv_prior double, aot_unc double, tcwv_unc double")
    got = T.retrieve(o, p, bands, models, gamma=0.1)
    rows = {(r.bi, r.bj): r for r in got.collect()}
    assert len(rows) == n * n
    assert max(abs(rows[i, j].aot - aot[i, j]) for i in range(n) for j in range(n)) < 0.02
    assert max(abs(rows[i, j].tcwv - 2.5) for i in range(n) for j in range(n)) < 0.2
    assert all(r.converged for r in rows.values())
    levels = {(r.bi, r.bj): r for r in T.retrieve_pyramid(o, p, bands, models, (n, n), gamma=0.1).collect()}
    assert len(levels) == n * n and all(r.converged for r in levels.values())
    assert max(abs(levels[k].aot - r.aot) + abs(levels[k].tcwv - r.tcwv) for k, r in rows.items()) < 1e-2
    assert not any(r.converged for r in T.retrieve(o, p, bands, models, gamma=0.1, rounds=1).collect())


def test_posterior_chain_equals_dense_inverse(spark):
    d = np.random.default_rng(0).uniform(1, 50, 12)
    chain = 2 * np.eye(12) - np.eye(12, k=1) - np.eye(12, k=-1)
    chain[0, 0] = chain[-1, -1] = 1
    want = np.sqrt(np.diag(np.linalg.inv(np.diag(d) + 4.0 * (chain + np.eye(12)))))
    np.testing.assert_allclose(T.chain_uncertainty(d, 2.0), want, rtol=1e-10)
    assert T.pyramid(20, 12)[-1] == (20, 12) and T.pyramid(20, 12)[0] == (5, 3) and T.pyramid(21, 21)[-3] == (5, 5)


def test_tree_models_on_tables(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    g = np.random.default_rng(1)
    rows = [(1, k, i, j, float(g.uniform(0, 0.2) + (0.5 if i < 8 else 0.0))) for i in range(16) for j in range(16) for k in ("blue", "nir")]
    toa = spark.createDataFrame([(s, k, i, j, v) for s, k, i, j, v in rows], "scene_id int, role string, r int, c int, toa double")
    wide = toa.groupBy("scene_id", "r", "c").pivot("role", ["blue", "nir"]).agg(F.first("toa")).withColumn("label", (F.col("r") < 8).cast("double"))
    train = VectorAssembler(inputCols=["blue", "nir"], outputCol="features").transform(wide)
    cloud = GBTClassifier(maxIter=3, maxDepth=2).fit(train)
    prob = E.cloud_probability(toa, ["blue", "nir"], cloud, 2).collect()
    assert len(prob) == 64 and all((r.cloud_prob > 0.5) == (r.r < 4) for r in prob)
    tree = GBTRegressor(maxIter=3, maxDepth=2).fit(train)
    aot = E.first_guess_aot(wide.drop("label"), ["blue", "nir"], tree, 16, 16).collect()
    assert len(aot) == 256 and all(0 < r.aot < 1.5 for r in aot)
    layers = [(np.eye(2), np.zeros(2)), (np.eye(2), np.zeros(2)), (np.ones((2, 1)) * 5, np.zeros(1))]
    tcwv = E.first_guess_tcwv(wide.drop("label"), ["blue", "nir"], layers, 0.0, 4.0).collect()
    assert all(0 < r.tcwv < 4 for r in tcwv)


def test_small_edges(spark):
    row = spark.range(1).select(
        R.qa_weight(F.lit(255)).alias("fill"), R.ndvi(F.lit(0.0), F.lit(0.0)).alias("none"), R.quantise(F.lit(None).cast("double")).alias("q"), A.wrap180(F.lit(-180.0)).alias("w"),
        P.water(F.lit(None).cast("double"), F.lit(0.1)).alias("water"), P.cloudy(F.lit(None).cast("double")).alias("cloud"), R.elevation(F.lit(float("nan"))).alias("ele"),
        G.tile_id(F.lit(0.9), F.lit(52.6)).alias("tile")).first()
    assert (row.fill, row.none, row.q, row.w, row.water, row.cloud, row.ele, row.tile) == (0.0, None, -9999, 180.0, True, True, 0.0, "h18v03")
    one = image(spark, np.array([[3.0]]))
    assert N.dilate(one.select("scene_id", "r", "c", F.lit(True).alias("mask")), 3).first().mask
    assert not N.erode(one.select("scene_id", "r", "c", F.lit(True).alias("mask")), 1).first().mask


def test_reflectance_sink_round_trip(spark, tmp_path):
    boa = spark.createDataFrame([(1, 2, 0, 0, 0.1234), (1, 2, 0, 1, -0.1), (2, 3, 1, 1, None)], "scene_id int, band int, r int, c int, boa double")
    P.write_reflectance(boa, str(tmp_path / "boa"))
    got = {(r.scene_id, r.band, r.r, r.c): r.boa for r in spark.read.parquet(str(tmp_path / "boa")).collect()}
    assert got == {(1, 2, 0, 0): 1234, (1, 2, 0, 1): -9999, (2, 3, 1, 1): -9999}


def test_many_splines_together(spark):
    import time

    g = np.random.default_rng(4)
    y, w = g.integers(0, 500, (2000, 33)).astype(float), (g.random((2000, 33)) < 0.7).astype(float)
    began = time.time()
    together = S.spline_smooth_many(y, w)
    assert time.time() - began < 30  # one by one these take minutes
    for k in (0, 999, 1999):
        alone = S.spline_smooth(y[k], w[k])
        np.testing.assert_allclose(together[0][k], alone[0], atol=0.05)
        np.testing.assert_allclose(together[1][k], alone[1], atol=1e-3)
    rows = [(0, y[0].tolist(), w[0].tolist()), (1, None, None), (2, y[1, :20].tolist(), w[1, :20].tolist()), (3, [], []), (4, [1.0, None, 3.0], [1.0, 1.0, 1.0])]
    got = {r.k: r for r in S.smooth_splines(spark.createDataFrame(rows, "k int, v array<double>, w array<double>"), "v", "w").collect()}
    assert got[1].v is None and got[1].s is None and got[3].v == [] and got[4].v_w[1] == 0
    for k, n in ((0, 33), (2, 20)):
        np.testing.assert_allclose(got[k].v, S.spline_smooth(y[k // 2, :n], w[k // 2, :n])[0], atol=0.05)


def test_smoothing_sends_each_cell_once_a_pass(spark):
    g = np.random.default_rng(8)
    a = g.normal(size=(6, 9))
    a[2, 3:6] = np.nan
    a[:, 0] = np.nan
    out = N.smooth(image(spark, a), 1.0, 1.0, 6, 9, reach=1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row for each tap of the kernel
    w = np.exp(-0.5 * np.arange(-1, 2) ** 2)

    def one(v):
        p = np.pad(v, 1, "symmetric")
        near = np.stack([p[k:k + len(v)] for k in range(3)])
        return np.where(np.isnan(near).all(0), np.nan, np.nansum(near * (w / w.sum())[:, None], 0))

    want = np.apply_along_axis(one, 1, np.apply_along_axis(one, 0, a))
    np.testing.assert_allclose(back(out, "dn", a.shape), want, atol=1e-12)


def test_width_costs_send_no_taps_and_meet_across_tiles(spark, monkeypatch):
    g = np.random.default_rng(12)
    img = image(spark, g.normal(size=(30, 30)))
    at = [(int(i), int(j)) for i, j in g.integers(0, 30, (40, 2))]
    points = spark.createDataFrame([(1, i, j, float(g.normal())) for i, j in dict.fromkeys(at)], "scene_id int, hx int, hy int, boa double")
    tried = spark.createDataFrame([(1, k, 1.0 + k / 4, 2.0, 10.0 * k, 2.0 - k, k - 1.0) for k in range(4)], "scene_id int, k long, std_row double, std_col double, angle double, xs double, ys double")
    bounds = ((1.0, 2.0), (1.0, 2.0), (0.0, 30.0), (-1.0, 2.0), (-1.0, 2.0))
    held = {(r.r, r.c): r.dn for r in img.collect()}
    want = {}
    for q in tried.collect():
        pairs = []
        for p in points.collect():
            taps = [(w, held[t]) for i, j, w in N.gaussian(q.std_row, q.std_col, q.angle) if (t := (p.hx + int(q.xs) + i, p.hy + int(q.ys) + j)) in held]
            if taps:
                pairs.append((sum(w * v for w, v in taps) / sum(w for w, _ in taps), p.boa))
        want[q.k] = abs(1 - np.corrcoef(*zip(*pairs, strict=True))[0, 1])
    for side in (64, 7):
        monkeypatch.setattr(X, "WIDTH_TILE", side)
        costs = X._width_costs(X._width_tiles(points, img, bounds, "dn"), tried)
        assert "Generate" not in costs._jdf.queryExecution().executedPlan().toString()
        got = {r.k: r.cost for r in costs.collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)


def test_designs_run_over_batches(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "i long")
    out = X.design(df, "i", 50, [(0.0, 50.0)], 1)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.x0 for r in out.collect()}
    assert got.pop(None) is None and sorted(int(v) for v in got.values()) == list(range(50))
