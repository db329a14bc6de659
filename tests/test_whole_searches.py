"""The registered searches over their whole range, against planted values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernel_fit as K
from rasterloom.plans import relational as Q


def geometry(g, n):
    return g.uniform(-50, 50, n), g.uniform(20, 50, n), g.uniform(0, 360, n)


def test_step_outside_the_middle_of_the_year(spark):
    g = np.random.default_rng(2)
    rows = []
    for d in range(1, 366, 3):
        v, s, a = (float(x[0]) for x in geometry(g, 1))
        # The query makes four bands of refl; the third mirrors it, so a drop raises that one.
        rows.append((d, 7, d, v, s, a, (0.4 if d <= 70 else 0.2) + float(g.normal(0, 1e-4))))
    s = spark.createDataFrame(rows, "sample_id long, pixel int, doy int, vza double, sza double, raa double, refl double")
    assert Q.step_day(s).first().dos == 70


def test_step_sums_equal_direct_sums(spark):
    g = np.random.default_rng(3)
    rows = [(p, b, int(d), *map(float, g.normal(size=3))) for p in (1, 2) for b in (0, 1) for d in g.integers(1, 40, 25)]
    s = spark.createDataFrame(rows, "pixel int, band int, doy int, k_vol double, k_geo double, refl double")
    days = spark.createDataFrame([(p, d) for p in (1, 2) for d in (0, 7, 20, 39)], "pixel int, dos int")
    got = {(r.pixel, r.band, r.dos): r for r in K.step_sums(s, ["pixel", "band"], days).collect()}
    assert len(got) == 16
    for (p, b, dos), r in got.items():
        own = np.array([x[2:] for x in rows if x[:2] == (p, b)])
        t = own[:, 0]
        k = np.stack([np.ones(len(t)), own[:, 1], own[:, 2], t, t**2, t**3, (t > dos) * 1.0])
        np.testing.assert_allclose(r.m, (k @ k.T)[np.triu_indices(7)], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(r.v, k @ own[:, 3], rtol=1e-9, atol=1e-9)
        assert (r.rr, r.n) == (pytest.approx((own[:, 3] ** 2).sum()), len(t))


def test_hot_spot_of_a_fine_width(spark):
    g = np.random.default_rng(6)
    rows = [(i, 1, *map(float, x)) for i, x in enumerate(zip(*geometry(g, 150), strict=True))]
    base = spark.createDataFrame(rows, "sample_id long, pixel int, vza double, sza double, raa double")
    truth = 437 * math.radians(10.0) / 1000
    made = K.with_kernels(base, hot_spot=truth).withColumn("refl", 0.3 + 0.2 * F.col("k_vol") + 0.05 * F.col("k_geo")).drop("k_vol", "k_geo")
    assert Q.best_widths(made).first().xi == pytest.approx(truth)


def test_far_shift_and_azimuth_classes(spark):
    g = np.random.default_rng(4)
    coarse = g.uniform(20, 60, (10, 10))
    angles = spark.createDataFrame([(1, i, j, float(coarse[i // 4, j // 4]), 0.0, float(200 + (i * 40 + j) ** 2 % 97.3), 0.0) for i in range(40) for j in range(40)],
                                   "scene_id int, r int, c int, sza double, vza double, saa double, vaa double")
    px = spark.createDataFrame([(1, 4, 4 * i + 30, 4 * j - 41 + 80, float(coarse[i, j])) for i in range(10) for j in range(10)], "scene_id int, band int, r int, c int, dn double")
    got = Q.shift_search(angles, px).first()
    assert (got.xs, got.ys, got.r) == (30, 39, 1.0)
    v = np.array([20 + (i * 40 + j) ** 2 % 97.3 for i in range(40) for j in range(40)])
    n = np.bincount(np.minimum(((v - v.min()) * 1000 / (v.max() - v.min())).astype(int), 999), minlength=1000)
    assert Q.azimuth_mode(angles).first().mode == pytest.approx(v.min() + n.argmax() * (v.max() - v.min()) / 1000, abs=1e-5)
