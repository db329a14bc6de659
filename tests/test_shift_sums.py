"""Sums of all shifts by Fourier transforms against the direct join."""

import numpy as np

from rasterloom.operators import psf as X


def test_sums_equal_the_direct_join(spark):
    g = np.random.default_rng(9)
    half, points, image = 6, [], []
    for scene, (n, m) in ((1, (70, 45)), (2, (9, 9))):
        image += [(scene, r, c, None if g.random() < 0.1 else float(g.uniform(0, 9000))) for r in range(n) for c in range(m)]
        points += [(scene, int(g.integers(-3, n + 3)), int(g.integers(-3, m + 3)), float(g.uniform(0, 1))) for _ in range(60)]
    points += points[:5] + [(1, 3, 3, None), (3, 1, 1, 0.5)]
    p = spark.createDataFrame(points, "scene_id int, hx int, hy int, boa double")
    i = spark.createDataFrame(image, "scene_id int, r int, c int, dn double")
    sums = {(r.scene_id, r.xs, r.ys): r for r in X.window_sums(p, i, half).collect()}
    direct = {(r.scene_id, r.xs, r.ys): r for r in X.window_correlations(p.where("boa is not null"), i, half).collect()}
    assert sums.keys() == direct.keys() and len(direct) > 200
    for k, d in direct.items():
        s = sums[k]
        assert s.n == d.n
        if d.r is not None and s.n > 2:
            got = (s.vb - s.v * s.b / s.n) / np.sqrt((s.vv - s.v**2 / s.n) * (s.bb - s.b**2 / s.n))
            assert abs(got - d.r) < 1e-6
    best = {r.scene_id: (r.xs, r.ys) for r in X.search_shift(p, i, half, accept=-2.0).collect()}
    assert best == {r.scene_id: (r.xs, r.ys) for r in X.best_shift(X.window_correlations(p, i, half), -2.0).collect()}
