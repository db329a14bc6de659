"""Nearest fill at any distance, against brute force."""

import numpy as np

from rasterloom.operators import neighborhood as N


def test_far_cells_take_the_nearest_known_value(spark):
    g = np.random.default_rng(7)
    rows, want = [], {}
    for scene, (h, w, n) in enumerate([(4, 300, 2), (150, 5, 3), (70, 70, 4), (6, 6, 0)]):
        at = {divmod(int(k), w) for k in g.choice(h * w // 4, n, replace=False)}  # all in the upper quarter, the rest is a gap
        known = {(r, c): float(10 * k + scene) for k, (r, c) in enumerate(sorted(at))}
        for r in range(h):
            for c in range(w):
                rows.append((scene, r, c, known.get((r, c))))
                want[scene, r, c] = known[min(known, key=lambda k: ((k[0] - r) ** 2 + (k[1] - c) ** 2, k))] if known else None
    grid = spark.createDataFrame(rows, "scene_id int, r int, c int, dn double")
    got = {(x.scene_id, x.r, x.c): x.dn for x in N.nearest_fill(grid, "dn").collect()}
    assert got == want
    capped = N.nearest_fill(grid.where("scene_id = 1"), "dn", 16).where("dn is null").count()
    assert capped > 0


def test_envelope_is_the_least_parabola_and_linear():
    g = np.random.default_rng(3)
    for _ in range(200):
        n = int(g.integers(1, 30))
        c = sorted(g.choice(60, n, replace=False).tolist())
        d = g.integers(0, 12, n).tolist()
        h = [1000 * x * x + k for k, x in enumerate(d)]
        start, owner = N.envelope(c, h, 1000)
        for x in range(-5, 70):
            k = owner[int(np.searchsorted(np.array(start), x, "right")) - 1]
            assert k == min(range(n), key=lambda i: 1000 * (x - c[i]) ** 2 + h[i])
    wide = list(range(200_000))
    start, owner = N.envelope(wide, [5 * 10**6] * len(wide), 10**6)
    assert len(owner) == len(wide)
