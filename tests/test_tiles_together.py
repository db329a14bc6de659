"""Tiles of many scenes solved side by side, and observations that stay where they lie."""

import numpy as np
import pandas as pd

from rasterloom.operators import retrieval as T
from rasterloom.storage import bucketed, discard


def tiles():
    g = np.random.default_rng(5)
    out = []
    for scene, (ni, nj) in enumerate([(8, 8), (1, 1), (3, 9), (8, 8), (2, 5)]):
        for i in range(ni):
            for j in range(nj):
                if g.uniform() < 0.9:
                    a, b, c = g.uniform(1, 50, 3)
                    out.append((scene, i, j, 0, 0, 0.2, 2.0, 0.2, 2.0, 0.4, 1.0, a, min(a, c) * 0.3, c, *(g.normal(size=2) * 20), b, int(g.integers(0, 9))))
    names = "scene_id bi bj ti tj aot tcwv aot_prior tcwv_prior aot_unc tcwv_unc h00 h01 h11 g0 g1 cost n".split()
    return pd.DataFrame(out, columns=names)


def test_tiles_together_equal_tiles_alone():
    rows = tiles()
    cut = [rows.iloc[k : k + 7] for k in range(0, len(rows), 7)]
    groups = list(T._batches_of_tiles(iter(cut)))
    assert sum(map(len, groups)) == len(rows)
    whole = {s: len(x) for s, x in rows.groupby("scene_id")}
    assert all(len(x) == whole[s] for p in groups for s, x in p.groupby("scene_id"))
    key, values = ["scene_id", "bi", "bj"], ["d_aot", "d_tcwv", "part"]
    together = T._tile_steps(rows, 64, 16, 2.0).sort_values(key)
    alone = pd.concat([T._tile_steps(x, 64, 16, 2.0) for _, x in rows.groupby("scene_id")]).sort_values(key)
    np.testing.assert_allclose(together[values], alone[values], atol=1e-7)
    assert (together["aot"] + together["d_aot"]).between(0.001 - 1e-9, 2.5 + 1e-9).all()


def test_rounds_do_not_send_observations(spark):
    obs = spark.createDataFrame([(1, 0, 0, b, 0.2, 0.15, 0.05) for b in (1, 2)], "scene_id int, bi int, bj int, band int, toa double, boa double, unc double")
    blocks = spark.createDataFrame([(1, 0, 0, 0.9, 1.0, 1.0, 0.2, 2.0, 0.3, 0.0)], "scene_id int, bi int, bj int, cos_sza double, cos_vza double, cos_raa double, aot double, tcwv double, tco3 double, ele double")
    weights = spark.createDataFrame([(1, 0.5), (2, 0.5)], "band int, bw double")
    held = bucketed(obs, [*T.BLOCK, "band"], "observations")
    sums = T.normal_sums(held, blocks, weights, [1, 2], T.linear_models([1, 2]))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning(scene_id" in plan and "SortMergeJoin" not in plan
    assert sums.select("n").first().n == 2
    discard(held)
    assert not [t for t in spark.catalog.listTables() if t.name == held.named]
