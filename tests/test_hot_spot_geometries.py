"""The hot-spot search sees each geometry of a key once, however many samples share it."""

import numpy as np
import pytest

from rasterloom.operators import kernel_fit as K


def test_samples_of_one_geometry_go_as_one(spark):
    g = np.random.default_rng(8)
    seen = [tuple(map(float, (g.uniform(-50, 50), g.uniform(20, 50), g.uniform(0, 360)))) for _ in range(40)]
    rows = [(p, *seen[k], float(g.uniform(0.1, 0.5))) for p in (1, 2) for k in range(40) for _ in range(25)]
    s = spark.createDataFrame(rows, "pixel int, vza double, sza double, raa double, refl double").repartition(3)
    grid = K.hot_spot_grid(spark, 10)
    best = K.hot_spot_search(s, ["pixel"], grid)
    fits = {(r.pixel, x.xi): r.rmse for x in grid.collect() for r in K.fit(K.with_kernels(s, hot_spot=x.xi), ["pixel"]).collect()}
    for r in best.collect():
        assert r.rmse == pytest.approx(min(v for (p, _), v in fits.items() if p == r.pixel), rel=1e-9)
    plan = best._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "vza" in below and "HashAggregate(keys=[pixel" in below.replace("knownfloatingpointnormalized(", "")
