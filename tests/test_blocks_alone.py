"""Retrieval without smoothness: all rounds of a block inside one task, with the answers of the rounds over sums."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.operators import retrieval as T

NAMES, TOL = [1, 2, 3], 1e-8
PRIOR = "scene_id int, bi int, bj int, cos_sza double, cos_vza double, cos_raa double, ele double, tco3 double, aot_prior double, tcwv_prior double, aot_unc double, tcwv_unc double"


def scenes(spark):
    """Two scenes whose blocks have no, one or many observations, some of them with nulls; and observations of a block that is not there."""
    g = np.random.default_rng(7)
    obs, prior = [(9, 1, 0, 0, 0.3, 0.2, 0.01)], []
    for s in (1, 2):
        for i in range(3):
            for j in range(3):
                prior.append((s, i, j, 0.8, 0.95, 0.3, 0.0, 0.3, 0.2, 2.0, 0.4, 1.0))
                aot, tcwv, n = 0.3 + 0.9 * i, 2.5 + 3 * j, (0, 1, 2, 7)[(3 * i + j) % 4]
                for k in range(n):
                    b = 1 + k % 3
                    toa = float(g.uniform(0.05, 0.5))
                    y = (1.1 + 0.3 / b * aot + 0.02 * b * tcwv) * toa - 0.01 - 0.12 / b * aot
                    obs.append((s, b, i, j, None if k == 5 else toa, None if k == 4 else float(y / (1 + (0.05 + 0.1 / b * aot) * y)), 0.01))
    bands = spark.createDataFrame([(1, 469), (2, 645), (3, 859)], "band int, wavelength_nm int")
    o = spark.createDataFrame(obs, "scene_id int, band int, bi int, bj int, toa double, boa double, unc double")
    return o, spark.createDataFrame(prior, PRIOR), bands


def values(df):
    got = {(r.scene_id, r.bi, r.bj): (r.aot, r.tcwv) for r in df.collect() if r.converged}
    assert len(got) == 18
    return got


def test_no_round_is_written_and_large_blocks_give_the_same(spark, monkeypatch):
    o, p, bands = scenes(spark)
    models, written, kept = T.linear_models(NAMES), [], T.checkpointed
    monkeypatch.setattr(T, "checkpointed", lambda df, name: written.append(name) or kept(df, name))
    alone = T.retrieve(o, p, bands, models, gamma=0.0, tol=TOL)
    assert sorted(written) == ["blocks", "moves", "start"]
    first = p.withColumns({"aot": F.col("aot_prior"), "tcwv": F.col("tcwv_prior")})
    coupled = T._retrieve_coupled(o, first, bands, NAMES, models, 0.0, 60, TOL, T.TILE, T.HALO)
    del written[:]
    split = T._retrieve_alone(o, first, bands, NAMES, models, 60, TOL, at_once=4, alone=2)  # the blocks of seven take the other way
    assert "steps" in written and alone.columns == coupled.columns == split.columns
    want = values(coupled)
    for got in (values(alone), values(split)):
        np.testing.assert_allclose([got[k] for k in sorted(want)], [want[k] for k in sorted(want)], atol=1e-6)
    assert want[1, 0, 0] == (0.2, 2.0) and max(abs(np.subtract(v, (0.2, 2.0))).max() for v in want.values()) > 0.5


def test_a_block_that_has_not_arrived_says_so(spark):
    o, p, bands = scenes(spark)
    got = T.retrieve(o, p, bands, T.linear_models(NAMES), gamma=0.0, tol=TOL, rounds=1).collect()
    assert len(got) == 18 and not any(r.converged for r in got)


def rows(key):
    """Own rows and observations of four blocks, one by one, with key(block)."""
    g, out = np.random.default_rng(2), []
    for k in range(4):
        out.append(dict(scene_id=1, bi=k, bj=0, band=None, toa=None, boa=None, w=None, own=[0.8, 0.9, 0.3, 0.2, 2.0, 0.3, 0.0, 0.2, 2.0, 0.4, 1.0], key=key(k)))
        out += [dict(scene_id=1, bi=k, bj=0, band=1 + n % 3, toa=float(t), boa=float(0.6 * t), w=900.0, own=None, key=key(k)) for n, t in enumerate(g.uniform(0.1, 0.5, 5))]
    kinds = [("scene_id", pa.int32()), ("bi", pa.int32()), ("bj", pa.int32()), ("band", pa.int32()), *[(k, pa.float64()) for k in ("toa", "boa", "w")], ("own", pa.list_(pa.float64())), ("key", pa.int64())]
    return out, pa.schema(kinds)


def test_blocks_of_one_hash_are_told_apart():
    models, got = T.linear_models(NAMES), []
    for key in (lambda k: k, lambda k: 5):
        r, kinds = rows(key)
        if key(0) == key(1):
            r = [r[k] for k in np.random.default_rng(3).permutation(len(r))]
        t = T._solved_blocks(pa.Table.from_pylist(r, kinds), NAMES, models, 60, TOL, 100)
        got.append(t.sort_by("bi").select(["bi", "aot", "tcwv"]).to_pandas().to_numpy())
    np.testing.assert_allclose(*got, atol=1e-9)
    assert len(got[0]) == 4 and len(set(got[0][:, 1])) == 4


def test_batches_keep_blocks_whole_and_large_ones_short():
    r, kinds = rows(lambda k: k)
    batches = [pa.RecordBatch.from_pylist(r[k : k + 5], kinds) for k in range(0, len(r), 5)]
    parts = list(T._whole_blocks(iter(batches), 4, 100))
    assert sum(map(len, parts)) == 24 and len(parts) > 1
    assert sum(len(set(t["bi"].to_pylist())) for t in parts) == 4
    short = list(T._whole_blocks(iter(batches), 4, 2))
    assert sum(t["own"].null_count for t in short) < 20 and sum(len(t) - t["own"].null_count for t in short) == 4
    solved = pa.concat_tables([T._solved_blocks(t, NAMES, T.linear_models(NAMES), 60, TOL, 2) for t in short])
    assert solved["large"].to_pylist() == [True] * 4


def test_steps_are_the_minimum_within_bounds():
    g = np.random.default_rng(1)
    a, c = g.uniform(1, 20, (2, 400))
    b, grad = np.sqrt(a * c) * g.uniform(-0.9, 0.9, 400), g.normal(0, 15, (2, 400))
    low, high = -g.uniform(0, 1, (2, 400)), g.uniform(0, 1, (2, 400))
    d = T._bounded_steps(grad, a, b, c, low, high)
    cost = lambda p, q: p * grad[0] + q * grad[1] + (a * p * p + 2 * b * p * q + c * q * q) / 2
    assert ((d >= low) & (d <= high)).all()
    for u in np.linspace(0, 1, 21):
        for v in np.linspace(0, 1, 21):
            assert (cost(*d) <= cost(low[0] + u * (high[0] - low[0]), low[1] + v * (high[1] - low[1])) + 1e-9).all()
    # Where nothing is known the block stays; where one direction is, the step takes it.
    still = T._bounded_steps(np.zeros((2, 1)), *np.zeros((3, 1)), np.full((2, 1), -1.0), np.full((2, 1), 1.0))
    assert (still == 0).all()
