"""Exact percentiles by rank selection against numpy, with ties, hot values and odd groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import pixels as P


@pytest.fixture(scope="module")
def groups():
    g = np.random.default_rng(8)
    return {1: g.normal(size=3001), 2: np.repeat(7.5, 2000), 3: np.concatenate([np.zeros(5000), g.normal(size=10)]), 4: np.array([4.0]), 5: np.array([1.0, 2.0]), 6: g.integers(0, 5, 999).astype(float), 7: np.array([np.inf, -np.inf, 0.0])}


def table(spark, groups):
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(1, None), (8, None)]
    return spark.createDataFrame(rows, "k int, v double").repartition(5)


def test_equals_numpy(spark, groups):
    at = (0.0, 0.05, 0.5, 0.951, 1.0)
    got = {r.k: r for r in P.percentiles(table(spark, groups), ["k"], "v", at).collect()}
    assert set(got) == {*groups, 8} and set(got[8][1:]) == {None}
    for k, v in groups.items():
        if k != 7:
            np.testing.assert_allclose(got[k][1:], np.percentile(v, [100 * a for a in at]), rtol=1e-12, atol=1e-12)


def test_median_and_empty_table(spark, groups):
    df = table(spark, groups)
    out = P.replace_by_median(df.where("k = 1"), ["k"], "v", F.col("v") > 0)
    v = groups[1]
    assert sorted(r.v for r in out.collect()) == pytest.approx(sorted(np.where(v > 0, v, np.median(v[v > 0])).tolist() + [np.median(v[v > 0])]))
    assert P.percentiles(df.where("k < 0"), ["k"], "v").collect() == []


def test_no_task_holds_a_group(spark, groups):
    """The plan has no percentile buffer and no collected list; a frequent value travels as one row a task."""
    plan = P.percentiles(table(spark, groups), ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_" not in plan
