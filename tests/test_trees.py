"""Trees kept as a table against fitted ones and a walk by hand."""

import numpy as np

from rasterloom.operators import trees as Y

ROWS = [(0, 0, 1, 0.5, 1, 2, None), (0, 1, None, None, None, None, 1.0), (0, 2, 0, 3.0, 3, 4, None), (0, 3, None, None, None, None, 2.0), (0, 4, None, None, None, None, 4.0), (1, 0, None, None, None, None, 0.25)]


def test_scores(spark):
    table = spark.createDataFrame(ROWS, "tree int, node int, feature int, threshold double, low int, high int, value double").repartition(3)
    df = spark.createDataFrame([(1, 2.0, 0.5), (2, 3.0, 0.6), (3, 3.1, 0.6), (4, None, 0.6), (5, 9.0, None)], "k int, a double, b double")
    got = {r.k: r.s for r in Y.tree_scores(df, ["a", "b"], Y.load_trees(table), "s").collect()}
    assert got == {1: 1.25, 2: 2.25, 3: 4.25, 4: 2.25, 5: 1.25}


def test_many_trees_by_hand():
    g = np.random.default_rng(2)
    rows = []
    for t in range(20):
        rows += [(t, i, int(g.integers(4)), float(g.normal()), 2 * i + 1, 2 * i + 2, None) for i in range(15)] + [(t, i, None, None, None, None, float(g.normal())) for i in range(15, 31)]
    x = g.normal(size=(50, 4))
    at = {r[:2]: r for r in rows}

    def walk(v, t):
        i = 0
        while at[t, i][2] is not None:
            i = at[t, i][4] if v[at[t, i][2]] <= at[t, i][3] else at[t, i][5]
        return at[t, i][6]

    np.testing.assert_allclose(Y.Trees(rows).score(x), [sum(walk(v, t) for t in range(20)) for v in x])


def test_order_of_a_mean_decides_no_threshold(spark):
    from rasterloom.operators import emulator as E

    # 0.1 + 0.2 + 0.3 over 3 is above 0.2 in this order, and not in the reverse one.
    model = Y.Trees([(0, 0, 0, 0.2, 1, 2, None), (0, 1, None, None, None, None, -1.0), (0, 2, None, None, None, None, 1.0)])
    for values in ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1)):
        toa = spark.createDataFrame([(1, "red", k // 2, k % 2, v) for k, v in enumerate(values)], "scene_id int, role string, r int, c int, toa double").coalesce(1)
        got = E.cloud_probability(toa, ["red"], model, 2).collect()
        assert [round(r.cloud_prob, 6) for r in got] == [0.268941]
