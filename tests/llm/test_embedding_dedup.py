"""Embedding near-dedup against all pairs: no link lost, none invented."""

import math

import numpy as np
import pytest

from rasterloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, label int, component_id string, key string"


def brute(rows, least=E.LEAST_COSINE):
    width = max((len(e) for _, e, *_ in rows if e), default=1)
    unit = {}
    for k, (i, e, label, *_) in enumerate(rows):
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(list(e) + [0.0] * (width - len(e)))
        x /= np.abs(x).max()
        unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if rows[a][0] != rows[b][0] and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= least]
    low = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in rows:
        for a, b in links:
            low[rows[a][0]] = min(low[rows[a][0]], low[rows[b][0]])
    n = {k: len({(rows[b][0], tuple(unit[b])) for a, b in links if a == k}) for k in range(len(rows))}
    return sorted(((r[0], n[k], low.get(r[0]), r[0] is not None and low[r[0]] == r[0]) for k, r in enumerate(rows)), key=repr)


def vectors(seed, n, width=24, labels=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, width))
    x = base[r.integers(0, len(base), n)] + r.normal(size=(n, width)) * r.choice([0.0, 0.02, 0.2, 0.45], (n, 1))
    return [(int(i), (x[i] * r.choice([1, 3])).tolist(), int(r.integers(labels)), "c", "k") for i in range(n)]


def compare(spark, rows, **options):
    got = E.near_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    return got


def test_equals_all_pairs(spark):
    got = compare(spark, vectors(1, 400))
    assert sum(r.n_links > 0 for r in got) > 100


def test_small_blocks_and_few_codes(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_BYTES", 24 * 8 * 7)
    compare(spark, vectors(2, 200, labels=1), fit_rows=20)


def test_odd_rows(spark):
    inf, nan, e = float("inf"), float("nan"), [1.0, 2.0, 3.0]
    rows = [(1, e, 0), (2, [2.0, 4.0, 6.0], 0), (3, e, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, nan, 3.0], 0), (9, [inf, 2.0, 3.0], 0),
            (10, [1e300, 2e300, 3e300], 0), (11, [1e-310, 2e-310, 3e-310], 0), (12, e, 1), (13, [1.0], 0), (14, [1.0, 0.0, 0.0], 0), (15, [-1.0, -2.0, -3.0], 0), (2, [2.0, 4.0, 6.0], 0), (None, e, 0), (16, [1.0, -0.0, 0.0], 0)]
    compare(spark, [(*r, "c", "k") for r in rows])


def test_many_copies_and_a_chain(spark):
    turn = [[math.cos(k * 0.3), math.sin(k * 0.3)] for k in range(15)]
    rows = [(i, [1.0, 0.0], 0, "c", "k") for i in range(500)] + [(1000 + k, t, 0, "c", "k") for k, t in enumerate(turn)]
    got = {r.vec_id: r for r in compare(spark, rows)}
    assert got[0].n_links == 501 and got[1014].component_id == 0 and got[1000].n_links == 501


def test_empty_table(spark):
    assert E.near_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
    got = E.near_embeddings(spark.createDataFrame([(3, None, 1, "c", "k")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(3, 0, 3, True)]


@pytest.mark.parametrize("width", [3, 24, 64])
def test_probes_and_bounds_never_lose_a_near_vector(width):
    r = np.random.default_rng(width)
    x = r.normal(size=(500, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + r.normal(size=x.shape) * 0.3 / np.sqrt(width)
    y /= np.linalg.norm(y, axis=1)[:, None]
    q, reach = E.Quantiser(x, 16), math.sqrt(2 - 2 * E.LEAST_COSINE)
    cell, codes, error, part = q.encode(y)
    near = (x * y).sum(1) >= E.LEAST_COSINE
    assert near.sum() > 100 and q.probes(x, reach)[np.arange(500), cell][near].all()
    d = np.sqrt(np.maximum(np.diag(q.distances(x, cell, codes, part)), 0))
    assert (d[near] <= reach + error[near] + E.SLACK).all()
    held = np.concatenate([b[codes[:, m]] for m, b in enumerate(q.books)], 1) + q.coarse[cell]
    assert np.allclose(d, np.linalg.norm(x - held, axis=1)) and np.allclose(error, np.linalg.norm(y - held, axis=1))


def test_far_clusters_are_not_probed():
    r = np.random.default_rng(1)
    x = np.eye(64)[np.arange(640) % 64] + r.normal(size=(640, 64)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = E.Quantiser(x, 32)
    assert q.probes(x, math.sqrt(2 - 2 * E.LEAST_COSINE)).mean() < 0.5
