"""The discriminant against log densities worked out in full, and its edge rows."""

import numpy as np
import pytest

from rasterloom.llm import quality_classifier as Q


def brute_scores(x, labels, to_pooled=0.6, to_diagonal=0.3):
    d = x.shape[1]
    known = [x[labels == c] for c in (0, 1)]
    spread = [(k - k.mean(0)).T @ (k - k.mean(0)) for k in known]
    pooled = sum(spread) / sum(map(len, known))
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
    log = []
    for c in (0, 1):
        own = (1 - to_pooled) * len(known[c]) / (len(known[c]) + d)
        s = own * spread[c] / len(known[c]) + (1 - own) * pooled
        u = x - known[c].mean(0)
        log.append(np.log(len(known[c]) / sum(map(len, known))) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", u, np.linalg.inv(s), u))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def test_scores_equal_full_densities(spark):
    r = np.random.default_rng(4)
    texts = [" ".join("".join(r.choice(list("abcdeXYZ!,.1"), r.integers(1, 9))) for _ in range(r.integers(0, 60))) for _ in range(160)]
    labels = np.array([int(r.random() < 0.6) for _ in texts])
    rows = [(i, t, 0.5, [1.0]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id int, text string, score double, x array<double>")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id int, quality int")
    got = sorted((r.doc_id, r.score) for r in Q.classify(docs, marks).collect())
    assert len(got) == len(texts) + 1
    x = np.array([Q.statistics(t) for t in [*texts, texts[5]]])
    teach = np.array([labels[i] if not Q.is_held_out(i) else -1 for i in range(len(texts))] + [labels[5] if not Q.is_held_out(5) else -1])
    want = brute_scores(x, teach)
    order = sorted(range(len(want)), key=lambda k: (k if k < len(texts) else 5))
    assert [s for _, s in got] == pytest.approx([want[k] for k in order], abs=1e-6)


def test_triangular_solve():
    r = np.random.default_rng(2)
    f = np.tril(r.normal(size=(9, 9))) + 5 * np.eye(9)
    b = r.normal(size=(9, 4))
    assert np.allclose(f @ Q.forward_substitution(f, b), b)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, None), (2, None)], "doc_id long, text string")
    assert Q.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 3
