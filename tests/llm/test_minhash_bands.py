"""Links between members of a bucket that no star proposes."""

import numpy as np

from rasterloom.llm import minhash


def small_link_with_unlike_sketches():
    """8 words and their first 7: 5 and 4 shingles of four words, a link of similarity 0.8 that few bins show."""
    r = np.random.default_rng(0)
    while True:
        w = [f"w{x}" for x in r.integers(0, 10**6, 8)]
        a, b = minhash.shingle_sets([" ".join(w), " ".join(w[:7])], 4)
        if (minhash.sketch(a) == minhash.sketch(b)).mean() < 0.8 - 5 * (0.16 / minhash.BINS) ** 0.5:
            return " ".join(w), " ".join(w[:7])


def test_every_band_and_unlike_sketches_count(spark):
    long, short = small_link_with_unlike_sketches()
    rows = [(1, "some words that are nowhere else at all here"), (2, long), (3, short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {i: len(s) for (i, _), s in zip(rows, minhash.shingle_sets([t for _, t in rows], 4), strict=True)}
    labels = spark.createDataFrame([(i, i) for i in sizes], "v long, label long")
    low = minhash.residual_sets(docs, 4)
    sketches = minhash.sketches(docs, 4)
    if "bytes" in sketches.columns:
        low = low.join(sketches.select("doc_id", "bytes"), "doc_id")
    for band in (0, 30):
        buckets = spark.createDataFrame([(77, band, i, n) for i, n in sizes.items()], "key long, band int, doc_id long, n long")
        assert [tuple(x) for x in minhash.cross_pairs(buckets, labels, low, 80).collect()] == [(3, 2)]
