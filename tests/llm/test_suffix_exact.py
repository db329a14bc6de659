"""Passage dedup where hashes say nothing, where anchors are hot, and for long texts."""

import random

import numpy as np
import pytest

from rasterloom.llm import suffix_dedup

from test_llm_operators import brute_repeats

KEYS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + (passage if i % 2 else "") + f" end {i} " + " ".join(rng.choice(words) for _ in range(20))) for i in range(40)]
    w = "a"
    while len(w) < 4096:
        w += w.translate(str.maketrans("ab", "ba"))
    out += [(50, w), (51, w.translate(str.maketrans("ab", "ba"))), (52, None), (53, ""), (54, "z" * 300), (55, "z" * 51), (7, out[3][1]), (7, out[3][1])]
    out.append((60, " ".join(rng.choice(words) + str(k % 700) for k in range(150_000)) + passage))
    return out


def collected(df):
    return sorted(tuple(r) for r in df.select(*KEYS).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("hot", [2, 20, suffix_dedup.HOT_CONTEXTS])
def test_hot_anchors_change_nothing(docs, hot):
    assert collected(suffix_dedup.remove_repeats(docs, with_text=False, hot_contexts=hot)) == brute_repeats(rows())


def test_equal_hashes_are_settled_by_bytes():
    data = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50 + b"x" * 60, np.uint8)
    start, size = np.array([0, 50, 100, 150]), np.array([50, 50, 50, 60])
    assert suffix_dedup.equal_slices(data, start, size, np.array([1, 2, 3]), np.array([0, 0, 0])).tolist() == [False, True, False]
    # A shard that gets contexts under one hash: two with equal bytes, one with others.
    import pyarrow as pa

    def blob(texts, holders):
        return suffix_dedup._pack(np.full(len(texts), 5, np.uint64), np.full(len(texts), 6, np.uint64), np.array(holders), np.array([len(t) for t in texts], np.int32),
                                  np.frombuffer(b"".join(texts), np.uint8))

    one, other = b"p" * 25 + b"q" * 27, b"r" * 52
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([1, 2], pa.int64()), pa.array([blob([one, other], [9, 4]), blob([one], [3])], pa.binary())], names=["shard", "chunk", "blob"])
    got = {}
    for out in suffix_dedup._sorter(50)(iter([batch])):
        runs, value = suffix_dedup._unpack(out.column(2)[0].as_py())
        got[out.column(0)[0].as_py()] = np.repeat(value, runs).tolist()
    assert got == {1: [3, 3, 3, 4, 4, 4], 2: [3, 3, 3]}
