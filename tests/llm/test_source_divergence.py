"""Divergences of sources against plain Python over every pair and term, and the quadrant tree by itself."""

import random
import re

import numpy as np
import pytest

from rasterloom.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string"


def brute(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        terms = {t for d in mine for t in d[2]}
        kept = {t for t in terms if sum(t in d[2] for d in mine) >= min_docs}
        sources = sorted({d[1] for d in mine})
        n = {s: {t: sum(d[2].count(t) for d in mine if d[1] == s) for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}

        def share(counts):
            total = sum(counts.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c + 2) // total for t, c in counts.items()}

        p, q = {s: share(n[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1)]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    pool = [f"{a}{b}" for a in ("alpha", "Élan", "βeta", "Zo") for b in "abcdefgh"]
    return [" ".join(r.choices(pool[: 4 + 3 * (i % 9)], k=r.randint(0, 30))) + "-x9'" for i in range(n)]


def compare(spark, rows, min_docs=2, top=3, parts=3):
    got = S.diverge(spark.createDataFrame(rows, SCHEMA).repartition(parts), min_docs, top).collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs, top)
    return got


def test_equals_plain_python(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], f"s{i % 7}" if i % 5 else None, "v", "r") for i, t in enumerate(texts(1, 60))]
    rows += rows[:4]  # repeated rows are documents of their own
    rows += [(100, None, "en", "empty", "v", "r"), (101, "", "xx", "only", "v", "r"), (102, "12 34", "xx", "other", "v", "r"), (None, "alphaa alphaa", "en", "s1", "v", "r")]
    rows.append((200, "Alphaa " * 20_000 + "é" * 50_000, "en", "s2", "v", "r"))
    compare(spark, rows)


def test_many_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 2)
    monkeypatch.setattr(S, "TERMS", 5)
    rows = [(i, t, "en", f"s{i % 7}", "v", "r") for i, t in enumerate(texts(2, 40))]
    got = compare(spark, rows)
    assert sum(r.part == "pair" for r in got) == 42


def test_ties_go_by_bytes(spark):
    rows = [(i, "same words here", "en", s, "v", "r") for i, s in enumerate(["b", "a", "é", "Z"])]
    got = compare(spark, rows)
    assert [r.item for r in sorted(got, key=lambda r: r["rank"]) if r.part == "pair" and r.source == "b"] == ["Z", "a", "é"]


def test_empty_table(spark):
    assert S.diverge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(9 * 10**13, 10**14, 12345)], "n long, t long, v long")
    assert df.select(S.share(F.col("n"), F.col("t"), F.col("v"))).first()[0] == 1 + 10**9 * (9 * 10**13 + 2) // (10**14 + 2 * 12345)


@pytest.mark.parametrize("shape", [(1, 1), (5, 40), (9, 8), (3, 200)])
def test_tree_visits_every_leaf_that_holds_a_count(shape):
    r = np.random.default_rng(3)
    m = r.random(shape) < 0.05
    tree = S.QuadTree(*np.nonzero(m), shape)
    every = np.arange(shape[0])
    got = {(int(a), int(b), int(c)) for x in tree.leaves(every, every) for a, b, c in zip(*x, strict=True)}
    blocks = [m[:, k : k + S.LEAF].any(1) for k in range(0, shape[1], S.LEAF)]
    assert got == {(a, b, c) for a in every for b in every for c, any_ in enumerate(blocks) if a < b and (any_[a] or any_[b])}
