"""Sketches of many paragraphs: every size, the comparison past the last one, and repeated rows."""

import time

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import fingerprint


@pytest.mark.parametrize("levels", [1, 2, fingerprint.LEVELS])
def test_every_size_gives_the_difference(spark, levels):
    rows = [(k, list(range(1000, 1000 + n)), list(range(1000 + m, 1000 + n))) for k, (n, m) in enumerate([(0, 0), (1, 0), (1, 1), (30, 9), (200, 60), (3000, 2900), (9000, 9000)])]
    df = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>")
    a, b = (F.transform(c, lambda x: F.xxhash64(x)) for c in ("a", "b"))
    df = df.select("k", a.alias("a"), b.alias("b")).withColumns({"sa": fingerprint.sketch(F.col("a")), "sb": fingerprint.sketch(F.col("b"))})
    got = df.select("k", fingerprint.differing(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), levels).alias("d")).collect()
    assert [r.d for r in sorted(got)] == [0, 0, 1, 9, 60, 2900, 9000]


def test_peeling_recovers_the_digests(spark):
    df = spark.createDataFrame([(list(range(20)), list(range(12, 30)))], "a array<bigint>, b array<bigint>")
    out = df.select(fingerprint.peel(fingerprint.subtract(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).alias("d")).first().d
    assert sorted(out) == [*range(12), *range(20, 30)]


def test_texts_of_many_lines_and_repeated_rows(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(3, long, 1), (2, long.replace("line 7\n", "line seven\n"), 1), (1, "A sentence. Another one! A third? And the rest; of it.", 1), (1, "A sentence. Another one! A third? And the rest; of it.", 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, d int")
    began = time.time()
    got = sorted((tuple(r) for r in fingerprint.fingerprints(docs).collect()), key=repr)
    assert time.time() - began < 120
    assert len(got) == 5 and got[0] == got[1] and all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got)
    by = {r[0]: r for r in got}
    assert by[3][6] == pytest.approx(19_999 / 20_001) and by[1][5] > 0 and by[None][6] == 0


def test_every_sentence_ends_a_paragraph(spark):
    texts = ["One ends in x. Two ends in z! Three ends in q? Four; five", "第一句话。第二句话！第三句话？完", "Line one\nLine two", "No end"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", F.size(fingerprint.digests(F.col("text"))).alias("n")).collect()}
    assert got == {0: 5, 1: 4, 2: 2, 3: 1}
    near = {r.doc_id: r.near_edited for r in fingerprint.fingerprints(df).collect()}
    assert near[0] > 0 and near[1] > 0
