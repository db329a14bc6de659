"""Components of chains, stars and random graphs, in tasks that cut them anywhere."""

import random

from rasterloom.llm import minhash


def test_components_of_long_chains(spark, monkeypatch):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 3000)
    edges = [(ids[k], ids[k + 1]) for k in range(2000) if k % 500 != 499] + [(ids[rng.randrange(2000, 3000)], ids[rng.randrange(2000, 3000)]) for _ in range(600)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.v: r.label for r in minhash.components(df).collect()} == {x: find(x) for x in root}
    few = [(k + 1, k) for k in range(40)]
    monkeypatch.setattr(minhash, "EDGES_PER_TASK", 15)  # several tasks, and rounds after them
    assert {r.label for r in minhash.components(spark.createDataFrame(few, "a long, b long")).collect()} == {0}


def test_a_large_star_spreads_evenly(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "EDGES_PER_TASK", 20_000)
    edges = spark.range(1, 200_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    out = minhash.contracted(edges).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(out) == 10 and max(r["count"] for r in out) < 22_000 and sum(r["count"] for r in out) == 200_000
