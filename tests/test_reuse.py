"""Reuse of written tables: the same inputs are read back, changed ones are built anew."""

import os
import time

from pyspark.sql import functions as F

from rasterloom.storage import fingerprint, reused


def test_key_follows_schema_plan_and_files(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(100).write.parquet(source)
    made = lambda: spark.read.parquet(source).where("id % 2 = 0").select((F.col("id") * 2).alias("x"))
    first = reused(made(), root, "even")
    places = lambda: sorted(x for x in os.listdir(f"{root}/even"))
    one = places()
    assert first.count() == 50 and len(one) == 1 and not one[0].startswith(".")
    stamp = os.path.getmtime(f"{root}/even/{one[0]}/_SUCCESS")
    assert reused(made(), root, "even").count() == 50 and places() == one and os.path.getmtime(f"{root}/even/{one[0]}/_SUCCESS") == stamp
    assert fingerprint(made()) == fingerprint(made())
    others = {fingerprint(made(), "2"), fingerprint(made().withColumnRenamed("x", "y")), fingerprint(spark.read.parquet(source).where("id % 3 = 0").select((F.col("id") * 2).alias("x")))}
    assert len(others | {fingerprint(made())}) == 4
    time.sleep(0.02)
    spark.range(100, 110).write.mode("append").parquet(source)
    assert reused(made(), root, "even").count() == 55 and len(places()) == 2


def test_a_partial_table_is_not_seen(spark, tmp_path):
    df = spark.range(5).toDF("x")
    place = tmp_path / "kept" / "t" / fingerprint(df)
    os.makedirs(tmp_path / "kept" / "t" / ".draft-lost")  # what a writer left that died
    assert reused(df, str(tmp_path / "kept"), "t").count() == 5 and (place / "_SUCCESS").exists()


def test_discarded_tables_are_gone(spark):
    from rasterloom.storage import checkpointed, discard

    kept = checkpointed(spark.range(3), "kept")
    old = checkpointed(kept, "old")
    assert os.path.isdir(old.written_at.removeprefix("file:"))
    discard(old, spark.range(1))
    assert not os.path.exists(old.written_at.removeprefix("file:")) and kept.count() == 3
