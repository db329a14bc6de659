"""A table that was written leaves no shuffle files behind."""

import os

from pyspark.sql import functions as F

from rasterloom.llm.common import _CLEAN, materialize


def test_written_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def held() -> set:
        return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}

    before, usual = held(), spark.conf.get(_CLEAN)
    df = spark.range(20000).repartition(4, "id").groupBy((F.col("id") % 5000).alias("k")).count()
    out = materialize(df, "counts")
    assert held() <= before
    assert spark.conf.get(_CLEAN) == usual
    assert out.count() == df.count() == 5000 and out.agg(F.sum("count")).first()[0] == 20000
