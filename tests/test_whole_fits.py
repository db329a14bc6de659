"""The fits of the first guess and the cloud probability take every row, and go over the tables once."""

import os

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import emulator as E
from rasterloom.plans import relational as R
from rasterloom.plans.registry import fixture

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def fitted(monkeypatch, name):
    seen = []
    monkeypatch.setattr(E, name, lambda df, *rest: seen.append((df, *rest)) or df)
    return seen


def test_fit_does_not_depend_on_a_sample(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    seen = fitted(monkeypatch, "first_guess_aot")
    # 14,000 cells, more than the 10,000 that the trees would take for their thresholds; three of them are unlike all others.
    n = F.col("id")
    a = spark.range(14000).select((n % 9).cast("int").alias("scene_id"), n.cast("int").alias("r"), F.lit(0).alias("c"), F.when(n < 3, 0.0).otherwise(20 + n % 7).alias("sza"), (n % 5).cast("double").alias("vza"),
                                  F.when(n < 3, 40000.0).otherwise(7.0 * (n % 11)).alias("saa"))
    R.first_guess_aot(a.repartition(3))
    R.first_guess_aot(a.repartition(5, "r"))
    one, two = (s[2] for s in seen)
    x = VectorAssembler(inputCols=["sza", "vza"], outputCol="features")
    rows = x.transform(a.withColumn("label", 0.2 + F.col("saa") / 400))
    whole = GBTRegressor(maxIter=3, maxDepth=3, seed=1, maxBins=120).fit(rows)  # 120 x 120 rows are all of them
    points = x.transform(a.select("sza", "vza").distinct()).orderBy("sza", "vza")
    want, *got = ([r.prediction for r in m.transform(points).orderBy("sza", "vza").collect()] for m in (whole, one, two))
    assert got[0] == got[1] == pytest.approx(want, abs=1e-9)


def test_cloud_fit_reads_written_means(spark, monkeypatch):
    seen = fitted(monkeypatch, "cloud_probability")
    R.cloud_probability(*[fixture(spark, SF, k) for k in ("px", "bands", "qa")])
    means, _, _, ratio = seen[0]
    assert ratio == 1 and not any("lineitem" in f for f in means.inputFiles())
    assert means.groupBy("scene_id", "role", "r", "c").count().where("count > 1").isEmpty()
