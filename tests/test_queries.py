"""Every registered query against its SQL on the smallest tables, and the shape of some plans."""

import os

import pytest

from rasterloom.plans import relational, scalar  # noqa: F401
from rasterloom.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-4)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["d02_nearest", "d03_bilinear", "d09_nearest_time", "d14_d15_block_lookup", "d17_seams", "n01_dilate", "n04_n05_psf_average", "n10_smoothness", "r06_correction", "u02_daily_mosaic"])
def test_no_cartesian_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from rasterloom.operators import pixels as P

    px = spark.createDataFrame([(1, 2, 3, 4, 5.0, "x")], "scene_id int, band int, r int, c int, dn double, other string")
    px.write.partitionBy("scene_id", "band").parquet(str(tmp_path / "px"))
    read = P.scan(spark.read.parquet(str(tmp_path / "px")), [2], [1], (0, 10)).select("r", "dn")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(r,0)" in plan and "other" not in plan.split("ReadSchema")[1]
    assert read.count() == 1
