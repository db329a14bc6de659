"""The whole-input queries read every order."""

from rasterloom.plans.registry import FIXTURES, fixture


def test_forecast_reads_every_order(spark, tmp_path):
    rows = [(k, f"2024-01-{k:02d}", float(k)) for k in range(1, 20)]  # no key is a multiple of 20
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderdate string, o_totalprice double")
    orders.selectExpr("o_orderkey", "to_timestamp(o_orderdate) AS o_orderdate", "o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    assert fixture(spark, str(tmp_path), "forecast").count() == 19


def test_manifest_cuts_percentages_in_whole_numbers(spark):
    from rasterloom.plans import relational

    bands = spark.sql(FIXTURES["bands"])
    px = spark.range(1600).selectExpr("1 AS scene_id", "CAST(id DIV 40 AS INT) AS r", "CAST(id % 40 AS INT) AS c", "IF(id < 116, 5000D, 0D) AS dn").crossJoin(bands.select("band"))
    assert '"valid_percent":7.25,' in relational.manifest(px, bands).first().manifest
