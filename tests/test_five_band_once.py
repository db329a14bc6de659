"""A line of a five-band file is made and split once, whatever the conditions on its words."""

from pyspark.sql import functions as F

from rasterloom.sources import scenes as M


def test_line_is_split_once(spark):
    made = spark.range(3).select(F.lit("p").alias("path"), F.col("id").alias("line_no"), F.concat_ws(" ", *[(F.col("id") + k).cast("string") for k in range(11)]).alias("line"))
    out = M.five_band(made)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("concat_ws(") == 1
    assert sorted(tuple(r) for r in out.where("line_no = 2").collect()) == [("p", 2, 6.0, 4.0, 7.0, b, 8.0 + b) for b in range(5)]


def test_odd_lines(spark):
    lines = ["# 1 2 3 4 5 6 7 8 9 10", None, "0 1 2 3 4 5 6 7 8 9", "  0 1 30 3 x 50\t6 7 bad 9 10 11 12 "]
    rows = spark.createDataFrame([("p", k, line) for k, line in enumerate(lines)], "path string, line_no long, line string")
    got = sorted((tuple(r) for r in M.five_band(rows).collect()), key=lambda r: r[5])
    assert got == [("p", 3, None, 30.0, 50.0, b, v) for b, v in enumerate([6.0, 7.0, None, 9.0, 10.0])]
    layout = M.five_band(rows, 2).first()
    assert (layout.vza, layout.sza, layout.raa) == (30.0, None, 47.0)
