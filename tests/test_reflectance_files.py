"""The written reflectance has as many files as its rows need, however many scenes and bands there are."""

import glob

from pyspark.sql import functions as F

from rasterloom.operators import pixels as P


def test_files_do_not_grow_with_scenes(spark, tmp_path):
    cells = spark.range(200 * 7 * 4).select((F.col("id") % 200).cast("int").alias("scene_id"), (F.col("id") % 7 + 1).cast("int").alias("band"), (F.expr("id div 1400") % 2).cast("int").alias("r"), F.expr("int(id div 2800)").alias("c"), (F.col("id") / 10000).alias("boa"))
    path = str(tmp_path / "boa")
    P.write_reflectance(cells, path)
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    assert len(files) <= 4  # the session's shuffle partitions
    keys = ["scene_id", "band", "r", "c"]
    key = F.struct(*keys)
    spans = sorted((tuple(r.a), tuple(r.b)) for f in files for r in [spark.read.parquet(f).agg(F.min(key).alias("a"), F.max(key).alias("b")).first()])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # each a range of its own
    back = spark.read.parquet(path)
    assert back.count() == 5600
    want = cells.select(*keys, F.when(F.col("boa") > 0, F.floor(F.col("boa") * 10000 + 0.5)).otherwise(-9999).cast("short").alias("boa"))
    assert back.select(*keys, "boa").exceptAll(want).isEmpty()
