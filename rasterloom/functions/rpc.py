"""Angles and detector modules from ratios of polynomials, and the active extent of a quadrilateral."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.grid import rational, vector_angles


def location(line: Column, samp: Column, height: Column, num: Column, den: Column) -> Column:
    """A five-term over four-term ratio: where a ground pixel lies on a detector module."""
    top = [F.lit(1.0), line, samp, height, line * samp]
    bottom = [line, samp, height, line * samp]
    a = sum((F.get(num, F.lit(k)) * t for k, t in enumerate(top)), F.lit(0.0))
    return a / sum((F.get(den, F.lit(k)) * t for k, t in enumerate(bottom)), F.lit(1.0))


def find_modules(px: DataFrame, modules: DataFrame) -> DataFrame:
    """Pixels with every module that sees them: (…, module, l1r_line, l1r_samp).

    modules has a row for each detector module of a band (a dozen or so, broadcast): offsets, ratio terms and ranges.
    """
    j = px.crossJoin(F.broadcast(modules))  # pixels x a dozen modules, then a range filter
    line, samp, height = F.col("line") - F.col("line_off"), F.col("samp") - F.col("samp_off"), F.col("height") - F.col("height_off")
    got = j.withColumns({"l1r_line": location(line, samp, height, F.col("line_num"), F.col("line_den")) + F.col("l1r_line_off"),
                         "l1r_samp": location(line, samp, height, F.col("samp_num"), F.col("samp_den")) + F.col("l1r_samp_off")})
    inside = F.col("l1r_line").between(F.col("line_min"), F.col("line_max")) & F.col("l1r_samp").between(F.col("samp_min"), F.col("samp_max"))
    return got.where(inside).select(*px.columns, "module", "l1r_line", "l1r_samp")


def vectors(located: DataFrame, terms: DataFrame) -> DataFrame:
    """Mean zenith and azimuth, in rounded hundredths of degrees, over the one or two modules of each pixel.

    terms(axis, mean, num, den) with axis x, y, z: three rows, broadcast.
    """
    t = F.broadcast(terms.agg(F.map_from_entries(F.collect_list(F.struct("axis", F.struct("mean", "num", "den")))).alias("t")))  # one row
    j = located.crossJoin(t)
    v = {k: rational(F.col("line"), F.col("samp"), F.col("height"), F.col("l1r_line"), F.col("l1r_samp"), F.col("t")[k]["mean"], F.col("t")[k]["num"], F.col("t")[k]["den"]) for k in "xyz"}
    zenith, azimuth = vector_angles(v["x"], v["y"], v["z"])
    return j.withColumns({"zenith": zenith, "azimuth": azimuth}).groupBy("scene_id", "line", "samp").agg(
        F.round(F.avg("zenith") * 100).cast("int").alias("zenith"), F.round(F.avg("azimuth") * 100).cast("int").alias("azimuth"))


def active_extent(lines: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """(line, start, end) of the samples strictly inside the quadrilateral of (line, sample) corners; lines it misses are dropped."""
    edges = F.array(*[F.struct(F.lit(float(a[0])).alias("y1"), F.lit(float(a[1])).alias("x1"), F.lit(float(b[0])).alias("y2"), F.lit(float(b[1])).alias("x2"))
                      for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    y = F.col("line").cast("double")
    e = lines.select("line", F.explode(edges).alias("e")).where((y >= F.least("e.y1", "e.y2")) & (y <= F.greatest("e.y1", "e.y2")) & (F.col("e.y1") != F.col("e.y2")))
    x = F.col("e.x1") + (y - F.col("e.y1")) * (F.col("e.x2") - F.col("e.x1")) / (F.col("e.y2") - F.col("e.y1"))
    return e.groupBy("line").agg((F.floor(F.min(x)) + 1).cast("int").alias("start"), (F.ceil(F.max(x)) - 1).cast("int").alias("end")).where("start <= end")
