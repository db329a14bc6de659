"""Pixel-table operators: scans, composites, masks, filters and scene summaries.

px(scene_id, band, r, c, dn) is the long pixel table; bands(band, role, wavelength_nm, scale,
off) has a few dozen rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import radiometry as R
from rasterloom.storage import checkpointed

CELL = ("scene_id", "r", "c")
ROLES = ("coastal", "blue", "green", "red", "nir", "swir1", "swir2")
MIN_TOA = 1e-4


def scan(px: DataFrame, bands: list[int] | None = None, scenes: list[int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of some bands, scenes and a row/column window; all filters reach the file scan. No-data becomes null."""
    out = px
    for name, values in (("band", bands), ("scene_id", scenes)):
        if values is not None:
            out = out.where(F.col(name).isin(values))
    for name, span in (("r", rows), ("c", cols)):
        if span is not None:
            out = out.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    return out.withColumn("dn", R.present(F.col("dn")))


def calibrated(px: DataFrame, bands: DataFrame) -> DataFrame:
    """px with role and toa."""
    return px.join(F.broadcast(bands), "band").withColumn("toa", R.calibrate(F.col("dn"), F.col("scale"), F.col("off")))


def sun_calibrated(px: DataFrame, bands: DataFrame, angles: DataFrame) -> DataFrame:
    """px with toa under the sun zenith of each pixel: scale and offset over its cosine."""
    joined = px.join(F.broadcast(bands), "band").join(angles.select(*CELL, "sza"), [*CELL])
    return joined.withColumn("toa", R.sun_calibrate(F.col("dn"), F.col("scale"), F.col("off"), F.col("sza")))


def composite(toa: DataFrame, roles: tuple[str, ...] = ROLES, value: str = "toa") -> DataFrame:
    """One row a pixel with a column for each role: one aggregation, no pivot pass over the values."""
    return toa.groupBy(*CELL).agg(*[F.max(F.when(F.col("role") == r, F.col(value))).alias(r) for r in roles])


def valid_in_all(wide: DataFrame, roles: tuple[str, ...] = ROLES, least: float = MIN_TOA) -> DataFrame:
    """wide plus valid: every role present and at least `least`."""
    return wide.withColumn("valid", F.forall(F.array(*roles), lambda x: F.coalesce(x >= least, F.lit(False))))


def valid_cells(toa: DataFrame, least: float = MIN_TOA) -> DataFrame:
    return toa.groupBy(*CELL).agg(F.every(F.coalesce(F.col("toa") >= least, F.lit(False))).alias("valid"))


def water(nir: Column, red: Column) -> Column:
    """Dark or water-like pixels; a null operand counts as water."""
    v = R.ndvi(nir, red)
    return F.coalesce(((v < 0.01) & (nir < 0.11)) | ((v < 0.1) & (nir < 0.05)) | (nir <= MIN_TOA) | (red <= MIN_TOA), F.lit(True))


def water_single(band: Column) -> Column:
    """Where only one infrared band is at hand."""
    return F.coalesce(band < 0.05, F.lit(True))


def snow(green: Column, swir1: Column) -> Column:
    """Snow-like pixels; a null or non-positive operand counts as snow."""
    return F.coalesce((R.ndsi(green, swir1) > 0.42) | (green <= 0) | (swir1 <= 0), F.lit(True))


def snow_single(blue: Column) -> Column:
    return F.coalesce(blue > 0.6, F.lit(True))


def cloudy(prob: Column, limit: float = 0.6) -> Column:
    """Probability above the limit; unknown counts as cloud."""
    return F.coalesce(prob > limit, F.lit(True))


def border(r: Column, c: Column, rows: int | Column, cols: int | Column, width: int = 30) -> Column:
    return (r < width) | (c < width) | (r >= rows - width) | (c >= cols - width)


def bad_pixels(wide: DataFrame, qa: DataFrame, limit: float = 0.6) -> DataFrame:
    """(cell, bad): water, snow, cloud or blue above 1, before erosion and dilation. A pixel without quality row is cloudy."""
    joined = wide.join(qa.select(*CELL, "cloud_prob"), [*CELL], "left")
    bad = water(F.col("nir"), F.col("red")) | snow(F.col("green"), F.col("swir1")) | cloudy(F.col("cloud_prob"), limit) | F.coalesce(F.col("blue") > 1, F.lit(False))
    return joined.select(*CELL, bad.alias("bad"))


def in_range(boa: DataFrame, low: float = 0.001, high: float = 1.0) -> DataFrame:
    """Cells whose reflectance lies in [low, high) in all bands."""
    ok = F.coalesce((F.col("boa") >= low) & (F.col("boa") < high), F.lit(False))
    return boa.groupBy(*CELL).agg(F.every(ok).alias("ok"))


def outlier_filter(pairs: DataFrame, envelopes: DataFrame, low: float = 0.05, high: float = 0.95, accuracy: int | None = None) -> DataFrame:
    """Cells of pairs(cell, band, toa, boa) that pass every band's envelope and its percentile range.

    envelopes(band, lo array, hi array) holds cubic coefficients, highest power first, one row a band.
    The percentiles of toa - boa are taken over what the envelope keeps, per scene and band: exact ones by rank
    selection, or with accuracy approximate ones in one pass.
    """
    def poly(name: str) -> Column:
        return F.aggregate(F.col(name), F.lit(0.0), lambda a, k: a * F.col("boa") + k)

    gap = F.col("toa") - F.col("boa")
    tested = pairs.join(F.broadcast(envelopes), "band").withColumn("gap", gap)
    tested = tested.withColumn("inside", (F.col("gap") >= poly("lo")) & (F.col("gap") <= poly("hi")))
    limits = percentiles(tested.where("inside"), ["scene_id", "band"], "gap", (low, high), accuracy)
    low_name, high_name = (c for c in limits.columns if c not in ("scene_id", "band"))
    # A row for each scene and band, which grows with the scenes: written, so that Spark can split a large scene's side of the join.
    limits = checkpointed(limits, "limits")
    judged = tested.join(limits.hint("merge"), ["scene_id", "band"], "left")
    ok = F.coalesce(F.col("inside") & (F.col("gap") >= F.col(low_name)) & (F.col("gap") <= F.col(high_name)), F.lit(False))
    return judged.groupBy(*CELL).agg(F.every(ok).alias("ok"))


def crop(px: DataFrame, ring: list[tuple[float, float]], x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Pixels whose point lies in a polygon: its bounding box goes to the scan, the even-odd test follows."""
    from rasterloom.functions.grid import inside_ring

    x, y = F.col("c") if x is None else x, F.col("r") if y is None else y
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = (x >= min(xs)) & (x <= max(xs)) & (y >= min(ys)) & (y <= max(ys))
    points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
    return px.where(box).where(inside_ring(x, y, points))


def dense_blocks(obs: DataFrame, least: int = 2) -> DataFrame:
    """Blocks of obs(scene_id, bi, bj, r, c) seen at no fewer than `least` distinct pixels, with their count."""
    return obs.groupBy("scene_id", "bi", "bj").agg(F.count_distinct("r", "c").alias("n_obs")).where(F.col("n_obs") >= least)


def scene_gate(cells: DataFrame, min_good: int = 10, min_passed: int = 3) -> DataFrame:
    """(scene_id, solve): scenes of cells(scene_id, good, passed) with enough to retrieve from."""
    n = cells.groupBy("scene_id").agg(F.count_if("good").alias("n_good"), F.count_if(F.col("good") & F.col("passed")).alias("n_passed"))
    return n.withColumn("solve", (F.col("n_good") > min_good) & (F.col("n_passed") > min_passed))


def solved_or_prior(solved: DataFrame, prior: DataFrame, gate: DataFrame) -> DataFrame:
    """Solutions of scenes that pass the gate, the prior of all others."""
    keep = gate.where("solve").select("scene_id")
    return solved.join(keep, "scene_id", "left_semi").unionByName(prior.join(keep, "scene_id", "left_anti"))


def clear_scenes(qa: DataFrame, limit: float = 0.6) -> DataFrame:
    """Scenes with at least one clear pixel."""
    return qa.where(~cloudy(F.col("cloud_prob"), limit)).select("scene_id").distinct()


def with_clear_pixel(scenes: DataFrame, qa: DataFrame, limit: float = 0.6) -> DataFrame:
    return scenes.join(clear_scenes(qa, limit), "scene_id", "left_semi")


def clean_percent(wide: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """Per scene: pixels, valid and clean shares in percent, and their counts. Clean: valid and neither water, snow nor cloud."""
    bad = water(F.col("nir"), F.col("red")) | snow(F.col("green"), F.col("swir1"))
    df = valid_in_all(wide)
    if qa is not None:
        df = df.join(qa.select(*CELL, "cloud_prob"), [*CELL], "left")
        bad = bad | cloudy(F.col("cloud_prob"))
    n, valid, clean = F.count("*"), F.count_if("valid"), F.count_if(F.col("valid") & ~bad)
    return df.groupBy("scene_id").agg(
        n.alias("n_pixels"), (valid / n * 100).alias("valid_percent"), (clean / n * 100).alias("clean_percent"), valid.alias("n_valid"), clean.alias("n_clean"))


def hundredths(part: str, whole: str) -> Column:
    """A share of counts in percent, cut to hundredths in whole numbers: as a double 116 of 1600 would be 7.24."""
    return F.expr(f"{part} * 10000 div {whole}") / 100


def rgb(wide: DataFrame, colours: tuple[str, str, str] = ("red", "green", "blue"), alpha: tuple[str, str, str] | None = None) -> DataFrame:
    """Byte composite; alpha names the top-of-atmosphere columns that make a pixel opaque."""
    alpha = alpha or colours
    return wide.select(*CELL, *[R.stretch(F.col(c)).alias(f"{c}_byte") for c in colours], R.opaque(*[F.col(a) for a in alpha]).alias("alpha"))


def overview(px: DataFrame, factor: int, value: str = "dn") -> DataFrame:
    """Block means of factor x factor pixels."""
    return px.groupBy("scene_id", "band", F.expr(f"r div {factor}").alias("r"), F.expr(f"c div {factor}").alias("c")).agg(F.avg(value).alias(value))


def percentiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.05, 0.5, 0.95), accuracy: int | None = None) -> DataFrame:
    """Exact, linearly interpolated percentiles p05, p50, ... per key, by selecting the two ranks around each position.

    Distinct values with their counts are dealt into ranges of (key, value); the ranges' totals say in which of them a rank lies, and
    only those ranges are counted through. So a group of any size, or one value of any frequency, never fills a task.
    Nulls do not count, a key without values has null percentiles; keys are not null. With accuracy, approximate ones in one pass.
    """
    names = [f"p{round(100 * a):02d}" for a in at]
    if accuracy:
        got = df.groupBy(*keys).agg(F.percentile_approx(value, list(at), accuracy).alias("p"))
        return got.select(*keys, *[F.col("p")[k].alias(n) for k, n in enumerate(names)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    ranged = checkpointed(counted.repartitionByRange(n, *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, "_part").agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_m"))), F.lit(0)).alias("_n"))
    group = Window.partitionBy(*keys)  # a row for each range that a key touches
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(group)})
    totals = checkpointed(totals, "range-totals")
    position = lambda a: F.lit(float(a)) * (F.col("_total") - 1)
    ranks = F.array(*[r for a in at for r in (F.floor(position(a)), F.ceil(position(a)))])
    picked = totals.withColumn("_slots", F.filter(F.transform(ranks, lambda r, k: F.struct(r.alias("rank"), k.alias("slot"))), lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_n"))))
    picked = checkpointed(picked.where("_total > 0 and size(_slots) > 0").select(*keys, "_part", "_before", "_slots"), "picked-ranges")
    inside = ranged.where("_v is not null").join(picked.hint("merge"), [*keys, "_part"])
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).select(*keys, "_v", "_m", "_upto", F.explode("_slots").alias("_s")).where("_s.rank < _upto and _s.rank >= _upto - _m")
    values = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_s.slot") == k, F.col("_v"))).alias(f"_{k}") for k in range(2 * len(at))])
    whole = totals.groupBy(*keys).agg(F.max("_total").alias("_total")).join(values.hint("merge"), keys, "left")
    weight = lambda a: position(a) - F.floor(position(a))
    between = lambda k, a: F.when(weight(a) == 0, F.col(f"_{2 * k}")).otherwise(F.col(f"_{2 * k}") + weight(a) * (F.col(f"_{2 * k + 1}") - F.col(f"_{2 * k}")))
    return whole.select(*keys, *[between(k, a).alias(n) for k, (a, n) in enumerate(zip(at, names, strict=True))])


def replace_by_median(df: DataFrame, keys: list[str], value: str, ok: Column, accuracy: int | None = None) -> DataFrame:
    """Values that fail ok become the median of those that pass, per key: the exact one, or with accuracy an approximate one in one pass."""
    good = checkpointed(percentiles(df.where(ok), keys, value, (0.5,), accuracy).withColumnRenamed("p50", "_median"), "medians")
    return df.join(good.hint("merge"), keys, "left").withColumn(value, F.when(F.coalesce(ok, F.lit(False)), F.col(value)).otherwise(F.col("_median"))).drop("_median")


def keep_in_bounds(solution: Column, prior: Column, low: float, high: float) -> Column:
    return F.when((solution >= low) & (solution <= high), solution).otherwise(prior)


def ordered_bands(bands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bands of each sensor (keys; all without) by wavelength with their ordinal: an array of a sensor's bands."""
    s = F.array_sort(F.collect_list(F.struct("wavelength_nm", "band", "role")))
    return bands.groupBy(*keys).agg(s.alias("s")).select(*keys, F.posexplode("s").alias("ordinal", "x")).select(*keys, "ordinal", "x.*")


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) of every pair of columns, from one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


def variance_inflation(df: DataFrame, columns: list[str]) -> float:
    """Largest diagonal of the pseudo-inverse of the correlation matrix (a few columns, on the driver)."""
    import numpy as np

    got = {(r.x, r.y): r.r for r in correlation_table(df, columns).collect()}
    return float(np.diag(np.linalg.pinv(np.array([[got[a, b] for b in columns] for a in columns]))).max())


def manifest(outputs: DataFrame, summary: DataFrame, version: str) -> DataFrame:
    """One JSON document a scene from outputs(scene_id, kind, path) and clean_percent's summary."""
    files = outputs.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("kind", "path"))).alias("outputs"))
    doc = F.struct("scene_id", F.lit(version).alias("version"), "valid_percent", "clean_percent", "outputs")
    return files.join(summary, "scene_id").select("scene_id", F.to_json(doc).alias("manifest"))


def footprint(px: DataFrame) -> DataFrame:
    """Corner ring of each scene as JSON."""
    e = px.groupBy("scene_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return e.select("scene_id", F.to_json(F.array(p("c0", "r0"), p("c1", "r0"), p("c1", "r1"), p("c0", "r1"))).alias("ring"))


def write_reflectance(boa: DataFrame, path: str) -> None:
    """Quantised reflectance in the order of scene, band, row and column, in files that are ranges of it, so that windows skip files and pages.

    There are as many files as the rows need, not one for each scene and band, and a large band takes several tasks.
    """
    q = boa.select("scene_id", "band", "r", "c", R.quantise(F.col("boa")).alias("boa"))
    q.repartitionByRange("scene_id", "band", "r", "c").sortWithinPartitions("scene_id", "band", "r", "c").write.mode("overwrite").parquet(path)


POSTERIOR = ("aot", "tcwv", "tco3", "aot_unc", "tcwv_unc", "tco3_unc")


def posterior_layers(blocks: DataFrame) -> DataFrame:
    """Long layers (scene_id, bi, bj, layer, value) of the posterior."""
    return blocks.unpivot(["scene_id", "bi", "bj"], [c for c in POSTERIOR if c in blocks.columns], "layer", "value").withColumn("value", F.col("value").cast(T.FloatType()))
