"""Joins between grids, times, tiles and bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import grid as G
from rasterloom.storage import checkpointed

CELL = ("scene_id", "r", "c")


def match_bands(sensor: DataFrame, reference: DataFrame, limit: float = 150) -> DataFrame:
    """Nearest reference band of each sensor band within limit nm, ordered by wavelength. Both are band dimensions, so one is broadcast."""
    gap = F.abs(F.col("s.wavelength_nm") - F.col("f.wavelength_nm"))
    near = sensor.alias("s").join(F.broadcast(reference.alias("f")), gap < limit)
    best = near.groupBy(F.col("s.band").alias("band"), F.col("s.wavelength_nm").alias("wavelength_nm")).agg(
        F.min_by(F.struct(F.col("f.band").alias("ref_band"), F.col("f.wavelength_nm").alias("ref_nm")), F.struct(gap, F.col("f.band"))).alias("m"))
    return best.select("band", "wavelength_nm", "m.ref_band", "m.ref_nm").orderBy("wavelength_nm")


def nearest(source: DataFrame, target: DataFrame, ratio: float, value: str = "dn", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Value of the source cell under the middle of each target cell; target cells are `ratio` source cells wide."""
    at = target.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"),
                       F.floor((F.col("r") + 0.5) * ratio).cast("int").alias("r"), F.floor((F.col("c") + 0.5) * ratio).cast("int").alias("c"))
    return at.join(source.select(*keys, "r", "c", value), [*keys, "r", "c"], "left").select(*keys, F.col("_r").alias("r"), F.col("_c").alias("c"), value)


def bilinear(source: DataFrame, target: DataFrame, ratio: float, value: str = "dn", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Four-neighbour interpolation at the middle of each target cell; missing neighbours leave the weights of the others."""
    y, x = (F.col("r") + 0.5) * ratio - 0.5, (F.col("c") + 0.5) * ratio - 0.5
    p = target.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), y.alias("y"), x.alias("x"))
    p = p.withColumns({"r0": F.floor("y").cast("int"), "c0": F.floor("x").cast("int")}).withColumns({"fy": F.col("y") - F.col("r0"), "fx": F.col("x") - F.col("c0")})
    tap = lambda dr, dc: F.struct(
        (F.col("r0") + dr).alias("r"), (F.col("c0") + dc).alias("c"),
        ((F.col("fy") if dr else 1 - F.col("fy")) * (F.col("fx") if dc else 1 - F.col("fx"))).alias("w"))
    taps = p.select(*keys, "_r", "_c", F.explode(F.array(tap(0, 0), tap(0, 1), tap(1, 0), tap(1, 1))).alias("t"))
    taps = taps.select(*keys, "_r", "_c", F.col("t.r").alias("r"), F.col("t.c").alias("c"), F.col("t.w").alias("w")).where("w > 0")
    met = taps.join(source.select(*keys, "r", "c", F.col(value).alias("v")).where("v is not null").hint("merge"), [*keys, "r", "c"])
    return met.groupBy(*keys, F.col("_r").alias("r"), F.col("_c").alias("c")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))


def average(source: DataFrame, ratio: int, value: str = "dn", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Mean over the source cells of each target cell."""
    return source.groupBy(*keys, F.expr(f"r div {ratio}").alias("r"), F.expr(f"c div {ratio}").alias("c")).agg(F.avg(value).alias(value))


def spline_matrix(n_in: int, n_out: int) -> np.ndarray:
    """(n_out x n_in): sampling at i / n_out * n_in, clamped to the last node, of the interpolating spline (cubic, not-a-knot; linear up to 3 nodes)."""
    t = np.minimum(np.arange(n_out) / n_out * n_in, n_in - 1)
    if n_in == 1:
        return np.ones((n_out, 1))
    if n_in <= 3:
        k = np.minimum(t.astype(int), n_in - 2)
        out = np.zeros((n_out, n_in))
        out[np.arange(n_out), k], out[np.arange(n_out), k + 1] = 1 - (t - k), t - k
        return out
    # Second derivatives m solve a banded system that is linear in the data.
    a, b = np.zeros((n_in, n_in)), np.zeros((n_in, n_in))
    for i in range(1, n_in - 1):
        a[i, i - 1 : i + 2], b[i, i - 1 : i + 2] = (1, 4, 1), (6, -12, 6)
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    m = np.linalg.solve(a, b)
    k = np.minimum(t.astype(int), n_in - 2)
    u = (t - k)[:, None]
    eye = np.eye(n_in)
    return (1 - u) * eye[k] + u * eye[k + 1] + ((1 - u) ** 3 - (1 - u)) / 6 * m[k] + (u**3 - u) / 6 * m[k + 1]


def spline_regrid(field: DataFrame, rows: tuple[int, int], cols: tuple[int, int], value: str, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """field(keys, r, c, value) of rows[0] x cols[0] on rows[1] x cols[1] cells; nulls take the mean of their grid first.

    The row and column matrices are literal weights of at most a control grid's size, joined on one axis after the other.
    """
    spark = field.sparkSession

    def taps(n: tuple[int, int], src: str) -> DataFrame:
        m = spline_matrix(*n)
        data = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(np.abs(m) > 1e-12), strict=True)]
        return F.broadcast(spark.createDataFrame(data, f"out int, {src} int, w double"))  # n[0] * n[1] rows of the control axis

    mean = F.avg(value).over(Window.partitionBy(*keys))
    filled = field.withColumn(value, F.coalesce(F.when(~F.isnan(value), F.col(value)), mean))
    by_row = filled.join(taps(rows, "r"), "r").groupBy(*keys, F.col("out").alias("r"), "c").agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return by_row.join(taps(cols, "c"), "c").groupBy(*keys, "r", F.col("out").alias("c")).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def stretch_over(field: DataFrame, shape: tuple[int, int], onto: tuple[int, int], value: str) -> DataFrame:
    """An array of some shape laid over the extent of another raster, nearest value."""
    spark = field.sparkSession
    cells = spark.range(onto[0] * onto[1]).select(F.expr(f"cast(id div {onto[1]} as int)").alias("r"), F.expr(f"cast(id % {onto[1]} as int)").alias("c"))
    at = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.floor((F.col("r") + 0.5) * shape[0] / onto[0]).cast("int").alias("r"), F.floor((F.col("c") + 0.5) * shape[1] / onto[1]).cast("int").alias("c"))
    return at.join(field.hint("shuffle_hash"), ["r", "c"]).select("scene_id", F.col("_r").alias("r"), F.col("_c").alias("c"), value)


def correspondence(coarse: DataFrame, coarse_m: float, fine_m: float) -> DataFrame:
    """coarse(…, r, c) plus (hx, hy), the fine pixel at each cell's corner."""
    return coarse.withColumns({"hx": G.fine_index(F.col("r"), coarse_m, fine_m), "hy": G.fine_index(F.col("c"), coarse_m, fine_m)})


def at_shift(cells: DataFrame, image: DataFrame, xs: Column | int, ys: Column | int, value: str = "dn") -> DataFrame:
    """Cells(scene_id, hx, hy, …) with the image value at the shifted pixel; what falls outside is dropped."""
    shifted = cells.withColumns({"r": (F.col("hx") + xs).cast("int"), "c": (F.col("hy") + ys).cast("int")})
    return shifted.join(image.select(*CELL, value).hint("merge"), [*CELL])


def nearest_time(obs: DataFrame, forecast: DataFrame, variables: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Each observation with the value of each variable at the nearest forecast time, the earlier one on a tie."""
    keyed = obs.withColumn("var", F.explode(F.array(*map(F.lit, variables))))
    return nearest_time_by(keyed, forecast, "var").select("scene_id", "obs_time", "var", "valid_time", "raw")


def nearest_time_by(obs: DataFrame, forecast: DataFrame, key: str, bucket_days: int = 1) -> DataFrame:
    """As-of nearest join within each key. Of several values at one time the greatest counts; keys without a forecast drop out.

    Each forecast time owns the span up to the middle between it and its neighbours. Spans are cut into buckets of days, which
    observations meet on (key, bucket): no window runs over observations, whose hot keys and days Spark can split. The first and
    last spans reach to the first and last observation, so there are about as many rows as forecasts and days together.
    """
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    size = bucket_days * 86_400_000_000
    span = obs.agg(F.min(micros(F.col("obs_time"))).alias("a"), F.max(micros(F.col("obs_time"))).alias("b")).first()  # one row
    low, high = (F.lit(x if x is not None else 0).cast("long") for x in (span["a"], span["b"]))
    once = forecast.groupBy(key, "valid_time").agg(F.max("raw").alias("raw")).withColumn("_m", micros(F.col("valid_time")))
    times = Window.partitionBy(key).orderBy("_m")  # the forecast times of one variable
    # Twice the middles, to stay with whole numbers: an observation at a middle belongs to the earlier time.
    own = once.withColumns({"_after": F.lag("_m").over(times) + F.col("_m"), "_upto": F.col("_m") + F.lead("_m").over(times)})
    bucket = lambda m: F.floor(m / size)
    first = F.greatest(F.coalesce(bucket(F.col("_after") / 2), bucket(low)), bucket(low))
    last = F.least(F.coalesce(bucket(F.col("_upto") / 2), bucket(high)), bucket(high))
    spans = own.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    spans = spans.select(key, "valid_time", "raw", "_after", "_upto", F.explode(F.sequence("_first", "_last")).alias("_bucket"))
    at = obs.withColumn("_t", micros(F.col("obs_time"))).withColumn("_bucket", bucket(F.col("_t")))
    met = at.join(spans.hint("merge"), [key, "_bucket"])
    mine = (F.col("_after").isNull() | (2 * F.col("_t") > F.col("_after"))) & (F.col("_upto").isNull() | (2 * F.col("_t") <= F.col("_upto")))
    return met.where(mine).select(*obs.columns, "valid_time", "raw")


#: Factors to optical thickness, g/cm2 and cm-atm; uncertainties where no prior is given.
PRIOR_UNITS = (1.0, 0.1, 46.698)
PRIOR_UNCERTAINTY = (0.4, 0.1, 0.05)


def atmospheric_prior(obs: DataFrame, forecast: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(scene_id, var, value, unc) from the nearest forecast, in the retrieval's units."""
    unit = F.element_at(F.array(*map(F.lit, PRIOR_UNITS)), F.col("var") + 1)
    unc = F.element_at(F.array(*map(F.lit, PRIOR_UNCERTAINTY)), F.col("var") + 1)
    return nearest_time(obs, forecast).select("scene_id", "var", ((F.col("raw") * scale + offset) * unit).alias("value"), unc.alias("unc"))


def day_window(obs: DataFrame, series: DataFrame, half: int = 16) -> DataFrame:
    """Series rows of the days around each observation.

    Each observed date meets the series once, on its exploded days; observations then meet what their date has found, so that none of
    them is repeated for a day.
    """
    dated = obs.withColumn("_date", F.col("obs_time").cast("date"))
    days = dated.select("_date").distinct().select("_date", F.explode(G.window_days(F.col("_date"), half)).alias("day"))
    near = days.join(series.hint("merge"), "day")
    return dated.join(near.hint("merge"), "_date").select("day", *obs.columns, *[c for c in series.columns if c != "day"])


def coverage(tiles: DataFrame, days: DataFrame, granules: DataFrame) -> DataFrame:
    """Required (tile, day) with the first granule of each, null where missing.

    The requirement is tiles x days by definition; days is a window of a few dozen rows and goes to every task.
    """
    needed = tiles.select("tile").distinct().crossJoin(F.broadcast(days.select("day").distinct()))
    have = granules.groupBy("tile", "day").agg(F.min("granule").alias("granule"))
    return needed.join(have.hint("shuffle_hash"), ["tile", "day"], "left")


def touched_tiles(points: DataFrame, granules: DataFrame) -> DataFrame:
    """Granules of the tiles that hold a vertex of a footprint."""
    tiles = points.select(G.tile_id(F.col("lon"), F.col("lat")).alias("tile")).distinct()
    return granules.join(tiles, "tile")


def daily_mosaic(rows: DataFrame) -> DataFrame:
    """Later tiles win: the value of the highest tile_order of each cell, day and band."""
    return rows.groupBy("cell_id", "day", "band").agg(F.max_by("value", "tile_order").alias("value"))


def join_windows(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("cell_id", "band", "day")) -> DataFrame:
    """Both halves of a window in day order, each (cell, band, day) once."""
    return first.unionByName(second).dropDuplicates([*keys])


def block_lookup(px: DataFrame, blocks: DataFrame, shape: tuple[int, int], n: tuple[int, int]) -> DataFrame:
    """Pixels with the values of their retrieval block."""
    keyed = px.withColumns({"bi": G.block_index(F.col("r"), shape[0], n[0]), "bj": G.block_index(F.col("c"), shape[1], n[1])})
    return keyed.join(blocks, ["scene_id", "bi", "bj"])


def band_angles(bands: DataFrame, angles: DataFrame) -> DataFrame:
    """Per (scene, band) view angles; a missing band takes the scene's mean. angles(scene_id, band, vza, vaa)."""
    mean = angles.groupBy("scene_id").agg(F.avg("vza").alias("m_vza"), F.avg("vaa").alias("m_vaa"))
    per = angles.groupBy("scene_id", "band").agg(F.avg("vza").alias("vza"), F.avg("vaa").alias("vaa"))
    wanted = mean.crossJoin(F.broadcast(bands.select("band")))  # scenes x a band dimension
    return wanted.join(per.hint("shuffle_hash"), ["scene_id", "band"], "left").select("scene_id", "band", F.coalesce("vza", "m_vza").alias("vza"), F.coalesce("vaa", "m_vaa").alias("vaa"))


def detector_seams(footprints: DataFrame, least: int = 10) -> DataFrame:
    """Overlaps of consecutive detectors in footprints(scene_id, det, r, c): size and the corner points of the split line."""
    a, b = footprints.alias("a"), footprints.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c")) & (F.col("b.det") == F.col("a.det") + 1))
    s = met.select("a.scene_id", "a.det", "a.r", "a.c").groupBy("scene_id", "det").agg(
        F.count("*").alias("n"), F.min_by(F.struct("r", "c"), F.struct("r", "c")).alias("top"), F.max_by(F.struct("r", "c"), F.struct("r", "c")).alias("bottom"))
    return s.where(F.col("n") >= least)


def seam_side(footprints: DataFrame, seams: DataFrame) -> DataFrame:
    """Overlap pixels with the signed side of their seam line (negative: left detector) and their distance to it."""
    line = seams.select("scene_id", "det", F.col("top.r").alias("r0"), F.col("top.c").alias("c0"), F.col("bottom.r").alias("r1"), F.col("bottom.c").alias("c1"))
    # A row a seam, written, so that Spark can split a long seam's pixels.
    joined = footprints.join(checkpointed(line, "seams").hint("merge"), ["scene_id", "det"])
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    side = (F.col("c") - F.col("c0")) * dr - (F.col("r") - F.col("r0")) * dc
    return joined.select("scene_id", "det", "r", "c", side.alias("side"), F.try_divide(F.abs(side), F.sqrt((dr * dr + dc * dc).cast("double"))).alias("distance"))
