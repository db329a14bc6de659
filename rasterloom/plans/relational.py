"""Queries of the filters, joins, aggregations, neighbourhoods, searches and jobs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from rasterloom.functions import angles as A
from rasterloom.functions import grid as G
from rasterloom.operators import emulator as E
from rasterloom.operators import kernel_fit as K
from rasterloom.operators import neighborhood as N
from rasterloom.operators import outline as O
from rasterloom.operators import pixels as P
from rasterloom.operators import psf as X
from rasterloom.operators import regrid as D
from rasterloom.operators import retrieval as T
from rasterloom.operators import spectral as Z
from rasterloom.operators import temporal as S
from rasterloom.operators.trees import Trees
from rasterloom.sources import scenes as M
from rasterloom.storage import checkpointed, reused, shared_dir

from . import step_sql as Q
from .registry import SIDE, query, table_query
from .scalar import _FOLD, _TILE, TOA, WIDE, _li_sql, r6, s6

#: Every band of a scene as a plane of its own, for operators on one grid at a time.
_PLANES = "pl AS (SELECT (scene_id * 8 + band)::INT AS scene_id, r, c, dn FROM fx_px)"


def _planes(px):
    return px.select((F.col("scene_id") * 8 + F.col("band")).cast("int").alias("scene_id"), "r", "c", "dn")


_WATER = "coalesce(((nir - red) / nullif(nir + red, 0) < 0.01 AND nir < 0.11) OR ((nir - red) / nullif(nir + red, 0) < 0.1 AND nir < 0.05) OR nir <= 1e-4 OR red <= 1e-4, true)"
_SNOW = "coalesce((green - swir1) / nullif(green + swir1, 0) > 0.42 OR green <= 0 OR swir1 <= 0, true)"
_VALID = "(" + " AND ".join(f"coalesce({k} >= 1e-4, false)" for k in P.ROLES) + ")"


@query("a01_clean_percent", "px", "bands", "qa", sql=f"""WITH {WIDE} SELECT scene_id, count(*) AS n_pixels, {s6(f'count(*) FILTER ({_VALID}) * 100::DOUBLE / count(*)', 'valid_percent')},
    {s6(f'count(*) FILTER ({_VALID} AND NOT ({_WATER} OR {_SNOW} OR coalesce(cloud_prob > 0.6, true))) * 100::DOUBLE / count(*)', 'clean_percent')} FROM fx_wide LEFT JOIN fx_qa USING (scene_id, r, c) GROUP BY 1""")
def clean_percent(px, bands, qa):
    out = P.clean_percent(P.composite(P.calibrated(px, bands)), qa)
    return out.select("scene_id", "n_pixels", r6(F.col("valid_percent"), "valid_percent"), r6(F.col("clean_percent"), "clean_percent"))


@query("f01_f04_masks", "px", "bands", sql=f"WITH {WIDE} SELECT scene_id, r, c, {_VALID} AS valid, {_WATER} AS water, {_SNOW} AS snow, coalesce(nir < 0.05, true) AS water_one, coalesce(blue > 0.6, true) AS snow_one FROM fx_wide")
def masks(px, bands):
    w = P.valid_in_all(P.composite(P.calibrated(px, bands)))
    return w.select("scene_id", "r", "c", "valid", P.water(F.col("nir"), F.col("red")).alias("water"), P.snow(F.col("green"), F.col("swir1")).alias("snow"),
                    P.water_single(F.col("nir")).alias("water_one"), P.snow_single(F.col("blue")).alias("snow_one"))


_BAD = f"fx_bad AS (SELECT w.scene_id, w.r, w.c, {_WATER} OR {_SNOW} OR coalesce(cloud_prob > 0.6, true) OR coalesce(blue > 1, false) AS bad FROM fx_wide w LEFT JOIN fx_qa q ON w.scene_id = q.scene_id AND w.r = q.r AND w.c = q.c)"


@query("f02_f06_bad_pixels", "px", "bands", "qa", sql=f"WITH {WIDE}, {_BAD} SELECT scene_id, r, c, bad, r < 5 OR c < 5 OR r >= 35 OR c >= 35 AS border FROM fx_bad")
def bad_pixels(px, bands, qa):
    return P.bad_pixels(P.composite(P.calibrated(px, bands)), qa).withColumn("border", P.border(F.col("r"), F.col("c"), SIDE, SIDE, 5))


@query("f05_bad_zone", "qa", sql="""WITH g AS (SELECT s.scene_id, r::INT AS r, c::INT AS c FROM (SELECT DISTINCT scene_id FROM fx_qa) s, range(40) a(r), range(40) b(c)),
    m AS (SELECT g.*, coalesce(q.cloud_prob > 0.02, false) AS mask FROM g LEFT JOIN fx_qa q USING (scene_id, r, c)), t AS (SELECT * FROM m WHERE mask),
    e AS (SELECT m.scene_id, m.r, m.c FROM m JOIN t ON t.scene_id = m.scene_id AND abs(t.r - m.r) <= 5 AND abs(t.c - m.c) <= 5 GROUP BY 1, 2, 3 HAVING count(*) = 121)
    SELECT m.scene_id, m.r, m.c, EXISTS (SELECT 1 FROM e WHERE e.scene_id = m.scene_id AND abs(e.r - m.r) <= 32 AND abs(e.c - m.c) <= 32) AS mask FROM m""")
def bad_zone(qa):
    """Erosion by 5 and growth by the reach of the point spread at 500 m."""
    mask = qa.select("scene_id", "r", "c", (F.col("cloud_prob") > 0.02).alias("mask"))
    return N.bad_zone(N.dense(mask, SIDE, SIDE), 500)


@query("f07_in_range", "px", "bands", sql=f"WITH {TOA} SELECT scene_id, r, c, bool_and(coalesce(toa - 0.2 >= 0.001 AND toa - 0.2 < 1, false)) AS ok FROM fx_toa GROUP BY 1, 2, 3")
def in_range(px, bands):
    return P.in_range(P.calibrated(px, bands).withColumn("boa", F.col("toa") - 0.2))


@query("f08_outliers", "px", "bands", sql=f"""WITH {TOA}, p AS (SELECT *, 0.8 * toa AS boa, toa - 0.8 * toa AS gap FROM fx_toa), i AS (SELECT *, gap >= -0.5 + 0.1 * boa AND gap <= 0.6 - 0.2 * boa AS inside FROM p),
    l AS (SELECT scene_id, band, quantile_cont(gap, 0.05) AS a, quantile_cont(gap, 0.95) AS b FROM i WHERE inside GROUP BY 1, 2)
    SELECT scene_id, r, c, bool_and(coalesce(inside AND gap >= a AND gap <= b, false)) AS ok FROM i LEFT JOIN l USING (scene_id, band) GROUP BY 1, 2, 3""")
def outliers(px, bands):
    pairs = P.calibrated(px, bands).select("scene_id", "band", "r", "c", "toa", (0.8 * F.col("toa")).alias("boa"))
    env = px.sparkSession.createDataFrame([(b, [0.0, 0.0, 0.1, -0.5], [0.0, 0.0, -0.2, 0.6]) for b in range(1, 8)], "band int, lo array<double>, hi array<double>")
    return P.outlier_filter(pairs, env)


_RING = [(3.5, 2.5), (36.5, 8.5), (30.5, 35.5), (20.5, 18.5), (6.5, 33.5)]
_EVEN = " + ".join(f"(({b[1]} > r) <> ({a[1]} > r) AND c < ({a[0]} - {b[0]})::DOUBLE * (r - {b[1]}) / ({a[1]} - {b[1]}) + {b[0]})::INT" for a, b in zip([_RING[-1], *_RING[:-1]], _RING, strict=True))


@query("f09_crop", "px", sql=f"SELECT scene_id, band, r, c, dn FROM fx_px WHERE ({_EVEN}) % 2 = 1")
def crop(px):
    return P.crop(px, _RING)


@query("f11_a04_dense_blocks", "px", sql="SELECT scene_id, trunc(r / 40.0::DOUBLE * 20)::INT AS bi, trunc(c / 40.0::DOUBLE * 20)::INT AS bj, count(DISTINCT r * 1000 + c) AS n_obs FROM fx_px WHERE dn > 5000 GROUP BY 1, 2, 3 HAVING count(DISTINCT r * 1000 + c) >= 2")
def dense_blocks(px):
    o = px.where("dn > 5000").withColumns({"bi": G.block_index(F.col("r"), 40, 20), "bj": G.block_index(F.col("c"), 40, 20)})
    return P.dense_blocks(o)


@query("f12_u03_scene_gate", "px", sql="""WITH g AS (SELECT scene_id, count(*) FILTER (dn > 9000) AS n_good, count(*) FILTER (dn > 9000 AND band = scene_id % 4 + 1) AS n_passed FROM fx_px GROUP BY 1), k AS (SELECT scene_id FROM g WHERE n_good > 10 AND n_passed > 3)
    SELECT scene_id, band, r, c, dn * 2 AS dn FROM fx_px WHERE scene_id IN (SELECT scene_id FROM k) UNION ALL SELECT scene_id, band, r, c, dn FROM fx_px WHERE scene_id NOT IN (SELECT scene_id FROM k)""")
def scene_gate(px):
    gate = P.scene_gate(px.select("scene_id", (F.col("dn") > 9000).alias("good"), (F.col("band") == F.col("scene_id") % 4 + 1).alias("passed")))
    return P.solved_or_prior(px.withColumn("dn", F.col("dn") * 2), px, gate)


@query("f13_clear_scenes", "qa", sql="SELECT DISTINCT scene_id FROM fx_qa q WHERE EXISTS (SELECT 1 FROM fx_qa p WHERE p.scene_id = q.scene_id AND p.cloud_prob <= 0.6)")
def clear_scenes(qa):
    return P.with_clear_pixel(qa.select("scene_id").distinct(), qa)


_COARSE = _PLANES + ", t AS (SELECT DISTINCT scene_id, r // 2 AS r, c // 2 AS c FROM pl)"


@query("d02_nearest", "px", sql=f"WITH {_COARSE}, a AS (SELECT *, floor((r + 0.5) * 2)::INT AS sr, floor((c + 0.5) * 2)::INT AS sc FROM t) SELECT a.scene_id, a.r::INT AS r, a.c::INT AS c, p.dn FROM a LEFT JOIN pl p ON p.scene_id = a.scene_id AND p.r = sr AND p.c = sc")
def nearest(px):
    px = _planes(px)
    target = px.select("scene_id", F.expr("r div 2").cast("int").alias("r"), F.expr("c div 2").cast("int").alias("c")).distinct()
    return D.nearest(px, target, 2.0)


@query("d03_bilinear", "px", sql=f"""WITH {_COARSE}, a AS (SELECT scene_id, r, c, (r + 0.5) * 1.5 - 0.5 AS y, (c + 0.5) * 1.5 - 0.5 AS x FROM t), k AS (SELECT a.*, floor(y)::INT + dr AS sr, floor(x)::INT + dc AS sc,
    ((CASE WHEN dr = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN dc = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END))::DOUBLE AS w FROM a, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc))
    SELECT k.scene_id, k.r::INT AS r, k.c::INT AS c, {s6('sum(w * dn) / sum(w)', 'dn')} FROM k JOIN pl p ON p.scene_id = k.scene_id AND p.r = sr AND p.c = sc WHERE w > 0 GROUP BY 1, 2, 3""")
def bilinear(px):
    px = _planes(px)
    target = px.select("scene_id", F.expr("r div 2").cast("int").alias("r"), F.expr("c div 2").cast("int").alias("c")).distinct()
    return D.bilinear(px, target, 1.5).select("scene_id", "r", "c", r6(F.col("dn"), "dn"))


@query("d04_a18_average", "px", sql=f"SELECT scene_id, band, (r // 4)::BIGINT AS r, (c // 4)::BIGINT AS c, {s6('avg(dn)', 'dn')} FROM fx_px GROUP BY 1, 2, 3, 4")
def average(px):
    return P.overview(px, 4).select("scene_id", "band", "r", "c", r6(F.col("dn"), "dn"))


def _spline_values(n_in: int, n_out: int, src: str) -> str:
    m = D.spline_matrix(n_in, n_out)
    return "(VALUES " + ", ".join(f"({i}, {j}, {float(m[i, j])!r}::DOUBLE)" for i in range(n_out) for j in range(n_in) if abs(m[i, j]) > 1e-12) + f") AS t(o, {src}, w)"


@query("d05_spline", "angles", sql=f"""WITH f AS (SELECT scene_id, r // 4 AS r, c // 4 AS c, avg(saa) AS v FROM fx_angles GROUP BY 1, 2, 3), a AS (SELECT scene_id, t.o AS r, c, sum(w * v) AS v FROM f JOIN {_spline_values(10, 25, 'r')} USING (r) GROUP BY 1, 2, 3)
    SELECT scene_id, a.r::INT AS r, t.o::INT AS c, {s6('sum(w * v)', 'saa')} FROM a JOIN {_spline_values(10, 25, 'c')} USING (c) GROUP BY 1, 2, 3""")
def spline(a):
    f = a.groupBy("scene_id", F.expr("r div 4").cast("int").alias("r"), F.expr("c div 4").cast("int").alias("c")).agg(F.avg("saa").alias("saa"))
    return D.spline_regrid(f, (10, 25), (10, 25), "saa").select("scene_id", "r", "c", r6(F.col("saa"), "saa"))


@query("d06_stretch", "angles", sql="""WITH t AS (SELECT (i // 30)::INT AS r, (i % 30)::INT AS c FROM range(900) x(i)), a AS (SELECT *, floor((r + 0.5) * 40 / 30)::INT AS sr, floor((c + 0.5) * 40 / 30)::INT AS sc FROM t)
    SELECT f.scene_id, a.r, a.c, f.sza FROM a JOIN fx_angles f ON f.r = sr AND f.c = sc""")
def stretch(a):
    return D.stretch_over(a.select("scene_id", "r", "c", "sza"), (40, 40), (30, 30), "sza")


_CELLS = "k AS (SELECT scene_id, r // 4 AS r, c // 4 AS c, avg(sza) AS boa FROM fx_angles GROUP BY 1, 2, 3), h AS (SELECT scene_id, r, c, boa, (floor(r * 4))::INT AS hx, (floor(c * 4))::INT AS hy FROM k)"


def _cells(a):
    k = a.groupBy("scene_id", F.expr("r div 4").cast("int").alias("r"), F.expr("c div 4").cast("int").alias("c")).agg(F.avg("sza").alias("boa"))
    return D.correspondence(k, 40.0, 10.0)


_PLANE_CELLS = _CELLS + ", hb AS (SELECT (scene_id * 8 + b)::INT AS scene_id, boa, hx, hy FROM h, range(1, 8) t(b)), " + _PLANES


def _plane_cells(a):
    each = _cells(a).withColumn("band", F.explode(F.array(*map(F.lit, range(1, 8)))))
    return each.select((F.col("scene_id") * 8 + F.col("band")).cast("int").alias("scene_id"), "boa", "hx", "hy")


@query("d07_d08_f10_shifted", "angles", "px", sql=f"WITH {_PLANE_CELLS} SELECT h.scene_id, hx, hy, {s6('boa', 'boa')}, p.dn FROM hb h JOIN pl p ON p.scene_id = h.scene_id AND p.r = hx + 2 AND p.c = hy - 1")
def shifted(a, px):
    return D.at_shift(_plane_cells(a), _planes(px), 2, -1).select("scene_id", "hx", "hy", r6(F.col("boa"), "boa"), "dn")


def _near(obs: str) -> str:
    """n: each row of obs(scene_id, obs_time, var) with the nearest forecast, the earlier one on a tie."""
    return f"""o3 AS ({obs}), t AS (SELECT var, valid_time, max(raw) AS raw FROM fx_forecast GROUP BY 1, 2),
    b AS (SELECT o3.*, t.valid_time AS bt, t.raw AS br FROM o3 ASOF LEFT JOIN t ON o3.var = t.var AND o3.obs_time >= t.valid_time),
    e AS (SELECT b.*, t.valid_time AS et, t.raw AS er FROM b ASOF LEFT JOIN t ON b.var = t.var AND b.obs_time <= t.valid_time),
    p AS (SELECT *, bt IS NULL OR (et IS NOT NULL AND epoch_us(et) - epoch_us(obs_time) < epoch_us(obs_time) - epoch_us(bt)) AS later FROM e WHERE bt IS NOT NULL OR et IS NOT NULL),
    n AS (SELECT scene_id, obs_time, var, CASE WHEN later THEN et ELSE bt END AS valid_time, CASE WHEN later THEN er ELSE br END AS raw FROM p)"""


_NEAR = _near("SELECT scene_id, obs_time, v::INT AS var FROM fx_obs, range(3) x(v)")


@query("d09_nearest_time", "obs", "forecast", sql=f"WITH {_NEAR} SELECT * FROM n")
def nearest_time(o, f):
    return D.nearest_time(o, f)


@query("d09_nearest_time_by", "obs", "forecast", sql=f"WITH {_near('SELECT scene_id, obs_time, (scene_id % 3)::INT AS var FROM fx_obs')} SELECT * FROM n")
def nearest_time_by(o, f):
    return D.nearest_time_by(o.withColumn("var", (F.col("scene_id") % 3).cast("int")), f, "var")


@query("s09_prior", "obs", "forecast", sql=f"WITH {_NEAR} SELECT scene_id, var, {s6('(raw * 0.001 + 0.1) * [1.0, 0.1, 46.698][var + 1]', 'value')}, [0.4, 0.1, 0.05][var + 1]::DOUBLE AS unc FROM n")
def prior(o, f):
    return D.atmospheric_prior(o, f, 0.001, 0.1).select("scene_id", "var", r6(F.col("value"), "value"), "unc")


@query("d10_s08_day_window", "brdf", sql=f"""SELECT cell_id, band, day, f_iso, f_vol, f_geo, {s6("CASE WHEN qa = 255 THEN 0 ELSE pow(0.618034::DOUBLE, qa) END", 'weight')} FROM fx_brdf WHERE day BETWEEN DATE '2024-01-16' - 16 AND DATE '2024-01-16' + 16""")
def day_window(b):
    return S.brdf_window(b, "2024-01-16").select("cell_id", "band", "day", "f_iso", "f_vol", "f_geo", r6(F.col("weight"), "weight"))


@query("d10_obs_window", "obs", "granules", sql="SELECT o.scene_id, g.tile, g.day, g.granule FROM fx_obs o JOIN (SELECT tile, granule, CAST(day - 8766 + (strftime(day, '%j')::INT * 37) % 2500 AS DATE) AS day FROM fx_granules) g ON g.day BETWEEN o.obs_time::DATE - 16 AND o.obs_time::DATE + 16")
def obs_window(o, g):
    old = g.select("tile", "granule", F.date_add(F.date_sub("day", 8766), (F.dayofyear("day") * 37) % 2500).alias("day"))
    return D.day_window(o, old).select("scene_id", "tile", "day", "granule")


@query("d11_coverage", "granules", sql="WITH d AS (SELECT DISTINCT day FROM fx_granules), t AS (SELECT DISTINCT tile FROM fx_granules) SELECT tile, day, (SELECT min(granule) FROM fx_granules g WHERE g.tile = t.tile AND g.day = d.day) AS granule FROM t, d")
def coverage(g):
    return D.coverage(g.select("tile"), g.select("day"), g)


@query("d12_o04_tiles", "points", "granules", sql=f"WITH t AS (SELECT DISTINCT {_TILE} AS tile FROM fx_points) SELECT granule, tile, day FROM fx_granules WHERE tile IN (SELECT tile FROM t)")
def tiles(p, g):
    return D.touched_tiles(p, g).select("granule", "tile", "day")


def _filled(known: str) -> str:
    """fill: every cell of every plane with the nearest value among known ones; of equal distances the least (row, column)."""
    return f"""{_PLANES}, g AS (SELECT s.scene_id, r::INT AS r, c::INT AS c FROM (SELECT DISTINCT scene_id FROM pl) s, range(40) a(r), range(40) b(c)), p AS (SELECT * FROM pl WHERE {known}),
    own AS (SELECT g.*, p.dn FROM g LEFT JOIN p USING (scene_id, r, c)),
    far AS (SELECT o.scene_id, o.r, o.c, arg_min(p.dn, ((p.r - o.r) * (p.r - o.r) + (p.c - o.c) * (p.c - o.c)) * 10000 + p.r * 100 + p.c) AS dn FROM own o JOIN p ON p.scene_id = o.scene_id WHERE o.dn IS NULL GROUP BY 1, 2, 3),
    fill AS (SELECT own.scene_id, own.r, own.c, coalesce(own.dn, far.dn) AS dn FROM own LEFT JOIN far USING (scene_id, r, c))"""


@query("d13_nearest_fill", "px", sql=f"WITH {_filled('dn > 8000')} SELECT * FROM fill")
def nearest_fill(px):
    """Few known cells, at any distance."""
    return N.nearest_fill(N.dense(_planes(px).withColumn("dn", F.when(F.col("dn") > 8000, F.col("dn"))), SIDE, SIDE, "dn"), "dn")


@query("d14_d15_block_lookup", "px", "angles", sql=f"WITH b AS (SELECT scene_id, r // 8 AS bi, c // 8 AS bj, avg(sza) AS aot FROM fx_angles GROUP BY 1, 2, 3) SELECT p.scene_id, p.band, p.r, p.c, {s6('aot', 'aot')} FROM fx_px p JOIN b ON b.scene_id = p.scene_id AND b.bi = trunc(p.r / 40.0::DOUBLE * 5) AND b.bj = trunc(p.c / 40.0::DOUBLE * 5)")
def block_lookup(px, a):
    b = a.groupBy("scene_id", F.expr("r div 8").cast("int").alias("bi"), F.expr("c div 8").cast("int").alias("bj")).agg(F.avg("sza").alias("aot"))
    return D.block_lookup(px, b, (40, 40), (5, 5)).select("scene_id", "band", "r", "c", r6(F.col("aot"), "aot"))


@query("d16_a05_band_angles", "bands", "angles", sql=f"""WITH a AS (SELECT scene_id, (r % 5 + 1)::INT AS band, vza, vaa FROM fx_angles), m AS (SELECT scene_id, avg(vza) AS z, avg(vaa) AS q FROM a GROUP BY 1), p AS (SELECT scene_id, band, avg(vza) AS z, avg(vaa) AS q FROM a GROUP BY 1, 2)
    SELECT m.scene_id, b.band, {s6('coalesce(p.z, m.z)', 'vza')}, {s6('coalesce(p.q, m.q)', 'vaa')} FROM m CROSS JOIN fx_bands b LEFT JOIN p ON p.scene_id = m.scene_id AND p.band = b.band""")
def band_angles(bands, a):
    return D.band_angles(bands, a.withColumn("band", (F.col("r") % 5 + 1).cast("int"))).select("scene_id", "band", r6(F.col("vza"), "vza"), r6(F.col("vaa"), "vaa"))


_DET = "f AS (SELECT DISTINCT scene_id, d::INT AS det, r, c FROM fx_px, range(4) t(d) WHERE c BETWEEN d * 9 + r // 10 AND d * 9 + 13 + r // 10)"


def _detectors(px):
    at = px.select("scene_id", "r", "c").distinct().withColumn("det", F.explode(F.array(*map(F.lit, range(4)))))
    edge = F.col("det") * 9 + F.expr("r div 10")
    return at.where((F.col("c") >= edge) & (F.col("c") <= edge + 13)).select("scene_id", "det", "r", "c")


@query("d17_seams", "px", sql=f"""WITH {_DET}, o AS (SELECT a.scene_id, a.det, a.r, a.c FROM f a JOIN f b ON a.scene_id = b.scene_id AND a.r = b.r AND a.c = b.c AND b.det = a.det + 1),
    s AS (SELECT scene_id, det, count(*) AS n, arg_min(r, r * 1000 + c) AS r0, arg_min(c, r * 1000 + c) AS c0, arg_max(r, r * 1000 + c) AS r1, arg_max(c, r * 1000 + c) AS c1 FROM o GROUP BY 1, 2 HAVING count(*) >= 10)
    SELECT f.scene_id, f.det, f.r, f.c, (c - c0) * (r1 - r0) - (r - r0) * (c1 - c0) AS side, {s6('abs((c - c0) * (r1 - r0) - (r - r0) * (c1 - c0)) / nullif(sqrt((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0)), 0)', 'distance')} FROM f JOIN s USING (scene_id, det)""")
def seams(px):
    f = _detectors(px)
    return D.seam_side(f, D.detector_seams(f)).select("scene_id", "det", "r", "c", "side", r6(F.col("distance"), "distance"))


@query("a02_a03_block_sums", "px", sql=f"SELECT scene_id, trunc(r / 40.0::DOUBLE * 7)::INT AS bi, trunc(c / 40.0::DOUBLE * 7)::INT AS bj, sum(dn) AS total, {s6('avg(nullif(dn % 7, 0))', 'info')} FROM fx_px GROUP BY 1, 2, 3")
def block_sums(px):
    return px.groupBy("scene_id", G.block_index(F.col("r"), 40, 7).alias("bi"), G.block_index(F.col("c"), 40, 7).alias("bj")).agg(F.sum("dn").alias("total"), r6(F.avg(F.nullif(F.col("dn") % 7, F.lit(0.0))), "info"))


@query("a06_percentiles", "px", sql=f"SELECT scene_id, band, {s6('quantile_cont(dn, 0.05)', 'p05', 4)}, {s6('quantile_cont(dn, 0.5)', 'p50', 4)}, {s6('quantile_cont(dn, 0.95)', 'p95', 4)} FROM fx_px GROUP BY 1, 2")
def percentiles(px):
    return P.percentiles(px, ["scene_id", "band"], "dn").select("scene_id", "band", *[r6(F.col(k), k, 4) for k in ("p05", "p50", "p95")])


@query("a08_correlation", "px", "angles", sql=f"SELECT scene_id, band, {s6('corr(dn, saa)', 'r', 4)}, {s6('abs(1 - corr(dn, saa))', 'cost', 4)} FROM fx_px JOIN fx_angles USING (scene_id, r, c) GROUP BY 1, 2")
def correlation(px, a):
    return px.join(a, ["scene_id", "r", "c"]).groupBy("scene_id", "band").agg(r6(F.corr("dn", "saa"), "r", 4), r6(X.pearson_cost("dn", "saa"), "cost", 4))


@query("a09_footprint", "px", sql="""SELECT scene_id, '[{"x":' || min(c) || ',"y":' || min(r) || '},{"x":' || max(c) || ',"y":' || min(r) || '},{"x":' || max(c) || ',"y":' || max(r) || '},{"x":' || min(c) || ',"y":' || max(r) || '}]' AS ring FROM fx_px GROUP BY 1""")
def footprint(px):
    return P.footprint(px)


_COVERED = f"{_PLANES}, cells AS (SELECT scene_id, r // 4 AS r, c // 4 AS c FROM pl GROUP BY 1, 2, 3 HAVING count(*) >= 12)"
_RUNS = ", ".join([
    "e AS (" + " UNION ALL ".join(f"SELECT scene_id, {h} AS heading, {line} AS line, {at} AS pos FROM cells a WHERE NOT EXISTS (FROM cells b WHERE b.scene_id = a.scene_id AND b.r = a.r + {dr} AND b.c = a.c + {dc})"
                                  for h, line, at, dr, dc in ((0, "r", "c", -1, 0), (1, "c + 1", "r", 0, 1), (2, "r + 1", "c", 1, 0), (3, "c", "r", 0, -1))) + ")",
    "isles AS (SELECT *, pos - row_number() OVER (PARTITION BY scene_id, heading, line ORDER BY pos) AS isle FROM e)",
    "spans AS (SELECT scene_id, heading, line, CASE WHEN heading < 2 THEN min(pos) ELSE max(pos) + 1 END AS f, CASE WHEN heading < 2 THEN max(pos) + 1 ELSE min(pos) END AS t FROM isles GROUP BY scene_id, heading, line, isle)",
    "runs AS (SELECT scene_id, heading, CASE WHEN heading % 2 = 0 THEN f ELSE line END AS x0, CASE WHEN heading % 2 = 0 THEN line ELSE f END AS y0, CASE WHEN heading % 2 = 0 THEN t ELSE line END AS x1, CASE WHEN heading % 2 = 0 THEN line ELSE t END AS y1 FROM spans)"])


def _covered(px):
    """Squares of 4 x 4 cells of every plane of which at least twelve have a pixel."""
    at = [F.expr(f"{k} div 4").cast("int").alias(k) for k in ("r", "c")]
    return _planes(px).groupBy("scene_id", *at).agg(F.count("*").alias("n")).where("n >= 12").drop("n")


@query("a09_boundary_runs", "px", sql=f"WITH {_COVERED}, {_RUNS} SELECT scene_id, heading, x0, y0, x1, y1 FROM runs")
def boundary_runs(px):
    """Straight runs of the boundary of the well covered part of every plane."""
    return O.boundary_runs(_covered(px), ["scene_id"])


@query("a09_outline", "px", sql=f"""WITH RECURSIVE {_COVERED}, {_RUNS}, named AS (SELECT *, (y0 * 1000 + x0) * 4 + heading AS run FROM runs),
    links AS (SELECT a.scene_id, a.run, arg_max(b.run, (b.heading = (a.heading + 1) % 4)::INT) AS next FROM named a JOIN named b ON a.scene_id = b.scene_id AND a.x1 = b.x0 AND a.y1 = b.y0 GROUP BY 1, 2),
    walk AS (SELECT scene_id, run AS head, run AS tail, x0 || ' ' || y0 AS points, (x0 - x1) * y0 AS area, 1 AS n FROM named
      UNION ALL SELECT w.scene_id, w.head, l.next, w.points || ',' || b.x0 || ' ' || b.y0, w.area + (b.x0 - b.x1) * b.y0, w.n + 1 FROM walk w JOIN links l ON l.scene_id = w.scene_id AND l.run = w.tail JOIN named b ON b.scene_id = w.scene_id AND b.run = l.next WHERE l.next > w.head)
    SELECT w.scene_id, points, area::BIGINT AS area, area < 0 AS hole, n::BIGINT AS n FROM walk w JOIN links l ON l.scene_id = w.scene_id AND l.run = w.tail AND l.next = w.head""")
def outlines(px):
    """Rings of the well covered part of every plane, holes included."""
    rings = O.outline(_covered(px), ["scene_id"])
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return rings.select("scene_id", text.alias("points"), "area", "hole", F.size("points").cast("long").alias("n"))


_KV = f"""{_FOLD}, {_li_sql(A.SPARSE_SHAPE, 'a')}, k AS (SELECT *, body / (cos(v) + cos(s)) - pi() / 4 AS kv, o - secants + 0.5 * (1 + cq) / cos(v1) / cos(s1) AS kg FROM lia)"""
_SOLVE = """m AS (SELECT pixel, count(*)::DOUBLE AS a, sum(kv) AS b, sum(kg) AS c, sum(kv * kv) AS d, sum(kv * kg) AS e, sum(kg * kg) AS f, sum(refl) AS x, sum(refl * kv) AS y, sum(refl * kg) AS z, sum(refl * refl) AS rr FROM k GROUP BY 1),
    t AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM m),
    p AS (SELECT *, (x * (d * f - e * e) - b * (y * f - e * z) + c * (y * e - d * z)) / nullif(det, 0) AS p0, (a * (y * f - e * z) - x * (b * f - e * c) + c * (b * z - y * c)) / nullif(det, 0) AS p1, (a * (d * z - y * e) - b * (b * z - y * c) + x * (b * e - d * c)) / nullif(det, 0) AS p2 FROM t)"""


@query("a10_kernel_fit", "samples", sql=f"WITH {_KV}, {_SOLVE} SELECT pixel, {s6('p0', 'f_iso', 5)}, {s6('p1', 'f_vol', 5)}, {s6('p2', 'f_geo', 5)}, {s6('sqrt(greatest(rr - p0 * x - p1 * y - p2 * z, 0) / a)', 'rmse', 5)}, a::BIGINT AS n FROM p")
def kernel_fit(s):
    f = K.fit(K.with_kernels(s), ["pixel"])
    return f.select("pixel", *[r6(F.col(c), c, 5) for c in ("f_iso", "f_vol", "f_geo", "rmse")], "n")


@query("a22_fit_report", "samples", sql=f"WITH {_KV}, {_SOLVE} SELECT sample_id, pixel, refl, {s6('p0 + p1 * kv + p2 * kg', 'modelled', 5)} FROM k JOIN (SELECT pixel, p0, p1, p2 FROM p) p USING (pixel)")
def fit_report(s):
    f = K.fit(K.with_kernels(s), ["pixel"]).select("pixel", "f_iso", "f_vol", "f_geo")
    return K.fit_report(s, f, ["pixel"]).select("sample_id", "pixel", "refl", r6(F.col("modelled"), "modelled", 5))


@query("a11_o03_hot_spot", "samples", sql=f"""WITH {_FOLD}, {_li_sql(A.SPARSE_SHAPE, 'a')}, w AS (SELECT i, i * radians(10) / 1000 AS xi FROM range(1000) t(i)),
    k0 AS (SELECT pixel, refl, x, body / (cos(v) + cos(s)) AS b, o - secants + 0.5 * (1 + cq) / cos(v1) / cos(s1) AS kg FROM lia),
    k AS (SELECT pixel, xi, refl, kg, CASE WHEN i > 0 THEN b * (1 + 1 / (1 + x / xi)) - pi() / 2 ELSE b - pi() / 4 END AS kv FROM k0, w),
    {_SOLVE.replace('SELECT pixel, count', 'SELECT pixel, xi, count').replace('GROUP BY 1)', 'GROUP BY 1, 2)')}, q AS (SELECT pixel, xi, p0, p1, p2, sqrt(greatest(rr - p0 * x - p1 * y - p2 * z, 0) / a) AS rmse FROM p WHERE p0 IS NOT NULL),
    m1 AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY rmse, xi) AS n FROM q)
    SELECT pixel, {s6('rmse', 'rmse', 5)} FROM m1 WHERE n = 1""")
def hot_spot(s):
    """Error at the best of 1000 widths for every pixel (of widths with errors that differ by rounding alone, either may be the best)."""
    return best_widths(s).select("pixel", r6(F.col("rmse"), "rmse", 5))


def best_widths(s):
    return K.hot_spot_search(s, ["pixel"], K.hot_spot_grid(s.sparkSession))


_STEP_BANDS = {0: 645.0, 1: 858.0, 2: 469.0, 3: 555.0}
_STEP_NOISE = tuple(K.BAND_NOISE[k] for k in (1, 4, 0, 6))
_LOW = " OR ".join(f"(s{k} > s0 AND s{k} > s1)" for k in (2, 3))


@query("a13_a15_step_day", "samples", sql=f"""WITH {Q.solved(_KV, "(0), (1), (2), (3)", "band", "CASE WHEN band = 2 THEN 0.6::DOUBLE - refl ELSE refl / (band + 1) END")},
    {Q.per_day(list(_STEP_BANDS), _STEP_NOISE)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY rmse, dos) AS k FROM per WHERE s0 < 0 AND s1 < 0 AND ({_LOW}))
    SELECT pixel, dos, {s6('rmse', 'rmse', 5)} FROM ranked WHERE k = 1""")
def step_day(s):
    """Step-change day of every pixel over the four-band record made of its samples."""
    bands = s.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("band")).withColumn("refl", F.when(F.col("band") == 2, 0.6 - F.col("refl")).otherwise(F.col("refl") / (F.col("band") + 1)))
    return K.detect_step(K.with_kernels(bands), _STEP_BANDS).select("pixel", "dos", r6(F.col("rmse"), "rmse", 5))


_BURN_BANDS = {0: 645.0, 1: 858.5, 2: 469.0, 3: 555.0, 4: 1240.0, 5: 1640.0, 6: 2130.0}
_BURN_SHAPE = {b: (w - K.BURN_OFFSET) - (w - K.BURN_OFFSET) ** 2 / (2 * (K.BURN_LIMIT - K.BURN_OFFSET)) for b, w in _BURN_BANDS.items()}
_GREEN = (0.08, 0.45, 0.05, 0.10, 0.42, 0.30, 0.18)
_BURNT = tuple(0.02 + 0.08 * (v / max(_BURN_SHAPE.values())) for v in _BURN_SHAPE.values())
_PART = "(CASE WHEN doy > 120 + pixel THEN 0.3::DOUBLE + (pixel % 5) * 0.1::DOUBLE ELSE 0 END)"
_BURN_RECORD = Q.solved(_KV, ", ".join(f"({b}, {g!r}::DOUBLE, {x!r}::DOUBLE)" for b, g, x in zip(_BURN_BANDS, _GREEN, _BURNT, strict=True)), "band, green, burnt", f"green * (1 - {_PART}) + burnt * {_PART} + (refl - 0.15::DOUBLE) * 0.01::DOUBLE")


@query("a14_a15_burn_day", "samples", sql=f"""WITH {_BURN_RECORD},
    {Q.per_day(list(_BURN_BANDS), K.BAND_NOISE)}, {Q.mixture(_BURN_SHAPE)},
    good AS (SELECT * FROM per JOIN mix USING (pixel, dos) WHERE a0 >= 0 AND a1 >= 0 AND fcc BETWEEN 0 AND 1 AND a0 + a1 <= 1 AND d1 < 0 AND d4 < 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY fcc DESC, dos) AS k FROM good)
    SELECT pixel, dos, {s6('rmse', 'rmse', 5)}, {s6('fcc', 'fcc', 4)}, {s6('a0', 'a0', 4)}, {s6('a1', 'a1', 4)} FROM ranked WHERE k = 1""")
def burn_day(s):
    """Day, burnt fraction and burnt spectrum of every pixel.

    The record has seven bands: a green spectrum until a day that the pixel's number gives, then a mixture of it with a
    burnt one, with the samples' reflectances as noise.
    """
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("band") + 1)
    part = F.when(F.col("doy") > 120 + F.col("pixel"), 0.3 + (F.col("pixel") % 5) * 0.1).otherwise(0.0)
    bands = s.select("*", F.explode(F.array(*map(F.lit, _BURN_BANDS))).alias("band"))
    bands = bands.withColumn("refl", of(_GREEN) * (1 - part) + of(_BURNT) * part + (F.col("refl") - 0.15) * 0.01)
    got = K.detect_step(K.with_kernels(bands), _BURN_BANDS)
    return got.select("pixel", "dos", r6(F.col("rmse"), "rmse", 5), *[r6(F.col(c), c, 4) for c in ("fcc", "a0", "a1")])


@query("a12_median", "angles", sql=f"WITH m AS (SELECT scene_id, quantile_cont(saa, 0.5) AS m FROM fx_angles WHERE saa > 100 AND saa < 300 GROUP BY 1) SELECT scene_id, r, c, {s6('CASE WHEN saa > 100 AND saa < 300 THEN saa ELSE m END', 'saa')} FROM fx_angles LEFT JOIN m USING (scene_id)")
def median(a):
    out = P.replace_by_median(a.select("scene_id", "r", "c", "saa"), ["scene_id"], "saa", (F.col("saa") > 100) & (F.col("saa") < 300))
    return out.select("scene_id", "r", "c", r6(F.col("saa"), "saa"))


@query("a16_azimuth_mode", "angles", sql=f"""WITH a AS (SELECT scene_id, saa - 180 AS v, saa - 180 > 0 AS positive FROM fx_angles WHERE saa <> 180), s AS (SELECT scene_id, positive, min(v) AS lo, max(v) AS hi FROM a GROUP BY 1, 2),
    k AS (SELECT scene_id, positive, lo, hi, coalesce(least(floor((v - lo) * 1000 / nullif(hi - lo, 0)), 999), 0) AS k, count(*) AS n FROM a JOIN s USING (scene_id, positive) GROUP BY 1, 2, 3, 4, 5)
    SELECT scene_id, positive, {s6('min_by(lo + k * (hi - lo) / 1000, -n * 1000 + k)', 'mode')} FROM k GROUP BY 1, 2""")
def azimuth_mode(a):
    out = K.azimuth_mode(a.withColumn("vaa", F.col("saa") - 180))
    return out.select("scene_id", "positive", r6(F.col("mode"), "mode"))


@query("a19_sample_diagnostics", "angles", sql="WITH v AS (SELECT * FROM (VALUES ('sza'), ('vza'), ('saa')) t(x)) SELECT a.x, b.x AS y, (round(CASE WHEN a.x = b.x THEN 1 WHEN a.x || b.x IN ('szavza', 'vzasza') THEN (SELECT corr(sza, vza) FROM fx_angles) WHEN a.x || b.x IN ('szasaa', 'saasza') THEN (SELECT corr(sza, saa) FROM fx_angles) ELSE (SELECT corr(vza, saa) FROM fx_angles) END, 4) + 0::DOUBLE) AS r FROM v a, v b")
def sample_diagnostics(a):
    return P.correlation_table(a, ["sza", "vza", "saa"]).select("x", "y", r6(F.col("r"), "r", 4))


@query("u01_join_windows", "brdf", sql="SELECT cell_id, band, day, qa FROM fx_brdf WHERE day < DATE '2024-02-10'")
def join_windows(b):
    return D.join_windows(b.where("day <= date'2024-01-20'"), b.where("day >= date'2024-01-10' AND day < date'2024-02-10'")).select("cell_id", "band", "day", "qa")


@query("u02_daily_mosaic", "brdf", sql="SELECT cell_id % 50 AS cell_id, day, band, arg_max(f_iso, cell_id) AS value FROM fx_brdf GROUP BY 1, 2, 3")
def daily_mosaic(b):
    return D.daily_mosaic(b.select((F.col("cell_id") % 50).alias("cell_id"), "day", "band", F.col("f_iso").alias("value"), F.col("cell_id").alias("tile_order")))


@query("u04_s05_scene_list", "mtl", "granules", sql="WITH m AS (SELECT scene_id, name, arg_max(value, line_no) AS value FROM (SELECT scene_id, line_no, trim(split_part(line, ' = ', 1)) AS name, split_part(line, ' = ', 2) AS value FROM fx_mtl) GROUP BY 1, 2) SELECT scene_id, name, value, NULL AS tile FROM m UNION ALL SELECT NULL, NULL, NULL, tile FROM fx_granules")
def scene_list(m, g):
    return M.one_scene_list(M.key_values(m, "^REFLECTANCE_MULT"), g.select("tile"))


@query("s05_landsat_scaling", "mtl", sql="SELECT scene_id, arg_max(split_part(line, ' = ', 2)::DOUBLE, line_no) AS mult FROM fx_mtl GROUP BY 1")
def landsat_scaling(m):
    return M.landsat_scaling(m).select("scene_id", "mult")


_MASK = _PLANES + ", g AS (SELECT s.scene_id, r::INT AS r, c::INT AS c FROM (SELECT DISTINCT scene_id FROM pl) s, range(40) a(r), range(40) b(c)), m AS (SELECT g.*, coalesce(p.dn > 9300, false) AS mask FROM g LEFT JOIN pl p ON p.scene_id = g.scene_id AND p.r = g.r AND p.c = g.c)"


def _mask(px, limit=9300):
    return N.dense(_planes(px).withColumn("mask", F.col("dn") > limit), SIDE, SIDE)


@query("n01_dilate", "px", sql=f"WITH {_MASK}, t AS (SELECT * FROM m WHERE mask) SELECT m.scene_id, m.r, m.c, EXISTS (SELECT 1 FROM t WHERE t.scene_id = m.scene_id AND abs(t.r - m.r) <= 3 AND abs(t.c - m.c) <= 3) AS mask FROM m")
def dilate(px):
    return N.dilate(_mask(px), 3)


@query("n02_erode", "px", sql=f"WITH {_MASK.replace('p.dn > 9300', 'p.dn IS NULL')}, t AS (SELECT * FROM m WHERE mask) SELECT m.scene_id, m.r, m.c, (SELECT count(*) FROM t WHERE t.scene_id = m.scene_id AND abs(t.r - m.r) <= 1 AND abs(t.c - m.c) <= 1) = 9 AS mask FROM m")
def erode(px):
    return N.erode(N.dense(_planes(px).withColumn("mask", F.lit(False)), SIDE, SIDE).withColumn("mask", F.col("mask").isNull()), 1)


@query("n03_open", "px", sql=f"""WITH {_MASK.replace('p.dn > 9300', 'p.dn IS NULL').replace('coalesce(p.dn IS NULL, false)', 'p.dn IS NULL')}, e AS (SELECT m.scene_id, m.r, m.c, NOT EXISTS (SELECT 1 FROM m t WHERE NOT t.mask AND t.scene_id = m.scene_id AND (t.r - m.r) * (t.r - m.r) + (t.c - m.c) * (t.c - m.c) <= 1) AS mask FROM m)
    SELECT e.scene_id, e.r, e.c, EXISTS (SELECT 1 FROM e t WHERE t.mask AND t.scene_id = e.scene_id AND (t.r - e.r) * (t.r - e.r) + (t.c - e.c) * (t.c - e.c) <= 9) AS mask FROM e""")
def open_mask(px):
    holes = N.dense(_planes(px).withColumn("mask", F.lit(False)), SIDE, SIDE).withColumn("mask", F.col("mask").isNull())
    return N.open_mask(holes, 1, 3)


_W = N.gaussian(1.2, 1.6)


@query("n04_n05_psf_average", "angles", "px", sql=f"""WITH {_PLANE_CELLS}, w AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {k!r}::DOUBLE)' for a, b, k in _W)}) t(dr, dc, w)),
    s AS (SELECT h.scene_id, hx, hy, w, CASE WHEN hx + dr >= 40 OR hy + dc >= 40 THEN 0 ELSE p.dn END AS v FROM hb h CROSS JOIN w LEFT JOIN pl p ON p.scene_id = h.scene_id AND p.r = hx + dr AND p.c = hy + dc)
    SELECT scene_id, hx AS r, hy AS c, {s6('sum(v * w) / sum(w)', 'dn')} FROM s WHERE v IS NOT NULL GROUP BY 1, 2, 3""")
def psf_average(a, px):
    points = _plane_cells(a).select("scene_id", F.col("hx").alias("r"), F.col("hy").alias("c"))
    return N.psf_average(points, _planes(px), _W, shape=(SIDE, SIDE)).select("scene_id", "r", "c", r6(F.col("dn"), "dn"))


def _gauss_pass(src: str, axis: str, std: float) -> str:
    n = math.ceil(4 * std)
    w = [math.exp(-0.5 * (k / std) ** 2) for k in range(-n, n + 1)]
    taps = ", ".join(f"({k}, {x / sum(w)!r}::DOUBLE)" for k, x in zip(range(-n, n + 1), w, strict=True))
    other = "c" if axis == "r" else "r"
    at = f"(((t.i + k.d) % 80) + 80) % 80"
    return f"""SELECT f.scene_id, {'t.i::INT AS r, f.c' if axis == 'r' else 'f.r, t.i::INT AS c'}, sum(k.w * f.dn) AS dn FROM range(40) t(i) CROSS JOIN (VALUES {taps}) k(d, w)
    JOIN {src} f ON f.{axis} = CASE WHEN {at} >= 40 THEN 79 - {at} ELSE {at} END GROUP BY f.scene_id, t.i, f.{other}"""


@query("n06_smooth", "px", sql=f"WITH {_filled('dn IS NOT NULL')}, rowed AS ({_gauss_pass('fill', 'r', 1.5)}), both_ways AS ({_gauss_pass('rowed', 'c', 2.0)}) SELECT scene_id, r, c, {s6('dn', 'dn', 5)} FROM both_ways")
def smooth(px):
    """Mirrored Gaussian of the nearest-filled planes."""
    full = N.nearest_fill(N.dense(_planes(px), SIDE, SIDE, "dn"), "dn")
    return N.smooth(full, 1.5, 2.0, SIDE, SIDE).select("scene_id", "r", "c", r6(F.col("dn"), "dn", 5))


@query("n10_smoothness", "angles", sql=f"""WITH b AS (SELECT scene_id, r AS bi, c AS bj, vza AS aot FROM fx_angles), d AS (SELECT a.scene_id, a.bi, a.bj, a.aot, n.bi AS ni, n.bj AS nj, a.aot - n.aot AS d FROM b a JOIN b n ON a.scene_id = n.scene_id AND abs(a.bi - n.bi) + abs(a.bj - n.bj) = 1),
    k AS (SELECT scene_id, bi, bj FROM d GROUP BY 1, 2, 3 HAVING count(*) = 4)
    SELECT b.scene_id, b.bi, b.bj, {s6('coalesce(sum(0.5 * 4 * d * d) FILTER (c.bi IS NOT NULL), 0)', 'cost', 5)}, {s6('coalesce(sum(4 * d) FILTER (c.bi IS NOT NULL), 0) + coalesce(sum(4 * d) FILTER (e.bi IS NOT NULL), 0)', 'gradient', 5)}
    FROM b LEFT JOIN d USING (scene_id, bi, bj) LEFT JOIN k c ON c.scene_id = b.scene_id AND c.bi = b.bi AND c.bj = b.bj LEFT JOIN k e ON e.scene_id = b.scene_id AND e.bi = ni AND e.bj = nj GROUP BY 1, 2, 3""")
def smoothness(a):
    full = N.dense(a, SIDE, SIDE, "vza").select("scene_id", F.col("r").alias("bi"), F.col("c").alias("bj"), F.col("vza").alias("aot"))
    out = N.smoothness(full, "aot", 2.0).join(full.where("aot is not null"), ["scene_id", "bi", "bj"])
    return out.select("scene_id", "bi", "bj", r6(F.coalesce("cost", F.lit(0.0)), "cost", 5), r6(F.coalesce("gradient", F.lit(0.0)), "gradient", 5))


@query("r01_o02_shift_search", "angles", "px", sql=f"""WITH {_CELLS}, s AS (SELECT xs::INT AS xs, ys::INT AS ys FROM range(-50, 50) a(xs), range(-50, 50) b(ys)),
    q AS (SELECT h.scene_id, p.r - hx AS xs, p.c - hy AS ys, corr(p.dn, boa) AS r, count(*) AS n FROM h JOIN fx_px p ON p.scene_id = h.scene_id AND p.band = 4 AND p.r - hx BETWEEN -50 AND 49 AND p.c - hy BETWEEN -50 AND 49 GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY round(abs(1 - r), 9), -n, xs, ys) AS k FROM q WHERE r IS NOT NULL AND NOT isnan(r))
    SELECT scene_id, CASE WHEN 1 - abs(1 - r) >= 0.6 THEN xs ELSE 0 END AS xs, CASE WHEN 1 - abs(1 - r) >= 0.6 THEN ys ELSE 0 END AS ys, {s6('r', 'r', 4)} FROM b WHERE k = 1""")
def shift_search(a, px):
    """Every shift in [-50, 50) of the reference band, accepted from 0.6 on."""
    out = X.search_shift(_cells(a).select("scene_id", "hx", "hy", "boa"), px.where("band = 4"))
    return out.select("scene_id", "xs", "ys", r6(F.col("r"), "r", 4))


@query("r02_width_search", "angles", "px")
def width_search(a, px):
    """Widths, angle and shift of each scene's point spread that agree best, of 50 starts and Newton steps from the best two."""
    found = X.search_width(_cells(a).select("scene_id", "hx", "hy", "boa"), px.where("band = 4"))
    best = F.min_by(F.struct("std_row", "std_col", "angle", "xs", "ys", "cost"), F.struct("cost", "k"))
    return found.groupBy("scene_id").agg(best.alias("b")).select("scene_id", "b.*")


def _robust_rounds(rounds: int, strength: float = 2.0) -> str:
    """x{rounds}: smoothed value x and weight w of every (cell_id, band, var, i), by tridiagonal sweeps over the days."""
    t = math.sqrt(1 + 16 * strength)
    leverage = math.sqrt(1 - math.sqrt(1 + t) / math.sqrt(2) / t)
    key = "cell_id, band, var"
    out = [f"""win AS (SELECT cell_id, band, (day - DATE '2023-12-31')::INT AS i, CASE WHEN qa = 255 THEN 0 ELSE pow(0.618034::DOUBLE, qa) END AS w,
        CASE WHEN f_iso = 32767 THEN 0 ELSE f_iso END AS f_iso, CASE WHEN f_vol = 32767 THEN 0 ELSE f_vol END AS f_vol, CASE WHEN f_geo = 32767 THEN 0 ELSE f_geo END AS f_geo
        FROM fx_brdf WHERE day BETWEEN DATE '2023-12-31' AND DATE '2024-02-01'),
    long AS (SELECT {key}, i, w, y FROM win UNPIVOT (y FOR var IN (f_iso, f_vol, f_geo))), keys AS (SELECT DISTINCT {key} FROM long),
    x0 AS (SELECT k.*, t.i::INT AS i, coalesce(l.w, 0)::DOUBLE AS w0, coalesce(l.w, 0)::DOUBLE AS w, coalesce(l.y, 0)::DOUBLE AS y, coalesce(l.y, 0)::DOUBLE AS x FROM keys k CROSS JOIN range(33) t(i)
        LEFT JOIN long l ON l.cell_id = k.cell_id AND l.band = k.band AND l.var = k.var AND l.i = t.i)"""]
    for n in range(1, rounds + 1):
        p = f"x{n - 1}"
        out.append(f"""f{n} AS (SELECT {key}, i, NULL::DOUBLE AS c, w + {strength} AS beta, w * y / (w + {strength}) AS x FROM {p} WHERE i = 0
        UNION ALL SELECT {key}, i, c, beta, (w * y + {strength} * last) / beta FROM (SELECT q.cell_id, q.band, q.var, q.i, -{strength} / f.beta AS c, q.w, q.y, f.x AS last,
            q.w + {strength} * (CASE WHEN q.i = 32 THEN 1 ELSE 2 END) - {strength * strength} / f.beta AS beta FROM f{n} f JOIN {p} q ON q.cell_id = f.cell_id AND q.band = f.band AND q.var = f.var AND q.i = f.i + 1)),
    b{n} AS (SELECT {key}, i, c, x FROM f{n} WHERE i = 32 UNION ALL SELECT f.cell_id, f.band, f.var, f.i, f.c, f.x - b.c * b.x FROM b{n} b JOIN f{n} f ON f.cell_id = b.cell_id AND f.band = b.band AND f.var = b.var AND f.i = b.i - 1),
    m{n} AS (SELECT p.*, b.x AS fresh, abs(b.x - p.y) AS gap FROM {p} p JOIN b{n} b USING (cell_id, band, var, i)),
    s{n} AS (SELECT {key}, greatest(coalesce(quantile_cont(gap, 0.5) FILTER (w0 > 0), 0), 1e-5) AS mad, sum(w0) > 1e-6 AS live FROM m{n} GROUP BY 1, 2, 3),
    u{n} AS (SELECT m.*, live, gap / (1.4826 * mad) / {leverage!r} / 4.685 AS u FROM m{n} m JOIN s{n} USING (cell_id, band, var)),
    x{n} AS (SELECT {key}, i, w0, CASE WHEN NOT live THEN w0 WHEN u < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0 END AS w, y, CASE WHEN live THEN fresh ELSE y END AS x FROM u{n})""")
    return ",\n    ".join(out)


_MIDDLE = ", ".join(f"{s6(f"max(x) FILTER (var = '{v}' AND i = 16)", v)}, {s6(f"CASE WHEN max(w0) = 0 THEN 1e-5 ELSE max(w) FILTER (var = '{v}' AND i = 16) END", v + '_w')}" for v in ("f_vol", "f_geo", "f_iso"))
_STEADY = lambda a, b: f"CASE WHEN avg(x) FILTER (var = 'f_iso' AND i BETWEEN {a} AND {b}) <> 0 THEN stddev_pop(x) FILTER (var = 'f_iso' AND i BETWEEN {a} AND {b}) / avg(x) FILTER (var = 'f_iso' AND i BETWEEN {a} AND {b}) END"


@query("n08_n09_a07_temporal", "brdf", sql=f"WITH RECURSIVE {_robust_rounds(3)} SELECT cell_id, band, {_MIDDLE}, {s6(_STEADY(6, 25), 'stability')}, {s6(_STEADY(12, 19), 'stability_near')} FROM x3 GROUP BY 1, 2")
def temporal(b):
    """Robust smoothing of every (cell, band) series around 16 January and its middle day."""
    w = S.brdf_window(b, "2024-01-16")
    cubes = S.series(w, ["cell_id", "band"], "2024-01-16", 16, ["f_iso", "f_vol", "f_geo"])
    out = S.centre_day(S.smooth_series(cubes, ["f_iso", "f_vol", "f_geo"]), ["f_vol", "f_geo", "f_iso"])
    return out.select("cell_id", "band", *[r6(F.col(c), c) for c in out.columns if c not in ("cell_id", "band")])


@query("a07_stability", "brdf", sql=f"""WITH w AS (SELECT cell_id, band, day - DATE '2023-12-31' AS i, f_iso FROM fx_brdf WHERE day BETWEEN DATE '2023-12-31' AND DATE '2024-02-01'), g AS (SELECT k.cell_id, k.band, coalesce(w.f_iso, 0) AS y FROM (SELECT DISTINCT cell_id, band FROM w) k CROSS JOIN range(6, 26) t(i) LEFT JOIN w ON w.cell_id = k.cell_id AND w.band = k.band AND w.i = t.i)
    SELECT cell_id, band, {s6('CASE WHEN avg(y) <> 0 THEN stddev_pop(y) / avg(y) END', 'stability')} FROM g GROUP BY 1, 2""")
def stability(b):
    cubes = S.series(b.withColumn("weight", F.lit(1.0)), ["cell_id", "band"], "2024-01-16", 16, ["f_iso"])
    return cubes.select("cell_id", "band", r6(S.stability(F.col("f_iso"), 10, 10), "stability"))


@query("n07_spline_smooth", "brdf")
def spline_smooth(b):
    """Cross-validated robust splines of every series."""
    cubes = S.series(S.brdf_window(b, "2024-01-16"), ["cell_id", "band"], "2024-01-16", 16, ["f_iso"])
    return S.smooth_splines(cubes, "f_iso", "weight")


@query("s13_posterior_layers", "angles", sql="SELECT scene_id, r AS bi, c AS bj, layer, value::FLOAT AS value FROM (SELECT scene_id, r, c, vza AS aot, sza AS tcwv, 0.3 AS tco3 FROM fx_angles) UNPIVOT (value FOR layer IN (aot, tcwv, tco3))")
def posterior_layers(a):
    return P.posterior_layers(a.select("scene_id", F.col("r").alias("bi"), F.col("c").alias("bj"), F.col("vza").alias("aot"), F.col("sza").alias("tcwv"), F.lit(0.3).alias("tco3")))


@query("s14_manifest", "px", "bands", sql=f"""WITH {WIDE}, s AS (SELECT scene_id, count(*) FILTER ({_VALID}) * 10000 // count(*) / 100::DOUBLE AS v, count(*) FILTER ({_VALID} AND NOT ({_WATER} OR {_SNOW})) * 10000 // count(*) / 100::DOUBLE AS k FROM fx_wide GROUP BY 1),
    o AS (SELECT scene_id, string_agg('{{"kind":"boa_' || band || '","path":"scene=' || scene_id || '/band=' || band || '"}}', ',' ORDER BY 'boa_' || band) AS files FROM (SELECT DISTINCT scene_id, band FROM fx_px) GROUP BY 1)
    SELECT scene_id, '{{"scene_id":' || scene_id || ',"version":"1","valid_percent":' || v || ',"clean_percent":' || k || ',"outputs":[' || files || ']}}' AS manifest FROM s JOIN o USING (scene_id)""")
def manifest(px, bands):
    """One JSON manifest a scene."""
    files = px.select("scene_id", "band").distinct().select("scene_id", F.concat(F.lit("boa_"), F.col("band")).alias("kind"), F.format_string("scene=%d/band=%d", "scene_id", "band").alias("path"))
    clean = P.clean_percent(P.composite(P.calibrated(px, bands)))
    return P.manifest(files, clean.withColumns({f"{c}_percent": P.hundredths(f"n_{c}", "n_pixels") for c in ("valid", "clean")}), "1")


def _blocks(a, n: int):
    """Prior blocks from the angle table: geometry and first guess per block."""
    k = 40 // n
    b = a.groupBy("scene_id", F.expr(f"r div {k}").cast("int").alias("bi"), F.expr(f"c div {k}").cast("int").alias("bj")).agg(
        F.avg("sza").alias("sza"), F.avg("vza").alias("vza"), F.avg("saa").alias("saa"), F.avg("vaa").alias("vaa"))
    return b.withColumns({**T.model_inputs(b), "ele": F.lit(0.0), "tco3": F.lit(0.3), "aot_prior": F.lit(0.2), "tcwv_prior": F.lit(2.0), "aot_unc": F.lit(0.4), "tcwv_unc": F.lit(1.0)})


def _observed(px, bands):
    """Observations by block, with a surface that reflects a fixed share of what is seen."""
    at = [F.expr(f"{k} div 5").cast("int").alias(n) for k, n in (("r", "bi"), ("c", "bj"))]
    return P.calibrated(px, bands).where("dn > 0").select("scene_id", "band", *at, "toa", (0.85 * F.col("toa")).alias("boa"), F.lit(0.05).alias("unc"))


def _planted(px, bands, unc: float):
    """Observations of the surface that an atmosphere makes of them which changes from block to block."""
    band, aot, tcwv = F.col("band"), 0.3 + 0.02 * F.col("bi"), 2.5 + 0.1 * F.col("bj")
    y, k = (1.1 + 0.3 / band * aot + 0.02 * band * tcwv) * F.col("toa") - (0.01 + 0.12 / band * aot), 0.05 + 0.1 / band * aot
    return _observed(px, bands).withColumns({"boa": y / (1 + k * y), "unc": F.lit(unc)})


@query("r03_r04_retrieval", "px", "bands", "angles")
def retrieval(px, bands, a):
    """Blocks of every scene retrieved through the pyramid of grids, with posterior uncertainty."""
    names = list(range(1, 8))
    few = bands
    # Written: every level of the pyramid and the information of the result read them.
    prior, obs = checkpointed(_blocks(a, 8), "prior"), checkpointed(_planted(px, few, 0.05), "observed")
    models = T.linear_models(names)
    solved = T.retrieve_pyramid(obs, prior, few, models, (8, 8), gamma=2.0)
    info = T.block_information(obs, solved, T.band_weights(few), names, models)
    joined = solved.join(info.hint("merge"), ["scene_id", "bi", "bj"], "left").select("scene_id", "bi", "bj", "info_aot", "info_tcwv", F.col("aot_unc").alias("aot_prior_unc"), F.col("tcwv_unc").alias("tcwv_prior_unc"))
    return solved.select("scene_id", "bi", "bj", "aot", "tcwv", "converged").join(T.posterior(joined, 2.0).hint("merge"), ["scene_id", "bi", "bj"])


_MODEL_BLOCKS = "g AS (SELECT scene_id, r // 5 AS bi, c // 5 AS bj FROM fx_angles GROUP BY 1, 2, 3)"


@query("r03_normal_sums", "px", "bands", "angles", sql=f"""WITH {_MODEL_BLOCKS}, {TOA}, w AS (SELECT band, pow(wavelength_nm / 1000::DOUBLE, -1.6) / sum(pow(wavelength_nm / 1000::DOUBLE, -1.6)) OVER () AS bw FROM fx_bands),
    o AS (SELECT t.scene_id, t.band, r // 5 AS bi, c // 5 AS bj, toa, 0.85::DOUBLE * toa AS boa, 0.25::DOUBLE * bw / (0.05::DOUBLE * 0.05::DOUBLE) AS w FROM fx_toa t JOIN w USING (band) WHERE dn > 0),
    m AS (SELECT o.*, 1.1 + 0.3::DOUBLE / band * 0.2 + 0.02::DOUBLE * band * 2 AS a, 0.01 + 0.12::DOUBLE / band * 0.2 AS b, 0.05 + 0.1::DOUBLE / band * 0.2 AS k, 0.3::DOUBLE / band AS a0, 0.02::DOUBLE * band AS a1, 0.12::DOUBLE / band AS b0, 0.1::DOUBLE / band AS k0 FROM o JOIN g USING (scene_id, bi, bj)),
    y AS (SELECT *, a * toa - b AS y, 1 + k * (a * toa - b) AS z FROM m),
    d AS (SELECT *, y / z - boa AS r, ((a0 * toa - b0) - k0 * y * y) / (z * z) AS d0, (a1 * toa) / (z * z) AS d1 FROM y)
    SELECT scene_id, bi, bj, {s6('sum(w * d0 * d0)', 'h00', 4)}, {s6('sum(w * d0 * d1)', 'h01', 4)}, {s6('sum(w * d1 * d1)', 'h11', 4)}, {s6('sum(w * d0 * r)', 'g0', 4)}, {s6('sum(w * d1 * r)', 'g1', 4)},
      {s6('0.5::DOUBLE * sum(w * r * r)', 'cost', 4)}, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def normal_sums(px, bands, a):
    """The retrieval's normal sums of every block at its prior."""
    prior = _blocks(a, 8).withColumns({"aot": F.col("aot_prior"), "tcwv": F.col("tcwv_prior")})
    got = T.normal_sums(_observed(px, bands), prior, T.band_weights(bands), list(range(1, 8)), T.linear_models(list(range(1, 8))))
    return got.select("scene_id", "bi", "bj", *[r6(F.col(c), c, 4) for c in ("h00", "h01", "h11", "g0", "g1", "cost")], "n")


def _uncoupled_sql(rounds: int) -> str:
    """Gauss-Newton rounds of every block by itself, from the prior (0.2, 2)."""
    ctes = ["s0 AS (SELECT scene_id, bi, bj, 0.2::DOUBLE AS aot, 2::DOUBLE AS tcwv FROM g)"]
    for k in range(rounds):
        ctes.append(f"""q{k} AS (SELECT o.*, aot, tcwv, (1.1 + 0.3::DOUBLE / band * aot + 0.02::DOUBLE * band * tcwv) * toa - (0.01 + 0.12::DOUBLE / band * aot) AS y, 0.05 + 0.1::DOUBLE / band * aot AS k FROM o JOIN s{k} USING (scene_id, bi, bj)),
    d{k} AS (SELECT *, y / (1 + k * y) - boa AS r, (0.3::DOUBLE / band * toa - 0.12::DOUBLE / band - 0.1::DOUBLE / band * y * y) / ((1 + k * y) * (1 + k * y)) AS d0, 0.02::DOUBLE * band * toa / ((1 + k * y) * (1 + k * y)) AS d1 FROM q{k}),
    m{k} AS (SELECT scene_id, bi, bj, sum(w * d0 * d0) + 6.25 AS a, sum(w * d0 * d1) AS b, sum(w * d1 * d1) + 1 AS c, sum(w * d0 * r) + 6.25 * (any_value(aot) - 0.2) AS g0, sum(w * d1 * r) + any_value(tcwv) - 2 AS g1 FROM d{k} GROUP BY 1, 2, 3 HAVING count(*) > 1),
    z{k} AS (SELECT scene_id, bi, bj, aot, tcwv, a, b, c, g0, g1, 0.001 - aot AS l0, 2.5 - aot AS h0, -tcwv AS l1, 7 - tcwv AS h1, -(c * g0 - b * g1) / (a * c - b * b) AS u0, -(a * g1 - b * g0) / (a * c - b * b) AS u1 FROM s{k} LEFT JOIN m{k} USING (scene_id, bi, bj)),
    y{k} AS (SELECT *, [{{'p': u0, 'q': u1, 'ok': u0 BETWEEN l0 AND h0 AND u1 BETWEEN l1 AND h1}}, {", ".join([f"{{'p': {e}, 'q': greatest(l1, least(h1, -(g1 + b * {e}) / c)), 'ok': true}}" for e in ("l0", "h0")] + [f"{{'p': greatest(l0, least(h0, -(g0 + b * {e}) / a)), 'q': {e}, 'ok': true}}" for e in ("l1", "h1")])}] AS t FROM z{k}),
    x{k} AS (SELECT *, list_filter(t, lambda v: v.ok AND v.p * g0 + v.q * g1 + (a * v.p * v.p + 2 * b * v.p * v.q + c * v.q * v.q) / 2 = list_min([w.p * g0 + w.q * g1 + (a * w.p * w.p + 2 * b * w.p * w.q + c * w.q * w.q) / 2 for w in t if w.ok]))[1] AS v FROM y{k}),
    s{k + 1} AS (SELECT scene_id, bi, bj, CASE WHEN a IS NULL THEN aot ELSE aot + v.p END AS aot, CASE WHEN a IS NULL THEN tcwv ELSE tcwv + v.q END AS tcwv FROM x{k})""")
    return ", ".join(ctes)


@query("r03_uncoupled", "px", "bands", "angles", sql=f"""WITH {_MODEL_BLOCKS}, {TOA}, w AS (SELECT band, pow(wavelength_nm / 1000::DOUBLE, -1.6) / sum(pow(wavelength_nm / 1000::DOUBLE, -1.6)) OVER () AS bw FROM fx_bands),
    f AS (SELECT t.scene_id, t.band, r // 5 AS bi, c // 5 AS bj, toa, 0.3::DOUBLE + 0.02::DOUBLE * (r // 5) AS pa, 2.5::DOUBLE + 0.1::DOUBLE * (c // 5) AS pt, 0.25::DOUBLE * bw / (0.01::DOUBLE * 0.01::DOUBLE) AS w FROM fx_toa t JOIN w USING (band) WHERE dn > 0),
    n AS (SELECT *, (1.1 + 0.3::DOUBLE / band * pa + 0.02::DOUBLE * band * pt) * toa - (0.01 + 0.12::DOUBLE / band * pa) AS y0, 0.05 + 0.1::DOUBLE / band * pa AS k0 FROM f),
    o AS (SELECT scene_id, band, bi, bj, toa, y0 / (1 + k0 * y0) AS boa, w FROM n), {_uncoupled_sql(12)}
    SELECT scene_id, bi, bj, {s6('aot', 'aot', 4)}, {s6('tcwv', 'tcwv', 4)}, true AS converged FROM s12""")
def uncoupled(px, bands, a):
    """Retrieval without smoothness, where every block is a system of its own, of an atmosphere that changes from block to block."""
    names = list(range(1, 8))
    obs = _planted(px, bands, 0.01)
    got = T.retrieve(obs, _blocks(a, 8), bands, T.linear_models(names), 0.0, tol=1e-7)
    return got.select("scene_id", "bi", "bj", r6(F.col("aot"), "aot", 4), r6(F.col("tcwv"), "tcwv", 4), "converged")


@query("s12_reflectance_sink", "px", "bands", sql=f"WITH {TOA} SELECT scene_id, band, r, c, CASE WHEN toa * 10000 > 0 THEN floor(toa * 10000 + 0.5) ELSE -9999 END::SMALLINT AS boa FROM fx_toa")
def reflectance_sink(px, bands):
    """Reflectance as it is read back after it was written, in ranges of scene, band and row."""
    spark = px.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/boa-{uuid.uuid4().hex}"
    P.write_reflectance(P.calibrated(px, bands).select("scene_id", "band", "r", "c", F.col("toa").alias("boa")), path)
    return spark.read.parquet(path).select("scene_id", "band", "r", "c", "boa")


@query("r04_posterior", "angles", sql=f"""WITH RECURSIVE b AS (SELECT scene_id, r // 2 AS bi, c // 2 AS bj, avg(vza) AS ia, avg(sza) AS it, 0.4::DOUBLE AS ua, CASE WHEN (r // 2 + c // 2) % 3 = 0 THEN 0 ELSE 1 END::DOUBLE AS ut FROM fx_angles GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY bi, bj) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM b),
    a AS (SELECT *, 4::DOUBLE * (3 - (k = 1)::INT - (k = n)::INT) AS links FROM k),
    d AS (SELECT *, ia + 1 / (ua * ua) + links AS da, it + CASE WHEN ut > 0 THEN 1 / (ut * ut) ELSE 0 END + links AS dt FROM a),
    up AS (SELECT scene_id, k, da AS a, dt AS t FROM d WHERE k = 1 UNION ALL SELECT d.scene_id, d.k, da - 16 / a, dt - 16 / t FROM up JOIN d ON d.scene_id = up.scene_id AND d.k = up.k + 1),
    down AS (SELECT scene_id, k, da AS a, dt AS t FROM d WHERE k = n UNION ALL SELECT d.scene_id, d.k, da - 16 / a, dt - 16 / t FROM down JOIN d ON d.scene_id = down.scene_id AND d.k = down.k - 1)
    SELECT scene_id, bi, bj, {s6('1 / sqrt(up.a + down.a - da)', 'aot_unc')}, {s6('1 / sqrt(up.t + down.t - dt)', 'tcwv_unc')} FROM d JOIN up USING (scene_id, k) JOIN down USING (scene_id, k)""")
def posterior_chain(a):
    """Posterior uncertainty along each scene's chain of blocks."""
    half = [F.expr(f"{k} div 2").cast("int").alias(n) for k, n in (("r", "bi"), ("c", "bj"))]
    blocks = a.groupBy("scene_id", *half).agg(F.avg("vza").alias("info_aot"), F.avg("sza").alias("info_tcwv"))
    blocks = blocks.withColumns({"aot_prior_unc": F.lit(0.4), "tcwv_prior_unc": F.when((F.col("bi") + F.col("bj")) % 3 == 0, 0.0).otherwise(1.0)})
    return T.posterior(blocks, 2.0).select("scene_id", "bi", "bj", r6(F.col("aot_unc"), "aot_unc"), r6(F.col("tcwv_unc"), "tcwv_unc"))


@query("r05_pyramid", "px", sql="""WITH s AS (SELECT scene_id, max(dn)::BIGINT % 300 + 1 AS ni, min(dn)::BIGINT % 200 + 1 AS nj FROM fx_px GROUP BY scene_id, band), d AS (SELECT DISTINCT * FROM s),
    l AS (SELECT *, greatest(len(bin(least(ni, nj))) - 1, 1) AS levels FROM d) SELECT scene_id, level::INT AS level, greatest(ni >> (levels - 1 - level), 1) AS ni, greatest(nj >> (levels - 1 - level), 1) AS nj FROM l, range(l.levels) t(level)""")
def pyramid(px):
    """Grid shapes from coarse to fine, for sides that the pixels give."""
    shapes = px.groupBy("scene_id", "band").agg((F.max("dn").cast("long") % 300 + 1).alias("ni"), (F.min("dn").cast("long") % 200 + 1).alias("nj")).select("scene_id", "ni", "nj").distinct()
    return T.pyramid_levels(shapes)


_BASIS = "CASE WHEN k = 0 THEN sqrt(1 / 40::DOUBLE) ELSE sqrt(2 / 40::DOUBLE) * cos(pi() * (2 * i + 1) * k / 80) END"


@query("n07_smooth_grids", "px", sql=f"""WITH {_PLANES}, b AS (SELECT i, k, {_BASIS} AS w FROM range(40) x(i), range(40) y(k)), g AS (SELECT p, r, c FROM (SELECT DISTINCT scene_id AS p FROM pl) s, range(40) a(r), range(40) b(c)),
    v AS (SELECT g.*, coalesce(dn, 0) / 1000 AS v FROM g LEFT JOIN pl ON pl.scene_id = p AND pl.r = g.r AND pl.c = g.c), f1 AS (SELECT p, r, k AS c, sum(v * w) AS v FROM v JOIN b ON i = c GROUP BY 1, 2, 3), f2 AS (SELECT p, k AS r, c, sum(v * w) AS v FROM f1 JOIN b ON i = r GROUP BY 1, 2, 3),
    h AS (SELECT p, r, c, v / (1 + 3 * pow(4 - 2 * cos(pi() * r / 40) - 2 * cos(pi() * c / 40), 2)) AS v FROM f2), b1 AS (SELECT p, i AS r, c, sum(v * w) AS v FROM h JOIN b ON k = r GROUP BY 1, 2, 3), b2 AS (SELECT p, r, i AS c, sum(v * w) AS v FROM b1 JOIN b ON k = c GROUP BY 1, 2, 3)
    SELECT p::INT AS scene_id, r::INT AS r, c::INT AS c, {s6('v', 'dn', 5)} FROM b2""")
def smooth_planes(px):
    """Every plane smoothed as a whole by splines of one strength; cells without a pixel are dark."""
    full = N.dense(_planes(px), SIDE, SIDE, "dn").withColumn("dn", F.coalesce("dn", F.lit(0.0)) / 1000)
    return Z.smooth_grids(full, "dn", ["scene_id"], 3.0).select("scene_id", "r", "c", r6(F.col("dn"), "dn", 5))


@query("p37_cloud_probability", "px", "bands", "qa")
def cloud_probability(px, bands, qa):
    """Cloud probability of cells twice as wide, by trees fitted to the quality table's own probabilities."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    half = [F.expr(f"{k} div 2").cast("int").alias(k) for k in ("r", "c")]
    # Written: the fit goes over its rows several times, and the model then reads the same means.
    coarse = checkpointed(P.calibrated(px, bands).groupBy("scene_id", "role", *half).agg(F.avg("toa").alias("toa")), "coarse")
    mean = coarse.groupBy("scene_id", "r", "c").agg(*[F.max(F.when(F.col("role") == k, F.col("toa"))).alias(k) for k in P.ROLES]).na.drop()
    seen = qa.groupBy("scene_id", *half).agg((F.avg("cloud_prob") > 0.6).cast("double").alias("label"))
    rows = checkpointed(mean.join(seen.hint("merge"), ["scene_id", "r", "c"]), "fitted")
    model = GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=list(P.ROLES), outputCol="features").transform(rows))
    return E.cloud_probability(coarse, list(P.ROLES), model, 1)


@query("p38_first_guess_tcwv", "angles", sql=f"""WITH g AS (SELECT scene_id, r, c, 0.5 + 0.2::DOUBLE * vza + 0.05::DOUBLE * sza AS g FROM fx_angles), m AS (SELECT scene_id, quantile_cont(g, 0.5) AS m FROM g WHERE g > 0 AND g < 3 GROUP BY 1)
    SELECT scene_id, r, c, {s6('CASE WHEN g > 0 AND g < 3 THEN g ELSE m END', 'tcwv')} FROM g LEFT JOIN m USING (scene_id)""")
def first_guess_tcwv(a):
    """Water vapour by a network of the angles; values out of range take the scene's median."""
    guess = E.first_guess_tcwv(a.select("scene_id", "r", "c", "vza", "sza"), ["vza", "sza"], T.exact_linear(0.5, (0.2, 0.05)), 0.0, 3.0)
    return guess.select("scene_id", "r", "c", r6(F.col("tcwv"), "tcwv"))


@query("p39_first_guess_aot", "angles")
def first_guess_aot(a):
    """Optical thickness by regression trees of the angles, trimmed, filled and smoothed."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = a.select("scene_id", "r", "c", "sza", "vza", (0.2 + F.col("saa") / 400).alias("label"))
    # Equal rows are one with their number as weight: the same fit, but every row counts in the choice of its thresholds and no pass over the cells is needed.
    weighed = checkpointed(rows.groupBy("sza", "vza", "label").agg(F.count("*").cast("double").alias("n")).coalesce(1).sortWithinPartitions("sza", "vza", "label"), "fitted")
    model = GBTRegressor(maxIter=3, maxDepth=3, seed=1, weightCol="n").fit(VectorAssembler(inputCols=["sza", "vza"], outputCol="features").transform(weighed))
    return E.first_guess_aot(rows.drop("label"), ["sza", "vza"], model, SIDE, SIDE)


def _tree_rows(n: int, trees: int, cut) -> list[tuple]:
    """Trees of seven inner nodes in heap order over n inputs; cut(k) is the threshold of the k-th inner node."""
    out = []
    for t in range(trees):
        out += [(t, i, (t + i) % n, cut(3 * t + i), 2 * i + 1, 2 * i + 2, None) for i in range(7)]
        out += [(t, i, None, None, None, None, ((5 * t + 3 * i) % 11 - 5) / 10) for i in range(7, 15)]
    return out


def _tree_sql(rows: list[tuple], names: list[str]) -> str:
    """The sum of the trees' values as nested cases."""
    at = {(r[0], r[1]): r for r in rows}

    def node(t: int, i: int) -> str:
        _, _, f, cut, low, high, value = at[t, i]
        return f"{value}::DOUBLE" if f is None else f"CASE WHEN {names[f]} <= {cut}::DOUBLE THEN {node(t, low)} ELSE {node(t, high)} END"

    return " + ".join(node(t, 0) for t in sorted({r[0] for r in rows}))


_CLOUD_TREES = _tree_rows(len(P.ROLES), 5, lambda k: (1 + k % 7) / 10)


@query("p37_tree_probability", "px", "bands", sql=f"""WITH {TOA}, h AS (SELECT scene_id, role, r // 2 AS r, c // 2 AS c, round(avg(toa), 9) AS toa FROM fx_toa GROUP BY 1, 2, 3, 4),
    w AS (SELECT scene_id, r, c, {', '.join(f"max(toa) FILTER (role = '{k}') AS {k}" for k in P.ROLES)} FROM h GROUP BY 1, 2, 3)
    SELECT scene_id, r, c, {s6(f"CASE WHEN {_VALID} THEN 1 / (1 + exp(-({_tree_sql(_CLOUD_TREES, list(P.ROLES))}))) END", 'cloud_prob')} FROM w""")
def tree_probability(px, bands):
    """Cloud probability of cells twice as wide by trees that come as a table."""
    out = E.cloud_probability(P.calibrated(px, bands), list(P.ROLES), Trees(_CLOUD_TREES), 2)
    return out.select("scene_id", *[F.col(k).cast("int").alias(k) for k in ("r", "c")], r6(F.col("cloud_prob"), "cloud_prob"))


_AOT_TREES = _tree_rows(2, 4, lambda k: float(2 + (5 * k) % 60))


@query("p39_tree_aot", "angles", sql=f"""WITH g AS (SELECT scene_id, r, c, exp(-({_tree_sql(_AOT_TREES, ['sza', 'vza'])})) AS g FROM fx_angles), q AS (SELECT scene_id, quantile_cont(g, 0.05) AS lo, quantile_cont(g, 0.95) AS hi FROM g GROUP BY 1),
    p AS (SELECT scene_id, r, c, g AS dn FROM g JOIN q USING (scene_id) WHERE g BETWEEN lo AND hi), cell AS (SELECT s.scene_id, r::INT AS r, c::INT AS c FROM q s, range(40) a(r), range(40) b(c)),
    own AS (SELECT cell.*, p.dn FROM cell LEFT JOIN p USING (scene_id, r, c)),
    far AS (SELECT o.scene_id, o.r, o.c, arg_min(p.dn, ((p.r - o.r) * (p.r - o.r) + (p.c - o.c) * (p.c - o.c)) * 10000 + p.r * 100 + p.c) AS dn FROM own o JOIN p ON p.scene_id = o.scene_id WHERE o.dn IS NULL GROUP BY 1, 2, 3),
    v AS (SELECT own.scene_id AS p, own.r, own.c, coalesce(own.dn, far.dn) AS v FROM own LEFT JOIN far USING (scene_id, r, c)), b AS (SELECT i, k, {_BASIS} AS w FROM range(40) x(i), range(40) y(k)),
    f1 AS (SELECT p, r, k AS c, sum(v * w) AS v FROM v JOIN b ON i = c GROUP BY 1, 2, 3), f2 AS (SELECT p, k AS r, c, sum(v * w) AS v FROM f1 JOIN b ON i = r GROUP BY 1, 2, 3),
    h AS (SELECT p, r, c, v / (1 + 0.5::DOUBLE * pow(4 - 2 * cos(pi() * r / 40) - 2 * cos(pi() * c / 40), 2)) AS v FROM f2), b1 AS (SELECT p, i AS r, c, sum(v * w) AS v FROM h JOIN b ON k = r GROUP BY 1, 2, 3), b2 AS (SELECT p, r, i AS c, sum(v * w) AS v FROM b1 JOIN b ON k = c GROUP BY 1, 2, 3)
    SELECT p AS scene_id, r::INT AS r, c::INT AS c, {s6('v', 'aot', 5)} FROM b2""")
def tree_aot(a):
    """First guess of the optical thickness by trees that come as a table: trimmed, filled and smoothed with one strength."""
    out = E.first_guess_aot(a.select("scene_id", "r", "c", "sza", "vza"), ["sza", "vza"], Trees(_AOT_TREES), SIDE, SIDE, 0.5)
    return out.select("scene_id", "r", "c", r6(F.col("aot"), "aot", 5))


@query("r06_correction", "px", "bands", "angles", sql=f"""WITH g AS (SELECT DISTINCT scene_id, r // 8 AS bi, c // 8 AS bj FROM fx_angles), {TOA}, p AS (SELECT t.*, (1.1 + 0.3::DOUBLE / band * 0.2 + 0.02::DOUBLE * band * 2) AS a, (0.01 + 0.12::DOUBLE / band * 0.2) AS b, (0.05 + 0.1::DOUBLE / band * 0.2) AS k FROM fx_toa t JOIN g ON g.scene_id = t.scene_id AND g.bi = t.r // 8 AND g.bj = t.c // 8)
    SELECT scene_id, band, r, c, {s6('CASE WHEN dn > 0 THEN (a * toa - b) / (1 + k * (a * toa - b)) END', 'boa')} FROM p""")
def correction(px, bands, a):
    blocks = _blocks(a, 5).withColumns({"aot": F.lit(0.2), "tcwv": F.lit(2.0), "tco3_unc": F.lit(0.05)})
    names = list(range(1, 8))
    out = T.correct(px, bands, blocks, T.linear_models(names), (40, 40), (5, 5))
    return out.select("scene_id", "band", "r", "c", r6(F.col("boa"), "boa"))


@query("a20_composite", "px", "bands", sql=f"WITH {WIDE} SELECT scene_id, r, c, " + ", ".join(s6(k, k) for k in P.ROLES) + " FROM fx_wide")
def composite(px, bands):
    w = P.composite(P.calibrated(px, bands))
    return w.select("scene_id", "r", "c", *[r6(F.col(k), k) for k in P.ROLES])


_PLANE_GRID = "fx_samples AS (SELECT sza, v::DOUBLE AS vza, 0::DOUBLE AS raa FROM (SELECT DISTINCT -6.0::DOUBLE * label AS sza FROM embeddings), range(-89, 90) t(v))"


@table_query("a21_kernel_tables", "embeddings", sql=f"WITH {_PLANE_GRID}, {_KV} SELECT sza, vza, {s6('kv', 'k_vol', 5)}, {s6('kg', 'k_geo', 5)} FROM k")
def kernel_tables(e):
    """Kernels of the principal plane for each sun zenith class that the labels stand for."""
    z = e.select((-6.0 * F.col("label")).alias("sza")).distinct()
    grid = z.select("sza", F.explode(F.sequence(F.lit(-89), F.lit(89))).alias("vza")).withColumns({"vza": F.col("vza").cast("double"), "raa": F.lit(0.0)})
    return K.with_kernels(grid).select("sza", "vza", r6(F.col("k_vol"), "k_vol", 5), r6(F.col("k_geo"), "k_geo", 5))


_GAUSS = ", ".join(f"({(x + 1) / 2!r}::DOUBLE, {w / 2!r}::DOUBLE)" for x, w in zip(*(v.tolist() for v in K.gauss_nodes(24)), strict=True))
_HEMISPHERE = "f AS (SELECT sza, mu, wm, acos(mu) AS v, radians(sza) AS s, (i + 0.5) * (2 * pi() / 48) AS a FROM (SELECT DISTINCT floor(sza)::INT AS sza FROM fx_angles WHERE sza < 90), (VALUES " + _GAUSS + ") n(mu, wm), range(48) t(i)), " + _FOLD[_FOLD.index("ph AS"):]


@query("a17_albedo", "angles", sql=f"""WITH {_HEMISPHERE}, {_li_sql(A.SPARSE_SHAPE, 'a')} SELECT sza, {s6('sum(mu * wm * 2 / 48 * body / (cos(v) + cos(s)))', 'bsa_vol', 5)},
    {s6('sum(mu * wm * 2 / 48 * (o - secants + 0.5 * (1 + cq) / cos(v1) / cos(s1)))', 'bsa_geo', 5)} FROM lia GROUP BY 1""")
def albedo(a):
    """Black-sky integrals at the sun zeniths that occur."""
    z = a.where("sza < 90").select(F.floor("sza").cast("int").alias("sza")).distinct()
    return K.albedo_integrals(z.sparkSession, zeniths=z).select("sza", r6(F.col("bsa_vol"), "bsa_vol", 5), r6(F.col("bsa_geo"), "bsa_geo", 5))


@table_query("n11_latin_hypercube", "supplier", sql="SELECT d::INT AS dimension, s::BIGINT AS stratum FROM range(3) a(d), (SELECT row_number() OVER () - 1 AS s FROM supplier) t")
def latin_strata(suppliers):
    """The strata that a design with a point for each supplier hits: every one once in every dimension."""
    n = suppliers.count()
    design = X.latin_hypercube(suppliers.sparkSession, n, [(0.0, 1.0), (-2.0, 2.0), (5.0, 6.0)], 3)
    of = [F.floor(F.col("x0") * n), F.floor((F.col("x1") + 2) / 4 * n), F.floor((F.col("x2") - 5) * n)]
    return design.select(F.posexplode(F.array(*of)).alias("dimension", "stratum"))


def _mixed_sql(*parts: str) -> str:
    out = "1"
    for p, m in zip(parts, X.MIX, strict=False):
        out = f"list_reduce([0::HUGEINT, ({out} * {m} + ({p}) % {X.PRIME}) % {X.PRIME}], lambda a, h: (h * h + h + 7) % {X.PRIME})"
    return out


def _design_sql(k: int, low: float, high: float) -> str:
    """One coordinate of a design over n points of the row's ordinal i."""
    key = 3 * 1009 + k + 1
    other = f"((({_mixed_sql('r', str(key))}) % n - x) % n + n) % n"
    coin = _mixed_sql(f"greatest(x, {other})", "r", str(key))
    place = f"list_reduce(list_prepend(i::HUGEINT, range(1, {X.SHUFFLES} + 1)::HUGEINT[]), lambda x, r: CASE WHEN ({coin} // 1024) % 2 = 1 THEN {other} ELSE x END)"
    return s6(f"({place} + ({_mixed_sql('i', str(key), '3')})::DOUBLE / {X.PRIME}) / n * {high - low}::DOUBLE + {low}::DOUBLE", f"x{k}")


_BOUNDS = [(0.0, 1.0), (-2.0, 2.0), (5.0, 6.0)]


@table_query("n11_design_points", "supplier", sql=f"WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, {', '.join(_design_sql(k, *b) for k, b in enumerate(_BOUNDS))} FROM s")
def design_points(suppliers):
    """Every supplier's own point of a design over all of them; their keys count from 0 without gaps."""
    n = suppliers.count()
    out = X.design(suppliers, "s_suppkey", n, _BOUNDS, 3)
    return out.select("s_suppkey", *[r6(F.col(f"x{k}"), f"x{k}") for k in range(len(_BOUNDS))])


@query("s15_reuse", "px", "bands", sql=f"WITH {TOA} SELECT scene_id, band, r, c, {s6('toa', 'toa')} FROM fx_toa")
def reused_table(px, bands):
    """Calibrated pixels, written on the first call and read back on the second one and whenever their inputs are the same."""
    toa = P.calibrated(px, bands).select("scene_id", "band", "r", "c", r6(F.col("toa"), "toa"))
    root = f"{shared_dir(px.sparkSession).rstrip('/')}/reuse"
    reused(toa, root, "toa")
    return reused(toa, root, "toa")


@query("s01_discover_sentinel", "listing", sql="SELECT path FROM fx_listing WHERE regexp_matches(path, '/MTD[^/]*TL[^/]*[.]xml$') OR suffix(path, '/metadata.xml')")
def discover_sentinel(f):
    return M.sentinel_files(f)


@query("s02_discover_landsat", "listing", sql="SELECT other AS path, string_split(other, '/')[-2] AS scene, string_split(string_split(other, '/')[-2], '_')[-2]::INT AS collection FROM fx_listing WHERE contains(lower(string_split(other, '/')[-1]), 'mtl.txt')")
def discover_landsat(f):
    return M.landsat_files(f.select(F.col("other").alias("path")))


def _tile_lines(t):
    """Metadata lines of the scenes that the suppliers stand for."""
    tile = F.concat(F.lit("  <TILE_ID>S2A_OPER_MSI_L1C_TL_X_A0_T"), "mm", F.lit("UCU_N"), "major", "minor", F.lit("</TILE_ID>"))
    time = F.concat(F.lit('  <SENSING_TIME metadataLevel="x">2020-01-02T10:'), "mm", F.lit(":11.123Z</SENSING_TIME>"))
    offsets = [F.concat(F.lit(f'<RADIO_ADD_OFFSET band_id="{k}">-'), (1000 + F.col("n") % 7 + k).cast("string"), F.lit("</RADIO_ADD_OFFSET>")) for k in range(1, 6)]
    q = F.concat(F.lit('<QUANTIFICATION_VALUE unit="none">'), (10000 + F.col("n") % 3).cast("string"), F.lit("</QUANTIFICATION_VALUE>"))
    return t.select("path", F.posexplode(F.array(F.lit("<x>"), tile, time, *offsets, q)).alias("line_no", "line"))


@query("s03_sentinel_metadata", "tile_xml", sql="""SELECT path, ('2020-01-02 10:' || mm || ':11.123')::TIMESTAMP AS sensing_time, 'T' || mm || 'UCU' AS tile, 'S2A' AS satellite, (replace(major, '.', '') || minor)::INT AS baseline FROM fx_tile_xml""")
def sentinel_metadata(t):
    return M.sentinel_metadata(_tile_lines(t))


@query("s04_sentinel_offsets", "tile_xml", "bands", sql="""SELECT path, band, CASE WHEN major = '05.0' AND band < 6 THEN -(1000 + n % 7 + band)::DOUBLE ELSE 0::DOUBLE END AS "offset",
    CASE WHEN major = '05.0' THEN (10000 + n % 3)::DOUBLE ELSE 10000::DOUBLE END AS quantification FROM fx_tile_xml, fx_bands""")
def sentinel_offsets(t, bands):
    rows = _tile_lines(t)
    return M.sentinel_offsets(rows, M.sentinel_metadata(rows), bands)


def _angle_documents(a):
    """One XML document a scene with its angles as grids; missing cells are NaN."""
    side, names = F.sequence(F.lit(0), F.lit(SIDE - 1)), ("sza", "saa", "vza", "vaa")
    # By line first: looking a key up in a map takes its length.
    line = lambda n: F.array_join(F.transform(side, lambda k: F.coalesce(F.try_element_at(F.col(n), k).cast("string"), F.lit("NaN"))), " ")
    lines = a.groupBy("scene_id", "r").agg(*[F.map_from_entries(F.collect_list(F.struct("c", n))).alias(n) for n in names]).select("scene_id", "r", *[line(n).alias(n) for n in names])
    maps = lines.groupBy("scene_id").agg(*[F.map_from_entries(F.collect_list(F.struct("r", n))).alias(n) for n in names])
    none = F.lit(" ".join(["NaN"] * SIDE))

    def grids(tag: str, zenith: str, azimuth: str):
        text = lambda n: F.array_join(F.transform(side, lambda r: F.concat(F.lit("<VALUES>"), F.coalesce(F.try_element_at(F.col(n), r), none), F.lit("</VALUES>"))), "")
        return F.concat(F.lit(f"<{tag}><Zenith><Values_List>"), text(zenith), F.lit("</Values_List></Zenith><Azimuth><Values_List>"), text(azimuth), F.lit(f"</Values_List></Azimuth></{tag.split()[0]}>"))

    value = F.concat(F.lit("<n><Tile_Angles>"), grids("Sun_Angles_Grid", "sza", "saa"), grids('Viewing_Incidence_Angles_Grids bandId="1" detectorId="2"', "vza", "vaa"), F.lit("</Tile_Angles></n>"))
    return maps.select(F.col("scene_id").cast("string").alias("path"), value.alias("value"))


_SCENE_CELLS = "g AS (SELECT s.scene_id, r::INT AS r, c::INT AS c FROM (SELECT DISTINCT scene_id FROM fx_angles) s, range(40) a(r), range(40) b(c))"


@query("s07_sun_angles", "angles", sql=f"WITH {_SCENE_CELLS} SELECT scene_id::VARCHAR AS path, r, c, sza, CASE WHEN saa > 180 THEN saa - 360 ELSE saa END AS saa FROM g LEFT JOIN fx_angles USING (scene_id, r, c)")
def sun_angles(a):
    return M.angle_cells(_angle_documents(a))[0]


@query("s07_view_angles", "angles", sql=f"WITH {_SCENE_CELLS} SELECT scene_id::VARCHAR AS path, 1::INT AS band, 2::INT AS det, r, c, vza, vaa FROM g LEFT JOIN fx_angles USING (scene_id, r, c)")
def view_angles(a):
    return M.angle_cells(_angle_documents(a))[1]


@query("s10_multi_angle", "samples", sql="""SELECT pixel::VARCHAR AS path, sample_id + 1 AS line_no, doy::DOUBLE AS doy, vza, sza, raa - 10 AS raa, b::INT AS band, [645.0, 859.0][b + 1]::DOUBLE AS wavelength, CASE WHEN b = 0 THEN refl ELSE refl * 2 END AS refl
    FROM fx_samples, range(2) t(b) WHERE sample_id % 3 = 1""")
def multi_angle(s):
    """Sample files of the pixels, as their lines: a header, then day, flag, view and sun angles and two bands."""
    text = lambda *c: F.concat_ws(" ", *[(x if isinstance(x, str) else x.cast("string")) for x in c])
    head = s.select(F.col("pixel").cast("string").alias("path"), F.lit(0).cast("long").alias("line_no"), F.lit("BRDF x 2 645 859").alias("line")).distinct()
    data = s.select(F.col("pixel").cast("string").alias("path"), (F.col("sample_id") + 1).alias("line_no"),
                    text(F.col("doy"), F.col("sample_id") % 3, F.col("vza"), F.col("raa"), F.col("sza"), F.lit(10), F.col("refl"), F.col("refl") * 2).alias("line"))
    return M.multi_angle(head.unionByName(data))


@query("s11_five_band", "samples", sql="SELECT pixel::VARCHAR AS path, sample_id AS line_no, vza, sza, raa, b::INT AS band, refl + b AS refl FROM fx_samples, range(5) t(b)")
def five_band(s):
    line = F.concat_ws(" ", F.lit("0 1"), F.col("sza").cast("string"), F.lit("3"), F.col("vza").cast("string"), F.col("raa").cast("string"), *[(F.col("refl") + k).cast("string") for k in range(5)])
    return M.five_band(s.select(F.col("pixel").cast("string").alias("path"), F.col("sample_id").alias("line_no"), line.alias("line")))
