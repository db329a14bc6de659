"""Queries of the projections and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.functions import angles as A
from rasterloom.functions import grid as G
from rasterloom.functions import radiometry as R
from rasterloom.functions import rpc
from rasterloom.operators import emulator as E
from rasterloom.operators import kernel_fit as K
from rasterloom.operators import pixels as P
from rasterloom.operators import regrid as D
from rasterloom.operators import retrieval as T

from .registry import query, table_query


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def s6(x: str, name: str, digits: int = 6) -> str:
    """The same in SQL; the sum turns -0 into 0."""
    return f"(round({x}, {digits}) + 0::DOUBLE) AS {name}"


TOA = "fx_toa AS (SELECT p.*, role, dn * scale + off AS toa FROM fx_px p JOIN fx_bands USING (band))"
WIDE = TOA + ", fx_wide AS (SELECT scene_id, r, c, " + ", ".join(f"max(CASE WHEN role = '{k}' THEN toa END) AS {k}" for k in P.ROLES) + " FROM fx_toa GROUP BY 1, 2, 3)"


@query("s06_scan", "px", sql="SELECT scene_id, band, r, c, nullif(dn, 0) AS dn FROM fx_px WHERE band IN (2, 4) AND scene_id IN (1, 2) AND r >= 5 AND r < 30 AND c >= 3 AND c < 33")
def scan(px):
    return P.scan(px, [2, 4], [1, 2], (5, 30), (3, 33)).select("scene_id", "band", "r", "c", "dn")


@query("p01_calibrate", "px", "bands", sql=f"SELECT scene_id, band, r, c, {s6('dn * scale + off', 'toa')} FROM fx_px JOIN fx_bands USING (band)")
def calibrate(px, bands):
    return P.calibrated(px, bands).select("scene_id", "band", "r", "c", r6(F.col("toa"), "toa"))


@query("p02_sun_calibrate", "px", "bands", "angles", sql=f"SELECT scene_id, band, r, c, {s6('(dn * scale + off) / cos(radians(sza))', 'toa')} FROM fx_px JOIN fx_bands USING (band) JOIN fx_angles USING (scene_id, r, c)")
def sun_calibrate(px, bands, angles):
    return P.sun_calibrated(px, bands, angles).select("scene_id", "band", "r", "c", r6(F.col("toa"), "toa"))


_RAA = "(((vaa - saa) % 360 + 360) % 360)"


@query("p03_angles", "angles", sql=f"""SELECT scene_id, r, c, {s6('cos(radians(sza))', 'cos_sza')}, {s6('cos(radians(vza))', 'cos_vza')},
    {s6(f'CASE WHEN {_RAA} > 180 THEN {_RAA} - 360 ELSE {_RAA} END', 'raa')}, {s6('vza * 0.01', 'decoded')} FROM fx_angles""")
def angles(a):
    return a.select("scene_id", "r", "c", r6(F.cos(F.radians("sza")), "cos_sza"), r6(F.cos(F.radians("vza")), "cos_vza"),
                    r6(A.relative_azimuth_deg(F.col("vaa"), F.col("saa")), "raa"), r6(A.decode(F.col("vza")), "decoded"))


@query("p04_elevation", "angles", sql=f"SELECT scene_id, r, c, {s6('coalesce(nullif(vaa, 0) * 0.001, 0)', 'ele')} FROM fx_angles")
def elevation(a):
    return a.select("scene_id", "r", "c", r6(R.elevation(F.nullif(F.col("vaa"), F.lit(0.0))), "ele"))


@query("p05_p06_indices", "px", "bands", sql=f"""WITH {WIDE} SELECT scene_id, r, c, {s6('(nir - red) / nullif(nir + red, 0)', 'ndvi')}, {s6('(green - swir1) / nullif(green + swir1, 0)', 'ndsi')} FROM fx_wide""")
def indices(px, bands):
    w = P.composite(P.calibrated(px, bands))
    return w.select("scene_id", "r", "c", r6(R.ndvi(F.col("nir"), F.col("red")), "ndvi"), r6(R.ndsi(F.col("green"), F.col("swir1")), "ndsi"))


@query("p07_p19_weights", "brdf", sql=f"""WITH w AS (SELECT cell_id, band, day, CASE WHEN qa = 255 THEN 0 ELSE pow(0.618034::DOUBLE, qa) END AS w FROM fx_brdf)
    SELECT cell_id, band, day, {s6('w', 'weight')}, {s6('0.015::DOUBLE / greatest(w, 1e-4)', 'unc')} FROM w""")
def weights(b):
    w = R.qa_weight(F.col("qa"))
    return b.select("cell_id", "band", "day", r6(w, "weight"), r6(R.weight_uncertainty(w), "unc"))


@query("p08_p09_quality_bits", "qa", sql="""SELECT scene_id, r, c, ((qa_bits & 1) | (qa_bits >> 1 & 1) | (qa_bits >> 2 & 1) | (qa_bits >> 4 & 1) | (qa_bits >> 7 & 1)) = 1 AS bad,
    qa_bits + 2600 BETWEEN 2720 AND 2732 AS clear FROM fx_qa""")
def quality_bits(qa):
    return qa.select("scene_id", "r", "c", R.any_bit(F.col("qa_bits")).alias("bad"), R.clear_collection1(F.col("qa_bits") + 2600).alias("clear"))


_FOLD = """f AS (SELECT *, abs(radians(vza)) AS v, abs(radians(sza)) AS s, radians(raa) + CASE WHEN vza < 0 THEN pi() ELSE 0 END + CASE WHEN sza < 0 THEN pi() ELSE 0 END AS a FROM fx_samples),
ph AS (SELECT *, greatest(-1, least(1, cos(v) * cos(s) + sin(v) * sin(s) * cos(a))) AS cp FROM f),
rk AS (SELECT *, acos(cp) AS x, (pi() / 2 - acos(cp)) * cp + sin(acos(cp)) AS body FROM ph)"""


def _li_sql(shape: tuple[float, float], tag: str) -> str:
    hb, br = shape
    return f"""g{tag} AS (SELECT *, atan(greatest({br} * tan(v), 0)) AS v1, atan(greatest({br} * tan(s), 0)) AS s1, ((a % (2 * pi())) + 2 * pi()) % (2 * pi()) AS phi FROM rk),
    h{tag} AS (SELECT *, greatest(-1, least(1, cos(v1) * cos(s1) + sin(v1) * sin(s1) * cos(phi))) AS cq, 1 / cos(v1) + 1 / cos(s1) AS secants,
      greatest(tan(v1) * tan(v1) + tan(s1) * tan(s1) - 2 * tan(v1) * tan(s1) * cos(phi), 0) AS d2 FROM g{tag}),
    i{tag} AS (SELECT *, acos(greatest(-1, least(1, {hb} * sqrt(d2 + pow(tan(v1) * tan(s1) * sin(phi), 2)) / secants))) AS t FROM h{tag}),
    li{tag} AS (SELECT *, greatest((t - sin(t) * cos(t)) * secants / pi(), 0) AS o FROM i{tag})"""


@query("p10_p11_geometry", "samples", sql=f"WITH {_FOLD} SELECT sample_id, {s6('v', 'vza_rad')}, {s6('s', 'sza_rad')}, {s6('a', 'raa_rad')}, {s6('x', 'phase')} FROM rk")
def geometry(s):
    v, z, a = A.fold(F.radians("vza"), F.radians("sza"), F.radians("raa"))
    return s.select("sample_id", r6(v, "vza_rad"), r6(z, "sza_rad"), r6(a, "raa_rad"), r6(A.phase_angle(v, z, a), "phase"))


@query("p12_p14_ross", "samples", sql=f"""WITH {_FOLD} SELECT sample_id, {s6('body / (cos(v) + cos(s))', 'thick')}, {s6('body / (cos(v) * cos(s))', 'thin')},
    {s6('body / (cos(v) + cos(s)) * (1 + 1 / (1 + x / 0.25))', 'hot')}, {s6('body / (cos(v) + cos(s)) - pi() / 4', 'normalised')} FROM rk""")
def ross(s):
    g = A.fold(F.radians("vza"), F.radians("sza"), F.radians("raa"))
    return s.select("sample_id", r6(A.ross(*g), "thick"), r6(A.ross(*g, thin=True), "thin"), r6(A.ross(*g, hot_spot=True), "hot"), r6(A.normalised(A.ross, *g), "normalised"))


@query("p15_li_sparse", "samples", sql=f"""WITH {_FOLD}, {_li_sql(A.SPARSE_SHAPE, 'a')} SELECT sample_id, {s6('o - secants + 0.5 * (1 + cq) / cos(v1) / cos(s1)', 'reciprocal')},
    {s6('o - secants + 0.5 * (1 + cq) / cos(v1)', 'plain')} FROM lia""")
def li_sparse(s):
    g = A.fold(F.radians("vza"), F.radians("sza"), F.radians("raa"))
    return s.select("sample_id", r6(A.li_sparse(*g), "reciprocal"), r6(A.li_sparse(*g, reciprocal=False), "plain"))


@query("p16_p17_li_dense", "samples", sql=f"""WITH {_FOLD}, {_li_sql(A.DENSE_SHAPE, 'a')} SELECT sample_id, {s6('(1 + cq) / (cos(v1) * cos(s1) * (secants - o)) - 2', 'dense')},
    {s6('(((pi() - phi) * cos(phi) + sin(phi)) * tan(s) * tan(v)) * (0.5 / pi()) - (tan(s) + tan(v) + sqrt(greatest(tan(s) * tan(s) + tan(v) * tan(v) - 2 * tan(s) * tan(v) * cos(phi), 0))) / pi()', 'roujean')} FROM lia""")
def li_dense(s):
    g = A.fold(F.radians("vza"), F.radians("sza"), F.radians("raa"))
    return s.select("sample_id", r6(A.li_dense(*g), "dense"), r6(A.roujean(*g), "roujean"))


@query("p16_li_transit", "samples", sql=f"""WITH {_FOLD}, {_li_sql(A.SPARSE_SHAPE, 'a')} SELECT sample_id,
    {s6('CASE WHEN secants - o <= 2 THEN o - secants + 0.5 * (1 + cq) / cos(v1) / cos(s1) ELSE (1 + cq) / (cos(v1) * cos(s1) * (secants - o)) - 2 END', 'transit')} FROM lia""")
def li_transit(s):
    g = A.fold(F.radians("vza"), F.radians("sza"), F.radians("raa"))
    return s.select("sample_id", r6(A.li_transit(*g), "transit"))


@query("p18_kernel_reflectance", "brdf", sql=f"""WITH b AS (SELECT *, radians(10) AS v, radians(30) AS s, radians(50) AS a FROM fx_brdf),
    k AS (SELECT *, cos(v) * cos(s) + sin(v) * sin(s) * cos(a) AS cp FROM b), r AS (SELECT *, ((pi() / 2 - acos(cp)) * cp + sin(acos(cp))) / (cos(v) + cos(s)) - pi() / 4 AS vol FROM k)
    SELECT cell_id, band, day, {s6('0.001 * (f_iso + f_vol * vol + f_geo * 0.25)', 'refl')} FROM r""")
def kernel_reflectance(b):
    v, s, a = (F.radians(F.lit(x)) for x in (10.0, 30.0, 50.0))
    return b.select("cell_id", "band", "day", r6(R.kernel_reflectance(F.col("f_iso"), F.col("f_vol"), F.col("f_geo"), A.normalised(A.ross, v, s, a), F.lit(0.25)), "refl"))


_Y = "(1.1::DOUBLE * toa - 0.05)"


@query("p20_p22_inversion", "px", "bands", sql=f"""WITH {TOA}, y AS (SELECT *, {_Y} AS y FROM fx_toa),
    g AS (SELECT *, (toa * 0.3 - 0.12 - y * y * 0.1) / pow(1 + 0.07 * y, 2) AS d0, (toa * 0.02 - y * y * 0.01) / pow(1 + 0.07 * y, 2) AS d1, 1.1 / pow(0.07 * y + 1, 2) AS dt FROM y)
    SELECT scene_id, band, r, c, {s6('CASE WHEN dn > 0 THEN y / (1 + 0.07 * y) END', 'boa')}, {s6('d0', 'd_aot')}, {s6('d1', 'd_tcwv')}, {s6('dt', 'd_toa')},
    {s6('sqrt(pow(dt * 0.05 * toa, 2) + pow(d0 * 0.1, 2) + pow(d1 * 0.5, 2))', 'unc')} FROM g""")
def inversion(px, bands):
    t = F.col("toa")
    a, b, c = F.lit(1.1), F.lit(0.05), F.lit(0.07)
    d0 = R.surface_gradient(t, a, b, c, F.lit(0.3), F.lit(0.12), F.lit(0.1))
    d1 = R.surface_gradient(t, a, b, c, F.lit(0.02), F.lit(0.0), F.lit(0.01))
    dt = R.toa_gradient(t, a, b, c)
    unc = R.reflectance_uncertainty([d0, d1, d1], [F.lit(0.1), F.lit(0.5), F.lit(1.0)], dt, t)
    return P.calibrated(px, bands).select("scene_id", "band", "r", "c", r6(R.surface_reflectance(t, a, b, c, F.col("dn")), "boa"), r6(d0, "d_aot"), r6(d1, "d_tcwv"), r6(dt, "d_toa"), r6(unc, "unc"))


def _layer_sql(x: str, n: int, m: int, relu: bool = True) -> str:
    cells = []
    for j in range(m):
        terms = " + ".join(f"{x}[{i + 1}] * {math.sin(i + 2 * j + 1) / 4!r}" for i in range(n))
        cell = f"{math.cos(j) / 10!r} + {terms}"
        cells.append(f"greatest({cell}, 0)" if relu else cell)
    return "[" + ", ".join(cells) + "]"


_NET = f"""WITH x AS (SELECT vec_id, [embedding[i]::DOUBLE for i in range(1, 7)] AS x FROM embeddings), l1 AS (SELECT vec_id, {_layer_sql('x', 6, 8)} AS x FROM x),
    l2 AS (SELECT vec_id, {_layer_sql('x', 8, 8)} AS x FROM l1), l3 AS (SELECT vec_id, {_layer_sql('x', 8, 6, False)} AS x FROM l2)
    SELECT vec_id, """ + ", ".join(s6(f"x[{k + 1}]", f"h{k}") for k in range(6)) + " FROM l3"


def _net_weights():
    import numpy as np

    w = lambda n, m: (np.array([[math.sin(i + 2 * j + 1) / 4 for j in range(m)] for i in range(n)]), np.array([math.cos(j) / 10 for j in range(m)]))
    return [w(6, 8), w(8, 8), w(8, 6)]


@table_query("p23_p26_network_sql", "embeddings", sql=_NET)
def network_sql(e):
    """The network as array expressions."""
    x = e.select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double")).alias("x"))
    for n, m, relu in ((6, 8, True), (8, 8, True), (8, 6, False)):
        w, b = E.closed_form(n, m)
        x = x.select("vec_id", E.layer(F.col("x"), w, b, relu).alias("x"))
    return x.select("vec_id", *[r6(F.col("x")[k], f"h{k}") for k in range(6)])


@table_query("p23_p26_network_arrow", "embeddings", sql=_NET)
def network_arrow(e):
    """The same network on Arrow batches."""
    names = [f"x{k}" for k in range(6)]
    x = e.select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return E.evaluate(x, names, _net_weights()).select("vec_id", *[r6(F.col("h")[k], f"h{k}") for k in range(6)])


_CELLS = "b AS (SELECT scene_id, r AS bi, c AS bj, 0.001 * saa AS aot, 0.05 * vza AS tcwv FROM fx_angles)"


@query("p24_p25_coefficients", "angles", sql=f"""WITH {_CELLS}, k AS (SELECT b.*, k, k + 1 AS band FROM b, range(3) t(k))
    SELECT scene_id, bi, bj, band, {s6('1.1 + 0.3::DOUBLE / (1 + k) * aot + 0.02::DOUBLE * (1 + k) * tcwv', 'a')}, {s6('0.01 + 0.12::DOUBLE / (1 + k) * aot', 'b')}, {s6('0.05 + 0.1::DOUBLE / (1 + k) * aot', 'c')},
    {s6('CASE WHEN aot > 0 THEN 0.3::DOUBLE / (1 + k) ELSE 0 END', 'a_0')}, {s6('CASE WHEN tcwv > 0 THEN 0.02::DOUBLE * (1 + k) ELSE 0 END', 'a_1')} FROM k""")
def coefficients(a):
    cells = a.select("scene_id", F.col("r").alias("bi"), F.col("c").alias("bj"), F.cos(F.radians("sza")).alias("cos_sza"), F.cos(F.radians("vza")).alias("cos_vza"), F.lit(0.5).alias("cos_raa"),
                     (0.001 * F.col("saa")).alias("aot"), (0.05 * F.col("vza")).alias("tcwv"), F.lit(0.3).alias("tco3"), F.lit(0.0).alias("ele"))
    out = E.coefficients(cells, [1, 2, 3], T.linear_models([1, 2, 3]))
    return out.select("scene_id", "bi", "bj", "band", *[r6(F.col(n), n) for n in ("a", "b", "c", "a_0", "a_1")])


@query("p27_spectral_map", "px", "bands", "spectral", sql=f"WITH {TOA} SELECT scene_id, band, r, c, {s6('slope * toa + m.off', 'boa', 9)} FROM fx_toa JOIN fx_spectral m USING (band)")
def spectral(px, bands, maps):
    return E.spectral_map(P.calibrated(px, bands).select("scene_id", "band", "r", "c", F.col("toa").alias("boa")), maps).select("scene_id", "band", "r", "c", r6(F.col("boa"), "boa", 9))


@query("p28_s12_quantise", "px", "bands", sql=f"WITH {TOA} SELECT scene_id, band, r, c, CASE WHEN toa - 0.3 > 0 THEN round((toa - 0.3) * 10000)::SMALLINT ELSE -9999::SMALLINT END AS q FROM fx_toa")
def quantise(px, bands):
    return P.calibrated(px, bands).select("scene_id", "band", "r", "c", R.quantise(F.col("toa") - 0.3).alias("q"))


@query("p29_a20_rgb", "px", "bands", sql=f"""WITH {WIDE} SELECT scene_id, r, c, {', '.join(f'floor(least(greatest({k} * 637.5, 0), 255))::SMALLINT AS {k}_byte' for k in ('red', 'green', 'blue'))},
    (CASE WHEN coalesce(red > 0 AND green > 0 AND blue > 0, false) THEN 255 ELSE 0 END)::SMALLINT AS alpha FROM fx_wide""")
def rgb(px, bands):
    return P.rgb(P.composite(P.calibrated(px, bands)))


_TILE = "concat('h', lpad(trunc((6371007.181 * radians(lon) * cos(radians(lat)) + pi() * 6371007.181) / (pi() * 6371007.181 / 18))::INT::VARCHAR, 2, '0'), 'v', lpad((17 - trunc((6371007.181 * radians(lat) + pi() * 6371007.181 / 2) / (pi() * 6371007.181 / 18))::INT)::VARCHAR, 2, '0'))"


@query("p30_tile_id", "points", sql=f"SELECT point_id, {_TILE} AS tile FROM fx_points")
def tile(p):
    return p.select("point_id", G.tile_id(F.col("lon"), F.col("lat")).alias("tile"))


@query("p31_p32_grid_index", "px", sql=f"""SELECT scene_id, band, r, c, {s6('399960.0 + c * 500.0', 'x')}, {s6('5900040.0 - r * 500.0', 'y')}, trunc(r / 40.0::DOUBLE * 7)::INT AS bi, trunc(c / 40.0::DOUBLE * 7)::INT AS bj,
    floor(r * (500.0::DOUBLE / 10))::INT AS hx FROM fx_px""")
def grid_index(px):
    x, y = G.to_map(F.col("r"), F.col("c"), 399960.0, 500.0, 5900040.0, -500.0)
    return px.select("scene_id", "band", "r", "c", r6(x, "x"), r6(y, "y"), G.block_index(F.col("r"), 40, 7).alias("bi"), G.block_index(F.col("c"), 40, 7).alias("bj"), G.fine_index(F.col("r"), 500, 10).alias("hx"))


def _poly(k, x: str) -> str:
    return f"((({k[0]!r} * {x} + {k[1]!r}) * {x} + {k[2]!r}) * {x} + {k[3]!r})"


@query("p33_envelope", "px", "bands", sql=f"""WITH {WIDE} SELECT scene_id, r, c, nir - red >= {_poly(R.ENVELOPE_LOW[2], 'red')} AND nir - red <= {_poly(R.ENVELOPE_HIGH[2], 'red')} AS inside FROM fx_wide""")
def envelope(px, bands):
    w = P.composite(P.calibrated(px, bands))
    return w.select("scene_id", "r", "c", R.within_envelope(F.col("nir"), F.col("red"), R.ENVELOPE_LOW[2], R.ENVELOPE_HIGH[2]).alias("inside"))


@query("p34_dates", "obs", sql="""SELECT scene_id, strftime(obs_time, '%Y%j') AS year_day, 33::INT AS n_days, CAST(obs_time::DATE - 16 AS DATE) AS first_day, TIMESTAMP '1900-01-01' + to_hours((scene_id % 900000)::INT) AS t FROM fx_obs""")
def dates(o):
    days = G.window_days(F.col("obs_time").cast("date"))
    return o.select("scene_id", G.year_day(F.col("obs_time")).alias("year_day"), F.size(days).alias("n_days"), days[0].alias("first_day"), G.hours_since_1900((F.col("scene_id") % 900000).cast("int")).alias("t"))


_NUM, _DEN = [0.1, 0.002, -0.003, 0.0, 0.001, 1e-5, 2e-5, -1e-5, 0.0, 0.0], [0.001, 0.002, 0.0, 0.0, 1e-6, 0.0, 0.0, 0.0, 0.0]


@query("p35_rational_angles", "px", sql=f"""WITH p AS (SELECT DISTINCT scene_id, r::DOUBLE AS l, c::DOUBLE AS s FROM fx_px), v AS (SELECT *, 0.2 + (0.1 + 0.002 * l - 0.003 * s + 0.001 * l + 1e-5 * l * l + 2e-5 * s * l - 1e-5 * s * s) / (1 + 0.001 * l + 0.002 * s + 1e-6 * l * l) AS x, 0.3 AS y, 0.9 AS z FROM p)
    SELECT scene_id, l::INT AS line, s::INT AS samp, round(degrees(acos(z / sqrt(x * x + y * y + z * z))) * 100)::INT AS zenith, round(degrees(atan2(x, y)) * 100)::INT AS azimuth FROM v""")
def rational_angles(px):
    at = px.select("scene_id", F.col("r").alias("line"), F.col("c").alias("samp")).distinct().withColumns({"height": F.lit(0.0), "l1r_line": F.col("line").cast("double"), "l1r_samp": F.col("samp").cast("double")})
    spark = px.sparkSession
    zero = [0.0] * 9
    terms = spark.createDataFrame([("x", 0.2, _NUM, _DEN), ("y", 0.3, [0.0] * 10, zero), ("z", 0.9, [0.0] * 10, zero)], "axis string, mean double, num array<double>, den array<double>")
    return rpc.vectors(at, terms)


@query("p36_modules", "px", sql="""WITH p AS (SELECT DISTINCT scene_id, r AS line, c AS samp FROM fx_px), m AS (SELECT p.*, m::INT AS module, (1 + 0.9::DOUBLE * (line - 20) + 0.01 * (samp - 20)) / (1 + 0.001 * (line - 20)) + 20 AS ll, (0.95::DOUBLE * (samp - 20)) / 1.0 + 20 - 12 * m AS ls FROM p, range(3) t(m))
    SELECT scene_id, line, samp, module, round(ll, 6) AS l1r_line, round(ls, 6) AS l1r_samp FROM m WHERE ll BETWEEN 2 AND 36 AND ls BETWEEN 0 AND 14""")
def modules(px):
    spark = px.sparkSession
    rows = [(m, 20.0, 20.0, 0.0, 20.0, 20.0 - 12 * m, [1.0, 0.9, 0.01, 0.0, 0.0], [0.001, 0.0, 0.0, 0.0], [0.0, 0.0, 0.95, 0.0, 0.0], [0.0] * 4, 2.0, 36.0, 0.0, 14.0) for m in range(3)]
    kinds = "module int, line_off double, samp_off double, height_off double, l1r_line_off double, l1r_samp_off double, line_num array<double>, line_den array<double>, samp_num array<double>, samp_den array<double>, line_min double, line_max double, samp_min double, samp_max double"
    at = px.select("scene_id", F.col("r").alias("line"), F.col("c").alias("samp")).distinct().withColumn("height", F.lit(0.0))
    return rpc.find_modules(at, spark.createDataFrame(rows, kinds)).select("scene_id", "line", "samp", "module", r6(F.col("l1r_line"), "l1r_line"), r6(F.col("l1r_samp"), "l1r_samp"))


@query("f14_active_extent", "px", sql="""WITH l AS (SELECT DISTINCT r AS line FROM fx_px), e AS (SELECT * FROM (VALUES (2.5, 5.5, 8.5, 33.25), (8.5, 33.25, 37.5, 28.75), (37.5, 28.75, 30.5, 2.25), (30.5, 2.25, 2.5, 5.5)) t(y1, x1, y2, x2)),
    x AS (SELECT line, (x1 + (line - y1) * (x2 - x1) / (y2 - y1))::DOUBLE AS x FROM l JOIN e ON line BETWEEN least(y1, y2) AND greatest(y1, y2))
    SELECT line, (floor(min(x)) + 1)::INT AS start, (ceil(max(x)) - 1)::INT AS "end" FROM x GROUP BY 1 HAVING floor(min(x)) + 1 <= ceil(max(x)) - 1""")
def active_extent(px):
    return rpc.active_extent(px.select(F.col("r").alias("line")).distinct(), [(2.5, 5.5), (8.5, 33.25), (37.5, 28.75), (30.5, 2.25)])


@query("p40_straighten", "angles", sql=f"""WITH a AS (SELECT scene_id, r, c, CASE WHEN vza + c >= 0.01 THEN vza + c END AS vza, saa - 180 AS vaa FROM fx_angles),
    e AS (SELECT scene_id, min(vza) AS v0, max(vza) AS v1, avg(vaa) FILTER (vaa < 0) AS lf, avg(vaa) FILTER (vaa > 0) AS rt FROM a GROUP BY 1),
    l AS (SELECT scene_id, regr_slope(r, c) AS m, regr_intercept(r, c) AS q FROM a JOIN e USING (scene_id) WHERE vza = v0 GROUP BY 1),
    d AS (SELECT a.*, v0, v1, lf, rt, CASE WHEN vza IS NOT NULL THEN abs(m * c + q - r) / sqrt(1 + m * m) END AS d FROM a JOIN e USING (scene_id) JOIN l USING (scene_id)),
    s AS (SELECT scene_id, max(d) - min(d) AS span FROM d GROUP BY 1)
    SELECT scene_id, r, c, {s6('v0 + d / nullif(span, 0) * (v1 - v0)', 'vza', 5)}, {s6('CASE WHEN vaa < 0 THEN lf WHEN vaa > 0 THEN rt ELSE vaa END', 'vaa', 5)} FROM d JOIN s USING (scene_id)""")
def straighten(a):
    shaped = a.select("scene_id", "r", "c", (F.col("vza") + F.col("c")).alias("vza"), (F.col("saa") - 180).alias("vaa"))
    return K.straighten(shaped).select("scene_id", "r", "c", r6(F.col("vza"), "vza", 5), r6(F.col("vaa"), "vaa", 5))


@query("p41_keep_prior", "angles", sql=f"SELECT scene_id, r, c, {s6('CASE WHEN saa BETWEEN 100 AND 300 THEN saa ELSE vza END', 'kept')} FROM fx_angles")
def keep_prior(a):
    return a.select("scene_id", "r", "c", r6(P.keep_in_bounds(F.col("saa"), F.col("vza"), 100, 300), "kept"))


@query("p42_constant_field", "px", sql="SELECT DISTINCT scene_id, r, c, 0.3::DOUBLE AS tco3 FROM fx_px")
def constant_field(px):
    return px.select("scene_id", "r", "c").distinct().withColumn("tco3", F.lit(0.3))


@query("p43_angle_stack", "angles", sql="SELECT scene_id, r, c, vaa AS azimuth, vza AS zenith FROM fx_angles")
def angle_stack(a):
    """Azimuth-first stacks: layers 0 and 1 of one file, unpivoted and named by their order."""
    long = a.unpivot(["scene_id", "r", "c"], ["vaa", "vza"], "layer", "value")
    kind = F.when(F.col("layer") == "vaa", "azimuth").otherwise("zenith")
    return long.groupBy("scene_id", "r", "c").agg(*[F.max(F.when(kind == k, F.col("value"))).alias(k) for k in ("azimuth", "zenith")])


@query("d01_o01_band_match", "sensors", "bands", sql="""WITH m AS (SELECT s.band, s.wavelength_nm, f.band AS ref_band, f.wavelength_nm AS ref_nm, row_number() OVER (PARTITION BY s.band ORDER BY abs(s.wavelength_nm - f.wavelength_nm), f.band) AS k
    FROM fx_sensors s JOIN fx_bands f ON abs(s.wavelength_nm - f.wavelength_nm) < 150 WHERE f.band <> 1) SELECT band, wavelength_nm, ref_band, ref_nm FROM m WHERE k = 1""")
def band_match(sensors, bands):
    """Bands of many sensors with the nearest of the six reference bands."""
    return D.match_bands(sensors, bands.where("band <> 1"))


@query("o01_ordered_bands", "sensors", sql="SELECT sensor_id, (row_number() OVER (PARTITION BY sensor_id ORDER BY wavelength_nm, band) - 1)::INT AS ordinal, wavelength_nm, band, role FROM fx_sensors")
def ordered(sensors):
    return P.ordered_bands(sensors, ("sensor_id",))
