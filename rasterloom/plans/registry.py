"""Named queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Logical tables over the driver's base tables. {t} stands for a base table; {side} for the grid's side. Every hundred
#: suppliers are four scenes, so that the number of scenes grows with the tables.
#: Only exact arithmetic, so that both engines see the same bits.
FIXTURES = {
    "px": """SELECT CAST(l_suppkey % 4 + 4 * floor(l_suppkey / 100) AS INT) AS scene_id, CAST(l_linenumber AS INT) AS band, CAST(l_orderkey % {side} AS INT) AS r,
        CAST(l_partkey % {side} AS INT) AS c, CAST(floor(min(l_extendedprice) / 10) AS DOUBLE) AS dn FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "bands": """SELECT * FROM (VALUES
        (1, 'coastal', 443, CAST(0.0001 AS DOUBLE), CAST(0.0 AS DOUBLE)), (2, 'blue', 469, CAST(0.0001 AS DOUBLE), CAST(-0.002 AS DOUBLE)),
        (3, 'green', 555, CAST(0.0001 AS DOUBLE), CAST(0.0 AS DOUBLE)), (4, 'red', 645, CAST(0.0001 AS DOUBLE), CAST(-0.002 AS DOUBLE)),
        (5, 'nir', 859, CAST(0.0001 AS DOUBLE), CAST(0.0 AS DOUBLE)), (6, 'swir1', 1640, CAST(0.0001 AS DOUBLE), CAST(-0.001 AS DOUBLE)),
        (7, 'swir2', 2130, CAST(0.0001 AS DOUBLE), CAST(0.0 AS DOUBLE))) AS t(band, role, wavelength_nm, scale, off)""",
    "angles": """SELECT CAST(l_suppkey % 4 + 4 * floor(l_suppkey / 100) AS INT) AS scene_id, CAST(l_orderkey % {side} AS INT) AS r, CAST(l_partkey % {side} AS INT) AS c,
        CAST(20 + 500 * max(l_tax) AS DOUBLE) AS sza, CAST(100 * min(l_discount) AS DOUBLE) AS vza, CAST(7 * max(l_quantity) AS DOUBLE) AS saa,
        CAST(3 * min(l_partkey % 100) AS DOUBLE) AS vaa FROM {lineitem} GROUP BY 1, 2, 3""",
    "qa": """SELECT CAST(l_suppkey % 4 + 4 * floor(l_suppkey / 100) AS INT) AS scene_id, CAST(l_orderkey % {side} AS INT) AS r, CAST(l_partkey % {side} AS INT) AS c,
        min((l_orderkey * 3 + l_partkey) % 256) AS qa_bits, CAST(max((l_partkey * 7 + l_suppkey * 13) % 100) AS DOUBLE) / 100 AS cloud_prob
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "brdf": """SELECT user_id AS cell_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 6 END AS band,
        CAST(ts AS DATE) AS day, CAST(floor(max(value)) AS DOUBLE) AS f_iso, CAST(floor(max(value) / 3) AS DOUBLE) AS f_vol,
        CAST(floor(max(value) / 5) AS DOUBLE) AS f_geo, CASE WHEN min(event_id) % 11 = 0 THEN CAST(255 AS BIGINT) ELSE min(event_id) % 4 END AS qa
        FROM {events} GROUP BY 1, 2, 3""",
    "forecast": """SELECT CAST(o_orderkey % 3 AS INT) AS var, o_orderdate AS valid_time, max(o_totalprice) AS raw FROM {orders} GROUP BY 1, 2""",
    "obs": "SELECT l_orderkey AS scene_id, min(l_shipdate) + INTERVAL 7 HOUR AS obs_time FROM {lineitem} GROUP BY 1",
    "samples": """SELECT l_orderkey * 1000 + l_partkey AS sample_id, min(l_partkey % 100) AS pixel, CAST(min(dayofyear(l_shipdate)) AS INT) AS doy,
        CAST(100 * min(l_discount) - 5 AS DOUBLE) AS vza, CAST(20 + 500 * min(l_tax) AS DOUBLE) AS sza, CAST(7 * min(l_quantity) AS DOUBLE) AS raa,
        min(l_extendedprice) / 200000 AS refl FROM {lineitem} GROUP BY 1""",
    "granules": """SELECT concat('MCD43A1.', cast(s_suppkey AS string)) AS granule,
        concat('h', lpad(cast(s_suppkey % 36 AS string), 2, '0'), 'v', lpad(cast(s_suppkey % 18 AS string), 2, '0')) AS tile,
        CAST(DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT) AS DATE) AS day FROM {supplier}""",
    "sensors": """SELECT CAST(p_partkey % 400 AS INT) AS sensor_id, CAST(p_partkey AS INT) AS band, CAST(400 + (p_partkey * 37) % 2000 AS INT) AS wavelength_nm,
        concat('b', CAST(p_partkey AS string)) AS role FROM {part}""",
    "listing": """SELECT s_suppkey AS scene_id, concat('/scenes/S2_', CAST(s_suppkey AS string), '/', CASE s_suppkey % 4 WHEN 0 THEN 'MTD_TL.xml' WHEN 1 THEN 'metadata.xml' WHEN 2 THEN 'other.xml'
        ELSE 'MTD_MSI.xml' END) AS path, concat('/scenes/LC08_L1TP_', CAST(s_suppkey AS string), '_20200101_20200113_0', CAST(s_suppkey % 2 + 1 AS string), '_T1/', CASE s_suppkey % 3 WHEN 0 THEN 'a_MTL.txt'
        WHEN 1 THEN 'B_mtl.TXT' ELSE 'c_B1.TIF' END) AS other FROM {supplier}""",
    "tile_xml": """SELECT concat('scene-', CAST(s_suppkey AS string)) AS path, CAST(s_suppkey AS INT) AS n, CASE WHEN s_suppkey % 3 = 0 THEN '02.0' ELSE '05.0' END AS major,
        CAST(s_suppkey % 10 AS string) AS minor, lpad(CAST(s_suppkey % 60 AS string), 2, '0') AS mm FROM {supplier}""",
    "points": "SELECT c_custkey AS point_id, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((c_custkey * 53) % 160 - 80 AS DOUBLE) AS lat FROM {customer}",
    "spectral": """SELECT * FROM (VALUES
        (2, CAST(1.0062 AS DOUBLE), CAST(0.0138 AS DOUBLE)), (3, CAST(1.0009 AS DOUBLE), CAST(0.0019 AS DOUBLE)), (4, CAST(1.0031 AS DOUBLE), CAST(0.0028 AS DOUBLE)),
        (5, CAST(0.9984 AS DOUBLE), CAST(0.0002 AS DOUBLE)), (6, CAST(1.0033 AS DOUBLE), CAST(0.0008 AS DOUBLE)), (7, CAST(0.9479 AS DOUBLE), CAST(-0.0014 AS DOUBLE))
        ) AS t(band, slope, off)""",
    "mtl": """SELECT s_suppkey AS scene_id, s_suppkey % 7 AS line_no,
        concat('    REFLECTANCE_MULT_BAND_', cast(s_suppkey % 7 + 1 AS string), ' = 2.0000E-05') AS line FROM {supplier}""",
}
BASE = ("lineitem", "events", "orders", "supplier", "customer", "embeddings", "part")
SIDE = 40


def fixture(spark: SparkSession, sf_dir: str, name: str, side: int = SIDE) -> DataFrame:
    """A logical table as a DataFrame; its scans read only the columns it names."""
    text = FIXTURES[name]
    used = [t for t in BASE if f"{{{t}}}" in text]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(text.replace("{side}", str(side)), **tables)


def with_fixtures(sql: str, *names: str, side: int = SIDE) -> str:
    """SQL with the named logical tables as leading CTEs (fx_<name>)."""
    ctes = []
    for n in names:
        text = FIXTURES[n].replace("{side}", str(side))
        for t in BASE:
            text = text.replace(f"{{{t}}}", t)
        ctes.append(f"fx_{n} AS ({text})")
    rest = sql.strip()
    if rest[:5].upper() == "WITH ":
        rest = rest[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        rest = rest[10:] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes) + ", " + rest
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + rest


def query(name: str, *fixtures: str, sql: str | None = None):
    """Register f(spark, *tables) under name: it gets the named logical tables; sql sees them as fx_<table>."""

    def wrap(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, x) for x in fixtures])
        if sql:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return f

    return wrap


def table_query(name: str, *tables: str, sql: str | None = None):
    """The same for base tables."""

    def wrap(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            ORACLES[name] = sql
        return f

    return wrap
