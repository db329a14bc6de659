"""Scene metadata and sample files as tables: text and XML scans, parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Processing baseline from which offsets apply, and the quantification where none is given.
OFFSET_BASELINE = 400
QUANTIFICATION = 10000.0


def lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, line_no, line) of all files below folder whose name matches; line numbers are within a file."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    parts = whole.select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return parts


def discover_sentinel(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata files of tiles: names with MTD, TL and xml, or metadata.xml."""
    return sentinel_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder).select("path"))


def sentinel_files(files: DataFrame) -> DataFrame:
    """The same of a listing files(path)."""
    files = files.select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(r"^MTD.*TL.*\.xml$") | (name == "metadata.xml")).distinct()


def discover_landsat(spark: SparkSession, folder: str) -> DataFrame:
    """MTL files with their scene folder and collection number (the folder name's second last part); only 1 and 2 are known."""
    return landsat_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path"))


def landsat_files(files: DataFrame) -> DataFrame:
    """The same of a listing files(path)."""
    files = files.select("path").where(F.lower(F.element_at(F.split("path", "/"), -1)).contains("mtl.txt"))
    scene = F.element_at(F.split("path", "/"), -2)
    number = F.element_at(F.split(scene, "_"), -2).try_cast("int")
    checked = F.when(number.isin(1, 2), number).otherwise(F.raise_error(F.concat(F.lit("unknown collection in "), scene)).cast("int"))
    return files.select("path", scene.alias("scene"), checked.alias("collection"))


def sentinel_metadata(rows: DataFrame) -> DataFrame:
    """(path, sensing_time, tile, satellite, baseline) from lines(path, line)."""
    grab = lambda tag: F.max(F.nullif(F.regexp_extract("line", rf"<{tag}[^>]*>([^<]+)<", 1), F.lit("")))
    got = rows.groupBy("path").agg(grab("SENSING_TIME").alias("time"), grab("TILE_ID").alias("tile_id"), grab("DATASTRIP_ID").alias("strip"), grab("PRODUCT_URI").alias("uri"))
    product = F.coalesce("uri", "tile_id")
    base = F.coalesce(F.nullif(F.regexp_extract("tile_id", r"_N(\d\d)\.(\d\d)", 1), F.lit("")), F.lit(""))
    return got.select(
        "path", F.regexp_replace("time", "Z$", "").try_cast("timestamp_ntz").alias("sensing_time"),
        F.regexp_extract("tile_id", r"_(T\d\d[A-Z]{3})", 1).alias("tile"), F.substring_index("tile_id", "_", 1).alias("satellite"),
        F.coalesce(F.concat(base, F.regexp_extract("tile_id", r"_N\d\d\.(\d\d)", 1)).try_cast("int"), F.regexp_extract(product, r"_N(\d{4})_", 1).try_cast("int")).alias("baseline"))


def sentinel_offsets(rows: DataFrame, metadata: DataFrame, bands: DataFrame) -> DataFrame:
    """(path, band, offset, quantification): offsets by band id from baseline 400 on, else 0 and 10000."""
    offset = F.regexp_extract("line", r'<RADIO_ADD_OFFSET band_id="(\d+)">(-?[\d.]+)<', 0)
    tagged = rows.where(F.col("line").contains("RADIO_ADD_OFFSET")).select(
        "path", F.regexp_extract("line", r'band_id="(\d+)"', 1).try_cast("int").alias("band"), F.regexp_extract("line", r">(-?[\d.]+)<", 1).try_cast("double").alias("offset")).where(offset != "")
    q = rows.groupBy("path").agg(F.max(F.regexp_extract("line", r"<(?:BOA_|)QUANTIFICATION_VALUE[^>]*>([\d.]+)<", 1).try_cast("double")).alias("q"))
    new = F.coalesce(F.col("baseline") >= OFFSET_BASELINE, F.lit(False))
    wanted = metadata.select("path", "baseline").crossJoin(F.broadcast(bands.select("band")))  # scenes x a band dimension
    joined = wanted.join(tagged.hint("merge"), ["path", "band"], "left").join(q.hint("merge"), "path", "left")
    return joined.select("path", "band", F.when(new, F.coalesce("offset", F.lit(0.0))).otherwise(0.0).alias("offset"), F.when(new, F.coalesce("q", F.lit(QUANTIFICATION))).otherwise(QUANTIFICATION).alias("quantification"))


def key_values(rows: DataFrame, pattern: str, key: str = "scene_id") -> DataFrame:
    """(key, name, value) of `name = value` lines whose name matches; the last line of a name wins."""
    parts = F.split(F.trim("line"), " = ")
    named = rows.select(key, "line_no", parts[0].alias("name"), F.get(parts, F.lit(1)).alias("value")).where(F.col("name").rlike(pattern) & F.col("value").isNotNull())
    return named.groupBy(key, "name").agg(F.max_by("value", "line_no").alias("value"))


def landsat_scaling(rows: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, mult, add): the values of the last REFLECTANCE_MULT_BAND and REFLECTANCE_ADD_BAND lines."""
    parts = F.split(F.trim("line"), " = ")
    last = lambda word: F.max_by(F.when(parts[0].startswith(word), F.get(parts, F.lit(1)).try_cast("double")), F.when(parts[0].startswith(word), F.col("line_no")))
    return rows.groupBy(key).agg(last("REFLECTANCE_MULT_BAND").alias("mult"), last("REFLECTANCE_ADD_BAND").alias("add"))


def landsat_time(rows: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, obs_time) from the acquisition date and centre time lines."""
    kv = key_values(rows, "^(DATE_ACQUIRED|SCENE_CENTER_TIME)$", key).groupBy(key).agg(
        F.max(F.when(F.col("name") == "DATE_ACQUIRED", F.col("value"))).alias("d"), F.max(F.when(F.col("name") == "SCENE_CENTER_TIME", F.regexp_replace("value", '["Z]', ""))).alias("t"))
    return kv.select(key, F.concat_ws(" ", "d", F.substring("t", 1, 15)).try_cast("timestamp_ntz").alias("obs_time"))


_GRID = "struct<VALUES:array<string>>"
_ANGLES = f"Zenith:struct<Values_List:{_GRID}>,Azimuth:struct<Values_List:{_GRID}>"
_SUN = f"struct<Tile_Angles:struct<Sun_Angles_Grid:struct<{_ANGLES}>>>"
_VIEW = f"struct<Tile_Angles:struct<Viewing_Incidence_Angles_Grids:array<struct<_bandId:int,_detectorId:int,{_ANGLES}>>>>"


def _cells(grids: Column, names: tuple[str, str], df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c, names) of a zenith and an azimuth grid of blank-separated rows; NaN becomes null. Cells that only one of them has are left out."""
    both = F.arrays_zip(grids["Zenith"]["Values_List"]["VALUES"].alias("z"), grids["Azimuth"]["Values_List"]["VALUES"].alias("a"))
    rows = df.select(*keys, F.posexplode(both).alias("r", "_l"))
    words = F.arrays_zip(*[F.split(F.trim(F.col(f"_l.{k}")), r"\s+").alias(k) for k in "za"])
    cells = rows.select(*keys, "r", F.posexplode(words).alias("c", "_v")).where("_v.z is not null and _v.a is not null")
    v = [F.col(f"_v.{k}").try_cast("double") for k in "za"]
    return cells.select(*keys, "r", "c", *[F.when(~F.isnan(x), x).alias(n) for x, n in zip(v, names, strict=True)])


def angle_grids(spark: SparkSession, folder: str, glob: str = "*.xml") -> tuple[DataFrame, DataFrame]:
    """Sun grid (path, r, c, sza, saa) and view grids (path, band, det, r, c, vza, vaa); saa above 180 wraps."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return angle_cells(text.select(F.input_file_name().alias("path"), "value"))


def angle_cells(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of documents(path, value)."""
    inner = F.regexp_extract("value", r"(?s)(<Tile_Angles>.*</Tile_Angles>)", 1)
    doc = lambda kind: documents.select("path", F.from_xml(F.concat(F.lit("<t>"), inner, F.lit("</t>")), kind).alias("x"))
    suns = _cells(F.col("x.Tile_Angles.Sun_Angles_Grid"), ("sza", "saa"), doc(_SUN), ["path"])
    suns = suns.withColumn("saa", F.when(F.col("saa") > 180, F.col("saa") - 360).otherwise(F.col("saa")))
    each = doc(_VIEW).select("path", F.explode("x.Tile_Angles.Viewing_Incidence_Angles_Grids").alias("v")).select("path", F.col("v._bandId").alias("band"), F.col("v._detectorId").alias("det"), "v")
    return suns, _cells(F.col("v"), ("vza", "vaa"), each, ["path", "band", "det"])


def mean_angles(sun: DataFrame, view: DataFrame) -> DataFrame:
    """Per file: mean sun angles, and mean view angles over bands and detectors."""
    s = sun.groupBy("path").agg(F.avg("sza").alias("sza"), F.avg("saa").alias("saa"))
    v = view.groupBy("path").agg(F.avg("vza").alias("vza"), F.avg("vaa").alias("vaa"))
    return s.join(v, "path", "left")


def read_multi_angle(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, doy, vza, sza, raa, band, wavelength, refl) of flagged rows; the header names the band centres."""
    return multi_angle(lines(spark, path, "*"))


def multi_angle(rows: DataFrame) -> DataFrame:
    """The same of rows(path, line_no, line)."""
    rows = rows.select("path", "line_no", F.split(F.trim("line"), r"\s+").alias("w"))
    n = F.get("w", F.lit(2)).try_cast("int")
    head = rows.where("line_no = 0").select("path", F.transform(F.slice("w", F.lit(4), n), lambda x: x.try_cast("double")).alias("centres"))
    at = lambda k: F.get("w", F.lit(k)).try_cast("double")  # noqa: E731  (headers may be parsed before they are filtered out)
    data = rows.where((F.col("line_no") > 0) & (F.size("w") > 6) & (F.get("w", F.lit(1)).try_cast("int") == 1))
    data = data.select("path", "line_no", at(0).alias("doy"), at(2).alias("vza"), at(4).alias("sza"), (at(3) - at(5)).alias("raa"), F.transform(F.slice("w", 7, 1000), lambda x: x.try_cast("double")).alias("x"))
    both = data.join(head.hint("merge"), "path")  # one header a file
    return both.select("path", "line_no", "doy", "vza", "sza", "raa", F.posexplode(F.arrays_zip("centres", "x")).alias("band", "z")).select(
        "path", "line_no", "doy", "vza", "sza", "raa", "band", F.col("z.centres").alias("wavelength"), F.col("z.x").alias("refl"))


def read_five_band(spark: SparkSession, path: str, layout: int = 1) -> DataFrame:
    """(path, line_no, vza, sza, raa, band, refl) of whitespace rows in one of two column layouts of five bands.

    Columns 6 to 10 are the bands. Layout 1: sza in column 2, vza in 4, raa in 5. Layout 2: vza in 2, sza in 4,
    and raa is column 5 less column 3. Columns count from 0.
    """
    return five_band(lines(spark, path, "*"), layout)


def five_band(rows: DataFrame, layout: int = 1) -> DataFrame:
    """The same of rows(path, line_no, line)."""
    # A generator hands on the words of a line: filters stay above it, so that a line is made and split once, not again in every condition.
    rows = rows.select("path", "line_no", F.explode(F.array(F.split(F.trim("line"), r"\s+"))).alias("w")).where((F.size("w") >= 11) & ~F.get("w", F.lit(0)).startswith("#"))
    at = lambda k: F.get("w", F.lit(k)).try_cast("double")
    vza, sza, raa = (at(4), at(2), at(5)) if layout == 1 else (at(2), at(4), at(5) - at(3))
    wide = rows.select("path", "line_no", vza.alias("vza"), sza.alias("sza"), raa.alias("raa"), F.slice("w", 7, 5).alias("x"))
    return wide.select("path", "line_no", "vza", "sza", "raa", F.posexplode("x").alias("band", "x")).select(
        "path", "line_no", "vza", "sza", "raa", "band", F.col("x").try_cast("double").alias("refl"))


def one_scene_list(tiles: DataFrame, other: DataFrame) -> DataFrame:
    """Scenes of both kinds of metadata file."""
    return tiles.unionByName(other, allowMissingColumns=True)
