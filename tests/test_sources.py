"""Scene metadata and sample files made here, read back by the sources."""

import datetime

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import scenes as M

GRID = "<{k}><Values_List><VALUES>{a}</VALUES><VALUES>{b}</VALUES></Values_List></{k}>"


def angle(a, b):
    return GRID.format(k="Zenith", a=a, b=b) + GRID.format(k="Azimuth", a=b, b=a)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("scenes")
    for name, base, offset in (("new", "05.09", True), ("old", "02.06", False)):
        d = top / f"S2_{name}"
        d.mkdir()
        extra = "".join(f'<RADIO_ADD_OFFSET band_id="{k}">-{1000 + k}</RADIO_ADD_OFFSET>\n' for k in range(3)) if offset else ""
        (d / "MTD_TL.xml").write_text(f"""<n1:Tile xmlns:n1="x">
<TILE_ID>S2B_OPER_MSI_L1C_TL_X_A0_T31UCU_N{base}</TILE_ID>
<SENSING_TIME>2017-11-23T11:13:49.123Z</SENSING_TIME>
{extra}<QUANTIFICATION_VALUE unit="none">10000</QUANTIFICATION_VALUE>
<Tile_Angles><Sun_Angles_Grid>{angle("10 20", "190 NaN")}</Sun_Angles_Grid>
<Viewing_Incidence_Angles_Grids bandId="1" detectorId="2">{angle("1 2", "3 4")}</Viewing_Incidence_Angles_Grids>
<Viewing_Incidence_Angles_Grids bandId="1" detectorId="3">{angle("5 6", "7 8")}</Viewing_Incidence_Angles_Grids></Tile_Angles></n1:Tile>""")
        (d / "other.xml").write_text("<x/>")
    land = top / "LC08_L1TP_042034_20200101_20200113_02_T1"
    land.mkdir()
    (land / "LC08_MTL.txt").write_text("""GROUP = A
    REFLECTANCE_MULT_BAND_1 = 1.0000E-05
    REFLECTANCE_MULT_BAND_9 = 2.0000E-05
    REFLECTANCE_ADD_BAND_1 = -0.200000
    REFLECTANCE_ADD_BAND_9 = -0.100000
    DATE_ACQUIRED = 2020-01-01
    SCENE_CENTER_TIME = "18:33:01.4567890Z"
""")
    return top


def test_sentinel_scenes(spark, folder):
    assert M.discover_sentinel(spark, str(folder)).count() == 2
    rows = M.lines(spark, str(folder), "MTD*.xml")
    meta = {r.path.split("/")[-2]: r for r in M.sentinel_metadata(rows).collect()}
    new = meta["S2_new"]
    assert (new.tile, new.satellite, new.baseline) == ("T31UCU", "S2B", 509) and meta["S2_old"].baseline == 206
    assert new.sensing_time == datetime.datetime(2017, 11, 23, 11, 13, 49, 123000)
    bands = spark.createDataFrame([(0,), (1,), (7,)], "band int")
    off = {(r.path.split("/")[-2], r.band): (r.offset, r.quantification) for r in M.sentinel_offsets(rows, M.sentinel_metadata(rows), bands).collect()}
    assert off["S2_new", 1] == (-1001.0, 10000.0) and off["S2_new", 7] == (0.0, 10000.0) and off["S2_old", 1] == (0.0, 10000.0)


def test_angle_grids(spark, folder):
    sun, view = M.angle_grids(spark, str(folder / "S2_new"), "MTD*.xml")
    s = {(r.r, r.c): (r.sza, r.saa) for r in sun.collect()}
    assert s == {(0, 0): (10.0, -170.0), (0, 1): (20.0, None), (1, 0): (190.0, 10.0), (1, 1): (None, 20.0)}
    v = {(r.band, r.det, r.r, r.c): (r.vza, r.vaa) for r in view.collect()}
    assert v[1, 2, 0, 1] == (2.0, 4.0) and v[1, 3, 1, 0] == (7.0, 5.0) and len(v) == 8
    mean = M.mean_angles(sun, view).first()
    assert mean.vza == pytest.approx(4.5) and mean.saa == pytest.approx((-170 + 10 + 20) / 3)


def test_landsat_scenes(spark, folder):
    found = M.discover_landsat(spark, str(folder)).first()
    assert found.collection == 2 and found.scene.startswith("LC08")
    rows = M.lines(spark, str(folder), "*MTL.txt").withColumn("scene_id", F.element_at(F.split("path", "/"), -2))
    got = M.landsat_scaling(rows).first()
    assert (got.mult, got["add"]) == (2e-05, -0.1)
    assert M.landsat_time(rows).first().obs_time == datetime.datetime(2020, 1, 1, 18, 33, 1, 456789)


def test_unknown_collection_is_refused(spark, tmp_path):
    d = tmp_path / "LC08_L1TP_042034_20200101_20200113_07_T1"
    d.mkdir()
    (d / "a_mtl.txt").write_text("x")
    with pytest.raises(Exception, match="unknown collection"):
        M.discover_landsat(spark, str(tmp_path)).collect()


def test_sample_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("BRDF 3 2 645 858\n10 1 20 30 40 50 0.1 0.2\n11 0 20 30 40 50 0.3 0.4\n12 1 -5 100 30 40 0.5 0.6\n")
    rows = M.read_multi_angle(spark, str(tmp_path / "a.txt")).orderBy("line_no", "band").collect()
    assert [(r.doy, r.vza, r.sza, r.raa, r.wavelength, r.refl) for r in rows] == [
        (10.0, 20.0, 40.0, -20.0, 645.0, 0.1), (10.0, 20.0, 40.0, -20.0, 858.0, 0.2), (12.0, -5.0, 30.0, 60.0, 645.0, 0.5), (12.0, -5.0, 30.0, 60.0, 858.0, 0.6)]
    (tmp_path / "b.txt").write_text("0 0 35 0 12 77 .1 .2 .3 .4 .5\n")
    one = M.read_five_band(spark, str(tmp_path / "b.txt"), 1).where("band = 4").first()
    two = M.read_five_band(spark, str(tmp_path / "b.txt"), 2).where("band = 0").first()
    assert (one.vza, one.sza, one.raa, one.refl) == (12.0, 35.0, 77.0, 0.5) and (two.vza, two.sza, two.raa, two.refl) == (35.0, 12.0, 77.0, 0.1)


def test_zenith_and_azimuth_come_from_one_pass(spark):
    grid = lambda z, a: f"<Zenith><Values_List>{z}</Values_List></Zenith><Azimuth><Values_List>{a}</Values_List></Azimuth>"
    z, a = "<VALUES>1 NaN 3</VALUES><VALUES>4 5</VALUES>", "<VALUES>10 200</VALUES>"
    text = f"<n><Tile_Angles><Sun_Angles_Grid>{grid(z, a)}</Sun_Angles_Grid>" + "".join(
        f'<Viewing_Incidence_Angles_Grids bandId="{b}" detectorId="3">{grid(a, z)}</Viewing_Incidence_Angles_Grids>' for b in (1, 2)) + "</Tile_Angles></n>"
    sun, view = M.angle_cells(spark.createDataFrame([("x", text)], "path string, value string"))
    assert sorted(map(tuple, sun.collect())) == [("x", 0, 0, 1.0, 10.0), ("x", 0, 1, None, -160.0)]  # cells of both grids
    assert sorted(map(tuple, view.collect()), key=repr) == [("x", b, 3, 0, c, *v) for b in (1, 2) for c, v in enumerate([(10.0, 1.0), (200.0, None)])]
    for df in (sun, view):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
