"""Observations meet the days around them by their date, without a row for each day."""

import datetime as dt

from rasterloom.operators import regrid as D


def test_window_repeats_dates_not_observations(spark):
    at = lambda d, h: dt.datetime(2020, 3, d, h)
    obs = spark.createDataFrame([(1, at(1, 7)), (2, at(1, 23)), (3, at(20, 0)), (4, None)], "scene_id int, obs_time timestamp")
    series = spark.createDataFrame([("a", dt.date(2020, 3, 3)), ("b", dt.date(2020, 3, 3)), ("c", dt.date(2020, 3, 4)), ("d", dt.date(2020, 3, 18))], "granule string, day date")
    got = D.day_window(obs, series, 2)
    assert got.columns == ["day", "scene_id", "obs_time", "granule"]
    assert sorted((r.scene_id, r.granule) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "d")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):].splitlines()[1:]
    assert below[0].strip(" :+-").startswith("Aggregate [")  # only distinct dates are exploded
