"""Levels of a host, repeated pages and columns that clash."""

from rasterloom.llm import url_filter


def test_names_below_country_codes_are_sites(spark):
    """Sites under co.uk don't share a reputation as one site would."""
    pages = [(i, f"http://www.{'good' if i % 2 else 'bad'}.co.uk/en/{i}") for i in range(400)] + [(1000, "http://other.good.co.uk/"), (1001, "http://other.bad.co.uk/"), (1000, "http://other.good.co.uk/")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, domain string")
    seen = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, outcome int")
    got = url_filter.filter_urls(df, seen).collect()
    assert len(got) == 403
    mean = {r.page_id: r.mean for r in got}
    assert mean[1000] > 0.9 > 0.1 > mean[1001]


def test_long_urls_and_blanks(spark):
    rows = [(1, "http://" + "a" * 100_000 + ".org/" + "p" * 100_000), (2, ""), (3, "://"), (4, None)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "page_id long, outcome int")).collect()}
    assert got[1].rule == "org/" and len(got[1].host) == 100_004 and [got[i].host for i in (2, 3, 4)] == ["", "", ""] and got[2].mean == 0.5
