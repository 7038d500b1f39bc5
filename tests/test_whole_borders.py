"""Every region's border has its points judged."""

from zonalis.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_regions_have_points_inside(spark):
    got = QUERIES["points_in_border"](spark, SF).groupBy("region").count().collect()
    assert len(got) == 25
    assert all(0 < r["count"] < 1000 for r in got)
