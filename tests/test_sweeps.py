"""The sweeps try the surveyed grids."""

from zonalis.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_grids_are_whole(spark):
    far = [3, 5, 8, 10, 15, 20, 30, 40, 60]
    for name, scales in {"exp": far, "gauss": far, "power": [1, 1.5, 2, 2.5, 3, 4], "network": [5, 10, 15, 20, 30, 45, 60, 90]}.items():
        got = QUERIES[f"tune_sweep_{name}"](spark, SF).collect()
        assert {(r.beta, r.scale) for r in got} == {(b, s) for b in (1, 1.5, 2, 2.77) for s in scales}
        assert len(got) == 4 * len(scales) * len({r.region for r in got})
