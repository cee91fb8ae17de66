"""X-bar charts of all full subgroups and of the published sizes."""

import pytest

from qualispark import catalogue
from qualispark.operators import control


@pytest.mark.parametrize("size", [2, 11, 25])
def test_sizes(spark, size):
    df = spark.createDataFrame([(g, float(i)) for g in range(4) for i in range(size)], "g int, x double")
    r, s = control.xbar_r(df, "x", "g").first(), control.xbar_s(df, "x", "g").first()
    assert r["ucl"] == pytest.approx(r["center"] + control.A2[size] * (size - 1))
    assert s["s_ucl"] == pytest.approx(control.B4[size] * s["s_bar"])
    assert [sorted(t) for t in (control.A2, control.D3, control.D4, control.A3, control.B3, control.B4)] == [list(range(2, 26))] * 6


def test_all_full_subgroups_count(spark):
    sf = "/root/testdata/sf0.01"
    sizes = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_partkey").count().collect()
    want = sum(r["count"] // 5 for r in sizes)
    for name in ("xbar_r_all", "xbar_s_all"):
        assert catalogue.QUERIES[name](spark, sf).first()["k"] == want > 500
