"""Constant, one-row and empty columns: a stated null, never a stopped job; unsuitable input is an error."""

import pytest
from pyspark.sql import functions as F

from qualispark.operators import chart_tables, charts, control, hypothesis, models, orderpairs, orderstats, posthoc

SCHEMA = "i int, g string, h string, x double, y double"
FLAT = [(i, "ab"[i % 2], "cd"[i // 2 % 2], 3.0, float(i % 3)) for i in range(12)]
ONE = [(1, "a", "c", 2.0, 1.0)]

TESTS = {
    "one_sample_t": lambda d: hypothesis.one_sample_t(d, "x"),
    "two_sample_t": lambda d: hypothesis.two_sample_t(d, "x", "g"),
    "pooled_t": lambda d: hypothesis.two_sample_t(d, "x", "g", equal_var=True),
    "one_way_anova": lambda d: hypothesis.one_way_anova(d, "x", "g"),
    "welch_anova": lambda d: hypothesis.welch_anova(d, "x", "g"),
    "brown_forsythe": lambda d: hypothesis.brown_forsythe_anova(d, "x", "g"),
    "levene": lambda d: hypothesis.levene(d, "x", "g"),
    "bartlett": lambda d: hypothesis.bartlett(d, "x", "g"),
    "f_test": lambda d: hypothesis.f_test(d, "x", "g"),
    "mann_whitney": lambda d: hypothesis.mann_whitney(d, "x", "g"),
    "kruskal": lambda d: hypothesis.kruskal(d, "x", "g"),
    "runs": lambda d: hypothesis.runs(d, "x", ["i"]),
    "chi_square": lambda d: hypothesis.chi_square(d.withColumn("h", F.lit("c")), "g", "h"),
    "tukey": lambda d: posthoc.tukey_hsd(d, "x", "g"),
    "games_howell": lambda d: posthoc.games_howell(d, "x", "g"),
    "dunn": lambda d: posthoc.dunn(d, "x", "g"),
    "correlation": lambda d: models.correlation(d, ["x", "y"]),
    "spearman": lambda d: models.correlation(d, ["x", "y"], "spearman"),
    "density": lambda d: chart_tables.density(d, "x"),
    "boxplot": lambda d: charts.boxplot(d, "x", "g"),
    "histogram": lambda d: charts.histogram(d, "x"),
    "imr": lambda d: control.imr_flags(d, "x", ["i"]),
    "rules": lambda d: control.run_rules(d, "x", ["i"]),
    "ewma": lambda d: control.ewma(d, "x", ["i"]),
    "kendall": lambda d: orderpairs.kendall(d, "x", "y"),
    "tolerance": lambda d: orderstats.normal_tolerance(d, "x"),
}
PAIRED = ("two_sample_t", "pooled_t", "f_test", "mann_whitney")


@pytest.mark.parametrize("name", sorted(TESTS))
def test_no_spread_stops_no_job(spark, name):
    for rows in (FLAT, ONE, []):
        df = spark.createDataFrame(rows, SCHEMA)
        if name in PAIRED and rows is not FLAT:
            with pytest.raises(Exception, match="two groups"):
                TESTS[name](df).collect()
            continue
        for r in TESTS[name](df).collect():
            assert r["p"] is None or 0 <= r["p"] <= 1 if "p" in r.asDict() else True


def test_values_without_spread(spark):
    df = spark.createDataFrame(FLAT, SCHEMA)
    assert hypothesis.one_sample_t(df, "x").first()["t"] is None
    assert hypothesis.one_way_anova(df, "x", "g").first()["f"] is None
    assert models.correlation(df, ["x", "y"]).first()["r"] is None


def test_unsuitable_input_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([*FLAT, (99, "a", "c", 1.0, 1.0)], SCHEMA)
    for chart in (control.xbar_r, control.xbar_s):
        with pytest.raises(Exception, match="subgroups need one size"):
            chart(df, "x", "g").collect()
        assert chart(df.filter("false"), "x", "g").count() == 0
    monkeypatch.setattr(posthoc, "MAX_GROUPS", 1)
    with pytest.raises(ValueError):
        posthoc.tukey_hsd(df, "x", "g")
    monkeypatch.setattr(hypothesis, "CATEGORY_CELLS", 3)
    with pytest.raises(ValueError):
        hypothesis.chi_square(df, "g", "h")


def test_order_by_text_and_by_a_repeated_key(spark):
    from qualispark.operators import ordered

    rows = [(f"k{i % 5:02d}" if i % 3 else "k01", i, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, one int").repartition(6)
    got = {r["i"]: r["row"] for r in ordered.numbered(df, ["k", "i"]).collect()}
    assert got == {i: n for n, (_, i, _) in enumerate(sorted(rows))}
    assert ordered.chunked(df, ["k", "i"], 8).select("__chunk").distinct().count() > 5


def test_previous_of_a_group_over_chunks(spark):
    from qualispark.operators import ordered

    rows = [("abc"[i * 7 % 3 if i % 5 else 0], i, None if i % 11 == 0 else float(i * i % 17)) for i in range(200)] + [(None, 500, 1.0), (None, 501, 2.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(7)
    want, last = {}, {}
    for g, i, x in rows:
        want[i] = last.get(g)
        last[g] = x
    assert {r["i"]: r["was"] for r in ordered.previous(df, "g", ["i"], "x", "was").collect()} == want


def test_rules_keep_order_columns(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(30)], "d int, v double")
    out = control.run_rules(df, "v", ["d"])
    assert "d" in out.columns and out.agg(F.max("d")).first()[0] == 29


def test_studentized_range():
    # Published upper 5 % points.
    for k, df, q in ((3, 10, 3.877), (5, 20, 4.232), (2, 1, 17.97), (10, 60, 4.646)):
        assert posthoc.studentized_range_ppf(0.95, k, df) == pytest.approx(q, rel=1e-3)
