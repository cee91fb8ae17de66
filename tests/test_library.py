"""Values with known answers, orders over chunks, sources, plans and the stream."""

import math

import pytest
from pyspark.sql import functions as F

from qualispark.functions import special
from qualispark.functions.expressions import compile_expression
from qualispark.operators import capability, control, models, ordered, wrangle
from qualispark.plans import pipeline
from qualispark.sources import tables
from qualispark.streaming import monitor


def test_tails():
    assert special.t_sf(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_ppf(0.95, 10) == pytest.approx(18.307038053, abs=1e-6)
    assert special.binomial_cdf(3, 10, 0.5) == pytest.approx(0.171875)
    assert special.poisson_cdf(2, 3.0) == pytest.approx(0.42319008112)
    assert special.norm_cdf(1.959963984540054) == pytest.approx(0.975)


def test_order_over_chunks(spark):
    df = spark.range(1, 200).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x")).repartition(6)
    rows = ordered.with_history(df, ["id"], "x", 5).orderBy("id").collect()
    for r in rows:
        assert r["history"] == [float(i % 7) for i in range(max(1, r["id"] - 5), r["id"])]
    total = 0.0
    for r in ordered.running(df, ["id"], s=("x", "sum"), m=("x", "max")).orderBy("id").collect():
        total += r["x"]
        assert r["s"] == total and r["m"] == max(i % 7 for i in range(1, r["id"] + 1))


def test_expressions(spark):
    df = spark.createDataFrame([(7.0, -2.0, None), (1.0, 0.0, "a")], "a double, b double, s string")
    got = df.select(*(compile_expression(e, df.columns).alias(f"c{i}") for i, e in enumerate(("a / b", "a // b", "a % b", "s != 'a'", "s == 'a'", "1 < a < 8", "where(isna(s), 1, 2)", "round(2.5)", "log(b)")))).collect()
    assert tuple(got[0]) == (-3.5, -4, -1.0, True, False, True, 1, 2.0, None)
    assert got[1]["c0"] is None and got[1]["c4"] is True
    for bad in ("a.b", "__import__('os')", "[a]", "lambda: 1", "zzz"):
        with pytest.raises(ValueError):
            compile_expression(bad, df.columns)


def test_longley(spark):
    # The Longley data (GNP deflator, GNP, unemployed, armed forces, population, year; employed).
    rows = [
        (83, 234289, 2356, 1590, 107608, 1947, 60323), (88.5, 259426, 2325, 1456, 108632, 1948, 61122), (88.2, 258054, 3682, 1616, 109773, 1949, 60171),
        (89.5, 284599, 3351, 1650, 110929, 1950, 61187), (96.2, 328975, 2099, 3099, 112075, 1951, 63221), (98.1, 346999, 1932, 3594, 113270, 1952, 63639),
        (99, 365385, 1870, 3547, 115094, 1953, 64989), (100, 363112, 3578, 3350, 116219, 1954, 63761), (101.2, 397469, 2904, 3048, 117388, 1955, 66019),
        (104.6, 419180, 2822, 2857, 118734, 1956, 67857), (108.4, 442769, 2936, 2798, 120445, 1957, 68169), (110.8, 444546, 4681, 2637, 121950, 1958, 66513),
        (112.6, 482704, 3813, 2552, 123366, 1959, 68655), (114.2, 502601, 3931, 2514, 125368, 1960, 69564), (115.7, 518173, 4806, 2572, 127852, 1961, 69331),
        (116.9, 554894, 4007, 2827, 130081, 1962, 70551),
    ]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"x{i} double" for i in range(1, 7)) + ", y double")
    got = {r["term"]: r["coef"] for r in models.ols(df, "y", [f"x{i}" for i in range(1, 7)]).collect()}
    want = {"intercept": -3482258.63459582, "x1": 15.0618722713733, "x2": -0.0358191792925910, "x3": -2.02022980381683, "x4": -1.03322686717359, "x5": -0.0511041056535807, "x6": 1829.15146461355}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7), k


def test_quality_levels():
    d = capability.dpmo(10, 1000, 1)
    assert d["dpmo"] == 10_000 and d["sigma"] == pytest.approx(2.3263 + 1.5, abs=1e-3)
    assert capability.stress_strength(60, 5, 40, 5) == pytest.approx(special.norm_cdf(20 / math.sqrt(50)))


def test_weibull(spark):
    import random

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.weibullvariate(100, 2.0), 1) for _ in range(4000)], "t double, e int")
    fit = models.weibull(df, "t", F.col("e") == 1)
    assert fit["shape"] == pytest.approx(2.0, rel=0.05) and fit["scale"] == pytest.approx(100, rel=0.05)


def test_logistic_and_gauge(spark):
    rows = [(float(i % 10), float((i * 7919 % 100) < 10 * (i % 10))) for i in range(2000)]
    got = {r["term"]: r for r in models.logistic(spark.createDataFrame(rows, "x double, y double"), "y", ["x"]).collect()}
    assert got["x"]["coef"] > 0.3 and got["x"]["z"] > 10
    study = [(p, o, p * 10 + o + r * 0.5) for p in range(5) for o in range(3) for r in range(2)]
    g = models.gauge_rr(spark.createDataFrame(study, "p int, o int, x double"), "x", "p", "o").first()
    assert g["repeatability"] == pytest.approx(0.125) and g["part"] > 100 and g["ndc"] >= 5


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "i int, x double")
    assert control.imr_flags(empty, "x", ["i"]).count() == 0
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "i int, x double")
    assert control.imr_limits(df, "x", ["i"]).first()["mr_bar"] == 2.0
    assert [r["x"] for r in wrangle.impute(df, "x", "ffill", order=["i"]).orderBy("i").collect()] == [2.0, 2.0, 4.0]
    assert [r["x"] for r in wrangle.impute(df, "x", "bfill", order=["i"]).orderBy("i").collect()] == [2.0, 4.0, 4.0]


def test_sources(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("# made by hand\n\nname; n ;empty\nx;1,000;\ny;2;\n")
    df = tables.read_delimited(spark, str(f))
    assert df.columns == ["name", "n"] and sorted(r["n"] for r in df.collect()) == [2.0, 1000.0]
    made = tables.materialize([{"df": df, "id": "a", "units": {"n": ("mm", "m")}}, {"df": df, "id": "b", "filter": "n > 5"}])
    assert made.count() == 3 and {r["_source"] for r in made.collect()} == {"a", "b"}


def test_plans(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, v double")
    out = pipeline.run_steps(df, [{"op": "compute", "params": {"name": "w", "expression": "v * 2"}}, {"op": "filter", "params": {"expression": "w > 5"}}])
    assert [tuple(r) for r in out.collect()] == [(2, 3.0, 6.0)]
    assert pipeline.ask("Compare weight by line", ["weight", "line"]) == {"kind": "anova", "column": "weight", "group": "line"}
    assert pipeline.ask("what now?", ["weight"]) is None
    assert pipeline.provenance({"a": 1}, {}) == pipeline.provenance({"a": 1}, {})


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.select("event_id", "ts", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    q = monitor.windowed_signals(stream, "ts", "value", 50.0, 20.0).writeStream.outputMode("complete").format("memory").queryName("signals").start()
    q.processAllAvailable()
    q.stop()
    want = monitor.windowed_signals(batch, "ts", "value", 50.0, 20.0)
    key = lambda df: sorted((r["start"], r["n"], r["signals"]) for r in df.collect())
    assert key(spark.table("signals")) == key(want)
