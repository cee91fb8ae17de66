"""Tests, post-hoc pairs, designs and fits against published values and plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualispark.functions import special
from qualispark.operators import hypothesis as hyp
from qualispark.operators import models, posthoc, regression


def test_studentized_range():
    # Upper 5 % points of the studentized range as tabulated.
    for k, df, q in ((3, 10, 3.877), (5, 20, 4.232), (4, 12, 4.199), (2, 5, 3.635), (10, 60, 4.646)):
        assert posthoc.studentized_range_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)
    assert posthoc.studentized_range_ppf(0.95, 3, 30_000) == pytest.approx(3.314, abs=2e-3)
    # of two groups it is Student's t
    for t, df in ((2.0, 7), (1.3, 50)):
        assert posthoc.studentized_range_sf(t * math.sqrt(2), 2, df) == pytest.approx(special.t_sf(t, df), abs=1e-7)


@pytest.fixture(scope="module")
def yields(spark):
    rows = [("A", v) for v in (6, 8, 4, 5, 3, 4)] + [("B", v) for v in (8, 12, 9, 11, 6, 8)] + [("C", v) for v in (13, 9, 11, 8, 7, 12)]
    return spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, x double")


def test_anova_of_a_textbook(yields):
    r = hyp.one_way_anova(yields, "x", "g").first()
    assert r["f"] == pytest.approx(9.264705882, abs=1e-8) and r["p"] == pytest.approx(0.0023987773, abs=1e-9)
    pairs = {(r["g1"], r["g2"]): r for r in posthoc.tukey_hsd(yields, "x", "g").collect()}
    assert pairs[("A", "B")]["p"] < 0.05 and pairs[("A", "C")]["p"] < 0.01 and pairs[("B", "C")]["p"] > 0.5
    assert pairs[("A", "B")]["low"] < pairs[("A", "B")]["diff"] == -4.0 < pairs[("A", "B")]["high"] < 0
    welch = posthoc.games_howell(yields, "x", "g").collect()
    assert len(welch) == 3 and all(0 < r["p"] < 1 for r in welch)
    best = {r["g"]: r for r in posthoc.hsu_mcb(yields, "x", "g").collect()}
    assert best["A"]["high"] == 0.0 and best["C"]["diff"] == 1.0 and best["C"]["low"] <= 0 <= best["C"]["high"]
    out = {r["g"]: r["out"] for r in posthoc.anom(yields, "x", "g").collect()}
    assert out["A"] and not out["B"]


def test_dunn_by_hand(spark):
    rows = [(g, float(v)) for g, vs in (("A", (1, 2, 3)), ("B", (4, 5, 6)), ("C", (7, 8, 9))) for v in vs]
    got = {(r["g1"], r["g2"]): r for r in posthoc.dunn(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    se = math.sqrt(7.5 * 2 / 3)
    assert got[("A", "C")]["z"] == pytest.approx(-6 / se) and got[("A", "B")]["z"] == pytest.approx(-3 / se)
    assert got[("A", "C")]["p_adjusted"] == pytest.approx(3 * got[("A", "C")]["p"])
    assert got[("A", "B")]["p_adjusted"] == pytest.approx(min(1, 2 * got[("A", "B")]["p"]))


def test_two_groups_or_an_error(yields):
    for f in (hyp.two_sample_t, hyp.f_test):
        with pytest.raises(Exception, match="exactly two groups, found 3"):
            f(yields, "x", "g").collect()


def test_exact_and_square_tables(spark):
    tea = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 3, "a int, b int")
    r = hyp.fisher_exact(tea, F.col("a") == 1, F.col("b") == 1).first()
    assert r["odds_ratio"] == 9.0 and r["p"] == pytest.approx(0.4857142857, abs=1e-9)
    cells = {("a", "b"): 15, ("b", "a"): 5, ("a", "c"): 9, ("c", "a"): 3, ("b", "c"): 8, ("c", "b"): 8, ("a", "a"): 20}
    rated = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    assert hyp.mcnemar_bowker(rated, "a", "b").first()["chi2"] == pytest.approx(100 / 20 + 36 / 12 + 0)
    assert hyp.stuart_maxwell(rated, "a", "b").first()["df"] == 2


def test_normality(spark):
    rng = random.Random(3)
    xs = [round(rng.gauss(10, 2), 1) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    m, s, n = np.mean(xs), np.std(xs, ddof=1), len(xs)
    cdf = np.array([special.norm_cdf((x - m) / s) for x in sorted(xs)])
    i = np.arange(1, n + 1)
    want = -n - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    got = hyp.anderson_darling(df, "x").first()
    assert got["a2"] == pytest.approx(want, rel=1e-9) and got["p"] > 0.05
    assert hyp.ks_normal(df, "x").first()["d"] == pytest.approx(max(np.max(i / n - cdf), np.max(cdf - (i - 1) / n)))
    assert hyp.anderson_darling(spark.createDataFrame([(math.exp(x),) for x in xs], "x double"), "x").first()["p"] < 1e-6


def test_two_way_types(spark):
    rng = random.Random(7)
    rows = [(a, b, 2.0 * (a == "q") + (b == "z") + 3 * (a == "q" and b == "x") + rng.gauss(0, 1)) for a in "pq" for b in "xyz" for _ in range(2 + rng.randrange(4))]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    y = np.array([r[2] for r in rows])

    def effect(levels, column):
        return np.array([[1.0 if r[column] == v else -1.0 if r[column] == levels[-1] else 0.0 for v in levels[:-1]] for r in rows])

    xa, xb = effect("pq", 0), effect("xyz", 1)
    xab = xa * xb

    def rss(*parts):
        x = np.concatenate((np.ones((len(rows), 1)), *parts), axis=1)
        return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))

    full = rss(xa, xb, xab)
    want = {1: (rss() - rss(xa), rss(xa) - rss(xa, xb)), 2: (rss(xb) - rss(xa, xb), rss(xa) - rss(xa, xb)), 3: (rss(xb, xab) - full, rss(xa, xab) - full)}
    for kind, (ss_a, ss_b) in want.items():
        got = {r["term"]: r for r in regression.two_way_anova(df, "x", "a", "b", kind).collect()}
        assert got["a"]["ss"] == pytest.approx(ss_a) and got["b"]["ss"] == pytest.approx(ss_b)
        assert got["a:b"]["ss"] == pytest.approx(rss(xa, xb) - full) and got["within"]["ss"] == pytest.approx(full)
        assert got["a:b"]["p"] == pytest.approx(special.f_sf(got["a:b"]["f"], 2, len(rows) - 6))


def test_fits(spark):
    rng = random.Random(11)
    x = np.array([[rng.gauss(0, 1), rng.gauss(3, 2)] for _ in range(400)])
    line = 1 + x @ [2.0, -0.5]
    y = line + np.array([rng.gauss(0, 1) for _ in range(400)])
    rate = np.array([sum(1 for _ in range(40) if rng.random() < min(1.0, math.exp(0.3 * v) / 20)) for v in x[:, 0]], float)
    df = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, rate, strict=True)], "a double, b double, y double, n double")
    terms = lambda out: [r["coef"] for r in out.collect()]
    x1 = np.concatenate((np.ones((400, 1)), x), axis=1)
    plain = np.linalg.lstsq(x1, y, rcond=None)[0]
    assert terms(regression.glm(df, "y", ["a", "b"])) == pytest.approx(plain, rel=1e-8)
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + 50 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert terms(regression.ridge(df, "y", ["a", "b"], 50.0)) == pytest.approx([y.mean() - b @ x.mean(0), *b], rel=1e-8)
    assert terms(regression.elastic_net(df, "y", ["a", "b"], 1e-9)) == pytest.approx(plain, rel=1e-5)
    assert terms(regression.elastic_net(df, "y", ["a", "b"], 1e6))[1:] == [0.0, 0.0]
    fit = regression.glm(df, "n", ["a"], "poisson").collect()
    mu = np.exp(fit[0]["coef"] + fit[1]["coef"] * x[:, 0])
    assert abs(np.sum(rate - mu)) < 1e-4 and abs(np.sum((rate - mu) * x[:, 0])) < 1e-4 and fit[1]["p"] < 1e-3
    spoiled = df.withColumn("y", F.when(F.rand(5) < 0.05, 1000.0).otherwise(F.col("y"))).cache()
    assert terms(regression.huber(spoiled, "y", ["a", "b"])) == pytest.approx([1, 2, -0.5], abs=0.35)
    apart = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double")
    with pytest.raises((ValueError, np.linalg.LinAlgError)):
        regression.glm(apart, "y", ["x"], "binomial")


def test_log_rank_of_three(spark):
    rows = [("a", 1.0, 1), ("a", 3.0, 1), ("a", 4.0, 0), ("b", 2.0, 1), ("b", 5.0, 0), ("b", 6.0, 1), ("c", 7.0, 1), ("c", 8.0, 1), ("c", 9.0, 0)]
    got = models.log_rank(spark.createDataFrame(rows, "g string, t double, e int"), "t", F.col("e") == 1, "g").collect()
    assert [r["df"] for r in got] == [2, 2, 2] and sum(r["observed"] for r in got) == 6.0
    assert sum(r["expected"] for r in got) == pytest.approx(6.0) and got[0]["p"] == pytest.approx(special.chi2_sf(got[0]["chi2"], 2))
