"""Fits of distributions against perturbed likelihoods, distances against sorted samples."""

import math

import numpy as np
import pytest

from qualispark.operators import distributions


def logs(family, x, a, b):
    if family == "normal":
        return -0.5 * ((x - a) / b) ** 2 - math.log(b) - 0.5 * math.log(2 * math.pi)
    if family == "lognormal":
        return logs("normal", np.log(x), a, b) - np.log(x)
    if family == "exponential":
        return -x / a - math.log(a)
    if family == "weibull":
        return math.log(a / b) + (a - 1) * np.log(x / b) - (x / b) ** a
    if family == "gamma":
        return (a - 1) * np.log(x) - x / b - a * math.log(b) - math.lgamma(a)
    u = (x - a) / b
    if family == "logistic":
        return -u - math.log(b) - 2 * np.log1p(np.exp(-u))
    if family == "log_logistic":
        return logs("logistic", np.log(x), math.log(b), 1 / a) - np.log(x)
    return (-u - np.exp(-u) if family == "gumbel_r" else u - np.exp(u)) - math.log(b)


def test_fits_are_the_best_and_distances_exact(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.weibull(1.7, 400) * 12 + 0.01, 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = {r["family"]: r for r in distributions.distribution_id(df, "x").collect()}
    assert set(got) == set(distributions.FAMILIES) and got["weibull"]["rank"] <= 2 and all(r["n"] == 400 for r in got.values())
    s = np.sort(x)
    i = np.arange(1, 401)
    for k, r in got.items():
        best = logs(k, x, r["a"], r["b"]).sum()
        assert r["log_likelihood"] == pytest.approx(best), k
        for da, db in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)):
            if r["b"] is not None or db == 1:
                assert logs(k, x, r["a"] * da, r["b"] and r["b"] * db).sum() < best, (k, da, db)
        f = distributions.distribution(k, r["a"], r["b"])(s)
        p = np.clip(f, 1e-12, 1 - 1e-12)
        assert r["ad"] == pytest.approx(-400 - ((2 * i - 1) / 400 * (np.log(p) + np.log(1 - p[::-1]))).sum()), k
        t = np.linspace(s[0], s[-1], 20_001)  # the distribution rises as the density says
        mid = np.exp(logs(k, (t[1:] + t[:-1]) / 2, r["a"], r["b"])).sum() * (t[1] - t[0])
        assert distributions.distribution(k, r["a"], r["b"])(t[[0, -1]]) @ [-1, 1] == pytest.approx(mid, abs=1e-5), k
    assert [r["ad"] for r in sorted(got.values(), key=lambda r: r["rank"])] == sorted(r["ad"] for r in got.values())


def test_families_of_positive_values_are_left_out(spark):
    df = spark.createDataFrame([(float(i - 5),) for i in range(20)], "x double")
    assert {r["family"] for r in distributions.distribution_id(df, "x").collect()} == {"normal", "logistic", "gumbel_l", "gumbel_r"}
    assert [r["family"] for r in distributions.distribution_id(df, "x", ["normal"]).collect()] == ["normal"]
    for bad in (lambda: distributions.distribution_id(df.limit(3), "x"), lambda: distributions.distribution_id(df.selectExpr("2.0D as x"), "x"), lambda: distributions.distribution_id(df, "x", ["zeta"])):
        with pytest.raises(ValueError):
            bad()


def test_special_values():
    # Euler's constant and pi squared over six.
    d, t = distributions.digamma(1.0)
    assert d == pytest.approx(-0.5772156649015329) and t == pytest.approx(math.pi**2 / 6)
    k = distributions.gamma_shape(math.log(3.0) - distributions.digamma(3.0)[0])
    assert k == pytest.approx(3.0)
