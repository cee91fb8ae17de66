"""Resampling, order statistics, ordered pairs, survival, recursions and grouped models against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualispark.functions import special
from qualispark.operators import control, mixed, orderpairs, orderstats, resample, scan, smoothing, survival


def frame(spark, columns, schema, parts=3):
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*columns, strict=True)], schema).repartition(parts)


# ------------------------------------------------------------ order statistics


def test_quantiles_of_groups_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, 2.5, rng.random()])) for _ in range(400)] + [("c", 4.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p975": 0.975, "p100": 1.0}
    got = {r["g"]: r for r in orderstats.quantiles(df, "x", probs, ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(x)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(x, 100 * p)), (g, name)
    assert set(got) == {"a", "b", "c", None}
    x = np.array([v for k, v in rows if k == "a"])
    mad = {r["g"]: r["mad"] for r in orderstats.mad(df, "x", ["g"]).collect()}
    assert mad["a"] == pytest.approx(np.median(np.abs(x - np.median(x)))) and mad["c"] == 0
    empty = orderstats.median(df.filter("false"), "x").first()
    assert empty["n"] == 0 and empty["median"] is None


def test_tolerance(spark):
    # Published one-sided factors (0.95, 0.95) of 10 and 50 values, and 59 and 93 as the least samples.
    assert orderstats.normal_k(10, 0.95, 0.95, False) == pytest.approx(2.911, abs=1e-3)
    assert orderstats.normal_k(50, 0.95, 0.95, False) == pytest.approx(2.065, abs=1e-3)
    assert orderstats.normal_k(50, 0.95, 0.95) == pytest.approx(2.379, abs=3e-3)
    assert orderstats.cut_ranks(93, 0.95, 0.95) == 2 and orderstats.cut_ranks(92, 0.95, 0.95) is None
    rng = random.Random(4)
    x = [rng.lognormvariate(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(4)
    got = orderstats.free_tolerance(df, "x", 0.9, 0.95).first()
    m, s = orderstats.cut_ranks(500, 0.9, 0.95), sorted(x)
    width, j = min((s[j + 500 - m] - s[j - 1], j) for j in range(1, m))
    assert (got["low_rank"], got["high_rank"]) == (j, j + 500 - m + 1) and got["high"] - got["low"] == pytest.approx(width)
    assert got["achieved"] >= 0.95 and orderstats.free_tolerance(df.limit(20), "x").count() == 0
    assert orderstats.normal_tolerance(df.limit(2), "x").first()["k"] is None


# ------------------------------------------------------------ bootstrap


def test_weights_are_poisson():
    w = resample.weights(np.arange(4000), np.arange(200), 3).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.002)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.3
    assert (resample.weights(np.arange(10), np.arange(5), 1) != resample.weights(np.arange(10), np.arange(5), 2)).any()


def plain_interval(x, keys, f, influence, replicates, seed, level, bca):
    w = resample.weights(np.array(keys), np.arange(replicates), seed).astype(float)
    boot = np.sort([f(x, w[:, r]) for r in range(replicates)])
    theta = f(x, np.ones(len(x)))
    low, high = (1 - level) / 2, (1 + level) / 2
    if bca:
        z0 = special.norm_ppf(min(max((boot < theta).mean(), 1e-9), 1 - 1e-9))
        u = influence(x)
        a = (u**3).sum() / (6 * (u**2).sum() ** 1.5)
        low, high = (special.norm_cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (special.norm_ppf(low), special.norm_ppf(high)))
    return theta, np.percentile(boot, 100 * low), np.percentile(boot, 100 * high), boot.std(ddof=1)


def mean(x, w):
    return (w * x).sum() / w.sum()


def std(x, w):
    m = mean(x, w)
    return math.sqrt((w * (x - m) ** 2).sum() / (w.sum() - 1))


@pytest.mark.parametrize("statistic,method", [("mean", "bca"), ("std", "bca"), ("mean", "percentile"), ("cv", "percentile"), ("proportion", "bca")])
def test_bootstrap_against_plain_resamples(spark, statistic, method):
    rng = np.random.default_rng(2)
    x, keys = rng.exponential(3, 300) - 1, np.arange(300) * 7 - 50
    df = frame(spark, [keys, x], "k long, x double")
    got = [tuple(resample.bootstrap(d, "x", statistic, replicates=150, method=method, seed=9, key=F.col("k")).first()) for d in (df, df.repartition(1), df.orderBy("x"))]
    assert got[0] == pytest.approx(got[1]) and got[0] == pytest.approx(got[2])
    used = (x > 0).astype(float) if statistic == "proportion" else x
    f = {"mean": mean, "proportion": mean, "std": std, "cv": lambda x, w: std(x, w) / mean(x, w)}[statistic]
    influence = (lambda x: (x - x.mean()) ** 2 - x.var()) if statistic == "std" else lambda x: x - x.mean()
    want = plain_interval(used, keys, f, influence, 150, 9, 0.95, method == "bca")
    assert got[0] == pytest.approx((300, *want))


def test_bootstrap_of_few_constant_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", 5.0), ("c", None), (None, 3.0)], "g string, x double")
    got = {r["g"]: r for r in resample.bootstrap(df, "x", "std", "g", replicates=50).collect()}
    assert set(got) == {"a", "b"} and got["a"]["estimate"] is None and got["b"]["estimate"] == pytest.approx(0, abs=1e-6) and got["b"]["high"] == pytest.approx(0, abs=1e-6)
    assert resample.bootstrap(df, "x", "median", "g").filter("g = 'b'").first()["high"] == 5
    assert resample.bootstrap(df.filter("false"), "x", "mean").count() <= 1
    for bad in (("iqr", "percentile"), ("skew", "bca"), ("mean", "other")):
        with pytest.raises(ValueError):
            resample.bootstrap(df, "x", bad[0], method=bad[1])
    with pytest.raises(ValueError):
        resample.effect_size(df.filter("g = 'a'"), "x", "g")


def test_median_interval_is_the_ideal_bootstrap(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=101)
    got = resample.bootstrap(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", "median").first()
    many = np.median(rng.choice(x, (40_000, 101)), axis=1)
    s = np.sort(x)
    for end, p in (("low", 2.5), ("high", 97.5)):
        at = np.searchsorted(s, got[end])
        near = np.percentile(many, p)
        assert s[max(at - 1, 0)] <= near <= s[min(at + 1, 100)]
    assert got["estimate"] == pytest.approx(np.median(x))


# ------------------------------------------------------------ pairs and survival


@pytest.mark.parametrize("values", [4, 60, 10**6])
def test_pair_sums_against_all_pairs(spark, values):
    rng = np.random.default_rng(values)
    n = 500
    x, a, b = rng.integers(0, values, n).astype(float), rng.integers(0, 3, n), rng.integers(0, 3, n)
    y = np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, values, n))
    df = frame(spark, [x, y, a, b], "x double, y double, a long, b long")
    before, ab = x[:, None] < x[None, :], a[:, None] * b[None, :]
    want = {k: int((ab * (before & t)).sum()) for k, t in (("below", y[:, None] < y), ("equal", y[:, None] == y), ("above", y[:, None] > y))}
    assert orderpairs.pair_sums(df, "x", "y", F.col("a"), F.col("b")) == want


def test_kendall(spark):
    # Fixed value: tau-b of the pairs (12,1) (2,4) (1,7) (12,1) (2,0), a textbook case with ties.
    df = spark.createDataFrame([(12.0, 1.0), (2.0, 4.0), (1.0, 7.0), (12.0, 1.0), (2.0, 0.0), (None, 1.0)], "x double, y double")
    got = orderpairs.kendall(df, "x", "y").first()
    assert got["n"] == 5 and got["tau"] == pytest.approx(-0.47140452079103173) and got["p"] == pytest.approx(0.2827454599327748)
    flat = orderpairs.kendall(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert flat["tau"] is None and orderpairs.kendall(df.filter("false"), "x", "y").first()["n"] == 0


def test_cox_against_plain_newton(spark):
    rng = np.random.default_rng(0)
    n = 200
    x = rng.normal(size=(n, 2)) + [50, 0]
    t, c = rng.exponential(1 / np.exp((x - [50, 0]) @ [0.7, -0.4])), rng.exponential(2, n)
    e, t = (t <= c).astype(int), np.round(np.minimum(t, c), 1)
    df = frame(spark, [t, e, x[:, 0], x[:, 1]], "t double, e int, u double, v double")
    got = survival.cox(df, "t", F.col("e"), ["u", "v"]).collect()
    b = np.zeros(2)
    z = x - x.mean(0)
    for _ in range(30):
        w, g, h, like = np.exp(z @ b), np.zeros(2), np.zeros((2, 2)), 0.0
        for i in np.flatnonzero(e):
            r = t >= t[i]
            s = w[r].sum()
            m = (w[r, None] * z[r]).sum(0) / s
            g, like = g + z[i] - m, like + z[i] @ b - math.log(s)
            h = h + np.einsum("i,ij,ik->jk", w[r], z[r], z[r]) / s - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    for i, r in enumerate(got):
        assert r["coef"] == pytest.approx(b[i], abs=1e-7) and r["se"] == pytest.approx(se[i], rel=1e-6) and r["log_likelihood"] == pytest.approx(like)
    risk = np.round(x @ b, 10)
    pairs = [(risk[i] > risk[j]) + 0.5 * (risk[i] == risk[j]) for i in np.flatnonzero(e) for j in range(n) if t[j] > t[i]]
    assert got[0]["c_index"] == pytest.approx(np.mean(pairs), abs=1e-3)
    for bad in (df.limit(5), df.withColumn("e", F.lit(0))):
        with pytest.raises(ValueError):
            survival.cox(bad, "t", F.col("e"), ["u", "v"])


# ------------------------------------------------------------ recursions


def test_affine_scan_over_chunks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    step = np.array([[0.5, 0.3], [-0.2, 0.8]])
    df = frame(spark, [np.arange(500), x[:, 0], x[:, 1]], "i long, a double, b double", 7)
    system = scan.System(step, np.eye(2), [1.0, -1.0])
    got = np.array([(r["z0"], r["z1"]) for r in scan.affine(df, ["i"], {"a": F.col("a"), "b": F.col("b")}, system, ["z0", "z1"]).orderBy("i").collect()])
    z, want = np.array([1.0, -1.0]), []
    for u in x:
        z = step @ z + u
        want.append(z)
    assert got == pytest.approx(np.array(want))
    assert scan.affine(df.filter("false"), ["i"], {"a": F.col("a"), "b": F.col("b")}, system, ["z0", "z1"]).count() == 0


def plain_winters(x, alpha, beta, gamma, m):
    """Forecasts and errors of additive seasons, row by row."""
    level, trend = x[:m].mean(), (x[m : 2 * m].mean() - x[:m].mean()) / m
    seasons = list(x[:m] - level)
    sse = 0.0
    for i in range(m, len(x)):
        s = seasons[i - m]
        before = level + trend
        sse += (x[i] - before - s) ** 2
        now = alpha * (x[i] - s) + (1 - alpha) * before
        seasons.append(gamma * (x[i] - before) + (1 - gamma) * s)
        trend, level = beta * (now - level) + (1 - beta) * trend, now
    return [level + h * trend + seasons[len(x) - m + (h - 1) % m] for h in range(1, 7)], sse


def test_seasons_and_fit(spark):
    rng = np.random.default_rng(6)
    x = 5 + 0.1 * np.arange(90) + np.tile([1.0, -2, 0.5], 30) + rng.normal(size=90) * 0.3
    df = frame(spark, [np.arange(90), x], "i long, x double")
    got = smoothing.forecast(df, "x", ["i"], 6, trend=True, season=3, alpha=0.4, beta=0.2, gamma=0.3).collect()
    want, sse = plain_winters(x, 0.4, 0.2, 0.3, 3)
    assert [r["forecast"] for r in got] == pytest.approx(want) and got[0]["sse"] == pytest.approx(sse)
    fit = smoothing.forecast(df, "x", ["i"], 2, trend=True, season=3).first()
    grid = [plain_winters(x, a, b, g, 3)[1] for a in np.linspace(0.02, 0.98, 9) for b in np.linspace(0.02, 0.98, 9) for g in np.linspace(0.02, 0.98, 9)]
    assert fit["sse"] <= 1.002 * min(grid)
    rows = smoothing.smoothed(df, "x", ["i"], 0.4, 0.2, 0.3, 3).orderBy("i").collect()
    assert sum((r["x"] - r["fitted"]) ** 2 for r in rows) == pytest.approx(sse)
    with pytest.raises(ValueError):
        smoothing.forecast(df.limit(4), "x", ["i"], season=3)


def test_mewma_needs_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0)], "i int, a double, b double")
    for columns in (["a", "b"], ["a"]):
        with pytest.raises(ValueError):
            control.mewma(df, columns, ["i"])


# ------------------------------------------------------------ grouped models


def test_random_intercept_against_dense_likelihood(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 12, 150)
    x = rng.normal(size=150) + 3
    y = 2 + 0.5 * x + rng.normal(size=12)[g] * 1.5 + rng.normal(size=150)
    got = {r["term"]: r for r in mixed.lmm(frame(spark, [g, x, y], "g long, x double, y double"), "y", ["x"], "g").collect()}
    r = got["x"]
    design = np.column_stack((np.ones(150), x))

    def likelihood(va, ve):
        v = ve * np.eye(150) + va * (g[:, None] == g)
        vi = np.linalg.inv(v)
        a = design.T @ vi @ design
        b = np.linalg.solve(a, design.T @ vi @ y)
        e = y - design @ b
        return -0.5 * (148 * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + e @ vi @ e), b, np.sqrt(np.diag(np.linalg.inv(a)))

    like, b, se = likelihood(r["group_variance"], r["residual_variance"])
    assert r["log_likelihood"] == pytest.approx(like)
    assert [got["intercept"]["coef"], r["coef"]] == pytest.approx(b.tolist()) and [got["intercept"]["se"], r["se"]] == pytest.approx(se.tolist())
    for da, de in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)):
        assert likelihood(r["group_variance"] * da, r["residual_variance"] * de)[0] < like
    with pytest.raises(ValueError):
        mixed.lmm(frame(spark, [g * 0, x, y], "g long, x double, y double"), "y", ["x"], "g")


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson", "gamma"])
def test_estimating_equations_against_dense(spark, family):
    rng = np.random.default_rng(8)
    n = 160
    g, x = rng.integers(0, 20, n), rng.normal(size=n)
    eta = 0.3 + 0.4 * x + 0.5 * rng.normal(size=20)[g]
    y = {"gaussian": eta + rng.normal(size=n), "binomial": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float), "poisson": rng.poisson(np.exp(eta)).astype(float), "gamma": rng.gamma(2, np.exp(eta) / 2)}[family]
    got = mixed.gee(frame(spark, [g, x, y], "g long, x double, y double"), "y", ["x"], "g", family).collect()
    b, alpha = np.array([r["coef"] for r in got]), got[0]["alpha"]
    design = np.column_stack((np.ones(n), x))
    e_ = design @ b
    mu = {"gaussian": e_, "binomial": 1 / (1 + np.exp(-e_)), "poisson": np.exp(e_), "gamma": np.exp(e_)}[family]
    slope = {"gaussian": np.ones(n), "binomial": mu * (1 - mu), "poisson": mu, "gamma": mu}[family]
    root = {"gaussian": np.ones(n), "binomial": np.sqrt(np.abs(mu * (1 - mu))), "poisson": np.sqrt(np.abs(mu)), "gamma": mu}[family]
    score, bread, meat, cross, pairs = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2)), 0.0, 0
    e = (y - mu) / root
    for k in range(20):
        at = np.flatnonzero(g == k)
        r = (1 - alpha) * np.eye(len(at)) + alpha
        d = slope[at, None] * design[at]
        vi = np.linalg.inv(np.outer(root[at], root[at]) * r)
        u = d.T @ vi @ (y[at] - mu[at])
        score, bread, meat = score + u, bread + d.T @ vi @ d, meat + np.outer(u, u)
        cross, pairs = cross + (e[at].sum() ** 2 - (e[at] ** 2).sum()) / 2, pairs + len(at) * (len(at) - 1) / 2
    assert np.abs(score).max() < 1e-6
    scale = (e**2).sum() / (n - 2)
    assert alpha == pytest.approx(cross / ((pairs - 2) * scale), abs=1e-8)
    inverse = np.linalg.inv(bread)
    assert [r["se"] for r in got] == pytest.approx(np.sqrt(np.diag(inverse @ meat @ inverse)).tolist())
