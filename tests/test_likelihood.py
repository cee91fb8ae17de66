"""Quantile, ordered and mixture fits, tests of vectors, and the stateful monitor against plain computations."""

import math
from itertools import combinations

import numpy as np
import pytest

from qualispark.operators import likelihood, multivariate
from qualispark.streaming import live


def frame(spark, columns, schema, parts=3):
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*columns, strict=True)], schema).repartition(parts)


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantile_line_is_the_best_of_all_pairs(spark, q):
    """The least check loss is reached by a line through two of the points."""
    rng = np.random.default_rng(1)
    x = rng.uniform(10, 20, 41)
    y = 3 + 0.7 * x + rng.exponential(2, 41)
    got = likelihood.quantile_regression(frame(spark, [x, y], "x double, y double"), "y", ["x"], q).collect()

    def loss(a, b):
        e = y - a - b * x
        return (e * (q - (e < 0))).sum()

    lines = [((y[i] - (y[j] - y[i]) / (x[j] - x[i]) * x[i]), (y[j] - y[i]) / (x[j] - x[i])) for i, j in combinations(range(41), 2)]
    best = min(lines, key=lambda c: loss(*c))
    assert [r["coef"] for r in got] == pytest.approx(best, rel=1e-3)
    assert loss(got[0]["coef"], got[1]["coef"]) == pytest.approx(loss(*best), rel=1e-5)
    flat = min(loss(v, 0) for v in y)
    assert got[0]["pseudo_r1"] == pytest.approx(1 - loss(*best) / flat, abs=2e-3)
    assert got[1]["se"] > 0 and got[1]["low"] < got[1]["coef"] < got[1]["high"]


def test_quantile_regression_refuses(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        likelihood.quantile_regression(df, "y", ["x"], 1.0)
    with pytest.raises(ValueError):
        likelihood.quantile_regression(df, "y", ["x"])


def test_ordered_classes_against_numeric_derivatives(spark):
    rng = np.random.default_rng(2)
    n = 250
    x = np.round(rng.normal(size=(n, 2)) * [1, 10] + [0, 100], 1)
    z = x @ [0.8, 0.05] + rng.logistic(size=n)
    k = np.digitize(z, np.quantile(z, [0.3, 0.55, 0.8]))
    got = {r["term"]: r for r in likelihood.ordinal_logit(frame(spark, [k, x[:, 0], x[:, 1]], "k int, a double, b double"), "k", ["a", "b"]).collect()}
    names = ["a", "b", "k<=0", "k<=1", "k<=2"]
    theta = np.array([got[t]["coef"] for t in names])

    def like(t):
        cut = np.concatenate(([-np.inf], t[2:], [np.inf]))
        s = lambda v: 1 / (1 + np.exp(-v))
        eta = (x - [0, 100]) @ t[:2] + 100 * t[1]
        return np.log(s(cut[k + 1] - eta) - s(cut[k] - eta)).sum()

    assert like(theta) == pytest.approx(got["a"]["log_likelihood"])
    h = np.array([1e-4, 1e-5, 1e-4, 1e-4, 1e-4])
    unit = np.eye(5) * h
    grad = np.array([(like(theta + u) - like(theta - u)) / 2 for u in unit]) / h
    assert np.abs(grad * [1, 0.01, 1, 1, 1]).max() < 1e-3
    hess = np.array([[(like(theta + u + v) - like(theta + u - v) - like(theta - u + v) + like(theta - u - v)) / 4 for v in unit] for u in unit]) / np.outer(h, h)
    assert [got[t]["se"] for t in names] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-hess))).tolist(), rel=0.02)
    with pytest.raises(ValueError):
        likelihood.ordinal_logit(frame(spark, [k * 0, x[:, 0]], "k int, a double"), "k", ["a"])


def test_mixture_finds_its_parts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, 700), rng.normal(6, 2, 300)))
    got = likelihood.mixture(frame(spark, [x], "x double"), "x", 2).collect()
    assert [r["mean"] for r in got] == pytest.approx([0, 6], abs=0.4) and [r["weight"] for r in got] == pytest.approx([0.7, 0.3], abs=0.06)
    w, m, s = ([r[c] for r in got] for c in ("weight", "mean", "sd"))
    like = np.log(sum(a / (c * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((x - b) / c) ** 2) for a, b, c in zip(w, m, s, strict=True))).sum()
    assert got[0]["log_likelihood"] == pytest.approx(like, rel=1e-6)
    for bad in ([1.0] * 40, [1.0, 2.0]):
        with pytest.raises(ValueError):
            likelihood.mixture(frame(spark, [bad], "x double"), "x", 2)


def test_vectors_of_three_columns(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 4, 120)
    x = rng.normal(size=(120, 3)) + np.array([[0, 0, 0], [1, 0, 2], [0, 1, 1], [2, 2, 0]])[g] * 0.7
    df = frame(spark, [np.array(list("abcd"))[g], *x.T], "g string, a double, b double, c double")
    within, between, mean = np.zeros((3, 3)), np.zeros((3, 3)), x.mean(0)
    for k in range(4):
        d = x[g == k] - x[g == k].mean(0)
        within += d.T @ d
        between += (g == k).sum() * np.outer(x[g == k].mean(0) - mean, x[g == k].mean(0) - mean)
    got = {r["statistic"]: r for r in multivariate.manova(df, ["a", "b", "c"], "g").collect()}
    assert got["wilks"]["value"] == pytest.approx(np.linalg.det(within) / np.linalg.det(within + between))
    assert got["pillai"]["value"] == pytest.approx(np.trace(np.linalg.solve(within + between, between)))
    assert got["hotelling_lawley"]["value"] == pytest.approx(np.trace(np.linalg.solve(within, between)))
    assert all(0 <= r["p"] <= 1 for r in got.values()) and got["pillai"]["df1"] == 9
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    axes = multivariate.discriminant_axes(df, ["a", "b", "c"], "g").collect()
    assert sorted({r["eigenvalue"] for r in axes}) == pytest.approx(sorted(values.real))
    place = x @ vectors.real / np.sqrt(np.diag(vectors.real.T @ within @ vectors.real))
    centers = np.array([place[g == k].mean(0) for k in range(4)])
    told = ((place[:, None] - centers) ** 2).sum(2).argmin(1)
    table = multivariate.discriminant(df, ["a", "b", "c"], "g").collect()
    want = {("abcd"[i], "abcd"[j]): int(((g == i) & (told == j)).sum()) for i in range(4) for j in range(4)}
    assert {(r["actual"], r["predicted"]): r["n"] for r in table} == {k: v for k, v in want.items() if v}
    assert table[0]["accuracy"] == pytest.approx((told == g).mean())


def test_vectors_refuse(spark):
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 1.0, 5.0), ("a", 1.0, 4.0)], "g string, x double, y double")
    for bad in (lambda: multivariate.manova(flat, ["x", "y"], "g"), lambda: multivariate.hotelling_test(flat, ["x", "y"]), lambda: multivariate.discriminant(flat.filter("g = 'a'"), ["x", "y"], "g"), lambda: multivariate.manova(flat.filter("false"), ["x", "y"], "g")):
        with pytest.raises(ValueError):
            bad()


def test_signals_of_a_series():
    found, state = live.judged([1.0, 2.0, 1.0, 2.0, 1.0, 40.0], (0, 0.0, 0.0, 0.0, 0, 0))
    assert [(f[0], f[1]) for f in found] == [] or found[0][1] == "beyond_3sigma"
    steady = [0.0, 1.0] * 10 + [5.0] * 12
    whole, end = live.judged(steady, (0, 0.0, 0.0, 0.0, 0, 0))
    assert "run_of_9" in [f[1] for f in whole]
    parts, state = [], (0, 0.0, 0.0, 0.0, 0, 0)
    for at in range(0, len(steady), 5):
        found, state = live.judged(steady[at : at + 5], state)
        parts += [(at + f[0], *f[1:]) for f in found]
    assert parts == whole and state == end


def test_each_signal_is_told_once_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=60), rng.normal(4, 1, 40)))
    rows = [("ab"[i % 2], i, float(v)) for i, v in enumerate(x)]
    schema = "k string, i long, v double"
    told = live.signals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")) if (tmp_path / "in").mkdir() is None else None, "k", ["i"], "v")
    for part in (rows[:30], rows[30:55], rows[55:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = live.drained(told, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["k"], r["i"], r["rule"]) for r in out.collect())
    want = []
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        want += [(k, own[f[0]][1], f[1]) for f in live.judged([r[2] for r in own], (0, 0.0, 0.0, 0.0, 0, 0))[0]]
    assert got == sorted(want) and len(got) > 2
