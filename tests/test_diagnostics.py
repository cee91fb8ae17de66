"""Regression diagnostics, capability studies and measurement studies against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualispark.functions.special import norm_cdf, norm_ppf, t_sf
from qualispark.operators import capability_study as cs
from qualispark.operators import diagnostics, studies


def lines(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(2, 3)
        rows.append((i, a, b, rng.gauss(0, 1), 1 + 2 * a - 0.5 * b + rng.gauss(0, 0.7)))
    rows[3] = (3, 6.0, -20.0, 0.0, 30.0)
    schema = "id int, a double, b double, c double, y double"
    return spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0), (901, 1.0, float("nan"), 1.0, 1.0)], schema).repartition(4), np.array(rows)


def test_influence(spark):
    df, r = lines(spark)
    x, y = np.column_stack([np.ones(len(r)), r[:, 1], r[:, 2]]), r[:, 4]
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    e, h, n, k = y - hat @ y, np.diag(hat), len(r), 3
    t = e / np.sqrt(e @ e / (n - k) * (1 - h))
    got = diagnostics.influence(df, "y", ["a", "b"], ["id"]).orderBy("id").toPandas()
    assert list(got["id"]) == list(range(n))
    assert np.allclose(got["fitted"], hat @ y) and np.allclose(got["residual"], e) and np.allclose(got["leverage"], h)
    assert np.allclose(got["studentized"], t) and np.allclose(got["cooks_d"], t**2 * h / (1 - h) / k)
    for i in range(n):  # leave the row out and fit again
        keep = np.arange(n) != i
        b = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        rest = y[keep] - x[keep] @ b
        s = math.sqrt(rest @ rest / (n - 1 - k))
        assert got["dffits"][i] == pytest.approx(((hat @ y)[i] - x[i] @ b) / (s * math.sqrt(h[i])), rel=1e-6)
    assert got["high_leverage"][3] and got["high_cooks_d"][3] and got["outlier"][3] == (abs(t[3]) > 3)
    assert list(got["high_leverage"]) == list(h > 2 * k / n)


def test_influence_refuses(spark):
    df, _ = lines(spark)
    with pytest.raises(ValueError, match="names of the result"):
        diagnostics.influence(df.withColumn("fitted", F.lit(1)), "y", ["a"], ["fitted"])
    with pytest.raises(ValueError, match="constant or depend"):
        diagnostics.influence(df.withColumn("d", F.col("a") * 2), "y", ["a", "d"], ["id"])
    with pytest.raises(ValueError, match="too few"):
        diagnostics.influence(df.filter("false"), "y", ["a"], ["id"])
    flat = diagnostics.influence(df.withColumn("y", F.lit(4.0)), "y", ["a"], ["id"]).first()
    assert flat["residual"] == 0 and flat["studentized"] is None and flat["outlier"] is None


def test_durbin_watson(spark):
    df, r = lines(spark)
    x = np.column_stack([np.ones(len(r)), r[:, 1]])
    e = r[:, 4] - x @ np.linalg.lstsq(x, r[:, 4], rcond=None)[0]
    got = diagnostics.durbin_watson(df.filter("id < 900"), "y", ["a"], ["id"]).first()
    assert got["n"] == len(r) and got["dw"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))


def plain_p(r, chosen):
    x, y = np.column_stack([np.ones(len(r)), *(r[:, i] for i in chosen)]), r[:, 4]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    free = len(r) - x.shape[1]
    se = np.sqrt(e @ e / free * np.diag(np.linalg.inv(x.T @ x)))
    return [t_sf(c / s, free) for c, s in zip(b[1:], se[1:], strict=True)]


def test_stepwise(spark):
    df, r = lines(spark, 80, 5)
    df = df.filter("id < 900")
    forward = diagnostics.stepwise(df, "y", ["a", "b", "c"], "forward").collect()
    first = min((plain_p(r, [i])[0], i) for i in (1, 2, 3))
    assert forward[0]["term"] == " abc"[first[1]] and forward[0]["p"] == pytest.approx(first[0], abs=1e-12)
    second = min((plain_p(r, [first[1], i])[1], i) for i in (1, 2, 3) if i != first[1])
    assert forward[1]["term"] == " abc"[second[1]] and forward[1]["p"] == pytest.approx(second[0], abs=1e-12)
    backward = diagnostics.stepwise(df, "y", ["a", "b", "c"], "backward").collect()
    ps = plain_p(r, [1, 2, 3])
    assert [(b["action"], b["term"]) for b in backward] == [("exit", "c")] and backward[0]["p"] == pytest.approx(ps[2])
    assert {b["term"] for b in diagnostics.stepwise(df, "y", ["a", "b", "c"]).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        diagnostics.stepwise(df, "y", ["a"], alpha_in=0.2, alpha_out=0.1)


def test_roc(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.4, rng.choice([0.1, 0.2, 0.5, 0.9, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 0.3), (True, None), (False, float("nan"))], "y boolean, s double").repartition(5)
    p, q = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in p for b in q) / len(p) / len(q)
    got = diagnostics.roc_summary(df, "y", "s").first()
    assert got["auc"] == pytest.approx(auc) and (got["positives"], got["negatives"]) == (len(p), len(q))
    curve = {r["threshold"]: (r["tp"], r["fp"]) for r in diagnostics.roc_curve(df, "y", "s").collect()}
    assert curve == {t: (sum(a >= t for a in p), sum(b >= t for b in q)) for t in {s for _, s in rows}}
    best = max(curve, key=lambda t: (curve[t][0] / len(p) - curve[t][1] / len(q), t))
    assert got["best_threshold"] == best and got["best_tpr"] == pytest.approx(curve[best][0] / len(p))
    one = diagnostics.roc_summary(df.filter("y"), "y", "s").first()
    assert one["auc"] is None and one["negatives"] == 0
    empty = diagnostics.roc_summary(df.filter("false"), "y", "s").first()
    assert empty["auc"] is None and empty["positives"] == 0


def test_hosmer_lemeshow(spark):
    rng = random.Random(8)
    rows = []
    for i in range(253):
        s = rng.choice([0.3, 0.4, rng.random()])
        rows.append((i, int(rng.random() < s), s))
    df = spark.createDataFrame(rows, "id int, y int, s double").repartition(4)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    bins, chi = np.array_split(np.arange(len(rows)), 10), 0.0
    got = {r["group"]: r for r in diagnostics.hosmer_lemeshow(df, "y", "s", ["id"]).collect()}
    for g, at in enumerate(bins, 1):
        o, e = sum(order[i][1] for i in at), sum(order[i][2] for i in at)
        chi += (o - e) ** 2 / e + (e - o) ** 2 / (len(at) - e)
        assert got[g]["n"] == len(at) and got[g]["observed_1"] == o and got[g]["expected_1"] == pytest.approx(e)
    assert got[1]["chi2"] == pytest.approx(chi) and got[1]["df"] == 8 and 0 < got[1]["p"] < 1
    assert diagnostics.hosmer_lemeshow(df.filter("false"), "y", "s", ["id"]).count() == 0
    with pytest.raises(Exception, match="needs 50 rows"):
        diagnostics.hosmer_lemeshow(df.limit(9), "y", "s", ["id"]).collect()


def test_logit_scores(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        x = rng.gauss(0, 1)
        rows.append((x, float(rng.random() < 1 / (1 + math.exp(-x)))))
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    got = diagnostics.logit_scores(df, "y", ["x"]).toPandas()
    assert got["score"].sum() == pytest.approx(got["y"].sum(), rel=1e-6)  # the score equations
    assert (got["score"] * got["x"]).sum() == pytest.approx((got["y"] * got["x"]).sum(), rel=1e-6)


def test_capability_order(spark):
    rng = random.Random(4)
    x = [rng.gauss(10, 2) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(x), (500, None), (501, float("nan"))], "i int, x double").repartition(4)
    got = cs.capability_study(df, "x", 4.0, 15.0, 10.0, order=["i"]).first()
    within, sd, m = np.abs(np.diff(x)).mean() / 1.128, np.std(x, ddof=1), np.mean(x)
    assert got["n"] == 120 and got["within"] == pytest.approx(within) and got["cp"] == pytest.approx(11 / 6 / within)
    cpk = min(15 - m, m - 4) / 3 / within
    half = norm_ppf(0.975) * math.sqrt(1 / 9 / 120 + cpk**2 / 2 / 119)
    assert got["cpk"] == pytest.approx(cpk) and got["cpk_low"] == pytest.approx(cpk - half)
    out = norm_cdf((4 - m) / within) + norm_cdf((m - 15) / within)
    assert got["ppm_within"] == pytest.approx(1e6 * out) and got["z_bench"] == pytest.approx(-norm_ppf(out))
    assert got["cpm"] == pytest.approx(11 / 6 / math.sqrt(sd**2 + (m - 10) ** 2))
    assert got["below"] == sum(v < 4 for v in x) and got["above"] == sum(v > 15 for v in x)
    one = cs.capability_study(df, "x", usl=15.0, order=["i"]).first()
    assert one["cp"] is None and one["cpl"] is None and one["cpk"] == pytest.approx((15 - m) / 3 / within) and one["below"] == 0
    assert one["ppm_within"] == pytest.approx(1e6 * norm_cdf((m - 15) / within))


def test_capability_subgroups_and_edges(spark):
    rng = random.Random(6)
    rows = [(g, rng.gauss(g % 3, 1)) for g in range(30) for _ in range(4)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    got = cs.capability_study(df, "x", -4.0, 6.0, subgroup="g").first()
    ranges = [max(v for k, v in rows if k == g) - min(v for k, v in rows if k == g) for g in range(30)]
    assert got["within"] == pytest.approx(np.mean(ranges) / 2.059) and got["sd"] == pytest.approx(np.std([v for _, v in rows], ddof=1))
    with pytest.raises(Exception, match="subgroups need one size"):
        cs.capability_study(df.union(spark.createDataFrame([(99, 1.0)], "g int, x double")), "x", 0.0, 1.0, subgroup="g").collect()
    assert cs.capability_study(df.filter("false"), "x", 0.0, 1.0, subgroup="g").count() == 0
    flat = cs.capability_study(df.withColumn("x", F.lit(2.0)), "x", 0.0, 4.0, subgroup="g").first()
    assert flat["cpk"] is None and flat["z_bench"] is None and flat["n"] == 120
    for bad in ({}, {"order": ["g"], "subgroup": "g"}):
        with pytest.raises(ValueError):
            cs.capability_study(df, "x", 0.0, 1.0, **bad)
    with pytest.raises(ValueError, match="positive values"):
        cs.capability_study(df, "x", 0.1, 1.0, order=["g"], transform="box-cox")


def test_capability_of_powers(spark):
    rng = random.Random(7)
    x = [math.exp(rng.gauss(1, 0.4)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double").repartition(4)
    got = cs.capability_study(df, "x", 0.5, 12.0, order=["i"], transform="box-cox").first()
    log = np.log(x)

    def like(g):
        y = log if abs(g) < 1e-9 else (np.exp(g * log) - 1) / g
        return -len(x) / 2 * math.log(y.var()) + (g - 1) * log.sum()

    g = got["power"]
    assert abs(g) < 0.4 and like(g) >= max(like(g - 0.001), like(g + 0.001))
    y = (np.array(x) ** g - 1) / g
    up = (12.0**g - 1) / g
    assert got["cpu"] == pytest.approx((up - y.mean()) / 3 / (np.abs(np.diff(y)).mean() / 1.128), rel=1e-6)
    assert got["above"] == sum(v > 12 for v in x)


def gauge_rows(seed=9):
    rng = random.Random(seed)
    rows = []
    for o in range(3):
        for p in range(5):
            level = 10 + o + rng.gauss(0, 2)
            rows += [(f"o{o}", p, level + rng.gauss(0, 0.5)) for _ in range(4)]
    return rows


def test_nested_gauge(spark):
    rows = gauge_rows()
    df = spark.createDataFrame(rows, "o string, p int, x double").repartition(4)
    got = studies.nested_gauge(df, "x", "p", "o", tolerance=20.0).first()
    cell = {(o, p): [v for a, b, v in rows if (a, b) == (o, p)] for o, p, _ in rows}
    mo = {o: np.mean([v for a, _, v in rows if a == o]) for o, _ in cell}
    grand = np.mean([r[2] for r in rows])
    error = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in cell.values()) / 45
    part = 4 * sum((np.mean(v) - mo[o]) ** 2 for (o, _), v in cell.items()) / 12
    op = 20 * sum((m - grand) ** 2 for m in mo.values()) / 2
    assert (got["ms_error"], got["ms_part"], got["ms_operator"]) == pytest.approx((error, part, op))
    grr, pv = error + max(0, (op - part) / 20), (part - error) / 4
    assert got["grr_share"] == pytest.approx(100 * math.sqrt(grr / (grr + pv))) and got["ndc"] == pytest.approx(math.sqrt(2 * pv / grr))
    assert got["grr_of_tolerance"] == pytest.approx(600 * math.sqrt(grr) / 20)
    with pytest.raises(Exception, match="equal counts"):
        studies.nested_gauge(df.union(spark.createDataFrame([("o1", 1, 3.0)], df.schema)), "x", "p", "o").collect()
    assert studies.nested_gauge(df.filter("false"), "x", "p", "o").count() == 0


def test_linearity(spark):
    rng = random.Random(10)
    rows = [(p, 2.0 * p, 2.0 * p + 0.3 + 0.05 * p + rng.gauss(0, 0.2)) for p in range(1, 6) for _ in range(p + 3)] + [(9, 20.0, 20.9)]
    df = spark.createDataFrame([*rows, (1, None, 3.0)], "p int, r double, x double").repartition(4)
    bias = {p: np.mean([x - r for q, r, x in rows if q == p]) for p, _, _ in rows}
    per = {r["part"]: r for r in studies.gauge_bias(df, "p", "r", "x").collect()}
    assert all(per[p]["bias"] == pytest.approx(b) for p, b in bias.items()) and per[9]["t"] is None and per[9]["p"] is None
    one = [x - r for q, r, x in rows if q == 2]
    t = np.mean(one) / (np.std(one, ddof=1) / math.sqrt(len(one)))
    assert per[2]["t"] == pytest.approx(t) and per[2]["p"] == pytest.approx(t_sf(t, len(one) - 1))
    got = studies.gauge_linearity(df, "p", "r", "x", 4.0).first()
    u, v = np.array([2.0 * p if p < 9 else 20.0 for p in bias]), np.array(list(bias.values()))
    slope = np.cov(u, v)[0, 1] / u.var(ddof=1)
    rest = v - v.mean() - slope * (u - u.mean())
    se = math.sqrt(rest @ rest / (len(u) - 2) / ((u - u.mean()) ** 2).sum())
    assert got["slope"] == pytest.approx(slope) and got["se_slope"] == pytest.approx(se) and got["p_slope"] == pytest.approx(t_sf(slope / se, len(u) - 2))
    every = np.array([x - r for _, r, x in rows])
    t = every.mean() / (every.std(ddof=1) / math.sqrt(len(every)))
    assert got["mean_bias"] == pytest.approx(every.mean()) and got["t"] == pytest.approx(t) and got["low"] < every.mean() < got["high"]
    assert got["linearity_share"] == pytest.approx(400 * abs(slope))
    with pytest.raises(Exception, match="six rows"):
        studies.gauge_linearity(df.filter("p = 1"), "p", "r", "x").collect()
    assert studies.gauge_linearity(df.filter("false"), "p", "r", "x").count() == 0


def test_agreement(spark):
    rng = random.Random(11)
    rows = [(a, p, rng.choice(["lo", "mid", "hi"]) if rng.random() < 0.4 else "mid") for p in range(40) for a in ("x", "y", "z") for _ in range(2)]
    rows.append(("x", 77, "lo"))  # a part that only one rated
    df = spark.createDataFrame(rows, "a string, p int, r string").repartition(4)
    mode = {}
    for a, p, _ in rows:
        seen = [r for b, q, r in rows if (b, q) == (a, p)]
        mode[a, p] = min(seen, key=lambda r: (-seen.count(r), r))
    table = np.array([[sum(mode[a, p] == c for a in "xyz") for c in ("hi", "lo", "mid")] for p in range(40)])
    observed, share = (((table**2).sum(axis=1) - 3) / 6).mean(), table.sum(axis=0) / 120
    got = studies.fleiss_kappa(df, "a", "p", "r").first()
    assert got["parts"] == 40 and got["matched"] == int((table.max(axis=1) == 3).sum())
    assert got["kappa"] == pytest.approx((observed - (share**2).sum()) / (1 - (share**2).sum()))
    two, order = df.filter("a <> 'z'"), ["hi", "lo", "mid"]
    for weights, power in ((None, None), ("linear", 1), ("quadratic", 2)):
        w = np.eye(3) if power is None else np.array([[1 - (abs(i - j) / 2) ** power for j in range(3)] for i in range(3)])
        m = np.zeros((3, 3))
        for p in range(40):
            m[order.index(mode["x", p]), order.index(mode["y", p])] += 1
        o, e = (w * m).sum() / 40, (w * np.outer(m.sum(axis=1), m.sum(axis=0))).sum() / 1600
        assert studies.cohen_kappa(two, "a", "p", "r", weights).first()["kappa"] == pytest.approx((o - e) / (1 - e)), weights
    within = {r["appraiser"]: r for r in studies.within_appraiser(df, "a", "p", "r").collect()}
    assert within["x"]["total"] == 40 and within["x"]["matched"] == sum(len({r for a, q, r in rows if (a, q) == ("x", p)}) == 1 for p in range(40))
    same = df.withColumn("r", F.lit("ok"))
    assert studies.fleiss_kappa(same, "a", "p", "r").first()["kappa"] == 1 and studies.cohen_kappa(same.filter("a <> 'z'"), "a", "p", "r").first()["kappa"] == 1
    assert studies.fleiss_kappa(df.filter("false"), "a", "p", "r").count() == 0 and studies.cohen_kappa(df.filter("false"), "a", "p", "r").count() == 0
    with pytest.raises(Exception, match="two appraisers"):
        studies.cohen_kappa(df, "a", "p", "r").collect()


def test_variance_budget(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(200):
        a, b, c = rng.choice("pqrs"), rng.choice("uv"), rng.choice("klm")
        rows.append((a, b, c, "pqrs".index(a) * 1.5 + (b == "u") + rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "a string, b string, c string, y double").repartition(4)
    y = np.array([r[3] for r in rows])

    def rss(factors):
        x = np.column_stack([np.ones(len(rows)), *(np.array([r["abc".index(f)] == v for r in rows], float) for f in factors for v in sorted({r["abc".index(f)] for r in rows}))])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return e @ e

    got = {r["source"]: r for r in studies.variance_budget(df, "y", ["a", "b", "c"]).collect()}
    full = rss("abc")
    assert got["residual"]["ss"] == pytest.approx(full) and got["residual"]["df"] == 200 - 7
    for f, d in (("a", 3), ("b", 1), ("c", 2)):
        ss = rss("abc".replace(f, "")) - full
        assert got[f]["ss"] == pytest.approx(ss, abs=1e-8) and got[f]["df"] == d and got[f]["f"] == pytest.approx(ss / d / (full / 193), abs=1e-8)
    assert sum(r["share"] for r in got.values()) == pytest.approx(100)
    twin = {r["source"]: r for r in studies.variance_budget(df.withColumn("d", F.concat("a", F.lit("x"))), "y", ["a", "d", "b"]).collect()}
    assert twin["a"]["df"] == 0 and twin["a"]["ss"] == 0 and twin["a"]["f"] is None
    with pytest.raises(ValueError):
        studies.variance_budget(df.filter("false"), "y", ["a"])


def test_against_standard(spark):
    rows = [("x", 1, "a", "a"), ("x", 1, "a", "a"), ("x", 2, "a", "b"), ("x", 3, "b", "b"), ("x", 3, "a", "b"), ("y", 1, "a", "a"), ("y", 2, None, "b")]
    df = spark.createDataFrame(rows, "a string, p int, r string, s string").repartition(3)
    got = {r["appraiser"]: (r["matched"], r["total"]) for r in studies.against_standard(df, "a", "p", "r", "s").collect()}
    assert got == {"x": (1, 3), "y": (1, 1)}
    with pytest.raises(Exception, match="two standards"):
        studies.against_standard(df.union(spark.createDataFrame([("x", 1, "a", "b")], df.schema)), "a", "p", "r", "s").collect()
    assert studies.against_standard(df.filter("false"), "a", "p", "r", "s").count() == 0


def test_keys_named_like_inner_columns(spark):
    rows = [(i, i // 3, i // 3, float(i * i % 7), float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "x int, r int, size int, v double, w double").repartition(3)
    want = cs.capability_study(df.withColumnRenamed("x", "i"), "v", 0.0, 9.0, order=["i"]).first()
    assert cs.capability_study(df, "v", 0.0, 9.0, order=["x"]).first() == want
    by = {name: cs.capability_study(df, "v", 0.0, 9.0, subgroup=name).first()["within"] for name in ("r", "size")}
    assert by["r"] == by["size"] > 0
    assert diagnostics.durbin_watson(df, "v", ["w"], ["x"]).first()["n"] == 30
