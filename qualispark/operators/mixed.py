"""Models of grouped rows: a random intercept by REML, and estimating equations.

A group enters through its sums alone (count, predictors, response), which one
aggregate gives; no group is ever in one task or in Python.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import normal_two_sided


def _own(df: DataFrame, response: str, predictors: list[str], group: str) -> DataFrame:
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors, 1)]
    return df.select(F.col(group).alias("g"), F.col(response).cast("double").alias("y"), F.lit(1.0).alias("x0"), *cols).na.drop()


def lmm(df: DataFrame, response: str, predictors: list[str], group: str, reml: bool = True) -> DataFrame:
    """A row per term: coef, se, z, p, low, high; group_variance, residual_variance, icc, log_likelihood, n, groups on each.

    For a ratio r of the variances the inverse covariance of a group of n rows
    is I - r / (1 + r n) 11', so all that a ratio needs are sums over groups of
    r / (1 + r n) times products of group sums. Those of a grid of ratios are
    one aggregate over the groups; the grid closes in on the best likelihood.
    """
    own = _own(df, response, predictors, group)
    k = len(predictors) + 1
    names = [*(f"x{i}" for i in range(k)), "y"]
    center = own.agg(*(F.avg(c).alias(c) for c in names)).first()
    if center["y"] is None:
        raise ValueError("no complete rows")
    shift = [0.0, *(center[f"x{i}"] for i in range(1, k)), center["y"]]
    moved = own.select("g", *((F.col(c) - float(s)).alias(c) for c, s in zip(names, shift, strict=True)))
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = moved.groupBy("g").agg(F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in cells))
    sums = sums.persist()  # a row a group, read once a grid
    try:
        total = sums.agg(F.count("*").alias("m"), F.sum("n").alias("n"), *(F.sum(f"q{i}_{j}").alias(f"q{i}_{j}") for i, j in cells)).first()
        n, m = int(total["n"]), total["m"]
        if n <= k or m < 2:
            raise ValueError("two groups and more rows than terms are needed")
        whole = np.array([[total[f"q{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])

        def at(ratios: list[float]) -> list[tuple[float, float, np.ndarray, float, np.ndarray]]:
            made = []
            for r, ratio in enumerate(ratios):
                c = F.lit(ratio) / (1 + F.lit(ratio) * F.col("n"))
                made += [F.sum(c * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{r}_{i}_{j}") for i, j in cells]
                made.append(F.sum(F.log1p(F.lit(ratio) * F.col("n"))).alias(f"d{r}"))
            row, out = sums.agg(*made).first(), []
            for r, ratio in enumerate(ratios):
                a = whole - np.array([[row[f"c{r}_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                inverse = np.linalg.inv(a[:k, :k])
                b = inverse @ a[:k, k]
                rss = max(a[k, k] - b @ a[:k, k], 1e-300)
                df_ = n - k if reml else n
                v = rss / df_
                like = -0.5 * (df_ * math.log(2 * math.pi * v) + df_ + row[f"d{r}"])
                if reml:
                    like -= 0.5 * np.linalg.slogdet(a[:k, :k])[1]
                out.append((like, ratio, b, v, inverse))
            return out

        low, high = -12.0, 12.0
        best = max(at([0.0]), key=lambda t: t[0])
        for _ in range(12):
            grid = np.linspace(low, high, 13)
            found = max(at([math.exp(g) for g in grid]), key=lambda t: t[0])
            best = max(best, found, key=lambda t: t[0])
            mid, step = math.log(found[1]), (high - low) / 12
            low, high = mid - step, mid + step
            if step < 1e-9:
                break
    finally:
        sums.unpersist()
    like, ratio, b, v, inverse = best
    cov = v * inverse
    # back to the origin: the intercept loses what the means explain
    t = np.eye(k)
    t[0, 1:] = -np.array(shift[1:k])
    b, cov = t @ b, t @ cov @ t.T
    b[0] += shift[k]
    se = np.sqrt(np.diag(cov))
    tail = (ratio * v, v, ratio / (1 + ratio), float(like), n, m)
    rows = [(name, float(c), float(s), float(c / s), normal_two_sided(c / s), float(c - 1.959963984540054 * s), float(c + 1.959963984540054 * s), *map(float, tail[:4]), n, m) for name, c, s in zip(["intercept", *predictors], b, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, low double, high double, group_variance double, residual_variance double, icc double, log_likelihood double, n long, groups long")


FAMILIES = ("gaussian", "binomial", "poisson", "gamma")


def _mean(family: str, eta: Column) -> tuple[Column, Column, Column]:
    """Mean, its derivative and the variance function under the usual link (gamma: log)."""
    if family == "gaussian":
        return eta, F.lit(1.0), F.lit(1.0)
    if family == "binomial":
        mu = 1 / (1 + F.exp(-eta))
        return mu, mu * (1 - mu), mu * (1 - mu)
    mu = F.exp(eta)
    return mu, mu, mu if family == "poisson" else mu * mu


def gee(df: DataFrame, response: str, predictors: list[str], group: str, family: str = "gaussian", structure: str = "exchangeable", steps: int = 60) -> DataFrame:
    """A row per term: coef, se (sandwich), z, p, low, high; alpha, scale, n, groups on each.

    ``structure`` is independence or exchangeable. With pearson residuals e and
    weighted derivatives d the inverse working correlation of a group of n rows
    is (I - c 11') / (1 - a), c = a / (1 + (n - 1) a), so the score, the bread
    and the meat need the group's sums of d, e, de and dd alone: two aggregates
    a step. The gamma family has the log link.
    """
    if family not in FAMILIES or structure not in ("independence", "exchangeable"):
        raise ValueError(f"family is one of {', '.join(FAMILIES)}; structure is independence or exchangeable")
    own = _own(df, response, predictors, group)
    k = len(predictors) + 1
    first = own.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.count_distinct("g").alias("groups")).first()
    n, groups = first["n"], first["groups"]
    if n <= k or groups < 2:
        raise ValueError("two groups and more rows than terms are needed")
    start = {"gaussian": lambda m: m, "binomial": lambda m: math.log(m / (1 - m)), "poisson": math.log, "gamma": math.log}
    b = np.zeros(k)
    b[0] = start[family](first["m"])
    alpha = 0.0
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def per_group(b: np.ndarray) -> DataFrame:
        eta = sum((float(b[i]) * F.col(f"x{i}") for i in range(k)), F.lit(0.0))
        mu, slope, var = _mean(family, eta)
        root = F.sqrt(var)
        rows = own.select("g", ((F.col("y") - mu) / root).alias("e"), *((slope / root * F.col(f"x{i}")).alias(f"d{i}") for i in range(k)))
        return rows.groupBy("g").agg(
            F.count("*").cast("double").alias("n"), F.sum("e").alias("e"), F.sum(F.col("e") * F.col("e")).alias("ee"),
            *(F.sum(f"d{i}").alias(f"d{i}") for i in range(k)), *(F.sum(F.col(f"d{i}") * F.col("e")).alias(f"de{i}") for i in range(k)),
            *(F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"dd{i}_{j}") for i, j in cells),
        )

    def step(b: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Score, bread, meat; scale and correlation by moments of the residuals at ``b``."""
        c = F.lit(alpha) / (1 + (F.col("n") - 1) * alpha)
        rows = per_group(b)
        u = [(F.col(f"de{i}") - c * F.col(f"d{i}") * F.col("e")) / (1 - alpha) for i in range(k)]
        rows = rows.withColumns({f"u{i}": v for i, v in enumerate(u)})
        row = rows.agg(
            *(F.sum(f"u{i}").alias(f"u{i}") for i in range(k)),
            *(F.sum((F.col(f"dd{i}_{j}") - c * F.col(f"d{i}") * F.col(f"d{j}")) / (1 - alpha)).alias(f"b{i}_{j}") for i, j in cells),
            *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in cells),
            F.sum("ee").alias("ee"), F.sum(F.col("e") * F.col("e") - F.col("ee")).alias("cross"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"),
        ).first()
        full = lambda p: np.array([[row[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        scale = row["ee"] / (n - k)
        free = row["pairs"] / 2 - k
        now = row["cross"] / 2 / (free * scale) if structure == "exchangeable" and free > 0 and scale > 0 else 0.0
        return np.array([row[f"u{i}"] for i in range(k)]), full("b"), full("m"), scale, now

    for turn in range(steps):
        u, bread, meat, scale, now = step(b, alpha)
        move = np.linalg.solve(bread, u)
        done = np.abs(move).max() < 1e-10 * max(1.0, np.abs(b).max()) and abs(now - alpha) < 1e-10
        if done and turn:
            break
        b, alpha = b + move, now
    inverse = np.linalg.inv(bread)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    rows = [(name, float(c), float(s), float(c / s), normal_two_sided(c / s), float(c - 1.959963984540054 * s), float(c + 1.959963984540054 * s), float(alpha), float(scale), n, groups) for name, c, s in zip(["intercept", *predictors], b, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, low double, high double, alpha double, scale double, n long, groups long")
