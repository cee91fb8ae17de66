"""Generalised linear models, penalised and robust lines, and designs of two factors.

Every fit is a loop of one aggregate over the data (a weighted Gram matrix of
the terms) and small algebra on the driver; rows with a null are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import f_sf, normal_two_sided, t_sf
from qualispark.operators.models import gram


def _dot(b: np.ndarray, x: list[Column]) -> Column:
    return sum((float(c) * v for c, v in zip(b, x, strict=True)), F.lit(0.0))


def _weighted(own: DataFrame, x: list[Column], z: Column, w: Column, *more: Column) -> tuple[np.ndarray, np.ndarray, list]:
    """X'WX, X'Wz and the other aggregates, in one pass."""
    k = len(x)
    row = own.agg(
        *(F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)),
        *(F.sum(w * x[i] * z).alias(f"g{i}") for i in range(k)), *(m.alias(f"m{i}") for i, m in enumerate(more)),
    ).first()
    h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return h, np.array([row[f"g{i}"] or 0.0 for i in range(k)]), [row[f"m{i}"] for i in range(len(more))]


def _terms(df: DataFrame, response: str, predictors: list[str], *others: str) -> tuple[DataFrame, list[Column], Column]:
    own = df.select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys((*predictors, response, *others)))).na.drop()
    return own, [F.lit(1.0), *(F.col(c) for c in predictors)], F.col(response)


def glm(df: DataFrame, response: str, predictors: list[str], family: str = "gaussian", exposure: str | None = None, steps: int = 50) -> DataFrame:
    """term, coef, se, z, p, ratio (exp of coef), deviance, n: gaussian, binomial, poisson (log link) or gamma (inverse link).

    Reweighted least squares, one aggregate a step; ``exposure`` is a positive
    column of a poisson model whose logarithm is an offset. Separated binomial
    data have no finite fit and are an error.
    """
    if family not in ("gaussian", "binomial", "poisson", "gamma"):
        raise ValueError(f"no such family: {family}")
    own, x, y = _terms(df, response, predictors, *([exposure] if exposure else []))
    offset = F.log(F.col(exposure)) if exposure else F.lit(0.0)
    start = own.agg(F.avg(y).alias("m"), F.count("*").alias("n"), F.avg(F.exp(offset)).alias("e")).first()
    mean, n = start["m"], start["n"]
    link = {"gaussian": lambda m: m, "binomial": lambda m: np.log(m / (1 - m)), "poisson": lambda m: np.log(m / start["e"]), "gamma": lambda m: 1 / m}
    b = np.zeros(len(x))
    b[0] = link[family](mean)
    for _ in range(steps):
        eta = _dot(b, x) + offset
        if family == "gaussian":
            w, z, dev = F.lit(1.0), y, F.pow(y - eta, 2)
        elif family == "binomial":
            eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))
            mu = 1 / (1 + F.exp(-eta))
            w, z = mu * (1 - mu), eta + (y - mu) / (mu * (1 - mu))
            dev = -2 * F.when(y > 0.5, F.log(mu)).otherwise(F.log(1 - mu))
        elif family == "poisson":
            mu = F.exp(eta)
            w, z = mu, eta - offset + (y - mu) / mu
            dev = 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))
        else:
            mu = 1 / eta
            w, z, dev = mu * mu, eta - (y - mu) / (mu * mu), -2 * (F.log(y / mu) - (y - mu) / mu)
        h, g, (deviance, pearson) = _weighted(own, x, z, w, F.sum(dev), F.sum(F.pow((y - mu) / mu, 2)) if family == "gamma" else F.sum(dev))
        new = np.linalg.solve(h, g)
        step, b = np.abs(new - b).max(), new
        if step < 1e-9 * max(1.0, np.abs(b).max()):
            break
    else:
        raise ValueError("no convergence" + (": the classes may be separated" if family == "binomial" else ""))
    if family == "binomial" and deviance < 1e-6 * n:
        raise ValueError("the classes are separated: no finite fit")
    scale = pearson / (n - len(x)) if family in ("gaussian", "gamma") else 1.0
    se = np.sqrt(scale * np.diag(np.linalg.inv(h)))
    rows = [
        (t, float(c), float(e), float(c / e), float(t_sf(c / e, n - len(x)) if family == "gaussian" else normal_two_sided(c / e)), float(np.exp(min(c, 700.0))), float(deviance), n)
        for t, c, e in zip(["intercept", *predictors], b, se, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, ratio double, deviance double, n long")


def ridge(df: DataFrame, response: str, predictors: list[str], alpha: float = 1.0) -> DataFrame:
    """term and coef of a ridge on standardised predictors (population deviations), scaled back."""
    n, means, s = gram(df, [*predictors, response])
    p = len(predictors)
    sd = np.sqrt(np.diag(s)[:p] / n)
    z = s[:p, :p] / np.outer(sd, sd)
    b = np.linalg.solve(z + alpha * np.eye(p), s[:p, p] / sd) / sd
    rows = [("intercept", float(means[p] - b @ means[:p])), *((t, float(c)) for t, c in zip(predictors, b, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")


def elastic_net(df: DataFrame, response: str, predictors: list[str], alpha: float = 1.0, l1_ratio: float = 1.0, steps: int = 10_000) -> DataFrame:
    """term and coef of a lasso (``l1_ratio`` 1) or elastic net: coordinate descent on the Gram matrix, no further pass."""
    n, means, s = gram(df, [*predictors, response])
    p = len(predictors)
    sd = np.sqrt(np.diag(s)[:p] / n)
    z, c = s[:p, :p] / np.outer(sd, sd) / n, s[:p, p] / sd / n
    b = np.zeros(p)
    for _ in range(steps):
        before = b.copy()
        for j in range(p):
            r = c[j] - z[j] @ b + z[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0.0) / (z[j, j] + alpha * (1 - l1_ratio))
        if np.abs(b - before).max() < 1e-12 * max(1.0, np.abs(b).max()):
            break
    b = b / sd
    rows = [("intercept", float(means[p] - b @ means[:p])), *((t, float(v)) for t, v in zip(predictors, b, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")


def huber(df: DataFrame, response: str, predictors: list[str], k: float = 1.345, steps: int = 50) -> DataFrame:
    """term and coef of a line robust to outliers: least squares with Huber's weights.

    The scale is the median absolute residual over 0.6745, taken anew each step
    from a sketch (relative error of rank 1e-4), so no task sorts all rows.
    """
    own, x, y = _terms(df, response, predictors)
    h, g, _ = _weighted(own, x, y, F.lit(1.0))
    b = np.linalg.solve(h, g)
    for _ in range(steps):
        r = F.abs(y - _dot(b, x))
        scale = (own.agg(F.percentile_approx(r, 0.5, 10_000)).first()[0] or 0.0) / 0.6745
        if scale == 0:
            break
        h, g, _ = _weighted(own, x, y, F.when(r <= k * scale, 1.0).otherwise(k * scale / r))
        new = np.linalg.solve(h, g)
        step, b = np.abs(new - b).max(), new
        if step < 1e-8 * max(1.0, np.abs(b).max()):
            break
    return df.sparkSession.createDataFrame([(t, float(c)) for t, c in zip(["intercept", *predictors], b, strict=True)], "term string, coef double")


def best_subsets(df: DataFrame, response: str, predictors: list[str]) -> DataFrame:
    """terms, r2, adj_r2 of every subset of at most eight predictors: one Gram matrix, no further pass."""
    from itertools import combinations

    if len(predictors) > 8:
        raise ValueError("at most eight predictors")
    n, _, s = gram(df, [*predictors, response])
    p, rows = len(predictors), []
    for size in range(1, p + 1):
        for some in combinations(range(p), size):
            own = list(some)
            r2 = float(np.linalg.solve(s[np.ix_(own, own)], s[own, p]) @ s[own, p] / s[p, p])
            rows.append((", ".join(predictors[i] for i in own), size, r2, 1 - (1 - r2) * (n - 1) / (n - size - 1)))
    return df.sparkSession.createDataFrame(rows, "terms string, size int, r2 double, adj_r2 double")


def two_way_anova(df: DataFrame, value: str, a: str, b: str, kind: int = 2) -> DataFrame:
    """term, ss, df, f, p of two factors, their interaction and the rest; sums of squares of type 1, 2 or 3.

    The data are read once into cells (count, mean, variance). The interaction
    is left out where no cell has two rows. Type 3 uses effect coding; empty
    cells are an error with it.
    """
    own = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).cast("double").alias("x")).na.drop()
    cells = own.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).limit(10_001).collect()
    if len(cells) > 10_000:
        raise ValueError("more than 10,000 cells: these are no factors")
    la, lb = sorted({r["a"] for r in cells}), sorted({r["b"] for r in cells})
    if len(la) < 2 or len(lb) < 2:
        raise ValueError("each factor needs two levels")
    n, m = np.array([float(r["n"]) for r in cells]), np.array([r["m"] for r in cells])
    within = float(sum((r["n"] - 1) * r["v"] for r in cells))

    def coded(levels: list, name: str) -> np.ndarray:
        """Effect coding: the last level is minus one everywhere."""
        at = np.array([levels.index(r[name]) for r in cells])
        out = np.eye(len(levels))[at][:, :-1]
        out[at == len(levels) - 1] = -1.0
        return out

    xa, xb, one = coded(la, "a"), coded(lb, "b"), np.ones((len(cells), 1))
    xab = np.concatenate([xa[:, [i]] * xb for i in range(xa.shape[1])], axis=1)
    both = n.max() > 1

    def rss(*parts: np.ndarray) -> float:
        x = np.concatenate((one, *parts), axis=1) * np.sqrt(n)[:, None]
        y = m * np.sqrt(n)
        return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))

    full = rss(xa, xb, xab) if both else rss(xa, xb)
    if kind == 3:
        if both and len(cells) < len(la) * len(lb):
            raise ValueError("type 3 needs rows in every cell")
        ss = {a: rss(xb, xab) - full, b: rss(xa, xab) - full} if both else {a: rss(xb) - full, b: rss(xa) - full}
    else:
        ss = {a: (rss() if kind == 1 else rss(xb)) - (rss(xa) if kind == 1 else rss(xa, xb)), b: rss(xa) - rss(xa, xb)}
    degrees = {a: len(la) - 1, b: len(lb) - 1}
    if both:
        ss[f"{a}:{b}"], degrees[f"{a}:{b}"] = rss(xa, xb) - full, len(cells) - len(la) - len(lb) + 1
    rest = int(n.sum()) - 1 - sum(degrees.values())
    error = within + full
    rows = []
    for term, value_ in ss.items():
        f = value_ / degrees[term] / (error / rest) if degrees[term] and rest and error else None
        rows.append((term, value_, degrees[term], f, f_sf(f, degrees[term], rest) if f is not None else None))
    rows += [("within", error, rest, None, None), ("total", rss() + within, int(n.sum()) - 1, None, None)]
    return df.sparkSession.createDataFrame(rows, "term string, ss double, df long, f double, p double")
