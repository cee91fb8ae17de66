"""Fits whose steps are one aggregate each: conditional quantiles, ordered classes, normal mixtures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import norm_ppf, normal_two_sided, t_ppf, t_sf
from qualispark.operators.models import gram
from qualispark.operators.orderstats import quantiles

#: Classes at most of an ordered response.
MAX_CLASSES = 100


def _counted(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Distinct complete rows with their number: a step then reads each once."""
    own = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).na.drop()
    return own.groupBy(*names).agg(F.count("*").cast("double").alias("c"))


def _full(row, prefix: str, k: int) -> np.ndarray:
    return np.array([[row[f"{prefix}{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def quantile_regression(df: DataFrame, response: str, predictors: list[str], q: float = 0.5, level: float = 0.95) -> DataFrame:
    """A row per term: coef, se, t, p, low, high; pseudo_r1, n on each.

    Newton's method on the check loss with its corner rounded by a logistic
    curve, whose width falls by steps to a millionth of the spread. Errors are
    the robust ones with Epanechnikov's kernel and the bandwidth of Hall and
    Sheather. Dependent predictors or too few rows are an error.
    """
    if not 0 < q < 1:
        raise ValueError("q is between 0 and 1")
    k = len(predictors) + 1
    names = [*(f"x{i}" for i in range(1, k)), "y"]
    own = _counted(df, [*predictors, response], names).persist()
    try:
        n, means, s = gram(df, [*predictors, response])
        if n <= k:
            raise ValueError(f"{n} complete rows are too few")
        x = [F.lit(1.0), *(F.col(f"x{i}") - float(means[i - 1]) for i in range(1, k))]
        y = F.col("y") - float(means[-1])
        b = np.concatenate(([0.0], np.linalg.solve(s[:-1, :-1], s[:-1, -1])))
        spread = math.sqrt(s[-1, -1] / n) or 1.0
        cells = [(i, j) for i in range(k) for j in range(i, k)]

        def residual(b: np.ndarray) -> Column:
            return y - sum((float(b[i]) * x[i] for i in range(k)), F.lit(0.0))

        def step(b: np.ndarray, h: float):
            e = residual(b)
            z = e / h
            p = 1 / (1 + F.exp(F.least(z, F.lit(500.0))))  # share of the lower side
            soft = q * e + h * F.when(z > 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)
            row = own.agg(
                F.sum(F.col("c") * soft).alias("loss"),
                *(F.sum(F.col("c") * (q - p) * x[i]).alias(f"g{i}") for i in range(k)),
                *(F.sum(F.col("c") * p * (1 - p) / h * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in cells),
            ).first()
            return row["loss"], np.array([row[f"g{i}"] for i in range(k)]), _full(row, "h", k)

        h = spread / 4
        while h > spread * 1e-6:
            loss, g, hess = step(b, h)
            for _ in range(12):
                ridge = 1e-12 * np.trace(hess) / k + 1e-300
                move = np.linalg.solve(hess + ridge * np.eye(k), g)
                now = step(b + move, h)
                while not now[0] <= loss and np.abs(move).max() > 1e-13 * spread:
                    move = move / 4
                    now = step(b + move, h)
                done = loss - now[0] <= 1e-10 * abs(loss)
                if now[0] <= loss:
                    b, (loss, g, hess) = b + move, now
                if done:
                    break
            h /= 4
        e = residual(b)
        bandwidth = n ** (-1 / 3) * norm_ppf(0.975) ** (2 / 3) * ((1.5 * _density(norm_ppf(q)) ** 2) / (2 * norm_ppf(q) ** 2 + 1)) ** (1 / 3)
        spread_rows = df.select(*(F.col(c).cast("double").alias(m) for c, m in zip([*predictors, response], names, strict=True))).na.drop()
        quart = quantiles(spread_rows.select(e.alias("e")), "e", {"a": 0.25, "b": 0.75}).first()
        sd = math.sqrt(s[-1, -1] / n)
        width = min(sd, (quart["b"] - quart["a"]) / 1.34) * (norm_ppf(min(q + bandwidth, 1 - 1e-9)) - norm_ppf(max(q - bandwidth, 1e-9)))
        u = e / width if width > 0 else F.lit(2.0)
        at = quantiles(spread_rows.select(F.col("y")), "y", {"m": q}).first()["m"] - float(means[-1])

        def check(v: Column) -> Column:
            return F.sum(F.col("c") * v * (q - F.when(v < 0, 1.0).otherwise(0.0)))

        row = own.agg(
            F.sum(F.when(F.abs(u) <= 1, F.col("c") * 0.75 * (1 - u * u)).otherwise(0.0)).alias("f"), check(e).alias("v"), check(y - F.lit(at)).alias("v0"),
            *(F.sum(F.col("c") * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in cells),
            *(F.sum(F.col("c") * F.when(e > 0, q * q).otherwise((1 - q) ** 2) * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in cells),
        ).first()
    finally:
        own.unpersist()
    f = row["f"] / (n * width) if width > 0 else math.nan
    inverse = np.linalg.inv(_full(row, "a", k))
    cov = inverse @ (_full(row, "m", k) / f**2 if f else np.full((k, k), math.nan)) @ inverse
    back = np.eye(k)
    back[0, 1:] = -means[:-1]
    b, cov = back @ b, back @ cov @ back.T
    b[0] += means[-1]
    se = np.sqrt(np.diag(cov))
    half, r1 = t_ppf(0.5 + level / 2, n - k), 1 - row["v"] / row["v0"] if row["v0"] else None
    rows = []
    for name, c, e_ in zip(["intercept", *predictors], b, se, strict=True):
        known = bool(e_ > 0)
        rows.append((name, float(c), float(e_) if known else None, float(c / e_) if known else None, float(t_sf(c / e_, n - k)) if known else None, float(c - half * e_) if known else None, float(c + half * e_) if known else None, r1, int(n)))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double, low double, high double, pseudo_r1 double, n long")


def _density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def ordinal_logit(df: DataFrame, response: str, predictors: list[str], steps: int = 50) -> DataFrame:
    """A row per term: coef, se, z, p; thresholds are terms too (``class<=v``); log_likelihood, aic, n on each.

    Classes are the sorted values of the response, ``MAX_CLASSES`` at most:
    P(class <= k) = logistic(threshold k - predictors * coef). A step is one
    aggregate by class. Fewer than two classes are an error.
    """
    classes = [r[0] for r in df.select(response).na.drop().distinct().orderBy(response).limit(MAX_CLASSES + 1).collect()]
    if not 2 <= len(classes) <= MAX_CLASSES:
        raise ValueError(f"{response} needs 2 to {MAX_CLASSES} classes")
    p, m = len(predictors), len(classes) - 1
    at = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(response)).cast("double")
    own = _counted(df.withColumn("__k", at), ["__k", *predictors], ["k", *(f"x{j}" for j in range(p))])
    center = own.agg(*(F.avg(f"x{j}").alias(f"m{j}") for j in range(p)), *(F.stddev_pop(f"x{j}").alias(f"s{j}") for j in range(p)), F.sum("c").alias("n")).first()
    shift = np.array([center[f"m{j}"] for j in range(p)])
    scale = np.array([center[f"s{j}"] or 1.0 for j in range(p)])
    n = center["n"]
    x = [(F.col(f"x{j}") - float(shift[j])) / float(scale[j]) for j in range(p)]
    counts = {int(r["k"]): r["n"] for r in own.groupBy("k").agg(F.sum("c").alias("n")).collect()}
    share = np.cumsum([counts.get(i + 1, 0.0) for i in range(m)]) / n
    theta = np.concatenate((np.log(share / (1 - share)), np.zeros(p)))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def step(theta: np.ndarray):
        """Log-likelihood, gradient, negated Hessian."""
        eta = sum((float(theta[m + j]) * x[j] for j in range(p)), F.lit(0.0))
        cut = F.array(F.lit(-1e9), *(F.lit(float(t)) for t in theta[:m]), F.lit(1e9))
        k = F.col("k").cast("int")
        side = lambda a: 1 / (1 + F.exp(-F.greatest(F.least(a - eta, F.lit(500.0)), F.lit(-500.0))))
        rows = own.select("k", "c", *(x[j].alias(f"z{j}") for j in range(p)), side(F.element_at(cut, k + 1)).alias("u"), side(F.element_at(cut, k)).alias("l"))
        rows = rows.withColumns({"fu": F.col("u") * (1 - F.col("u")), "fl": F.col("l") * (1 - F.col("l"))})
        c, fu, fl = F.col("c"), F.col("fu"), F.col("fl")
        prob = F.greatest(F.col("u") - F.col("l"), F.lit(1e-300))
        du, dl = fu * (1 - 2 * F.col("u")), fl * (1 - 2 * F.col("l"))
        gap = fu - fl
        made = {
            "like": c * F.log(prob), "gu": c * fu / prob, "gl": -c * fl / prob,
            "huu": c * (du / prob - (fu / prob) ** 2), "hll": c * (-dl / prob - (fl / prob) ** 2), "hul": c * fu * fl / prob**2,
        }
        he = c * ((du - dl) / prob - (gap / prob) ** 2)
        hue, hle = c * (-du / prob + fu * gap / prob**2), c * (dl / prob - fl * gap / prob**2)
        z = [F.col(f"z{j}") for j in range(p)]
        aggs = [F.sum(v).alias(name) for name, v in made.items()]
        aggs += [F.sum(-c * gap / prob * z[j]).alias(f"g{j}") for j in range(p)]
        aggs += [F.sum(hue * z[j]).alias(f"hu{j}") for j in range(p)] + [F.sum(hle * z[j]).alias(f"hl{j}") for j in range(p)]
        aggs += [F.sum(he * z[i] * z[j]).alias(f"h{i}_{j}") for i, j in pairs]
        like, g, h = 0.0, np.zeros(m + p), np.zeros((m + p, m + p))
        for r in rows.groupBy("k").agg(*aggs).collect():  # a row a class
            i = int(r["k"]) - 1  # upper threshold i, lower i - 1
            like += r["like"]
            for j in range(p):
                g[m + j] += r[f"g{j}"]
            for a, b in pairs:
                h[m + a, m + b] += r[f"h{a}_{b}"]
                h[m + b, m + a] = h[m + a, m + b]
            for t, gt, ht, hj in ((i, "gu", "huu", "hu"), (i - 1, "gl", "hll", "hl")):
                if 0 <= t < m:
                    g[t] += r[gt]
                    h[t, t] += r[ht]
                    for j in range(p):
                        h[t, m + j] += r[f"{hj}{j}"]
                        h[m + j, t] = h[t, m + j]
            if 1 <= i < m:
                h[i, i - 1] += r["hul"]
                h[i - 1, i] = h[i, i - 1]
        return like, g, -h

    like, g, h = step(theta)
    for _ in range(steps):
        move = np.linalg.solve(h, g)
        while True:
            new = theta + move
            if (np.diff(new[:m]) > 0).all():
                now = step(new)
                if now[0] >= like - 1e-9 * abs(like):
                    break
            move = move / 2
            if np.abs(move).max() < 1e-14:
                now, new = (like, g, h), theta
                break
        theta, (like, g, h) = new, now
        if np.abs(move).max() < 1e-9:
            break
    cov = np.linalg.inv(h)
    back = np.eye(m + p)
    back[range(m, m + p), range(m, m + p)] = 1 / scale
    back[:m, m:] = shift / scale  # thresholds move by what the centres explained
    theta, cov = back @ theta, back @ cov @ back.T
    se = np.sqrt(np.diag(cov))
    names = [*predictors, *(f"{response}<={c}" for c in classes[:-1])]
    order = [*range(m, m + p), *range(m)]
    rows = [(name, float(theta[i]), float(se[i]), float(theta[i] / se[i]), normal_two_sided(theta[i] / se[i]), float(like), float(2 * (m + p) - 2 * like), int(n)) for name, i in zip(names, order, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, log_likelihood double, aic double, n long")


def mixture(df: DataFrame, value: str, components: int = 2, steps: int = 300, tolerance: float = 1e-8) -> DataFrame:
    """component (by mean), mean, sd, weight; log_likelihood, aic, bic, steps, n on each, by expectation and maximisation.

    Means start at equally spaced quantiles, with the common deviation. A step
    is one aggregate over the distinct values. A deviation stays above a
    millionth of the common one. Fewer than ten values a component are an error.
    """
    own = _counted(df.filter(~F.isnan(F.col(value).cast("double"))), [value], ["x"])
    s = own.agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("m")).first()
    n, k = s["n"] or 0, components
    if n < 10 * k:
        raise ValueError(f"{k} components need {10 * k} values")
    sd0 = math.sqrt(own.agg(F.sum(F.col("c") * (F.col("x") - s["m"]) ** 2).alias("v")).first()["v"] / (n - 1))
    if not sd0:
        raise ValueError("all values are equal")
    start = quantiles(df, value, {f"q{j}": (j + 0.5) / k for j in range(k)}).first()
    mu, sd, w = np.array([start[f"q{j}"] for j in range(k)]), np.full(k, sd0), np.full(k, 1 / k)
    before, done = -math.inf, 0
    for done in range(1, steps + 1):
        parts = [F.lit(float(w[j] / (sd[j] * math.sqrt(2 * math.pi)))) * F.exp(-0.5 * ((F.col("x") - float(mu[j])) / float(sd[j])) ** 2) for j in range(k)]
        rows = own.select("x", "c", *(F.greatest(v, F.lit(1e-300)).alias(f"d{j}") for j, v in enumerate(parts)))
        total = sum((F.col(f"d{j}") for j in range(k)), F.lit(0.0))
        made = [F.sum(F.col("c") * F.log(total)).alias("like")]
        for j in range(k):
            r = F.col("c") * F.col(f"d{j}") / total
            z = F.col("x") - float(mu[j])
            made += [F.sum(r).alias(f"n{j}"), F.sum(r * z).alias(f"s{j}"), F.sum(r * z * z).alias(f"q{j}")]
        row = rows.agg(*made).first()
        like = row["like"]
        size = np.array([row[f"n{j}"] for j in range(k)])
        move = np.array([row[f"s{j}"] for j in range(k)]) / size
        if abs(like - before) < tolerance * max(1.0, abs(like)):
            break
        before = like
        sd = np.maximum(np.sqrt(np.maximum(np.array([row[f"q{j}"] for j in range(k)]) / size - move**2, 0.0)), 1e-6 * sd0)
        mu, w = mu + move, size / n
    free = 3 * k - 1
    out = sorted(zip(mu.tolist(), sd.tolist(), w.tolist(), strict=True))
    rows = [(j + 1, *c, float(like), float(2 * free - 2 * like), float(free * math.log(n) - 2 * like), done, int(n)) for j, c in enumerate(out)]
    return df.sparkSession.createDataFrame(rows, "component int, mean double, sd double, weight double, log_likelihood double, aic double, bic double, steps int, n long")
