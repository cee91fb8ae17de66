"""Which distribution fits a column: likelihood fits of several at once and Anderson-Darling's distance.

The values are counted with their ranks first. A Newton step of all fits that
need steps is one aggregate over those counts; the distance of every fit is one
pass more. Positive families start at zero: two parameters each, no threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import gamma_inc_upper
from qualispark.operators.orderstats import ranked
from qualispark.operators.posthoc import _phi

FAMILIES = ("normal", "lognormal", "exponential", "weibull", "gamma", "logistic", "log_logistic", "gumbel_l", "gumbel_r")
POSITIVE = ("lognormal", "weibull", "gamma", "log_logistic")
_KNOTS = 4096


def digamma(x: float) -> tuple[float, float]:
    """The logarithmic derivative of the gamma function, and its own derivative."""
    a = b = 0.0
    while x < 10:
        a, b, x = a - 1 / x, b + 1 / x**2, x + 1
    y = 1 / x**2
    return (
        a + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))),
        b + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30))),
    )


def gamma_shape(gap: float) -> float:
    """Shape whose log mean exceeds its mean log by ``gap``."""
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(60):
        d, t = digamma(k)
        step = (math.log(k) - d - gap) / (1 / k - t)
        k = k - step if step < k else k / 2
        if abs(step) < 1e-12 * k:
            break
    return k


def _gumbel_sums(name: str, z: Column, low: float, beta: float) -> list[Column]:
    w = F.col("__c") * F.exp(-(z - low) / beta)
    return [F.sum(w).alias(f"{name}0"), F.sum(w * z).alias(f"{name}1"), F.sum(w * z * z).alias(f"{name}2")]


def _logistic_sums(name: str, z: Column, m: float, s: float) -> list[Column]:
    u, c = (z - m) / s, F.col("__c")
    t = F.tanh(u / 2)
    v = 1 - t * t
    made = {"m": t, "s": u * t - 1, "mm": v / 2, "ms": t + u * v / 2, "ss": 2 * u * t - 1 + u * u * v / 2}
    return [F.sum(c * x).alias(f"{name}_{k}") for k, x in made.items()]


def _steps(rows: DataFrame, n: int, series: dict[str, tuple[str, Column, float]]) -> dict[str, tuple[float, float]]:
    """Location and scale of each series (kind, standardised column, its least value), all in the same passes."""
    at = {k: (0.0, 0.78 if kind == "gumbel" else 0.55) for k, (kind, _, _) in series.items()}
    for _ in range(60):
        sums = []
        for k, (kind, z, low) in series.items():
            sums += _gumbel_sums(k, z, low, at[k][1]) if kind == "gumbel" else _logistic_sums(k, z, *at[k])
        row, moved = rows.agg(*sums).first(), 0.0
        for k, (kind, _, low) in series.items():
            m, s = at[k]
            if kind == "gumbel":
                first, second = row[f"{k}1"] / row[f"{k}0"], row[f"{k}2"] / row[f"{k}0"]
                new = s - (s + first) / (1 + (second - first**2) / s**2)
                new = new if new > 0 else s / 2
                at[k] = (low - new * math.log(row[f"{k}0"] / n), new)
            else:
                g = np.array([row[f"{k}_m"], row[f"{k}_s"]]) * s
                h = np.array([[row[f"{k}_mm"], row[f"{k}_ms"]], [row[f"{k}_ms"], row[f"{k}_ss"]]])
                step = np.linalg.solve(h, g)
                while s + step[1] <= 0:
                    step = step / 2
                at[k] = (m + step[0], s + step[1])
                new = at[k][1]
            moved = max(moved, abs(new - s), abs(at[k][0] - m) if kind != "gumbel" else 0.0)
        if moved < 1e-11:
            break
    return at


def _gamma_table(k: float, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knots of log x with the distribution and its slope there."""
    low = math.log(scale) + (math.log(1e-14) + math.lgamma(k + 1)) / k
    y = np.linspace(low, math.log(scale * (k + 12 * math.sqrt(k) + 60)), _KNOTS)
    x = np.exp(y) / scale
    f = np.array([1 - gamma_inc_upper(k, v) for v in x])
    return y, f, np.exp(k * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(k))


def _hermite(v: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    y, f, slope = table
    h = y[1] - y[0]
    at = np.clip((v - y[0]) / h, 0, len(y) - 1.000001)
    i = np.floor(at).astype(int)
    t = at - i
    return f[i] + t * t * (3 - 2 * t) * (f[i + 1] - f[i]) + h * t * (1 - t) * ((1 - t) * slope[i] - t * slope[i + 1])


def distribution(family: str, a: float, b: float | None) -> Callable[[np.ndarray], np.ndarray]:
    """The distribution function of a fit."""
    logistic = lambda u: 1 / (1 + np.exp(-np.clip(u, -700, 700)))
    if family == "gamma":
        table = _gamma_table(a, b)
        return lambda x: _hermite(np.log(x), table)
    return {
        "normal": lambda x: _phi((x - a) / b),
        "lognormal": lambda x: _phi((np.log(x) - a) / b),
        "exponential": lambda x: -np.expm1(-x / a),
        "weibull": lambda x: -np.expm1(-((x / b) ** a)),
        "logistic": lambda x: logistic((x - a) / b),
        "log_logistic": lambda x: logistic((np.log(x) - math.log(b)) * a),
        "gumbel_r": lambda x: np.exp(-np.exp(np.clip(-(x - a) / b, None, 700))),
        "gumbel_l": lambda x: -np.expm1(-np.exp(np.clip((x - a) / b, None, 700))),
    }[family]


def distribution_id(df: DataFrame, value: str, families: list[str] | None = None) -> DataFrame:
    """rank, family, a, b, log_likelihood, aic, ad, n: fits by rising Anderson-Darling distance (ties by aic).

    a, b: mean and deviation (normal; of logs: lognormal), scale (exponential),
    shape and scale (weibull, gamma, log_logistic), location and scale (others).
    Families of positive values are left out where a value is not positive,
    exponential where one is negative. Fewer than eight values, or all values
    equal, are an error.
    """
    wanted = list(families or FAMILIES)
    if unknown := set(wanted) - set(FAMILIES):
        raise ValueError(f"no such family: {', '.join(sorted(unknown))}")
    rows = ranked(df, value).persist()
    try:
        c, v = F.col("__c"), F.col("__v")
        s = rows.agg(F.sum(c).alias("n"), (F.sum(c * v) / F.sum(c)).alias("m"), F.min(v).alias("low"), F.max(v).alias("high")).first()
        n = s["n"] or 0
        if n < 8 or s["low"] == s["high"]:
            raise ValueError(f"{n} values with a spread are too few")
        mean, low, high = s["m"], s["low"], s["high"]
        positive = low > 0
        log = F.log(v)
        more = rows.agg(F.sum(c * (v - mean) * (v - mean)).alias("ss"), *([F.sum(c * log).alias("l"), F.min(log).alias("ll"), F.max(log).alias("lh")] if positive else [])).first()
        sd = math.sqrt(more["ss"] / n)
        lm = more["l"] / n if positive else 0.0
        lsd = math.sqrt(rows.agg(F.sum(c * (log - lm) * (log - lm)).alias("q")).first()["q"] / n) if positive else 1.0
        z, lz = (v - mean) / sd, (log - lm) / lsd
        series = {"gumbel_r": ("gumbel", z, (low - mean) / sd), "gumbel_l": ("gumbel", -z, (mean - high) / sd), "logistic": ("logistic", z, 0.0)}
        if positive:
            series |= {"weibull": ("gumbel", -lz, (lm - more["lh"]) / lsd), "log_logistic": ("logistic", lz, 0.0)}
        at = _steps(rows, n, {k: x for k, x in series.items() if k in wanted}) if set(series) & set(wanted) else {}
        fits: dict[str, tuple[float, float | None]] = {"normal": (mean, sd)}
        if low >= 0:
            fits["exponential"] = (mean, None)
        for k, (m, w) in at.items():
            if k == "weibull":
                fits[k] = (1 / (w * lsd), math.exp(lm - m * lsd))
            elif k == "log_logistic":
                fits[k] = (1 / (w * lsd), math.exp(lm + m * lsd))
            else:
                fits[k] = ((mean - m * sd) if k == "gumbel_l" else mean + m * sd, w * sd)
        if positive:
            fits["lognormal"] = (lm, lsd)
            shape = gamma_shape(math.log(mean) - lm)
            fits["gamma"] = (shape, mean / shape)
        fits = {k: fits[k] for k in FAMILIES if k in fits and k in wanted}
        density = {}
        for k, (a, b) in fits.items():
            u = (v - a) / b if b else v / a
            density[k] = {
                "normal": lambda u=u, b=b: -0.5 * u * u - math.log(b) - 0.5 * math.log(2 * math.pi),
                "lognormal": lambda a=a, b=b: -0.5 * F.pow((log - a) / b, 2) - math.log(b) - 0.5 * math.log(2 * math.pi) - log,
                "exponential": lambda u=u, a=a: -u - math.log(a),
                "weibull": lambda a=a, b=b: math.log(a / b) + (a - 1) * (log - math.log(b)) - F.exp(a * (log - math.log(b))),
                "gamma": lambda a=a, b=b: (a - 1) * log - v / b - a * math.log(b) - math.lgamma(a),
                "logistic": lambda u=u, b=b: -F.abs(u) - math.log(b) - 2 * F.log1p(F.exp(-F.abs(u))),
                "log_logistic": lambda a=a, b=b: math.log(a) - log - F.abs(a * (log - math.log(b))) - 2 * F.log1p(F.exp(-F.abs(a * (log - math.log(b))))),
                "gumbel_r": lambda u=u, b=b: -u - F.exp(-u) - math.log(b),
                "gumbel_l": lambda u=u, b=b: u - F.exp(u) - math.log(b),
            }[k]()
        like = rows.agg(*(F.sum(c * d).alias(k) for k, d in density.items())).first()

        def distance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = {k: distribution(k, *ab) for k, ab in fits.items()}
            sums = dict.fromkeys(known, 0.0)
            for g in batches:
                x, k, lo = g["__v"].to_numpy(), g["__c"].to_numpy(float), g["__lo"].to_numpy(float)
                for name, f in known.items():
                    p = np.clip(f(x), 1e-12, 1 - 1e-12)
                    sums[name] += float((k * ((2 * lo + k) * np.log(p) + (2 * n - 2 * lo - k) * np.log1p(-p))).sum())
            yield pd.DataFrame({"family": list(sums), "s": list(sums.values())})

        found = {r["family"]: -n - r["s"] / n for r in rows.select("__v", "__c", "__lo").mapInPandas(distance, "family string, s double").groupBy("family").agg(F.sum("s").alias("s")).collect()}
    finally:
        rows.unpersist()
    out = []
    for k, (a, b) in fits.items():
        free = 1 if b is None else 2
        out.append((k, float(a), None if b is None else float(b), float(like[k]), float(2 * free - 2 * like[k]), float(found[k]), int(n)))
    out.sort(key=lambda r: (r[5], r[4]))
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(out)], "rank int, family string, a double, b double, log_likelihood double, aic double, ad double, n long")
