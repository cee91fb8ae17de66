"""Groups of vectors: scatter within and between classes from one aggregate by class."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import f_sf
from qualispark.operators.models import gram

#: Classes at most: each is a row on the driver.
MAX_CLASSES = 1000


def _scatter(df: DataFrame, columns: list[str], group: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their sizes and means, and the scatter within and between them, of complete rows."""
    p = len(columns)
    own = df.select(F.col(group).alias("g"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop()
    center = own.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(p))).first()
    if center["m0"] is None:
        raise ValueError("no complete rows")
    shift = np.array([center[f"m{i}"] for i in range(p)])
    x = [F.col(f"x{i}") - float(shift[i]) for i in range(p)]
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    rows = own.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(p)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in cells)).limit(MAX_CLASSES + 1).collect()
    if not 2 <= len(rows) <= MAX_CLASSES:
        raise ValueError(f"{group} needs 2 to {MAX_CLASSES} classes")
    rows = sorted(rows, key=lambda r: r["g"])
    n = np.array([r["n"] for r in rows], float)
    means = np.array([[r[f"s{i}"] for i in range(p)] for r in rows]) / n[:, None]
    total = np.array([[sum(r[f"q{min(i, j)}_{max(i, j)}"] for r in rows) for j in range(p)] for i in range(p)])
    between = (means * n[:, None]).T @ means  # about the grand mean, which is zero here
    return [r["g"] for r in rows], n, means + shift, total - between, between


def hotelling_test(df: DataFrame, columns: list[str], mu: list[float] | None = None) -> DataFrame:
    """n, t2, f, df1, df2, p: the mean vector against ``mu`` (zero if left out)."""
    n, means, s = gram(df, columns)
    p = len(columns)
    if n <= p:
        raise ValueError(f"{n} complete rows are too few for {p} columns")
    if np.linalg.matrix_rank(s) < p:
        raise ValueError("the covariance is singular: a column is constant or depends on others")
    gap = means - (np.zeros(p) if mu is None else np.array(mu, float))
    t2 = float(n * gap @ np.linalg.solve(s / (n - 1), gap))
    f = t2 * (n - p) / ((n - 1) * p)
    return df.sparkSession.createDataFrame([(int(n), t2, f, p, int(n - p), f_sf(f, p, n - p))], "n long, t2 double, f double, df1 int, df2 long, p double")


def manova(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """statistic, value, f, df1, df2, p of Wilks, Pillai, Hotelling-Lawley and Roy (an upper bound of f)."""
    names, n, _, within, between = _scatter(df, columns, group)
    p, q, v = len(columns), len(names) - 1, n.sum() - len(names)
    if v < p or np.linalg.matrix_rank(within) < p:
        raise ValueError("the scatter within classes is singular")
    roots = np.sort(np.clip(np.linalg.eigvals(np.linalg.solve(within, between)).real, 0, None))[::-1]
    s = min(p, q)
    m, k = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks, pillai, trace, roy = np.prod(1 / (1 + roots)), (roots / (1 + roots)).sum(), roots.sum(), roots[0]
    r, u = v - (p - q + 1) / 2, (p * q - 2) / 4
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d1, d2 = p * q, r * t - 2 * u
    y = wilks ** (1 / t)
    rows = [("wilks", wilks, (1 - y) / y * d2 / d1, d1, d2)]
    d1, d2 = s * (2 * m + s + 1), s * (2 * k + s + 1)
    rows.append(("pillai", pillai, pillai / (s - pillai) * d2 / d1, d1, d2))
    if k > 0:
        b = (p + 2 * k) * (q + 2 * k) / (2 * (2 * k + 1) * (k - 1)) if k != 1 else math.inf
        d1 = p * q
        d2 = 4 + (p * q + 2) / (b - 1)
        c = (d2 - 2) / (2 * k)
        rows.append(("hotelling_lawley", trace, d2 / d1 * trace / c, d1, d2))
    else:
        d1, d2 = s * (2 * m + s + 1), 2 * (s * k + 1)
        rows.append(("hotelling_lawley", trace, d2 / d1 / s * trace, d1, d2))
    d1 = max(p, q)
    d2 = v - d1 + q
    rows.append(("roy", roy, d2 / d1 * roy, d1, d2))
    out = [(name, float(x), float(f), float(a), float(b), float(f_sf(f, a, b))) for name, x, f, a, b in rows]
    return df.sparkSession.createDataFrame(out, "statistic string, value double, f double, df1 double, df2 double, p double")


def _axes(within: np.ndarray, between: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Roots and axes of the generalised problem, axes of unit length within, the largest entry positive."""
    low = np.linalg.cholesky(within)
    half = np.linalg.inv(low)
    roots, vectors = np.linalg.eigh(half @ between @ half.T)
    order = np.argsort(-roots)[:count]
    axes = half.T @ vectors[:, order]
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return np.clip(roots[order], 0, None), axes * flip


def discriminant_axes(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """axis (from 1), eigenvalue, share, column, weight: Fisher's axes, scaled to unit scatter within classes."""
    names, _, _, within, between = _scatter(df, columns, group)
    if np.linalg.matrix_rank(within) < len(columns):
        raise ValueError("the scatter within classes is singular")
    roots, axes = _axes(within, between, min(len(names) - 1, len(columns)))
    whole = roots.sum() or 1.0
    rows = [(a + 1, float(roots[a]), float(roots[a] / whole), c, float(axes[i, a])) for a in range(len(roots)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, share double, column string, weight double")


def discriminant(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """actual, predicted, n, accuracy: every complete row at the class whose mean is nearest along Fisher's axes.

    The distance is a linear score for each class, so rows are classified in
    one projection; of equal scores the first class in order counts.
    """
    names, n, means, within, between = _scatter(df, columns, group)
    if np.linalg.matrix_rank(within) < len(columns):
        raise ValueError("the scatter within classes is singular")
    _, axes = _axes(within, between, min(len(names) - 1, len(columns)))
    origin = (means * n[:, None]).sum(0) / n.sum()
    at = (means - origin) @ axes
    own = df.select(F.col(group).alias("actual"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop()
    place = [sum((float(axes[i, a]) * (F.col(f"x{i}") - float(origin[i])) for i in range(len(columns))), F.lit(0.0)) for a in range(axes.shape[1])]
    # unit scatter within classes makes places shrink as the rows grow in number: scores are rounded in their own unit
    unit = float(np.abs(at).max() / math.sqrt(n.sum())) or 1.0
    scores = [F.round(sum((float(at[g, a] / unit) * place[a] for a in range(axes.shape[1])), F.lit(0.0)) - float((at[g] ** 2).sum() / 2 / unit), 12) for g in range(len(names))]
    best = F.array_position(F.array(*scores), F.greatest(*scores)).cast("int")
    told = own.select("actual", F.element_at(F.array(*(F.lit(x) for x in names)), best).alias("predicted"))
    table = told.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    right = table.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return table.join(F.broadcast(right))
