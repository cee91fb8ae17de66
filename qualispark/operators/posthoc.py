"""Comparisons of groups after a test, from one row a group.

Pairs are of groups, whose number a comparison of groups keeps small; the data
are read once into counts, means and variances (or rank sums).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.functions.special import norm_cdf, normal_two_sided, t_ppf, t_sf, tail
from qualispark.operators.hypothesis import _clean, _stats, average_ranks

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


#: Groups at most in a comparison of all pairs.
MAX_GROUPS = 1000
#: The normal distribution at steps of 1 / 512 from -40 to 40, for cubic interpolation.
_STEP = 512
_TABLE = np.array([norm_cdf(i / _STEP) for i in range(-40 * _STEP, 40 * _STEP + 1)])


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution by Hermite's cubic on the table (error below 1e-13)."""
    at = np.clip(x, -39.9, 39.9) * _STEP + 40 * _STEP
    i = np.floor(at).astype(int)
    t = at - i
    slope = [np.exp(-0.5 * ((i + k - 40 * _STEP) / _STEP) ** 2) / np.sqrt(2 * np.pi) / _STEP for k in (0, 1)]
    a, b = _TABLE[i], _TABLE[i + 1]
    return a + t * t * (3 - 2 * t) * (b - a) + t * (1 - t) * ((1 - t) * slope[0] - t * slope[1])


_Z = np.concatenate([(a + b) / 2 + (b - a) / 2 * _NODES for a, b in zip(range(-8, 8, 2), range(-6, 10, 2), strict=True)])
_W = np.tile(_WEIGHTS, 8) * np.exp(-_Z * _Z / 2) / np.sqrt(2 * np.pi)
_PZ = _phi(_Z)


def range_cdf(q: float, k: int) -> float:
    """Chance that the range of k standard normals is below q."""
    return float(k * np.sum(_W * (_PZ - _phi(_Z - q)) ** (k - 1)))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range: the normal range over the chi distribution of the scale."""
    if q <= 0:
        return 1.0
    if df > 25_000:
        return 1 - range_cdf(q, k)
    from math import lgamma, log

    wide = 8 / np.sqrt(2 * df)
    low, high = max(1e-9, 1 - wide), 1 + wide
    if df < 40:
        low, high = 1e-9, 1 + 12 / np.sqrt(df)
    s = (low + high) / 2 + (high - low) / 2 * _NODES
    log_f = log(2) + df / 2 * log(df / 2) - lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(max(0.0, 1 - np.sum(_WEIGHTS * (high - low) / 2 * np.exp(log_f) * ((k * _W * (_PZ - _phi(_Z - q * s[:, None])) ** (k - 1)).sum(axis=1)))))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    low, high = 0.0, 8.0
    while 1 - studentized_range_sf(high, k, df) < p and high < 1e6:
        low, high = high, 2 * high
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - studentized_range_sf(mid, k, df) < p else (low, mid)
    return (low + high) / 2


def _pairs(g: DataFrame) -> DataFrame:
    """All pairs of groups; more than ``MAX_GROUPS`` are an error."""
    if g.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: no comparison of all pairs")
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, F.col("a.g") < F.col("b.g"))


def _pooled(df: DataFrame, value: str, group: str) -> DataFrame:
    """g1, g2, diff, se, t, df, k of all pairs, with the pooled error."""
    g = _stats(df, value, group)
    pool = g.agg(over(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1)).alias("mse"), F.sum(F.col("n") - 1).alias("df"), F.count("*").alias("k"))
    se = F.sqrt(F.col("mse") * (over(1, F.col("a.n")) + over(1, F.col("b.n"))))
    diff = F.col("a.m") - F.col("b.m")
    pairs = _pairs(g).join(F.broadcast(pool))
    return pairs.select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), diff.alias("diff"), se.alias("se"), over(diff, se).alias("t"), "df", "k")


def fisher_lsd(df: DataFrame, value: str, group: str) -> DataFrame:
    """All pairs with the least significant difference: p of t, no correction."""
    return _pooled(df, value, group).drop("k").withColumn("p", tail(t_sf, "t", "df"))


def _range_columns(out: DataFrame, level: float) -> DataFrame:
    root = F.sqrt(F.lit(2.0))
    made = out.withColumn("p", tail(studentized_range_sf, F.abs("t") * root, "k", "df"))
    # one quantile for each number of groups and degrees of freedom, not for each pair
    points = made.select(F.col("k").alias("__k"), F.col("df").alias("__df")).distinct()
    points = points.withColumn("__q", tail(lambda k, d: studentized_range_ppf(level, int(k), d), "__k", "__df"))
    made = made.join(F.broadcast(points), (F.col("k") == F.col("__k")) & (F.col("df") == F.col("__df")), "left")
    half = F.col("__q") / root * F.col("se")
    return made.withColumns({"low": F.col("diff") - half, "high": F.col("diff") + half}).drop("k", "__k", "__df", "__q")


def tukey_hsd(df: DataFrame, value: str, group: str, level: float = 0.95) -> DataFrame:
    """All pairs with p and interval of the studentized range."""
    return _range_columns(_pooled(df, value, group), level)


def games_howell(df: DataFrame, value: str, group: str, level: float = 0.95) -> DataFrame:
    """All pairs with Welch's error and degrees of freedom, p and interval of the studentized range."""
    g = _stats(df, value, group)
    count = g.agg(F.count("*").alias("k"))
    va, vb = over(F.col("a.v"), F.col("a.n")), over(F.col("b.v"), F.col("b.n"))
    dof = over(F.pow(va + vb, 2), over(va * va, F.col("a.n") - 1) + over(vb * vb, F.col("b.n") - 1))
    diff, se = F.col("a.m") - F.col("b.m"), F.sqrt(va + vb)
    out = _pairs(g).join(F.broadcast(count))
    out = out.select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), diff.alias("diff"), se.alias("se"), over(diff, se).alias("t"), dof.alias("df"), "k")
    return _range_columns(out, level)


def dunnett(df: DataFrame, value: str, group: str, control) -> DataFrame:
    """Each group against the control; p of t times the number of comparisons (Bonferroni's bound)."""
    out = _pooled(df, value, group).filter((F.col("g1") == F.lit(control)) | (F.col("g2") == F.lit(control)))
    flip = F.when(F.col("g2") == F.lit(control), 1).otherwise(-1)
    out = out.select(
        F.when(flip == 1, F.col("g1")).otherwise(F.col("g2")).alias("g"), (F.col("diff") * flip).alias("diff"), "se", (F.col("t") * flip).alias("t"), "df", "k"
    )
    return out.withColumn("p", F.least(F.lit(1.0), tail(t_sf, "t", "df") * (F.col("k") - 1))).drop("k")


def dunn(df: DataFrame, value: str, group: str, adjust: str = "holm") -> DataFrame:
    """All pairs by mean ranks with the tie-corrected error; p adjusted by Holm or Bonferroni."""
    r = average_ranks(_clean(df, value, group), "x")
    g = r.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("rank").alias("m"), F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("t"))
    total = g.agg(F.sum("n").alias("all"), F.sum("t").alias("ties"))
    n = F.col("all")
    variance = n * (n + 1) / 12 - over(F.col("ties"), 12 * (n - 1))
    se = F.sqrt(variance * (over(1, F.col("a.n")) + over(1, F.col("b.n"))))
    diff = F.col("a.m") - F.col("b.m")
    out = _pairs(g).join(F.broadcast(total)).select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), diff.alias("diff"), se.alias("se"), over(diff, se).alias("z"))
    out = out.withColumn("p", tail(normal_two_sided, "z"))
    every, upto = Window.partitionBy(), Window.orderBy("p", "g1", "g2")  # pairs of groups alone
    m = F.count("*").over(every)
    if adjust == "bonferroni":
        return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * m))
    step = out.withColumn("__step", F.col("p") * (m - F.row_number().over(upto) + 1))
    return step.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("__step").over(upto.rowsBetween(Window.unboundedPreceding, 0)))).drop("__step")


def hsu_mcb(df: DataFrame, value: str, group: str, level: float = 0.95, largest: bool = True) -> DataFrame:
    """Each group against the best of the others, with an interval kept on its side of zero (Bonferroni's t)."""
    sign = 1 if largest else -1
    g = _stats(df, value, group)
    pool = g.agg(over(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1)).alias("mse"), F.sum(F.col("n") - 1).alias("df"), F.count("*").alias("k"))
    a, b = g.alias("a"), g.alias("b")
    best = a.join(b, F.col("a.g") != F.col("b.g")).groupBy(F.col("a.g").alias("g"), F.col("a.n").alias("n"), F.col("a.m").alias("m")).agg(
        F.max(F.struct((F.col("b.m") * sign).alias("m"), F.col("b.n").alias("n"))).alias("best")
    )
    diff = (F.col("m") - F.col("best.m") * sign).alias("diff")
    out = best.join(F.broadcast(pool)).select("g", "n", "m", diff, F.sqrt(F.col("mse") * (over(1, F.col("n")) + over(1, F.col("best.n")))).alias("se"), "df", "k")
    half = tail(lambda k, d: t_ppf(1 - over(1 - level, k - 1), d), "k", "df") * F.col("se")
    return out.withColumns({"low": F.least(F.lit(0.0), F.col("diff") - half), "high": F.greatest(F.lit(0.0), F.col("diff") + half)}).drop("k")


def anom(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Group means against limits about the grand mean (Bonferroni's t)."""
    g = _stats(df, value, group)
    s = g.agg(
        over(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1)).alias("mse"), F.sum(F.col("n") - 1).alias("df"),
        over(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"), F.count("*").alias("k"),
    )
    h = tail(lambda k, d: t_ppf(1 - over(alpha, 2 * k), d), "k", "df")
    half = h * F.sqrt(over(F.col("mse") * (F.col("k") - 1), F.col("k") * F.col("n")))
    out = g.join(F.broadcast(s)).withColumn("half", half)
    limits = {"low": F.col("grand") - F.col("half"), "high": F.col("grand") + F.col("half")}
    return out.withColumns(limits).select("g", "n", "m", "grand", "low", "high", ((F.col("m") < F.col("low")) | (F.col("m") > F.col("high"))).alias("out"))
