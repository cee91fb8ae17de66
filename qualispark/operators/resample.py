"""Bootstrap intervals with Poisson(1) weights.

The weight of a row in a replicate is a hash of the row's key, the replicate
and the seed, looked up in a table of the Poisson distribution: no row is
copied, no draw depends on partitions, and the same seed gives the same
interval whatever the layout. A task multiplies its block of weights with the
powers of the values, so it sends on one row of moments for each group and
replicate; all replicates take one pass. The weights add up to about n, and
every statistic divides by their sum.

Quantiles need no weights: the distribution of an order statistic of a
resample is binomial, so the ends of the ideal bootstrap's percentile interval
are order statistics at known ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import binomial_cdf, norm_cdf, norm_ppf, tail
from qualispark.operators.orderstats import quantiles, ranked

#: Bits of the hash that pick a weight: the table has so many entries.
TABLE_BITS = 20
#: The multipliers of a published 32-bit mixer, and the golden ratio's fraction.
MULTIPLIERS, GOLDEN = (0x21F0AAAD, 0xD35A2D97), 0x9E3779B9
#: Least share of the hash's range at which each weight above 0 begins.
STEPS = [math.ceil(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << TABLE_BITS)) for k in range(9)]
_WEIGHT = np.searchsorted(np.array(STEPS), np.arange(1 << TABLE_BITS), "right").astype(np.uint8)
_MASK = np.uint64(0xFFFFFFFF)
#: Groups whose moments a task holds before it sends them on.
_GROUPS = 256
POWERS = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(16))
    h = (h * np.uint64(MULTIPLIERS[0])) & _MASK
    h = h ^ (h >> np.uint64(15))
    h = (h * np.uint64(MULTIPLIERS[1])) & _MASK
    return h ^ (h >> np.uint64(15))


def weights(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Rows by replicates: the weight of each key in each replicate."""
    k = keys.astype(np.int64).view(np.uint64)
    own = _mixed((k & _MASK) ^ _mixed((k >> np.uint64(32)) ^ np.uint64(seed & 0xFFFFFFFF)))
    turn = (replicates.astype(np.uint64) * np.uint64(GOLDEN)) & _MASK
    return _WEIGHT[(_mixed((own[:, None] + turn[None, :]) & _MASK) >> np.uint64(32 - TABLE_BITS)).astype(np.int64)]


def replicate_moments(own: DataFrame, replicates: int, seed: int) -> DataFrame:
    """g, r, w, s1 .. s4: sums of weights and of weighted powers of x. ``own`` has g (string), x, key."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = np.arange(replicates)
        held: dict = {}

        def out() -> pd.DataFrame:
            m = np.concatenate(list(held.values()))
            names = pd.Series([g for g in held for _ in range(replicates)], dtype=object)
            cols = {"w": m[:, 0]} | {f"s{i}": m[:, i] for i in range(1, POWERS + 1)}
            return pd.DataFrame({"g": names, "r": np.tile(turns, len(held)), **cols})

        for batch in batches:
            for g, part in batch.groupby("g", dropna=False, sort=False):
                g = None if g != g else g
                x, key = part.x.to_numpy(), part.key.to_numpy()
                total = held.setdefault(g, np.zeros((replicates, POWERS + 1)))
                rows = max(1, (1 << 21) // replicates)
                for at in range(0, len(x), rows):
                    w = weights(key[at : at + rows], turns, seed).astype(np.float64)
                    total += w.T @ np.vander(x[at : at + rows], POWERS + 1, increasing=True)
            if len(held) > _GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    schema = "g string, r int, w double, " + ", ".join(f"s{i} double" for i in range(1, POWERS + 1))
    made = own.mapInPandas(moments, schema)
    return made.groupBy("g", "r").agg(*(F.sum(c).alias(c) for c in ("w", "s1", "s2", "s3", "s4")))


def _prepared(df: DataFrame, value: str | Column, key: Column | None, group: str | None) -> DataFrame:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    named = F.col(group).cast("string") if group else F.lit(None).cast("string")
    own = df.select(named.alias("g"), v.alias("x"), (key if key is not None else F.xxhash64(*df.columns)).cast("long").alias("key"))
    own = own.filter("x is not null and not isnan(x) and abs(x) < double('inf') and key is not null")
    return own.filter("g is not null") if group else own


def _statistic(name: str, shift: Column) -> Column:
    """A statistic of the weighted moments about ``shift``."""
    w = F.col("w")
    m = [F.lit(1.0), *(F.try_divide(F.col(f"s{i}"), w) for i in range(1, POWERS + 1))]
    c2 = m[2] - m[1] * m[1]
    c3 = m[3] - 3 * m[1] * m[2] + 2 * m[1] ** 3
    c4 = m[4] - 4 * m[1] * m[3] + 6 * m[1] ** 2 * m[2] - 3 * m[1] ** 4
    var = F.greatest(F.try_divide(c2 * w, w - 1), F.lit(0.0))
    mean = shift + m[1]
    return {
        "mean": mean,
        "proportion": mean,
        "var": var,
        "std": F.sqrt(var),
        "cv": F.try_divide(F.sqrt(var), mean),
        "skew": F.try_divide(c3, F.pow(c2, 1.5)),
        "kurtosis": F.try_divide(c4, c2 * c2) - 3,
    }[name]


STATISTICS = ("mean", "proportion", "var", "std", "cv", "skew", "kurtosis")
QUANTILES = {"median": 0.5, "q25": 0.25, "q50": 0.5, "q75": 0.75}


def bootstrap(
    df: DataFrame, value: str, statistic: str = "mean", group: str | None = None, replicates: int = 1000, method: str = "percentile", level: float = 0.95, seed: int = 0, key: Column | None = None
) -> DataFrame:
    """group, n, estimate, low, high, se of a statistic, for each group if there is one.

    ``key`` is an integer that tells rows apart (a hash of all columns if left
    out: equal rows then share their weights). ``method`` is percentile, or bca
    for mean, proportion, var and std, whose acceleration is the skewness of
    the influence function. median, q25, q50 and q75 give the ideal bootstrap's
    interval and no se. Fewer than three values, or a statistic that is
    undefined (cv of a zero mean, skew of a constant), give nulls.
    """
    if statistic in QUANTILES:
        return _quantile_interval(df, value, QUANTILES[statistic], group, level)
    if statistic not in STATISTICS:
        raise ValueError(f"statistic is one of {', '.join((*STATISTICS, *QUANTILES))}")
    if method == "bca" and statistic not in ("mean", "proportion", "var", "std"):
        raise ValueError(f"no acceleration for {statistic}: use percentile")
    if method not in ("percentile", "bca"):
        raise ValueError("method is percentile or bca")
    own = _prepared(df, F.when(F.col(value).cast("double") > 0, 1.0).otherwise(F.when(F.col(value).isNotNull(), 0.0)) if statistic == "proportion" else value, key, group)
    shift = own.agg(F.avg("x").alias("m")).first()["m"] or 0.0
    centred = own.withColumn("x", F.col("x") - F.lit(shift))
    c = F.lit(shift)
    plain = centred.groupBy("g").agg(F.count("*").cast("double").alias("w"), *(F.sum(F.pow("x", F.lit(i))).alias(f"s{i}") for i in range(1, 7)))
    plain = plain.withColumn("estimate", F.when(F.col("w") >= 3, _statistic(statistic, c)))
    made = replicate_moments(centred, replicates, seed).select("g", _statistic(statistic, c).alias("v"))
    dist = made.filter("v is not null and not isnan(v)").groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("v"), F.stddev_samp("v").alias("se"))  # ``replicates`` values a group
    both = plain.join(dist.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")), "left")
    k = F.size("v")
    if method == "bca":
        less = F.size(F.filter("v", lambda v: v < F.col("estimate"))) / k
        less = F.least(F.greatest(less, F.lit(1e-9)), F.lit(1 - 1e-9))
        both = both.withColumn("z0", tail(norm_ppf, less)).withColumn("acc", F.coalesce(_acceleration(statistic), F.lit(0.0)))
        for name, p in (("p_low", (1 - level) / 2), ("p_high", (1 + level) / 2)):
            z = F.col("z0") + F.lit(norm_ppf(p))
            both = both.withColumn(name, tail(norm_cdf, F.col("z0") + z / (1 - F.col("acc") * z)))
    else:
        both = both.withColumns({"p_low": F.lit((1 - level) / 2), "p_high": F.lit((1 + level) / 2)})

    def at(p: str) -> Column:
        h = (k - 1) * F.col(p)
        a, b = F.get("v", F.floor(h).cast("int")), F.get("v", F.ceil(h).cast("int"))
        return F.when(F.col("estimate").isNotNull(), a + (h - F.floor(h)) * (b - a))

    out = both.select(F.col("g").alias(group or "g"), F.col("w").cast("long").alias("n"), "estimate", at("p_low").alias("low"), at("p_high").alias("high"), F.when(F.col("estimate").isNotNull(), F.col("se")).alias("se"))
    return out if group else out.drop("g")


def _acceleration(statistic: str) -> Column:
    """Skewness of the influence function over six times the root of n."""
    n = F.col("w")
    m = [F.lit(1.0), *(F.col(f"s{i}") / n for i in range(1, 7))]

    def central(r: int) -> Column:
        return sum((math.comb(r, i) * m[r - i] * (-m[1]) ** i for i in range(r + 1)), F.lit(0.0))

    if statistic in ("mean", "proportion"):
        second, third = central(2), central(3)
    else:  # var and std: the influence of a row is its squared deviation less the variance
        v = central(2)
        second, third = central(4) - v * v, central(6) - 3 * central(4) * v + 2 * v**3
    return F.try_divide(third, 6 * F.sqrt(n) * F.pow(F.greatest(second, F.lit(0.0)), 1.5))


def rank_of(n: int, p: float, confidence: float) -> int:
    """Least rank j for which a resample's order statistic at p is at most x_(j) with that probability."""
    n = int(n)
    k = max(1, math.ceil(n * p))
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if 1 - binomial_cdf(k - 1, n, mid / n) >= confidence else (mid, high)
    return high


def _quantile_interval(df: DataFrame, value: str, p: float, group: str | None, level: float) -> DataFrame:
    by = [group] if group else []
    known = df.filter(F.col(group).isNotNull()) if group else df
    sizes = quantiles(known, value, {"estimate": p}, by)
    ends = {"low": (1 - level) / 2, "high": (1 + level) / 2}
    wanted = sizes.withColumns({f"r_{k}": F.when(F.col("n") >= 3, tail(rank_of, F.col("n"), F.lit(p), F.lit(c))) for k, c in ends.items()})
    rows = ranked(known, value, by)
    wanted = wanted.withColumnRenamed(group, "of") if group else wanted
    joined = wanted.join(rows, F.col("of") == F.col(group), "left") if group else wanted.join(rows, F.lit(True), "left")
    key = ["of"] if group else []
    found = [F.max(F.when((F.col("__lo") < F.col(f"r_{k}")) & (F.col(f"r_{k}") <= F.col("__lo") + F.col("__c")), F.col("__v"))).alias(k) for k in ends]
    out = joined.groupBy(*key, "n", "estimate").agg(*found)
    named = [F.col("of").alias(group)] if group else []
    return out.select(*named, "n", F.when(F.col("n") >= 3, F.col("estimate")).alias("estimate"), "low", "high", F.lit(None).cast("double").alias("se"))


EFFECTS = ("cohens_d", "glass_delta", "hedges_g", "eta_squared")


def _effect(kind: str, moments: DataFrame, by: list[str]) -> DataFrame:
    """by, value: the effect from the moments (w, s1, s2) of each group g."""
    w = F.col("w")
    mean = F.try_divide(F.col("s1"), w)
    within = F.col("s2") - F.col("s1") * mean
    sums = moments.select(*by, "g", "w", "s1", mean.alias("m"), F.greatest(within, F.lit(0.0)).alias("ss"))
    if kind == "eta_squared":
        o = sums.groupBy(*by).agg(F.sum("w").alias("n"), F.sum("s1").alias("t"), F.sum("ss").alias("ss"), F.sum(F.col("s1") * F.col("m")).alias("b"))
        between = F.col("b") - F.col("t") * F.col("t") / F.col("n")
        return o.select(*by, F.coalesce(F.try_divide(between, between + F.col("ss")), F.lit(0.0)).alias("value"))
    # the first and the second group in the order of their names
    o = sums.groupBy(*by).agg(F.count("*").alias("k"), F.min(F.struct("g", "w", "m", "ss")).alias("a"), F.max(F.struct("g", "w", "m", "ss")).alias("b")).filter("k = 2")
    n1, n2 = F.col("a.w"), F.col("b.w")
    gap = F.col("a.m") - F.col("b.m")
    pooled = F.sqrt(F.try_divide(F.col("a.ss") + F.col("b.ss"), n1 + n2 - 2))
    d = F.try_divide(gap, pooled)
    made = {"cohens_d": d, "hedges_g": d * (1 - 3 / (4 * (n1 + n2) - 9)), "glass_delta": F.try_divide(gap, F.sqrt(F.try_divide(F.col("b.ss"), n2 - 1)))}
    return o.select(*by, made[kind].alias("value"))


def effect_size(df: DataFrame, value: str, group: str, kind: str = "cohens_d", replicates: int = 1000, level: float = 0.95, seed: int = 0, key: Column | None = None) -> DataFrame:
    """kind, n, estimate, low, high: an effect between groups and its percentile interval.

    cohens_d, hedges_g and glass_delta need two groups (first less second by
    name, glass_delta over the second's deviation); eta_squared two or more. No
    spread gives a null estimate (zero for eta_squared).
    """
    if kind not in EFFECTS:
        raise ValueError(f"kind is one of {', '.join(EFFECTS)}")
    own = _prepared(df, value, key, group)
    names = own.select("g").distinct().limit(3 if kind != "eta_squared" else 2).count()
    if names != 2:
        raise ValueError(f"{kind} needs {'two groups' if kind != 'eta_squared' else 'two groups or more'}")
    shift = own.agg(F.avg("x").alias("m")).first()["m"]
    centred = own.withColumn("x", F.col("x") - F.lit(shift))
    plain = centred.groupBy("g").agg(F.count("*").cast("double").alias("w"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    made = _effect(kind, replicate_moments(centred, replicates, seed), ["r"])
    q = F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))  # ``replicates`` values
    dist = made.filter("value is not null").agg(q.alias("q"))
    sizes = plain.agg(F.sum("w").cast("long").alias("n"))
    return _effect(kind, plain, []).join(F.broadcast(sizes)).join(F.broadcast(dist)).select(F.lit(kind).alias("kind"), "n", F.col("value").alias("estimate"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
