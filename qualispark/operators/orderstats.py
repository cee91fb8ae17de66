"""Exact order statistics and quantiles by counted ranks, and what rests on them.

Values are counted by (group, chunk of the value's range), chunks are numbered
through by their totals (one row a group and chunk), and only inside a chunk
are the counts added up in order. A rank is then a look-up, so any number of
quantiles of any number of groups takes two exchanges; a frequent value is one
row, and a group that holds most rows is spread over all chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.special import beta_inc, chi2_ppf, noncentral_t_ppf, norm_ppf
from qualispark.operators.ordered import _CHUNK, chunked, numbered


def _own(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value).cast("double").alias("__v")
    return df.select(*by, v).filter("__v is not null and not isnan(__v)")


def ranked(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, __v, __c, __lo, __n: each distinct value, its count, how many are smaller, how many there are."""
    by = by or []
    counts = chunked(_own(df, value, by), ["__v"]).groupBy(*by, _CHUNK, "__v").agg(F.count("*").alias("__c"))
    per = counts.groupBy(*by, _CHUNK).agg(F.sum("__c").alias("__k"))
    w = Window.partitionBy(*by)  # one row a chunk
    earlier = w.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tops = per.select(*(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), F.col(_CHUNK).alias("__at"), F.coalesce(F.sum("__k").over(earlier), F.lit(0)).alias("__before"), F.sum("__k").over(w).alias("__n"))
    on = F.col(_CHUNK) == F.col("__at")
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    inside = Window.partitionBy(*by, _CHUNK).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__up", F.sum("__c").over(inside))
    return upto.join(tops, on).select(*by, "__v", "__c", (F.col("__before") + F.col("__up") - F.col("__c")).alias("__lo"), "__n")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by, n and a column for each probability, with linear interpolation between neighbours.

    Nulls and NaN are left out; without values there is one row of nulls (no
    row with ``by``). A null key is a group.
    """
    by = by or []
    rows = ranked(df, value, by)
    made, out = [F.max("__n").alias("__n")], []
    for i, (name, p) in enumerate(probs.items()):
        at = (F.col("__n") - 1) * F.lit(float(p))
        for side, k in (("a", F.floor(at)), ("b", F.ceil(at))):
            made.append(F.max(F.when((F.col("__lo") <= k) & (k < F.col("__lo") + F.col("__c")), F.col("__v"))).alias(f"__{side}{i}"))
        share = (F.col("__n") - 1) * F.lit(float(p))
        out.append((F.col(f"__a{i}") + (share - F.floor(share)) * (F.col(f"__b{i}") - F.col(f"__a{i}"))).alias(name))
    grouped = rows.groupBy(*by).agg(*made) if by else rows.agg(*made)
    return grouped.select(*by, F.coalesce("__n", F.lit(0)).alias("n"), *out)


def median(df: DataFrame, value: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    """by, n and the exact median."""
    return quantiles(df, value, {name: 0.5}, by)


def mad(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, median and the median absolute deviation from it."""
    by = by or []
    mid = median(df, value, by).withColumnsRenamed({"n": "__m_n", **{b: f"__m_{b}" for b in by}})
    on = F.lit(True)
    for b in by:
        on &= F.col(b).eqNullSafe(F.col(f"__m_{b}"))
    own = _own(df, value, by)
    both = own.join(mid, on) if by else own.join(F.broadcast(mid))  # one row
    away = both.select(*by, "median", F.abs(F.col("__v") - F.col("median")).alias("__away"))
    return quantiles(away, "__away", {"mad": 0.5}, [*by, "median"])


def normal_k(n: int, coverage: float, confidence: float, two_sided: bool = True) -> float:
    """Tolerance factor of a normal sample: Howe's for two sides, the noncentral t's for one."""
    if two_sided:
        return norm_ppf((1 + coverage) / 2) * math.sqrt((n - 1) * (1 + 1 / n) / chi2_ppf(1 - confidence, n - 1))
    return noncentral_t_ppf(confidence, n - 1, norm_ppf(coverage) * math.sqrt(n)) / math.sqrt(n)


def normal_tolerance(df: DataFrame, value: str, coverage: float = 0.95, confidence: float = 0.95, two_sided: bool = True) -> DataFrame:
    """n, mean, sd, k, low, high: bounds of the part ``coverage`` of a normal population; each bound alone if one-sided.

    Fewer than three values give nulls for k and the bounds.
    """
    row = _own(df, value, []).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"))
    n = row.first()["n"]
    k = F.lit(normal_k(n, coverage, confidence, two_sided) if n >= 3 else None).cast("double")
    return row.withColumn("k", k).withColumns({"low": F.col("mean") - k * F.col("sd"), "high": F.col("mean") + k * F.col("sd")})


def cut_ranks(n: int, coverage: float, confidence: float) -> int | None:
    """How many ranks in all may be cut from both ends (two at least), by the binomial bound; None if n is too small."""

    def safe(total: int) -> bool:
        return beta_inc(n - total + 1, total, coverage) <= 1 - confidence

    if n < 2 or not safe(2):
        return None
    low, high = 2, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if safe(mid) else (low, mid)
    return low


def free_tolerance(df: DataFrame, value: str, coverage: float = 0.95, confidence: float = 0.95) -> DataFrame:
    """n, low, high, low_rank, high_rank, achieved: the narrowest pair of order statistics that holds the coverage.

    The confidence of a pair depends on the number of ranks outside it alone,
    so all pairs with that number compete: rank j meets rank j + n - m + 1 in a
    join on the rank, whatever the number of pairs. Of equally narrow ones the
    lowest counts. Too few values give no row.
    """
    own = _own(df, value, [])
    n = own.count()
    m = cut_ranks(n, coverage, confidence)
    rows = numbered(own, ["__v"], "__r").select((F.col("__r") + 1).alias("r"), F.col("__v").alias("v"))
    gap = n - (m or 0) + 1
    low = rows.filter(F.col("r") <= (m or 0) - 1).select(F.col("r").alias("low_rank"), F.col("v").alias("low"))
    high = rows.filter(F.col("r") > gap).select((F.col("r") - gap).alias("key"), F.col("r").alias("high_rank"), F.col("v").alias("high"))
    pairs = low.join(high, F.col("low_rank") == F.col("key"))
    best = pairs.agg(F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "low_rank", "low", "high", "high_rank")).alias("x")).filter("x is not null")
    achieved = 1 - beta_inc(n - m + 1, m, coverage) if m else None
    return best.select(F.lit(n).cast("long").alias("n"), "x.low", "x.high", "x.low_rank", "x.high_rank", F.lit(achieved).cast("double").alias("achieved"))
