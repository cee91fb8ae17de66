"""Capability with one or two limits, subgroups or individuals, intervals and a power transform."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.functions.special import as_column, norm_cdf, norm_ppf
from qualispark.operators.control import D2_PAIR, _factor, _one_size, imr_points
from qualispark.operators.wrangle import boxcox_lambda

# Expected range of n normal values in deviations.
D2 = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847, 9: 2.970, 10: 3.078,
      11: 3.173, 12: 3.258, 13: 3.336, 14: 3.407, 15: 3.472, 16: 3.532, 17: 3.588, 18: 3.640, 19: 3.689, 20: 3.735, 21: 3.778, 22: 3.819, 23: 3.858, 24: 3.895, 25: 3.931}


def _power(v: float | None, g: float) -> float | None:
    if v is None:
        return None
    if v <= 0:
        raise ValueError("a power transform needs positive limits and a positive target")
    return math.log(v) if abs(g) < 1e-9 else (v**g - 1) / g


def capability_study(
    df: DataFrame, value: str, lsl: float | None = None, usl: float | None = None, target: float | None = None, *,
    order: list[str] | None = None, subgroup: str | None = None, transform: str | None = None, confidence: float = 0.95,
) -> DataFrame:
    """One row: n, mean, sd (overall), within, cp, cpl, cpu, cpk, pp, ppl, ppu, ppk, cpm, intervals of cpk and ppk,
    the rows outside the limits and the expected ones (parts a million, within and overall), z_bench and the power.

    The deviation within comes from moving ranges in ``order`` or from the ranges of subgroups of one size (2 to 25;
    other sizes are an error): give one of the two. With one limit cp, pp and cpm are null, cpk and ppk that limit's.
    ``transform``="box-cox" fits a power by maximum likelihood and studies the powers; values that aren't positive are
    an error. Rows with a null or NaN, or without a subgroup, are left out; without spread the indices are null; an empty table gives no row.
    """
    if lsl is None and usl is None:
        raise ValueError("capability needs a limit")
    if (order is None) == (subgroup is None):
        raise ValueError("give an order or subgroups")
    if transform not in (None, "box-cox"):
        raise ValueError(f"no such transform: {transform}")
    keys = order if order is not None else [subgroup]
    inner = [f"__k{i}" for i in range(len(keys))]
    own = df.select(*(F.col(c).alias(k) for c, k in zip(keys, inner, strict=True)), F.col(value).cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    if subgroup is not None:
        own = own.filter(F.col(inner[0]).isNotNull())
    power = None
    if transform:
        least = own.agg(F.min("__v")).first()[0]
        if least is not None and least <= 0:
            raise ValueError("a power transform needs positive values")
        power = 1.0 if least is None else boxcox_lambda(own, "__v")
        lsl, usl, target = _power(lsl, power), _power(usl, power), _power(target, power)
        own = own.withColumn("__v", F.log("__v") if abs(power) < 1e-9 else (F.pow("__v", F.lit(power)) - 1) / power)
    below = F.count_if(F.col("x") < lsl) if lsl is not None else F.lit(0).cast("long")
    above = F.count_if(F.col("x") > usl) if usl is not None else F.lit(0).cast("long")
    all_ = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), below.alias("below"), above.alias("above")]
    if order is not None:
        o = imr_points(own, "__v", inner).agg(*all_, (F.avg("mr") / D2_PAIR).alias("within"))
    else:
        ranges = own.groupBy(inner[0]).agg(F.count("*").alias("size"), (F.max("__v") - F.min("__v")).alias("r"))
        g = ranges.agg(F.min("size").alias("size"), F.max("size").alias("most"), F.avg("r").alias("r")).filter(_one_size())
        g = g.select((F.col("r") / _factor(D2, F.col("size"))).alias("within"))
        o = own.select(F.col("__v").alias("x")).agg(*all_).join(F.broadcast(g))
    o = o.filter("n > 0")
    m, none = F.col("mean"), F.lit(None).cast("double")

    def three(s: Column) -> tuple[Column, Column, Column, Column]:
        low = over(m - lsl, 3 * s) if lsl is not None else none
        high = over(usl - m, 3 * s) if usl is not None else none
        return (over(float(usl - lsl), 6 * s) if lsl is not None and usl is not None else none), low, high, F.least(low, high)

    def outside(s: Column) -> Column:
        low = as_column(norm_cdf, over(lsl - m, s)) if lsl is not None else F.lit(0.0)
        high = as_column(norm_cdf, over(m - usl, s)) if usl is not None else F.lit(0.0)
        return 1e6 * (low + high)

    o = o.withColumns(dict(zip(("cp", "cpl", "cpu", "cpk"), three(F.col("within")), strict=True)))
    o = o.withColumns(dict(zip(("pp", "ppl", "ppu", "ppk"), three(F.col("sd")), strict=True)))
    z = norm_ppf(0.5 + confidence / 2)
    half = lambda c: z * F.sqrt(over(1.0, 9.0 * F.col("n")) + over(F.col(c) * F.col(c), 2.0 * (F.col("n") - 1)))
    two = lsl is not None and usl is not None and target is not None
    o = o.withColumns({
        "cpm": over(float(usl - lsl), 6 * F.sqrt(F.col("sd") * F.col("sd") + F.pow(m - target, 2))) if two else none,
        "cpk_low": F.col("cpk") - half("cpk"), "cpk_high": F.col("cpk") + half("cpk"), "ppk_low": F.col("ppk") - half("ppk"), "ppk_high": F.col("ppk") + half("ppk"),
        "ppm_within": outside(F.col("within")), "ppm_overall": outside(F.col("sd")),
    })
    o = o.withColumns({"z_bench": as_column(lambda p: -norm_ppf(p / 1e6) if 0 < p < 1e6 else float("nan"), F.col("ppm_within")), "power": F.lit(power).cast("double")})
    return o.withColumn("z_bench", F.nanvl("z_bench", none))
