"""Control charts: limits by aggregates, flags by chunked order.

Every chart drops rows without a plotted value. Limits are one small row that
is joined to the points, so a chart is one pass for the limits and one for the
flags. Rows are ordered by ``order``, which the caller states.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.operators.models import gram
from qualispark.operators.ordered import last, numbered, previous, running, with_history
from qualispark.operators.scan import System, affine

# Published three-decimal Shewhart factors by subgroup size.
A2 = {2: 1.880, 3: 1.023, 4: 0.729, 5: 0.577, 6: 0.483, 7: 0.419, 8: 0.373, 9: 0.337, 10: 0.308,
      11: 0.285, 12: 0.266, 13: 0.249, 14: 0.235, 15: 0.223, 16: 0.212, 17: 0.203, 18: 0.194, 19: 0.187, 20: 0.180, 21: 0.173, 22: 0.167, 23: 0.162, 24: 0.157, 25: 0.153}
D3 = {2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.076, 8: 0.136, 9: 0.184, 10: 0.223,
      11: 0.256, 12: 0.283, 13: 0.307, 14: 0.328, 15: 0.347, 16: 0.363, 17: 0.378, 18: 0.391, 19: 0.403, 20: 0.415, 21: 0.425, 22: 0.434, 23: 0.443, 24: 0.451, 25: 0.459}
D4 = {2: 3.267, 3: 2.574, 4: 2.282, 5: 2.114, 6: 2.004, 7: 1.924, 8: 1.864, 9: 1.816, 10: 1.777,
      11: 1.744, 12: 1.717, 13: 1.693, 14: 1.672, 15: 1.653, 16: 1.637, 17: 1.622, 18: 1.608, 19: 1.597, 20: 1.585, 21: 1.575, 22: 1.566, 23: 1.557, 24: 1.548, 25: 1.541}
A3 = {2: 2.659, 3: 1.954, 4: 1.628, 5: 1.427, 6: 1.287, 7: 1.182, 8: 1.099, 9: 1.032, 10: 0.975,
      11: 0.927, 12: 0.886, 13: 0.850, 14: 0.817, 15: 0.789, 16: 0.763, 17: 0.739, 18: 0.718, 19: 0.698, 20: 0.680, 21: 0.663, 22: 0.647, 23: 0.633, 24: 0.619, 25: 0.606}
B3 = {2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.030, 7: 0.118, 8: 0.185, 9: 0.239, 10: 0.284,
      11: 0.321, 12: 0.354, 13: 0.382, 14: 0.406, 15: 0.428, 16: 0.448, 17: 0.466, 18: 0.482, 19: 0.497, 20: 0.510, 21: 0.523, 22: 0.534, 23: 0.545, 24: 0.555, 25: 0.565}
B4 = {2: 3.267, 3: 2.568, 4: 2.266, 5: 2.089, 6: 1.970, 7: 1.882, 8: 1.815, 9: 1.761, 10: 1.716,
      11: 1.679, 12: 1.646, 13: 1.618, 14: 1.594, 15: 1.572, 16: 1.552, 17: 1.534, 18: 1.518, 19: 1.503, 20: 1.490, 21: 1.477, 22: 1.466, 23: 1.455, 24: 1.445, 25: 1.435}
D2_PAIR = 1.128
D4_PAIR = 3.267


def _points(df: DataFrame, value: str, *more: str) -> DataFrame:
    own = df.select(F.col(value).cast("double").alias("x"), *more).filter("x is not null and not isnan(x)")
    return own


def imr_points(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """x and its moving range mr (null at the first row), with the order columns."""
    with_last = with_history(_points(df, value, *order), order, "x", 1)
    return with_last.withColumn("mr", F.abs(F.col("x") - F.try_element_at("history", F.lit(1)))).drop("history")


def _imr_limits(points: DataFrame) -> DataFrame:
    return points.agg(F.count("x").alias("n"), F.avg("x").alias("center"), F.avg("mr").alias("mr_bar")).withColumns(
        {
            "sigma": F.col("mr_bar") / D2_PAIR,
            "ucl": F.col("center") + 3 * F.col("mr_bar") / D2_PAIR,
            "lcl": F.col("center") - 3 * F.col("mr_bar") / D2_PAIR,
            "mr_ucl": D4_PAIR * F.col("mr_bar"),
        }
    )


def imr_limits(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row: n, center, mr_bar, sigma, ucl, lcl, mr_ucl."""
    return _imr_limits(imr_points(df, value, order))


def imr_flags(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Each point with its range, the limits and whether either is out."""
    points = imr_points(df, value, order)
    out = points.join(F.broadcast(_imr_limits(points)))
    return out.withColumns(
        {
            "out": (F.col("x") > F.col("ucl")) | (F.col("x") < F.col("lcl")),
            "mr_out": F.coalesce(F.col("mr") > F.col("mr_ucl"), F.lit(False)),
        }
    )


def run_rules(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Rules 1 to 8 as booleans r1..r8 for each point, about the individuals limits.

    A rule is marked at the last point of its run and needs its full frame;
    with zero sigma nothing is marked.
    """
    points = _points(df, value, *order)
    limits = imr_limits(df, value, order).select("center", "sigma")
    rows = with_history(points, order, "x", 14, "__h").join(F.broadcast(limits))
    d = F.transform(F.concat("__h", F.array("x")), lambda v: v - F.col("center"))
    rows = rows.withColumn("__d", d)
    s = F.col("sigma")

    def every(n: int, test) -> Column:
        return F.forall(last(F.col("__d"), n), test)

    def count(n: int, test) -> Column:
        return F.size(F.filter(last(F.col("__d"), n), test))

    def steps(n: int) -> Column:
        items = last(F.col("__d"), n + 1)
        return F.transform(F.slice(items, 2, n), lambda v, i: v - F.get(items, i))

    turns = F.transform(F.slice(F.col("__s"), 2, 12), lambda v, i: F.signum(v) * F.signum(F.get("__s", i)))
    rows = rows.withColumn("__s", steps(13))
    at = F.element_at("__d", -1)
    rules = {
        "r1": F.abs(at) > 3 * s,
        "r2": every(9, lambda v: v > 0) | every(9, lambda v: v < 0),
        "r3": F.forall(steps(5), lambda v: v > 0) | F.forall(steps(5), lambda v: v < 0),
        "r4": F.forall(turns, lambda v: v < 0),
        "r5": (count(3, lambda v: v > 2 * s) >= 2) | (count(3, lambda v: v < -2 * s) >= 2),
        "r6": (count(5, lambda v: v > s) >= 4) | (count(5, lambda v: v < -s) >= 4),
        "r7": every(15, lambda v: F.abs(v) < s),
        "r8": every(8, lambda v: F.abs(v) > s),
    }
    marked = {k: F.coalesce(v & (s > 0), F.lit(False)) for k, v in rules.items()}
    return rows.withColumns(marked).drop("__h", "__d", "__s")


def phased_imr(df: DataFrame, value: str, phase: str, order: list[str]) -> DataFrame:
    """Individuals limits for each consecutive run of a phase: one row a run.

    Runs are islands of the order; ``run`` counts them from 1.
    """
    points = numbered(_points(df, value, phase, *order), order, "row")
    keyed = with_history(points, ["row"], phase, 1, "was") if not _nullable(points, phase) else None
    rows = keyed.withColumn("new", F.coalesce((F.try_element_at("was", F.lit(1)) != F.col(phase)).cast("long"), F.lit(1).cast("long")))
    rows = running(rows, ["row"], run=("new", "sum"))
    ranged = previous(rows, "run", ["row"], "x", "__was").withColumn("mr", F.abs(F.col("x") - F.col("__was")))
    return ranged.groupBy("run", phase).agg(
        F.count("*").alias("n"), F.avg("x").alias("center"), (F.avg("mr") / D2_PAIR).alias("sigma")
    )


def _nullable(df: DataFrame, column: str) -> bool:
    if df.filter(F.col(column).isNull()).isEmpty():
        return False
    raise ValueError(f"phase column {column} has nulls")


def _subgroups(df: DataFrame, value: str, group: str) -> DataFrame:
    own = _points(df, value, group).filter(F.col(group).isNotNull())
    return own.groupBy(group).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("range"), F.stddev_samp("x").alias("sd")
    )


def subgrouped(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """The rows of all full subgroups of ``size`` consecutive rows of each key, with the key as ``subgroup``'s first field.

    Only the rows after a key's last full subgroup are left out.
    """
    w = Window.partitionBy(key)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    at = F.floor(F.col("__i") / size)
    return rows.filter((at + 1) * size <= F.col("__n")).withColumn("subgroup", F.struct(key, at.alias("at"))).drop("__i", "__n")


def _factor(table: dict[int, float], n: Column) -> Column:
    return F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[n.cast("int")]


def _one_size() -> Column:
    """A condition on ``size`` and ``most``: unequal or unsupported sizes are an error, no subgroup is no row."""
    fits = (F.col("size") == F.col("most")) & F.col("size").between(2, 25)
    message = F.concat(F.lit("subgroups need one size from 2 to 25, found "), F.col("size").cast("string"), F.lit(" to "), F.col("most").cast("string"))
    return F.when(F.col("size").isNull(), False).when(fits, True).otherwise(F.raise_error(message).cast("boolean"))


def xbar_r(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row of X-bar and R limits; subgroups must have one size from 2 to 25."""
    g = _subgroups(df, value, group).agg(
        F.count("*").alias("k"), F.min("n").alias("size"), F.max("n").alias("most"), F.avg("mean").alias("center"), F.avg("range").alias("r_bar")
    )
    g = g.filter(_one_size())
    n, r, c = F.col("size"), F.col("r_bar"), F.col("center")
    return g.select("k", "size", "center", "r_bar", (c + _factor(A2, n) * r).alias("ucl"), (c - _factor(A2, n) * r).alias("lcl"), (_factor(D4, n) * r).alias("r_ucl"), (_factor(D3, n) * r).alias("r_lcl"))


def xbar_s(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row of X-bar and S limits; subgroups must have one size from 2 to 25."""
    g = _subgroups(df, value, group).agg(
        F.count("*").alias("k"), F.min("n").alias("size"), F.max("n").alias("most"), F.avg("mean").alias("center"), F.avg("sd").alias("s_bar")
    )
    g = g.filter(_one_size())
    n, s, c = F.col("size"), F.col("s_bar"), F.col("center")
    return g.select("k", "size", "center", "s_bar", (c + _factor(A3, n) * s).alias("ucl"), (c - _factor(A3, n) * s).alias("lcl"), (_factor(B4, n) * s).alias("s_ucl"), (_factor(B3, n) * s).alias("s_lcl"))


def p_chart(df: DataFrame, defectives: str, size: str) -> DataFrame:
    """Each subgroup's proportion with limits for its own size, clipped to [0, 1]."""
    d = df.select("*", F.col(defectives).cast("double").alias("__d"), F.col(size).cast("double").alias("__n")).filter("__d is not null and __n > 0")
    center = d.agg(over(F.sum("__d"), F.sum("__n")).alias("center"))
    half = 3 * F.sqrt(over(F.col("center") * (1 - F.col("center")), F.col("__n")))
    out = d.join(F.broadcast(center)).withColumns(
        {"p": over(F.col("__d"), F.col("__n")), "ucl": F.least(F.lit(1.0), F.col("center") + half), "lcl": F.greatest(F.lit(0.0), F.col("center") - half)}
    )
    return out.withColumn("out", (F.col("p") > F.col("ucl")) | (F.col("p") < F.col("lcl"))).drop("__d", "__n")


def np_chart(df: DataFrame, defectives: str, size: int) -> DataFrame:
    """One row of limits for a constant subgroup size."""
    mean = F.avg(F.col(defectives).cast("double"))
    half = 3 * F.sqrt(mean * (1 - mean / size))
    return df.agg(mean.alias("center"), F.least(F.lit(float(size)), mean + half).alias("ucl"), F.greatest(F.lit(0.0), mean - half).alias("lcl"))


def c_chart(df: DataFrame, count: str) -> DataFrame:
    """One row: center and limits of counts."""
    mean = F.avg(F.col(count).cast("double"))
    return df.agg(mean.alias("center"), (mean + 3 * F.sqrt(mean)).alias("ucl"), F.greatest(F.lit(0.0), mean - 3 * F.sqrt(mean)).alias("lcl"))


def u_chart(df: DataFrame, count: str, units: str) -> DataFrame:
    """Each subgroup's rate with limits for its own units."""
    d = df.select("*", F.col(count).cast("double").alias("__d"), F.col(units).cast("double").alias("__n")).filter("__d is not null and __n > 0")
    center = d.agg(over(F.sum("__d"), F.sum("__n")).alias("center"))
    half = 3 * F.sqrt(over(F.col("center"), F.col("__n")))
    out = d.join(F.broadcast(center)).withColumns(
        {"u": over(F.col("__d"), F.col("__n")), "ucl": F.col("center") + half, "lcl": F.greatest(F.lit(0.0), F.col("center") - half)}
    )
    return out.withColumn("out", (F.col("u") > F.col("ucl")) | (F.col("u") < F.col("lcl"))).drop("__d", "__n")


def laney(df: DataFrame, defectives: str, size: str, order: list[str]) -> DataFrame:
    """One row: center, sigma_z (moving range of standardised residuals) and the verdict."""
    points = p_chart(df, defectives, size)
    sd = F.sqrt(over(F.col("center") * (1 - F.col("center")), F.col(size)))
    z = points.withColumn("z", over(F.col("p") - F.col("center"), sd))
    step = with_history(z.select(*order, "z", "center"), order, "z", 1)
    mr = F.abs(F.col("z") - F.try_element_at("history", F.lit(1)))
    out = step.agg(F.count("*").alias("k"), F.first("center").alias("center"), (F.avg(mr) / D2_PAIR).alias("sigma_z"))
    verdict = F.when(F.col("sigma_z") > 1.2, "over").when(F.col("sigma_z") < 0.8, "under").otherwise("none")
    return out.withColumn("dispersion", verdict)


def cusum(df: DataFrame, value: str, order: list[str], k: float = 0.5, h: float = 4.0, target: float | None = None) -> DataFrame:
    """Tabular sums c_plus and c_minus of each point and whether either exceeds h sigma.

    With P the running sum of deviations beyond the slack,
    C = P - min(0, smallest P so far): two running totals, no recursion.
    """
    points = _points(df, value, *order)
    stats = points.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("s"))
    goal = F.col("mean") if target is None else F.lit(float(target))
    d = points.join(F.broadcast(stats)).withColumns({"up": F.col("x") - goal - k * F.col("s"), "down": goal - k * F.col("s") - F.col("x")})
    d = running(d, order, p=("up", "sum"), q=("down", "sum"))
    d = running(d, order, p_low=("p", "min"), q_low=("q", "min"))
    out = d.withColumns(
        {"c_plus": F.col("p") - F.least(F.lit(0.0), "p_low"), "c_minus": F.col("q") - F.least(F.lit(0.0), "q_low")}
    )
    limit = h * F.col("s")
    return out.withColumn("out", (F.col("c_plus") > limit) | (F.col("c_minus") > limit)).drop("up", "down", "p", "q", "p_low", "q_low", "mean", "s")


def ewma(df: DataFrame, value: str, order: list[str], lam: float = 0.2, width: float = 3.0) -> DataFrame:
    """Weighted average z of each point with its time-varying limits.

    The average starts at the mean, which takes the first point's place.
    """
    points = numbered(_points(df, value, *order), order, "__i")
    stats = points.agg(F.avg("x").alias("center"), F.stddev_samp("x").alias("s"))
    center = stats.first()["center"] or 0.0
    shown = F.when(F.col("__i") == 0, F.lit(center)).otherwise(F.col("x"))
    rows = affine(points, ["__i"], {"x": shown}, System([[1 - lam]], [[lam]], [center]), ["z"]).join(F.broadcast(stats))
    sd = F.col("s") * F.sqrt(lam / (2 - lam) * (1 - F.pow(F.lit(1 - lam), 2 * (F.col("__i") + 1))))
    rows = rows.withColumns({"ucl": F.col("center") + width * sd, "lcl": F.col("center") - width * sd})
    return rows.withColumn("out", (F.col("z") > F.col("ucl")) | (F.col("z") < F.col("lcl"))).drop("s", "__i")


def mewma(df: DataFrame, columns: list[str], order: list[str], lam: float = 0.2, arl0: float = 200.0) -> DataFrame:
    """order, t2, ucl, out: the multivariate weighted average's distance from the mean at each complete row.

    The covariance of the average at row i is lam / (2 - lam) * (1 - (1 - lam) ** (2 i)) of that of the rows; the limit is
    the closed approximation p + 2 sqrt(p) ln(arl0 / 100) + 4. Fewer than p + 2 complete rows are an error.
    """
    p = len(columns)
    if p < 2:
        raise ValueError("two columns or more are needed")
    own = df.select(*order, *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop(subset=[f"c{i}" for i in range(p)])
    n, means, s = gram(df, columns)
    if n < p + 2:
        raise ValueError(f"{n} complete rows are too few for {p} columns")
    inverse = np.linalg.pinv(s / (n - 1))
    rows = numbered(own, order, "__i")
    system = System((1 - lam) * np.eye(p), lam * np.eye(p), np.zeros(p))
    names = [f"z{i}" for i in range(p)]
    out = affine(rows, ["__i"], {f"c{i}": F.col(f"c{i}") - float(means[i]) for i in range(p)}, system, names)
    far = sum((float(inverse[i, j]) * F.col(names[i]) * F.col(names[j]) for i in range(p) for j in range(p)), F.lit(0.0))
    scale = lam / (2 - lam) * (1 - F.pow(F.lit(1 - lam), 2 * (F.col("__i") + 1)))
    ucl = p + 2 * p**0.5 * math.log(arl0 / 100) + 4
    out = out.select(*order, over(far, scale).alias("t2"), F.lit(ucl).alias("ucl"))
    return out.withColumn("out", F.col("t2") > F.col("ucl"))


def moving_average(df: DataFrame, value: str, order: list[str], w: int = 5) -> DataFrame:
    """Mean of the last w points against center +- 3 sigma / sqrt(w); null before w points."""
    points = _points(df, value, *order)
    stats = points.agg(F.avg("x").alias("center"), F.stddev_samp("x").alias("s"))
    rows = with_history(points, order, "x", w - 1).join(F.broadcast(stats))
    full = last(F.concat("history", F.array("x")), w)
    rows = rows.withColumn("ma", F.aggregate(full, F.lit(0.0), lambda a, v: a + v) / w)
    half = 3 * F.col("s") / w**0.5
    return rows.withColumn("out", F.coalesce(F.abs(F.col("ma") - F.col("center")) > half, F.lit(False))).drop("history", "s")


def t_chart(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Limits of times between events: individuals limits of t ** (1 / 3.6), brought back."""
    t = df.withColumn("__t", F.when(F.col(value) > 0, F.pow(F.col(value), 1 / 3.6)))
    lim = imr_limits(t, "__t", order)
    back = lambda c: F.pow(F.greatest(F.col(c), F.lit(0.0)), F.lit(3.6))
    return lim.select("n", back("center").alias("center"), back("ucl").alias("ucl"), back("lcl").alias("lcl"))


def g_chart(df: DataFrame, count: str) -> DataFrame:
    """Limits of counts between events: geometric quantiles at the tails of 0.00135, less one."""
    g = df.agg(F.avg(F.col(count).cast("double")).alias("mean")).withColumn("p", over(1, F.col("mean") + 1))
    q = lambda tail: F.greatest(F.lit(0.0), F.ceil(over(F.log(F.lit(1 - tail)), F.log(1 - F.col("p")))).cast("double") - 1)
    return g.select("mean", "p", q(1 - 0.00135).alias("ucl"), q(0.00135).alias("lcl"))


def z_mr(df: DataFrame, value: str, group: str, order: list[str]) -> DataFrame:
    """Points standardised by their group's mean and moving range; groups under two points are left out."""
    own = _points(df, value, group, *order).filter(F.col(group).isNotNull())
    own = previous(own, group, order, "x", "__was").withColumn("mr", F.abs(F.col("x") - F.col("__was"))).drop("__was")
    stats = own.groupBy(group).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.avg("mr") / D2_PAIR).alias("s")).filter("n >= 2")
    out = own.join(stats, group).withColumn("z", F.try_divide(F.col("x") - F.col("mean"), F.col("s")))
    return out.withColumn("out", F.abs(F.col("z")) > 3).drop("n", "mean", "s")


def short_run(df: DataFrame, value: str, group: str, order: list[str]) -> DataFrame:
    """One row: limits of deviations from group means with the pooled moving range."""
    own = _points(df, value, group, *order).filter(F.col(group).isNotNull())
    means = own.groupBy(group).agg(F.avg("x").alias("mean"))
    dev = previous(own, group, order, "x", "__was").withColumn("mr", F.abs(F.col("x") - F.col("__was"))).join(means, group).withColumn("dev", F.col("x") - F.col("mean"))
    s = F.avg("mr") / D2_PAIR
    out = dev.agg(F.count("dev").alias("n"), s.alias("sigma"))
    return out.withColumns({"ucl": 3 * F.col("sigma"), "lcl": -3 * F.col("sigma")})


def laney_limits(df: DataFrame, defectives: str, size: str, order: list[str]) -> DataFrame:
    """The p chart with its limits widened by sigma_z, cut at 0 and 1: p, low, high, out for each row."""
    points = p_chart(df, defectives, size)
    z = laney(df, defectives, size, order).select("sigma_z")
    half = 3 * F.col("sigma_z") * F.sqrt(over(F.col("center") * (1 - F.col("center")), F.col(size)))
    out = points.join(F.broadcast(z)).withColumns(
        {"low": F.greatest(F.lit(0.0), F.col("center") - half), "high": F.least(F.lit(1.0), F.col("center") + half)}
    )
    return out.select(*order, "p", "low", "high", ((F.col("p") < F.col("low")) | (F.col("p") > F.col("high"))).alias("out"))


def t2_chart(df: DataFrame, columns: list[str], keep: list[str], alpha: float = 0.0027) -> DataFrame:
    """Hotelling's T squared of each complete row, its limit, and whether it is beyond.

    One Gram matrix, inverted on the driver, then a projection.
    """
    import numpy as np

    from qualispark.functions.special import f_sf
    from qualispark.operators.models import gram

    m, means, s = gram(df, columns)
    p = len(columns)
    if m <= p:
        raise ValueError("more complete rows than columns are needed")
    inverse = np.linalg.pinv(s / (m - 1))
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_sf(mid, p, m - p) > alpha else (low, mid)
    limit = p * (m + 1) * (m - 1) / (m * m - m * p) * low
    d = [F.col(c).cast("double") - float(v) for c, v in zip(columns, means, strict=True)]
    t2 = sum((float(inverse[i, j]) * d[i] * d[j] for i in range(p) for j in range(p)), F.lit(0.0))
    own = df.na.drop(subset=columns).withColumn("t2", t2)
    return own.select(*keep, "t2", F.lit(float(limit)).alias("ucl"), (F.col("t2") > limit).alias("out"))
