"""Capability, quality levels and Pareto tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.operators import orderstats
from qualispark.functions.special import norm_cdf, norm_ppf
from qualispark.operators.control import D2_PAIR, imr_points
from qualispark.operators.ordered import last, with_history


def capability(df: DataFrame, value: str, order: list[str], lsl: float, usl: float, target: float | None = None) -> DataFrame:
    """One row: Cp, Cpk (moving range sigma), Pp, Ppk (overall), Cpm."""
    t = (lsl + usl) / 2 if target is None else target
    o = imr_points(df, value, order).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), (F.avg("mr") / D2_PAIR).alias("within"))
    m, s, w = F.col("mean"), F.col("sd"), F.col("within")
    near = F.least(usl - m, m - lsl)
    return o.withColumns(
        {
            "cp": over(usl - lsl, 6 * w), "cpk": over(near, 3 * w), "pp": over(usl - lsl, 6 * s), "ppk": over(near, 3 * s),
            "cpm": over(usl - lsl, 6 * F.sqrt(s * s + F.pow(m - t, 2))),
        }
    )


def clements(df: DataFrame, value: str, lsl: float, usl: float) -> DataFrame:
    """Indices from the 0.135, 50 and 99.865 percentiles."""
    o = orderstats.quantiles(df, value, {"low": 0.00135, "mid": 0.5, "high": 0.99865})
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")
    return o.select(
        mid.alias("median"), over(usl - lsl, high - low).alias("pp"), F.least(over(usl - mid, high - mid), over(mid - lsl, mid - low)).alias("ppk")
    )


def rolling_cpk(df: DataFrame, value: str, order: list[str], lsl: float, usl: float, window: int = 30) -> DataFrame:
    """Cpk of the last ``window`` points at each point that has as many."""
    own = df.select(*order, F.col(value).cast("double").alias("x")).filter("x is not null")
    rows = with_history(own, order, "x", window - 1)
    full = last(F.concat("history", F.array("x")), window)
    rows = rows.filter(full.isNotNull()).withColumn("w", full)
    mean = F.aggregate("w", F.lit(0.0), lambda a, v: a + v) / window
    rows = rows.withColumn("m", mean)
    sd = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / (window - 1))
    return rows.select(*order, "x", "m", F.try_divide(F.least(usl - F.col("m"), F.col("m") - lsl), 3 * sd).alias("cpk"))


def predictive_cpk(df: DataFrame, value: str, lsl: float, usl: float, factors: tuple[float, ...] = (0.9, 0.8, 0.7, 0.5)) -> DataFrame:
    """Cpk if sigma shrank by each factor."""
    o = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    o = o.select("m", "s", F.explode(F.array(*map(F.lit, (1.0, *factors)))).alias("factor"))
    return o.select("factor", over(F.least(usl - F.col("m"), F.col("m") - lsl), 3 * F.col("s") * F.col("factor")).alias("cpk"))


def dpmo(defects: int, units: int, opportunities: int, shift: float = 1.5) -> dict[str, float]:
    """Defect rates and sigma level of counts."""
    import math

    dpu, dpo = defects / units, defects / (units * opportunities)
    level = 6.0 if dpo <= 0 else 0.0 if dpo >= 1 else norm_ppf(1 - dpo) + shift
    return {"dpu": dpu, "dpo": dpo, "dpmo": dpo * 1e6, "rty": math.exp(-dpu), "yield": 1 - dpo, "sigma": level}


def stress_strength(m_strength: float, s_strength: float, m_stress: float, s_stress: float) -> float:
    return norm_cdf((m_strength - m_stress) / (s_strength**2 + s_stress**2) ** 0.5)


def pareto(df: DataFrame, category: str, value: str | None = None, threshold: float = 80.0) -> DataFrame:
    """Categories by falling count (or sum), share, running share, vital few.

    The window runs over categories, after the aggregate.
    """
    total = F.count("*").cast("double") if value is None else F.sum(F.col(value).cast("double"))
    g = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(total.alias("total"))
    every = g.agg(F.sum("total").alias("all"))
    w = Window.orderBy(F.col("total").desc(), "category")
    out = g.join(F.broadcast(every)).withColumn("share", over(100 * F.col("total"), F.col("all")))
    out = out.withColumn("cum", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("vital", F.coalesce(F.lag("cum").over(w), F.lit(0.0)) < threshold).drop("all")


def cost_pareto(df: DataFrame, category: str, cost: str, threshold: float = 80.0) -> DataFrame:
    """Ranks by count and by cost side by side, and whether they disagree."""
    rank = lambda d, n: d.select("category", F.col("total").alias(n), F.row_number().over(Window.orderBy(F.col("total").desc(), "category")).alias(n + "_rank"))
    out = rank(pareto(df, category), "n").join(rank(pareto(df, category, cost), "cost"), "category")
    return out.withColumn("disagrees", F.col("n_rank") != F.col("cost_rank"))


# Words that say nothing about a theme.
STOP = frozenset(
    "the and for are was were with that this from but not you your have has had its our they them their there here "
    "his her she him who what when where which will would can could should been being than then into onto over "
    "under out off per via all any some such very too also just only".split()
)


def text_pareto(df: DataFrame, text: str, top: int = 10) -> DataFrame:
    """The ``top`` stems by occurrences, with shares of all occurrences."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z][a-z'-]+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*sorted(STOP)))
    terms = df.select(F.explode(kept).alias("w")).groupBy("w").count()  # words before stems: fewer rows to cut
    stem = F.when(F.col("w").rlike("^.{3,}ies$"), F.concat(F.expr("substr(w, 1, length(w) - 3)"), F.lit("y")))
    for end in ("ing", "ied", "es", "ed", "s"):
        stem = stem.when(F.col("w").rlike(f"^.{{3,}}{end}$"), F.expr(f"substr(w, 1, length(w) - {len(end)})"))
    g = terms.groupBy(stem.otherwise(F.col("w")).alias("term")).agg(F.sum("count").alias("n"))
    every = g.agg(F.sum("n").alias("all"))
    best = g.orderBy(F.col("n").desc(), "term").limit(top)
    return best.join(F.broadcast(every)).select("term", "n", over(100 * F.col("n"), F.col("all")).alias("share"))


def attribute_capability(df: DataFrame, defectives: str, size: str) -> DataFrame:
    """Pooled rate, defects per million and Wilson interval of binomial counts."""
    z = 1.959963984540054
    o = df.agg(F.sum(F.col(defectives).cast("double")).alias("k"), F.sum(F.col(size).cast("double")).alias("n")).withColumn("rate", over(F.col("k"), F.col("n")))
    n, p = F.col("n"), F.col("rate")
    mid, half = over(p + over(z * z, 2 * n), 1 + over(z * z, n)), over(z * F.sqrt(over(p * (1 - p), n) + over(z * z, 4 * n * n)), 1 + over(z * z, n))
    return o.select("n", "rate", (p * 1e6).alias("dpmo"), (mid - half).alias("low"), (mid + half).alias("high"))


def cycle_time(df: DataFrame, start: str, end: str) -> DataFrame:
    """Percentiles of days from start to end; negative ones are left out."""
    days = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 86_400e6
    q = [0.5, 0.7, 0.85, 0.95]
    d = df.select(days.alias("d")).filter("d >= 0")
    o = orderstats.quantiles(d, "d", {f"p{round(100 * x)}": x for x in q})
    return o.join(F.broadcast(d.agg(F.avg("d").alias("mean")))).select("n", "mean", *(f"p{round(100 * x)}" for x in q))
