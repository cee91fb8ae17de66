"""Measurement studies: nested gauges, bias and linearity, agreement of appraisers, and a budget of variance.

All of them work on aggregates of cells (operator and part, part, appraiser and part), never on a group's rows in one
place. Rows with a null in a used column are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.functions.special import as_column, f_sf, t_ppf, t_sf, tail

#: Most categories of a rating, and most levels of all factors of a budget.
MAX_LEVELS = 1000


def _unless(bad, message: str):
    """A condition that is an error where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def nested_gauge(df: DataFrame, value: str, part: str, operator: str, tolerance: float | None = None) -> DataFrame:
    """One row of a balanced study whose parts are measured by one operator each.

    operators, parts (an operator's), replicates, mean squares, variances of repeatability, reproducibility and part
    (negative estimates are zero), their shares of the total deviation in percent, the gauge's share of the tolerance
    (null without one) and ndc. Unequal counts, or fewer than two operators, parts or replicates, are an error; an
    empty table gives no row.
    """
    own = df.select(F.col(value).cast("double").alias("x"), F.col(part).alias("p"), F.col(operator).alias("o")).na.drop()
    cell = own.groupBy("o", "p").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("e"))
    ops = cell.groupBy("o").agg(
        F.count("*").alias("b"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("m").alias("mo"), (F.var_pop("m") * F.count("*")).alias("sp"), F.sum("e").alias("se")
    )
    all_ = ops.agg(
        F.count("*").alias("operators"), F.min("b").alias("parts"), F.max("b").alias("many"), F.min("least").alias("replicates"), F.max("most").alias("most"),
        (F.var_pop("mo") * F.count("*")).alias("so"), F.sum("sp").alias("sp"), F.sum("se").alias("se"),
    ).filter("operators > 0")
    a, b, r = F.col("operators"), F.col("parts"), F.col("replicates")
    all_ = all_.filter(_unless((b != F.col("many")) | (r != F.col("most")), "a nested study needs equal counts of parts and replicates"))
    all_ = all_.filter(_unless((a < 2) | (b < 2) | (r < 2), "a nested study needs two operators, parts and replicates"))
    o = all_.select(
        "operators", "parts", "replicates", (r * b * F.col("so") / (a - 1)).alias("ms_operator"), (r * F.col("sp") / (a * (b - 1))).alias("ms_part"), (F.col("se") / (a * b * (r - 1))).alias("ms_error")
    )
    zero = F.lit(0.0)
    o = o.withColumns({
        "repeatability": F.col("ms_error"), "reproducibility": F.greatest(zero, (F.col("ms_operator") - F.col("ms_part")) / (b * r)),
        "part": F.greatest(zero, (F.col("ms_part") - F.col("ms_error")) / r),
    })
    grr = F.col("repeatability") + F.col("reproducibility")
    share = lambda v: 100 * F.sqrt(over(v, grr + F.col("part")))
    return o.withColumns({
        "repeatability_share": share(F.col("repeatability")), "reproducibility_share": share(F.col("reproducibility")), "grr_share": share(grr), "part_share": share(F.col("part")),
        "grr_of_tolerance": F.lit(None).cast("double") if tolerance is None else 600 * F.sqrt(grr) / float(tolerance), "ndc": F.sqrt(over(2 * F.col("part"), grr)),
    })


def _parts(df: DataFrame, part: str, reference: str, value: str) -> DataFrame:
    own = df.select(F.col(part).alias("part"), F.col(reference).cast("double").alias("r"), F.col(value).cast("double").alias("x")).na.drop()
    return own.groupBy("part").agg(F.count("x").alias("n"), F.avg("r").alias("reference"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).withColumn("bias", F.col("mean") - F.col("reference"))


def gauge_bias(df: DataFrame, part: str, reference: str, value: str) -> DataFrame:
    """part, n, reference (its mean), mean, sd, bias, bias_share (percent of the reference), and t and p of no bias (null without spread)."""
    g = _parts(df, part, reference, value).withColumns({"bias_share": 100 * over(F.col("bias"), F.col("reference")), "t": over(F.col("bias") * F.sqrt("n"), F.col("sd"))})
    return g.withColumn("p", tail(t_sf, "t", F.col("n") - 1)).select("part", "n", "reference", "mean", "sd", "bias", "bias_share", "t", "p")


def gauge_linearity(df: DataFrame, part: str, reference: str, value: str, process_variation: float | None = None, confidence: float = 0.95) -> DataFrame:
    """One row: parts, n, slope, intercept, r2, se_slope, p_slope of the parts' bias on their reference; mean_bias, low,
    high, t, p of all rows' bias; linearity and bias in percent of the process variation (null without one).

    Fewer than six rows or two reference values are an error; an empty table gives no row.
    """
    g = _parts(df, part, reference, value)
    x, y, n = F.col("reference"), F.col("bias"), F.col("n")
    # A part's rows spread about the overall bias by their own variance and by the part's distance from it.
    first = g.agg(F.sum(n).alias("n"), (F.sum(n * y) / F.sum(n)).alias("mean_bias"))
    o = g.drop("n").join(F.broadcast(first.select(F.col("n").alias("rows"), "mean_bias"))).join(g.select(F.col("part").alias("at"), "n"), F.col("at").eqNullSafe(F.col("part")))
    o = o.groupBy("rows", "mean_bias").agg(
        F.count("*").alias("parts"), F.count_distinct("reference").alias("references"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"),
        F.sum((n - 1) * F.coalesce(F.col("sd") * F.col("sd"), F.lit(0.0)) + n * F.pow(y - F.col("mean_bias"), 2)).alias("ss"),
    )
    o = o.filter(_unless((F.col("rows") < 6) | (F.col("references") < 2), "linearity needs six rows and two reference values"))
    slope, rows = over(F.col("c"), F.col("vx")), F.col("rows")
    o = o.withColumns({"slope": slope, "r2": over(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")), "se": F.sqrt(over(F.col("ss"), (rows - 1) * rows))})
    o = o.withColumns({"se_slope": F.sqrt(F.greatest(F.lit(0.0), over(F.col("vy") - slope * F.col("c"), F.col("vx") * (F.col("parts") - 2)))), "t": over(F.col("mean_bias"), F.col("se"))})
    half = F.col("se") * as_column(lambda d: t_ppf(0.5 + confidence / 2, d), rows - 1)
    share = (lambda v: 100 * v) if process_variation else (lambda v: F.lit(None).cast("double"))
    pv = float(process_variation or 1)
    return o.select(
        "parts", rows.alias("n"), "slope", (F.col("my") - slope * F.col("mx")).alias("intercept"), "r2", "se_slope",
        as_column(t_sf, over(F.col("slope"), F.col("se_slope")), F.col("parts") - 2).alias("p_slope"), "mean_bias", (F.col("mean_bias") - half).alias("low"), (F.col("mean_bias") + half).alias("high"),
        "t", as_column(t_sf, F.col("t"), rows - 1).alias("p"), share(F.abs("slope") * pv).alias("linearity_share"), share(F.abs("mean_bias") / pv).alias("bias_share"),
    )


def within_appraiser(df: DataFrame, appraiser: str, part: str, rating: str) -> DataFrame:
    """appraiser, matched, total, share: of the parts rated twice or more, those whose ratings are all equal."""
    own = df.select(F.col(appraiser).alias("appraiser"), F.col(part).alias("p"), F.col(rating).alias("r")).na.drop()
    cell = own.groupBy("appraiser", "p").agg((F.count("r") > 1).alias("again"), (F.min("r") == F.max("r")).alias("same"))
    g = cell.groupBy("appraiser").agg(F.count_if(F.col("again") & F.col("same")).alias("matched"), F.count_if("again").alias("total"))
    return g.withColumn("share", 100 * over(F.col("matched"), F.col("total")))


def _modes(df: DataFrame, appraiser: str, part: str, rating: str) -> DataFrame:
    """a, p, r: each appraiser's most frequent rating of a part, the smallest of ties, of parts that all appraisers rated."""
    own = df.select(F.col(appraiser).cast("string").alias("a"), F.col(part).alias("p"), F.col(rating).cast("string").alias("r")).na.drop()
    counts = own.groupBy("a", "p", "r").agg(F.count("*").alias("c"))
    modes = counts.groupBy("a", "p").agg(F.min_by("r", F.struct(-F.col("c"), F.col("r"))).alias("r"))
    raters = modes.agg(F.count_distinct("a").alias("raters"))
    full = modes.groupBy("p").agg(F.count("*").alias("k")).join(F.broadcast(raters)).filter("k = raters").select("p", "raters")
    return modes.join(full, "p")


def fleiss_kappa(df: DataFrame, appraiser: str, part: str, rating: str) -> DataFrame:
    """One row: appraisers, parts, matched, p_observed, p_expected, kappa of the appraisers' most frequent ratings.

    Parts that not all appraisers rated are left out. kappa is one where chance alone would always agree; an empty
    table gives no row. Fewer than two appraisers are an error.
    """
    m = _modes(df, appraiser, part, rating)
    cells = m.groupBy("p", "raters", "r").agg(F.count("*").cast("double").alias("c"))
    parts = cells.groupBy("p", "raters").agg(F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("ratings"))
    a = F.col("raters")
    seen = parts.groupBy("raters").agg(F.count("*").alias("parts"), F.count_if(F.col("ratings") == 1).alias("matched"), F.avg(over(F.col("q") - a, a * (a - 1))).alias("p_observed"))
    totals = cells.groupBy("r").agg(F.sum("c").alias("t")).agg((F.sum(F.col("t") * F.col("t")) / F.pow(F.sum("t"), 2)).alias("p_expected"))
    o = seen.join(F.broadcast(totals))
    kappa = F.coalesce(over(F.col("p_observed") - F.col("p_expected"), 1 - F.col("p_expected")), F.lit(1.0))
    # In the result, not as a filter: a filter on the number of appraisers would be inferred for the parts that few rated, too.
    kappa = F.when(a < 2, F.raise_error(F.lit("kappa needs two appraisers")).cast("double")).otherwise(kappa)
    return o.select(a.alias("appraisers"), "parts", "matched", "p_observed", "p_expected", kappa.alias("kappa"))


def cohen_kappa(df: DataFrame, appraiser: str, part: str, rating: str, weights: str | None = None) -> DataFrame:
    """One row: parts, matched, p_observed, p_expected, kappa of two appraisers' most frequent ratings.

    ``weights``: None, linear or quadratic, by the distance of the ratings in their order as text. Other than two
    appraisers, or more than ``MAX_LEVELS`` ratings, are an error; parts that one of them didn't rate are left out, and
    without any part there is no row. kappa is one where chance alone would always agree.
    """
    if weights not in (None, "linear", "quadratic"):
        raise ValueError("weights are linear, quadratic or none")
    pairs = _modes(df, appraiser, part, rating).groupBy("p").agg(F.min_by("r", "a").alias("u"), F.max_by("r", "a").alias("v"), F.max("raters").alias("k"))
    both = pairs.groupBy("u", "v").agg(F.count("*").alias("c"), F.max("k").alias("k"))
    marks = both.select(F.explode(F.array(F.struct(F.col("u").alias("r"), "c", F.lit(0).cast("long").alias("d"), "k"), F.struct(F.col("v").alias("r"), F.lit(0).cast("long").alias("c"), F.col("c").alias("d"), "k"))).alias("x"))
    counts = marks.groupBy("x.r").agg(F.sum("x.c").alias("c"), F.sum("x.d").alias("d"), F.max("x.k").alias("k")).orderBy("r").limit(MAX_LEVELS + 1).collect()
    if len(counts) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} ratings")
    if any(r["k"] != 2 for r in counts):
        raise ValueError("this kappa needs two appraisers")
    schema = "parts long, matched long, p_observed double, p_expected double, kappa double"
    if not counts:
        return df.sparkSession.createDataFrame([], schema)
    k, place = len(counts), {r["r"]: i for i, r in enumerate(counts)}
    gap = np.abs(np.subtract.outer(np.arange(k), np.arange(k))) / max(1, k - 1)
    agree = np.eye(k) if weights is None else 1 - (gap if weights == "linear" else gap**2)
    first, second = np.array([r["c"] for r in counts], float), np.array([r["d"] for r in counts], float)
    index = df.sparkSession.createDataFrame(list(place.items()), "r string, i int")  # MAX_LEVELS rows at most
    seen = both.join(F.broadcast(index.select(F.col("r").alias("u"), F.col("i"))), "u").join(F.broadcast(index.select(F.col("r").alias("v"), F.col("i").alias("j"))), "v")
    far = F.abs(F.col("i") - F.col("j")) / max(1, k - 1)
    same = {None: (F.col("i") == F.col("j")).cast("double"), "linear": 1 - far, "quadratic": 1 - far * far}[weights]
    row = seen.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0)).alias("matched"), F.sum(F.col("c") * same).alias("o")).first()
    n = row["n"]
    observed, expected = row["o"] / n, float(first @ agree @ second) / n / n
    kappa = (observed - expected) / (1 - expected) if expected < 1 else 1.0
    return df.sparkSession.createDataFrame([(n, row["matched"], float(observed), expected, float(kappa))], schema)


def against_standard(df: DataFrame, appraiser: str, part: str, rating: str, standard: str) -> DataFrame:
    """appraiser, matched, total, share: of an appraiser's parts, those whose every rating is the part's standard.

    A part whose rows name two standards is an error. Rows with a null in a used column are left out.
    """
    own = df.select(F.col(appraiser).alias("appraiser"), F.col(part).alias("p"), F.col(rating).cast("string").alias("r"), F.col(standard).cast("string").alias("s")).na.drop()
    cell = own.groupBy("appraiser", "p").agg(F.min("s").alias("s"), F.max("s").alias("t"), F.min("r").alias("low"), F.max("r").alias("high"))
    same = (F.col("low") == F.col("s")) & (F.col("high") == F.col("s"))
    two = F.raise_error(F.lit("a part has two standards")).cast("boolean")
    g = cell.select("appraiser", F.when(F.col("s") != F.col("t"), two).otherwise(same).alias("same")).groupBy("appraiser").agg(F.count_if("same").alias("matched"), F.count("*").alias("total"))
    return g.withColumn("share", 100 * over(F.col("matched"), F.col("total")))


def variance_budget(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """source, df, ss, share (percent), f, p: what each factor explains beyond all others, and the rest (source "residual").

    The normal equations are counts of pairs of levels and sums by level, one grouped aggregate for each pair of
    factors; more than ``MAX_LEVELS`` levels in all are an error, as are too few rows. A factor that the others
    determine explains nothing (0 degrees of freedom, no f).
    """
    names = [f"f{i}" for i in range(len(factors))]
    own = df.select(F.col(value).cast("double").alias("y"), *(F.col(c).cast("string").alias(n) for c, n in zip(factors, names, strict=True))).na.drop()
    total = own.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).first()
    n, mean = total["n"], total["m"]
    if not factors or n < len(factors) + 3:
        raise ValueError("too few factors or complete rows")
    own = own.withColumn("y", F.col("y") - float(mean))
    place: dict[tuple[int, str], int] = {}
    sums, ones = [], []
    for i, c in enumerate(names):
        levels = own.groupBy(c).agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy(c).limit(MAX_LEVELS + 1).collect()
        if len(place) + len(levels) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels of factors")
        for r in levels:
            place[i, r[c]] = len(place)
            ones.append(r["n"])
            sums.append(r["s"])
    k = len(place)
    cross = np.zeros((k + 1, k + 1))
    cross[0, 0], cross[0, 1:], cross[1:, 0] = n, ones, ones
    cross[np.arange(1, k + 1), np.arange(1, k + 1)] = ones
    right = np.array([0.0, *sums])
    for i, j in combinations(range(len(names)), 2):
        for r in own.groupBy(names[i], names[j]).count().collect():  # levels times levels at most, both bounded above
            a, b = place[i, r[0]] + 1, place[j, r[1]] + 1
            cross[a, b] = cross[b, a] = r[2]
    owner = np.array([-1, *(i for i, _ in place)])

    def explained(keep: np.ndarray) -> tuple[float, int]:
        """Sum of squares and rank of the model with these columns, by an eigenvalue cut."""
        values, vectors = np.linalg.eigh(cross[np.ix_(keep, keep)])
        good = values > values.max() * 1e-10
        along = vectors[:, good].T @ right[keep]
        return float((along**2 / values[good]).sum()), int(good.sum())

    full, rank = explained(np.arange(k + 1))
    rss, free = max(0.0, total["v"] * n - full), n - rank
    rows = []
    for i, c in enumerate(factors):
        less, lower = explained(np.flatnonzero(owner != i))
        rows.append((c, rank - lower, max(0.0, full - less) if rank > lower else 0.0))
    every = sum(r[2] for r in rows) + rss
    out = []
    for c, d, ss in rows:
        f = ss / d / (rss / free) if d and free > 0 and rss > 0 else None
        out.append((c, d, float(ss), 100 * ss / every if every else None, f, float(f_sf(f, d, free)) if f is not None else None))
    out.append(("residual", int(free), float(rss), 100 * rss / every if every else None, None, None))
    return df.sparkSession.createDataFrame(out, "source string, df long, ss double, share double, f double, p double")
