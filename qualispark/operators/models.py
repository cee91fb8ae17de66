"""Regression, correlation, reliability, survey and measurement studies.

A fit reads the data once into sums (a Gram matrix); the rest is small algebra.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.functions.special import chi2_sf, f_sf, t_ppf, t_sf
from qualispark.operators.hypothesis import average_ranks


def gram(df: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and centred cross products of complete rows: one pass for each."""
    own = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop()
    k = len(columns)
    first = own.agg(F.count("*").alias("n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in range(k))).first()
    means = np.array([first[f"m{i}"] or 0.0 for i in range(k)])
    d = [F.col(f"c{i}") - float(means[i]) for i in range(k)]
    sums = own.agg(*(F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return first["n"], means, out


def ols(df: DataFrame, response: str, predictors: list[str], confidence: float = 0.95) -> DataFrame:
    """One row per term: coef, se, t, p, low, high, vif; the fit's r2, adj_r2, f, rmse, aic, bic on each."""
    n, means, s = gram(df, [*predictors, response])
    p = len(predictors)
    inverse = np.linalg.inv(s[:p, :p])
    b = inverse @ s[:p, p]
    rss, tss = s[p, p] - b @ s[:p, p], s[p, p]
    dof = n - p - 1
    mse = rss / dof
    intercept = means[p] - b @ means[:p]
    se = np.sqrt(mse * np.diag(inverse))
    se0 = np.sqrt(mse * (1 / n + means[:p] @ inverse @ means[:p]))
    f = (tss - rss) / p / mse
    like = n * np.log(2 * np.pi) + n * np.log(rss / n) + n
    fit = {
        "n": int(n), "r2": 1 - rss / tss, "adj_r2": 1 - mse / (tss / (n - 1)), "f": f, "f_p": f_sf(f, p, dof), "rmse": mse**0.5,
        "aic": like + 2 * (p + 1), "bic": like + np.log(n) * (p + 1),
    }
    half = t_ppf(0.5 + confidence / 2, dof)
    rows = []
    for i, (name, coef, e) in enumerate([("intercept", intercept, se0), *zip(predictors, b, se, strict=True)]):
        vif = float(s[i - 1, i - 1] * inverse[i - 1, i - 1]) if i else None
        rows.append((name, float(coef), float(e), float(coef / e), float(t_sf(coef / e, dof)), float(coef - half * e), float(coef + half * e), vif, *(float(v) if k != "n" else v for k, v in fit.items())))
    schema = "term string, coef double, se double, t double, p double, low double, high double, vif double, n long, r2 double, adj_r2 double, f double, f_p double, rmse double, aic double, bic double"
    return df.sparkSession.createDataFrame(rows, schema)


def logistic(df: DataFrame, response: str, predictors: list[str], steps: int = 25) -> DataFrame:
    """Term, coef, se, z, odds_ratio by Newton's method: one aggregate a step."""
    own = df.select(*(F.col(c).cast("double").alias(c) for c in (*predictors, response))).na.drop()
    x = [F.lit(1.0), *(F.col(c) for c in predictors)]
    k, b = len(x), np.zeros(len(x))
    for _ in range(steps):
        z = sum((float(c) * v for c, v in zip(b, x, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-z))
        row = own.agg(*(F.sum(v * (F.col(response) - mu)).alias(f"g{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j] * mu * (1 - mu)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
        g = np.array([row[f"g{i}"] for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    rows = [(n, float(c), float(e), float(c / e), float(np.exp(c))) for n, c, e in zip(["intercept", *predictors], b, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, odds_ratio double")


def _corr(a: str, b: str) -> Column:
    """Correlation of the rows that have both; null without spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return over(F.covar_pop(x, y), F.when(spread > 1e-300, spread))


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, n, r of each pair over its complete rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "pearson":
        both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
        row = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), _corr(a, b).alias("r")) for a, b in pairs))
        return df.agg(row.alias("x")).select(F.inline("x"))
    out = None
    for a, b in pairs:
        own = df.select(F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")).na.drop()
        ranked = average_ranks(average_ranks(own, "u", "ru").drop("ties"), "v", "rv")
        one = ranked.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n"), _corr("ru", "rv").alias("r"))
        out = one if out is None else out.unionByName(one)
    return out


def simple_line(df: DataFrame, y: str, x: str, group: str | None = None) -> DataFrame:
    """Slope, intercept and r2, for each group if there is one."""
    agg = [F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]
    return df.groupBy(group).agg(*agg) if group else df.agg(*agg)


def kaplan_meier(df: DataFrame, time: str, event: Column, group: str | None = None) -> DataFrame:
    """Survival at each event time with Greenwood's interval.

    Totals run over distinct times, after the aggregate: in chunks without a
    group, in a window for each group with one.
    """
    from qualispark.operators.ordered import running

    keys = [group] if group else []
    t = df.select(*keys, F.col(time).cast("double").alias("t"), event.cast("int").alias("e")).na.drop()
    per = t.groupBy(*keys, "t").agg(F.sum("e").alias("d"), F.count("*").alias("c"))
    log_s = F.when(F.col("d") < F.col("n"), F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0)
    step_v = F.try_divide(F.col("d").cast("double"), F.col("n") * (F.col("n") - F.col("d")))
    steps = {"ls": log_s, "dv": step_v, "all": (F.col("d") == F.col("n")).cast("int")}
    if group:
        w = Window.partitionBy(*keys).orderBy(F.col("t").desc())
        risk = per.withColumn("n", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("d > 0").withColumns(steps)
        up = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        run = risk.withColumns({"__s": F.sum("ls").over(up), "v": F.sum("dv").over(up), "__dead": F.max("all").over(up)})
    else:
        risk = running(per.withColumn("__back", -F.col("t")), ["__back"], n=("c", "sum")).filter("d > 0").withColumns(steps)
        run = running(risk, ["t"], __s=("ls", "sum"), v=("dv", "sum"), __dead=("all", "max"))
    s = F.when(F.col("__dead") == 1, 0.0).otherwise(F.exp("__s"))
    out = run.select(*keys, "t", "n", "d", s.alias("s"), "v")
    power = lambda sign: F.pow(F.col("s"), F.exp(sign * 1.959963984540054 * F.sqrt("v") / F.abs(F.log("s"))))
    inside = (F.col("s") > 0) & (F.col("s") < 1)
    return out.withColumns({"low": F.when(inside, power(1)), "high": F.when(inside, power(-1))})


def log_rank(df: DataFrame, time: str, event: Column, group: str) -> DataFrame:
    """Chi-square of any number of groups' observed against expected events, one row a group.

    g, observed, expected, chi2, df, p. Numbers at risk are running sums over
    distinct times in chunks; the covariance is one aggregate over pairs of
    groups, whose number is small.
    """
    from qualispark.operators.ordered import running

    t = df.select(F.col(time).cast("double").alias("t"), event.cast("int").alias("e"), F.col(group).alias("g")).na.drop()
    names = [r["g"] for r in t.select("g").distinct().orderBy("g").limit(101).collect()]
    if not 2 <= len(names) <= 100:
        raise ValueError("the test needs two to a hundred groups")
    k = range(len(names))
    per = t.groupBy((-F.col("t")).alias("back")).agg(
        F.sum("e").cast("double").alias("d"),
        *(F.count_if(F.col("g") == F.lit(names[i])).cast("double").alias(f"c{i}") for i in k),
        *(F.sum(F.when(F.col("g") == F.lit(names[i]), F.col("e")).otherwise(0)).cast("double").alias(f"d{i}") for i in k),
    )
    per = running(per, ["back"], **{f"n{i}": (f"c{i}", "sum") for i in k}).withColumn("n", sum((F.col(f"n{i}") for i in k), F.lit(0.0))).filter("d > 0")
    share = [F.col(f"n{i}") / F.col("n") for i in k]
    spread = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    row = per.agg(
        *(F.sum(f"d{i}").alias(f"o{i}") for i in k), *(F.sum(F.col("d") * share[i]).alias(f"e{i}") for i in k),
        *(F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])).alias(f"v{i}_{j}") for i in k for j in k),
    ).first()
    gap = np.array([(row[f"o{i}"] or 0.0) - (row[f"e{i}"] or 0.0) for i in k])[:-1]
    v = np.array([[row[f"v{i}_{j}"] or 0.0 for j in k] for i in k])[:-1, :-1]
    chi = float(gap @ np.linalg.pinv(v) @ gap)
    rows = [(names[i], row[f"o{i}"], row[f"e{i}"], chi, len(names) - 1, chi2_sf(chi, len(names) - 1)) for i in k]
    kind = dict(t.dtypes)["g"]
    return df.sparkSession.createDataFrame(rows, f"g {kind}, observed double, expected double, chi2 double, df int, p double")


def crow_amsaa(df: DataFrame, time: str) -> DataFrame:
    """Power-law growth of failure times: beta, scale, last time."""
    t = df.select(F.col(time).cast("double").alias("t")).filter("t > 0")
    end = t.agg(F.max("t").alias("end"))
    o = t.join(F.broadcast(end)).groupBy("end").agg(F.count("*").alias("n"), F.sum(F.log(F.col("end") / F.col("t"))).alias("s"))
    o = o.withColumn("beta", F.col("n") / F.col("s"))
    return o.select("n", "end", "beta", (F.col("n") / F.pow("end", "beta")).alias("scale"))


def exponential_life(df: DataFrame, time: str, event: Column) -> DataFrame:
    """Failure rate and mean time between failures with censoring."""
    o = df.agg(F.count_if(event).alias("failures"), F.sum(F.col(time).cast("double")).alias("total"))
    return o.select("failures", "total", (F.col("failures") / F.col("total")).alias("rate"), F.try_divide("total", "failures").alias("mtbf"))


def weibull(df: DataFrame, time: str, event: Column, steps: int = 60) -> dict[str, float]:
    """Shape and scale by maximum likelihood: one aggregate a step of a bracketed search."""
    t = df.select(F.log(F.col(time).cast("double")).alias("l"), event.cast("int").alias("e")).filter("l is not null")
    base = t.agg(F.sum("e").alias("r"), F.sum(F.col("e") * F.col("l")).alias("sl"), F.max("l").alias("top"), F.min("l").alias("low")).first()
    r, mean, top = base["r"], base["sl"] / base["r"], base["top"]

    def slope(shapes):
        made = [F.sum(F.exp(b * (F.col("l") - top)) * p).alias(f"s{i}_{j}") for i, b in enumerate(shapes) for j, p in enumerate((F.lit(1.0), F.col("l")))]
        row = t.agg(*made).first()
        return [row[f"s{i}_1"] / row[f"s{i}_0"] - 1 / b - mean for i, b in enumerate(shapes)], [row[f"s{i}_0"] for i in range(len(shapes))]

    low, high = 1e-3, 1e3
    for _ in range(steps):
        grid = [low * (high / low) ** (i / 16) for i in range(17)]
        values, _ = slope(grid)
        i = next((i for i, v in enumerate(values) if v > 0), 16)
        low, high = grid[max(0, i - 1)], grid[i]
        if high / low < 1 + 1e-12:
            break
    shape = (low * high) ** 0.5
    total = slope([shape])[1][0]
    return {"shape": shape, "scale": float(np.exp(top) * (total / r) ** (1 / shape)), "failures": r}


def survey_alpha(df: DataFrame, items: list[str]) -> DataFrame:
    """Cronbach's alpha, and for each item its corrected correlation and the alpha without it."""
    n, _, s = gram(df, items)
    v, k = s / (n - 1), len(items)
    one, total = v.sum(axis=1), v.sum()

    def alpha(m):
        return len(m) / (len(m) - 1) * (1 - np.trace(m) / m.sum())

    rows = []
    for j, name in enumerate(items):
        r = (one[j] - v[j, j]) / np.sqrt(v[j, j] * (total - 2 * one[j] + v[j, j]))
        rest = np.delete(np.delete(v, j, 0), j, 1)
        rows.append((name, int(n), float(alpha(v)), float(r), float(alpha(rest)) if k > 2 else None))
    return df.sparkSession.createDataFrame(rows, "item string, n long, alpha double, item_total double, alpha_without double")


def gauge_rr(df: DataFrame, value: str, part: str, operator: str) -> DataFrame:
    """Balanced crossed study: variances of repeatability, reproducibility and parts, shares and ndc."""
    own = df.select(F.col(value).cast("double").alias("x"), F.col(part).alias("p"), F.col(operator).alias("o")).na.drop()
    cell = own.groupBy("p", "o").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    parts, ops = cell.groupBy("p").agg(F.avg("m").alias("mp")), cell.groupBy("o").agg(F.avg("m").alias("mo"))
    size = cell.agg(F.min("n").alias("r"), F.max("n").alias("most"), F.count_distinct("p").alias("np"), F.count_distinct("o").alias("no"), F.count("*").alias("cells"), F.avg("m").alias("grand"), F.sum((F.col("n") - 1) * F.col("v")).alias("sse"))
    size = size.filter("r = most and cells = np * no and r > 1")
    j = cell.join(parts, "p").join(ops, "o").join(F.broadcast(size))
    o = j.groupBy("r", "np", "no", "sse").agg(
        F.sum(F.col("r") * F.pow(F.col("mp") - F.col("grand"), 2)).alias("ssp"), F.sum(F.col("r") * F.pow(F.col("mo") - F.col("grand"), 2)).alias("sso"),
        F.sum(F.col("r") * F.pow(F.col("m") - F.col("mp") - F.col("mo") + F.col("grand"), 2)).alias("ssi"),
    )
    r, p, q = F.col("r"), F.col("np"), F.col("no")
    e, i = F.col("sse") / (p * q * (r - 1)), F.col("ssi") / ((p - 1) * (q - 1))
    mo, mp = F.col("sso") / (q - 1), F.col("ssp") / (p - 1)
    zero = F.lit(0.0)
    out = o.select(e.alias("repeatability"), (F.greatest(zero, (mo - i) / (p * r)) + F.greatest(zero, (i - e) / r)).alias("reproducibility"), F.greatest(zero, (mp - i) / (q * r)).alias("part"))
    grr = F.col("repeatability") + F.col("reproducibility")
    return out.withColumns({"grr_share": 100 * F.sqrt(grr / (grr + F.col("part"))), "ndc": F.floor(F.sqrt(2 * F.col("part") / grr))})


def two_way_cells(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Cells of a two-way layout with their main-effect and interaction parts (balanced or not)."""
    cell = df.groupBy(a, b).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    g = cell.agg(F.avg("mean").alias("grand"))
    out = cell.join(F.broadcast(g)).withColumns({"a_effect": F.avg("mean").over(wa) - F.col("grand"), "b_effect": F.avg("mean").over(wb) - F.col("grand")})
    return out.withColumn("interaction", F.col("mean") - F.col("grand") - F.col("a_effect") - F.col("b_effect"))


def pca(df: DataFrame, columns: list[str]) -> DataFrame:
    """Components of the correlation matrix: eigenvalue, share and loadings (largest positive)."""
    n, _, s = gram(df, columns)
    d = np.sqrt(np.diag(s))
    values, vectors = np.linalg.eigh(s / np.outer(d, d))
    order = np.argsort(-values)
    rows = []
    for k, i in enumerate(order):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        rows.append((k + 1, float(values[i]), float(values[i] / values.sum()), [float(x) for x in v * np.sqrt(max(values[i], 0))]))
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, loadings array<double>")


def acf(df: DataFrame, value: str, order: list[str], lags: int = 20) -> DataFrame:
    """Biased autocorrelations of an ordered column: lag, r."""
    from qualispark.operators.ordered import with_history

    own = df.select(*order, F.col(value).cast("double").alias("x")).filter("x is not null")
    m = own.agg(F.avg("x").alias("m"))
    d = own.join(F.broadcast(m)).withColumn("d", F.col("x") - F.col("m")).select(*order, "d")
    rows = with_history(d, order, "d", lags)
    size = F.size("history")
    sums = rows.agg(F.sum(F.col("d") * F.col("d")).alias("c0"), *(F.sum(F.col("d") * F.get("history", size - k)).alias(f"c{k}") for k in range(1, lags + 1)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("r")) for k in range(lags + 1)))))


def cross_correlation(df: DataFrame, x: str, y: str, order: list[str], lags: int = 5) -> DataFrame:
    """Correlation of y with x so many rows earlier: lag, r."""
    from qualispark.operators.ordered import with_history

    own = df.select(*order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    rows = with_history(own, order, "x", lags)
    size = F.size("history")
    past = lambda k: F.col("x") if k == 0 else F.get("history", size - k)
    return rows.agg(F.array(*(F.struct(F.lit(k).alias("lag"), F.corr("y", past(k)).alias("r")) for k in range(lags + 1))).alias("x")).select(F.inline("x"))


def decompose(df: DataFrame, value: str, order: list[str], period: int = 12) -> DataFrame:
    """Additive seasonal parts by phase: centred means of what the centred moving average leaves."""
    from qualispark.operators.ordered import last, numbered, with_history

    own = numbered(df.select(*order, F.col(value).cast("double").alias("x")).filter("x is not null"), order, "i")
    width = period + 1 if period % 2 == 0 else period
    rows = with_history(own, ["i"], "x", width - 1)
    full = last(F.concat("history", F.array("x")), width)
    ends = (F.element_at(full, 1) + F.element_at(full, -1)) / 2 if period % 2 == 0 else F.lit(0.0)
    inner = F.slice(full, 2, width - 2) if period % 2 == 0 else full
    trend = (F.aggregate(inner, F.lit(0.0), lambda a, v: a + v) + ends) / period
    half = width // 2
    mid = rows.filter(full.isNotNull()).select((F.col("i") - half).alias("i"), F.element_at(full, half + 1).alias("x"), trend.alias("trend"))
    phase = mid.groupBy((F.col("i") % period).alias("phase")).agg(F.avg(F.col("x") - F.col("trend")).alias("s"))
    return phase.join(F.broadcast(phase.agg(F.avg("s").alias("m")))).select("phase", (F.col("s") - F.col("m")).alias("seasonal"))
