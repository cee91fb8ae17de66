"""Checks of fitted models: influence of rows, serial correlation, stepwise choice, classifiers' curves and calibration.

A linear fit is one Gram matrix, so what a row does to it is an expression of
the row: no second shuffle. Curves and calibration go by distinct scores or
row numbers over chunks, never by one sorting task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.functions.special import chi2_sf, t_sf
from qualispark.operators.control import imr_points
from qualispark.operators.hypothesis import _with_p
from qualispark.operators.models import gram
from qualispark.operators.ordered import numbered, running
from qualispark.operators.regression import glm

#: What ``influence`` adds to the columns kept.
_ADDED = ("fitted", "residual", "leverage", "studentized", "cooks_d", "dffits", "high_leverage", "high_cooks_d", "high_dffits", "outlier")


def _solved(s: np.ndarray, k: int) -> np.ndarray:
    """The inverse of the leading k x k block; dependent or constant predictors are an error."""
    block = s[:k, :k]
    d = np.sqrt(np.diag(block))
    if (d <= 0).any() or np.linalg.cond(block / np.outer(d, d)) > 1e12:
        raise ValueError("predictors are constant or depend on one another")
    return np.linalg.inv(block)


def _line(df: DataFrame, response: str, predictors: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, means, inverse, slopes and residual mean square."""
    n, means, s = gram(df, [*predictors, response])
    p = len(predictors)
    if n < p + 3:
        raise ValueError(f"{n} complete rows are too few for {p} predictors")
    inverse = _solved(s, p)
    b = inverse @ s[:p, p]
    return n, means, inverse, b, max(0.0, float(s[p, p] - b @ s[:p, p])) / (n - p - 1)


def _complete(columns: list[str]) -> Column:
    """A row has a number in each column; a row with NaN is no complete row either."""
    out = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x)
    return out


def influence(df: DataFrame, response: str, predictors: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and, for each complete row of a linear fit, fitted, residual, leverage, (internally) studentized
    residual, Cook's distance, DFFITS and flags: leverage over 2k/n, Cook's distance over 4/n, DFFITS over
    2 sqrt(k/n) (k terms with the intercept), studentized beyond 3.

    Rows with a null or NaN are left out; equal rows get equal values. Kept columns named like an added one are
    an error, as are too few rows and dependent predictors. Without residual spread the ratios are null.
    """
    clash = set(keep) & set(_ADDED)
    if clash:
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    df = df.filter(_complete([*predictors, response]))
    n, means, inverse, b, mse = _line(df, response, predictors)
    k = len(predictors) + 1
    d = [F.col(c).cast("double") - float(m) for c, m in zip(predictors, means, strict=False)]
    fitted = float(means[-1]) + sum((float(c) * v for c, v in zip(b, d, strict=True)), F.lit(0.0))
    lever = F.lit(1.0 / n)
    for i, u in enumerate(d):
        for j in range(i, len(d)):
            lever = lever + (1 if i == j else 2) * float(inverse[i, j]) * u * d[j]
    rows = df.select(*keep, fitted.alias("fitted"), (F.col(response).cast("double") - fitted).alias("residual"), lever.alias("leverage"))
    e, h, free = F.col("residual"), F.col("leverage"), n - k
    rows = rows.withColumn("studentized", over(e, F.sqrt(F.greatest(F.lit(0.0), mse * (1 - h)))))
    t = F.col("studentized")
    outside = t * F.sqrt(over(F.lit(float(free - 1)), F.greatest(F.lit(0.0), free - t * t)))
    rows = rows.withColumns({"cooks_d": t * t * over(h, k * (1 - h)), "dffits": outside * F.sqrt(over(h, 1 - h))})
    return rows.withColumns({
        "high_leverage": h > 2 * k / n, "high_cooks_d": F.col("cooks_d") > 4 / n,
        "high_dffits": F.abs("dffits") > 2 * (k / n) ** 0.5, "outlier": F.abs(t) > 3,
    })


def durbin_watson(df: DataFrame, response: str, predictors: list[str], order: list[str]) -> DataFrame:
    """n and the statistic of a linear fit's residuals in the given order (about 2: no serial correlation)."""
    df = df.filter(_complete([*predictors, response]))
    _, means, _, b, _ = _line(df, response, predictors)
    fitted = float(means[-1]) + sum((float(c) * (F.col(x).cast("double") - float(m)) for c, x, m in zip(b, predictors, means, strict=False)), F.lit(0.0))
    inner = [f"__k{i}" for i in range(len(order))]
    own = df.select(*(F.col(c).alias(k) for c, k in zip(order, inner, strict=True)), (F.col(response).cast("double") - fitted).alias("__e"))
    points = imr_points(own, "__e", inner)
    return points.agg(F.count("x").alias("n"), over(F.sum(F.col("mr") * F.col("mr")), F.sum(F.col("x") * F.col("x"))).alias("dw"))


def stepwise(df: DataFrame, response: str, predictors: list[str], direction: str = "both", alpha_in: float = 0.05, alpha_out: float = 0.10) -> DataFrame:
    """step, action (enter, exit), term, p, n, r2 and adj_r2 after it, of a choice of predictors by their p-values.

    All candidate fits are solved from one Gram matrix of all predictors. ``alpha_out`` below ``alpha_in`` could go
    round in circles and is an error. No step gives no row.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError("direction is forward, backward or both")
    if alpha_out < alpha_in:
        raise ValueError("alpha_out is below alpha_in")
    n, _, s = gram(df.filter(_complete([*predictors, response])), [*predictors, response])
    y = len(predictors)

    def fit(chosen: list[int]) -> tuple[np.ndarray, float]:
        """p-values of the chosen terms, and r2."""
        free = n - len(chosen) - 1
        if free < 1:
            raise ValueError(f"{n} complete rows are too few for {len(chosen)} predictors")
        at = [*chosen, y]
        own = s[np.ix_(at, at)]
        k = len(chosen)
        inverse = _solved(own, k)
        b = inverse @ own[:k, k]
        rss = max(0.0, float(own[k, k] - b @ own[:k, k]))
        se = np.sqrt(rss / free * np.diag(inverse))
        return np.array([t_sf(c / e, free) if e > 0 else 0.0 for c, e in zip(b, se, strict=True)]), 1 - rss / own[k, k] if own[k, k] > 0 else 0.0

    inside, rows = ([] if direction != "backward" else list(range(y))), []

    def note(action: str, term: int, p: float) -> None:
        r2 = fit(inside)[1] if inside else 0.0
        adjusted = 1 - (1 - r2) * (n - 1) / (n - len(inside) - 1)
        rows.append((len(rows) + 1, action, predictors[term], float(p), int(n), float(r2), float(adjusted)))

    while True:
        before = len(rows)
        outside = [i for i in range(y) if i not in inside]
        if direction != "backward" and outside:
            p, best = min((fit([*inside, i])[0][-1], i) for i in outside)
            if p < alpha_in:
                inside.append(best)
                note("enter", best, p)
        if direction != "forward" and inside:
            ps = fit(inside)[0]
            worst = int(np.argmax(ps))
            if ps[worst] > alpha_out:
                note("exit", inside.pop(worst), ps[worst])
        if len(rows) == before:
            break
    return df.sparkSession.createDataFrame(rows, "step int, action string, term string, p double, n long, r2 double, adj_r2 double")


def logit_scores(df: DataFrame, response: str, predictors: list[str], name: str = "score") -> DataFrame:
    """All columns and each row's fitted probability; null where a predictor is null. ``name`` must be new."""
    if name in df.columns:
        raise ValueError(f"a column {name} is there already")
    fit = {r["term"]: r["coef"] for r in glm(df, response, predictors, "binomial").collect()}  # one row a term
    b = [fit[t] for t in ("intercept", *predictors)]
    z = float(b[0]) + sum((float(c) * F.col(x).cast("double") for c, x in zip(b[1:], predictors, strict=True)), F.lit(0.0))
    return df.withColumn(name, 1 / (1 + F.exp(-z)))


def _scored(df: DataFrame, label: str, score: str, *more: str) -> DataFrame:
    return df.select(F.col(label).cast("int").alias("__y"), F.col(score).cast("double").alias("__s"), *more).filter("__y is not null and __s is not null and not isnan(__s)")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr of each distinct score, where a row at or above it is called positive.

    ``label`` is boolean or 0/1. Tied scores are one point. A rate is null if its class has no row. Rows with a null
    are left out. Counts are added up by score before they are put in order.
    """
    c = _scored(df, label, score).groupBy((-F.col("__s")).alias("__down")).agg(F.count_if(F.col("__y") == 1).alias("__p"), F.count_if(F.col("__y") == 0).alias("__q"))
    total = c.agg(F.sum("__p").alias("__all_p"), F.sum("__q").alias("__all_q"))
    out = running(c, ["__down"], tp=("__p", "sum"), fp=("__q", "sum")).join(F.broadcast(total))
    return out.select((-F.col("__down")).alias("threshold"), "tp", "fp", over(F.col("tp"), F.col("__all_p")).alias("tpr"), over(F.col("fp"), F.col("__all_q")).alias("fpr"))


def roc_summary(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: positives, negatives, auc (ties count half) and the threshold with the largest tpr - fpr (the highest of ties).

    The area is summed by trapezes between distinct scores. auc is null if a class has no row.
    """
    c = _scored(df, label, score).groupBy((-F.col("__s")).alias("__down")).agg(F.count_if(F.col("__y") == 1).alias("__p"), F.count_if(F.col("__y") == 0).alias("__q"))
    total = c.agg(F.sum("__p").alias("positives"), F.sum("__q").alias("negatives"))
    curve = running(c, ["__down"], tp=("__p", "sum"), fp=("__q", "sum")).join(F.broadcast(total))
    curve = curve.withColumns({"tpr": over(F.col("tp"), F.col("positives")), "fpr": over(F.col("fp"), F.col("negatives"))})
    area = F.sum(F.col("__q").cast("double") * (F.col("tp") - F.col("__p") / 2))
    best = F.max_by(F.struct((-F.col("__down")).alias("t"), "tpr", "fpr"), F.struct(F.col("tpr") - F.col("fpr"), -F.col("__down")))
    o = curve.agg(F.coalesce(F.max("positives"), F.lit(0)).alias("positives"), F.coalesce(F.max("negatives"), F.lit(0)).alias("negatives"), area.alias("a"), best.alias("b"))
    auc = over(over(F.col("a"), F.col("positives")), F.col("negatives"))
    return o.select("positives", "negatives", auc.alias("auc"), F.col("b.t").alias("best_threshold"), F.col("b.tpr").alias("best_tpr"), F.col("b.fpr").alias("best_fpr"))


def hosmer_lemeshow(df: DataFrame, label: str, score: str, order: list[str], groups: int = 10) -> DataFrame:
    """group, n, observed_1, expected_1, observed_0, expected_0 and, on each row, chi2, df, p of the calibration test.

    Rows are numbered by score, then ``order`` (which must tell rows apart), and cut into groups whose sizes differ by one
    at most, the larger ones first. ``label`` is boolean or 0/1. Fewer than five rows a group are an error; no row, no result.
    """
    if groups < 3:
        raise ValueError("the test needs three groups")
    rows = numbered(_scored(df, label, score, *order), ["__s", *order], "__i")
    total = rows.agg(F.count("*").alias("__n"))
    few = F.concat(F.lit(f"calibration needs {5 * groups} rows, found "), F.col("__n").cast("string"))
    total = total.filter(F.when(F.col("__n") == 0, False).when(F.col("__n") >= 5 * groups, True).otherwise(F.raise_error(few).cast("boolean")))
    rows = rows.join(F.broadcast(total))
    q, more, i = F.floor(F.col("__n") / groups), F.col("__n") % groups, F.col("__i")
    head = more * (q + 1)
    at = F.when(i < head, F.floor(i / (q + 1))).otherwise(more + F.floor((i - head) / q))
    one, s = F.col("__y") == 1, F.col("__s")
    g = rows.groupBy((at + 1).cast("int").alias("group")).agg(
        F.count("*").alias("n"), F.count_if(one).alias("observed_1"), F.sum(s).alias("expected_1"), F.count_if(~one).alias("observed_0"), F.sum(1 - s).alias("expected_0")
    )
    part = lambda c: F.coalesce(over(F.pow(F.col(f"observed_{c}") - F.col(f"expected_{c}"), 2), F.col(f"expected_{c}")), F.lit(0.0))
    every = Window.partitionBy()  # one row a group
    g = g.withColumns({"chi2": F.sum(part(1) + part(0)).over(every), "df": F.lit(groups - 2)})
    return _with_p(g, chi2_sf, "chi2", "df")
