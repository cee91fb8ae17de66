"""Cox regression: risk sets as running sums over distinct times.

Rows that agree in time, event and predictors are one row with a count; these
are kept, with the chunk of their time, so that no step goes back to the source.
A Newton step first adds exp(risk) and its products with the predictors up by
distinct time (so a frequent time is one row), then runs the totals backwards
in time over chunks, and ends in one aggregate of the score and the
information. Nothing but those sums reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.special import normal_two_sided
from qualispark.operators.ordered import _CHUNK, chunked, running_in
from qualispark.operators.orderpairs import concordance

#: Distinct rows of a chunk, as long as there are fewer chunks than shuffle partitions.
ROWS = 20_000


def _own(df: DataFrame, time: str, event: Column, predictors: list[str]) -> DataFrame:
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)]
    own = df.select(F.col(time).cast("double").alias("t"), event.cast("int").cast("double").alias("e"), *cols).na.drop()
    own = own.groupBy(*own.columns).agg(F.count("*").alias("n"))
    return own.withColumn("back", -F.col("t"))


def _step(own: DataFrame, b: np.ndarray, shift: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, score and information at ``b`` (Breslow's ties)."""
    k = len(b)
    x = [F.col(f"x{i}") - float(shift[i]) for i in range(k)]
    eta = sum((float(b[i]) * x[i] for i in range(k)), F.lit(0.0))
    w = F.exp(eta)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    w, e = w * F.col("n"), F.col("e") * F.col("n")
    per = own.groupBy(_CHUNK, "back").agg(
        F.sum(w).alias("w"),
        *(F.sum(w * x[i]).alias(f"w{i}") for i in range(k)),
        *(F.sum(w * x[i] * x[j]).alias(f"w{i}_{j}") for i, j in cells),
        F.sum(e).alias("d"),
        F.sum(e * eta).alias("de"),
        *(F.sum(e * x[i]).alias(f"d{i}") for i in range(k)),
    )
    names = ["w", *(f"w{i}" for i in range(k)), *(f"w{i}_{j}" for i, j in cells)]
    late = running_in(per, ["back"], **{f"s_{n}": (n, "sum") for n in names}).filter("d > 0")
    s = F.col("s_w")
    mean = [F.col(f"s_w{i}") / s for i in range(k)]
    row = late.agg(
        F.sum(F.col("de") - F.col("d") * F.log(s)).alias("like"),
        *(F.sum(F.col(f"d{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(k)),
        *(F.sum(F.col("d") * (F.col(f"s_w{i}_{j}") / s - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in cells),
    ).first()
    g = np.array([row[f"g{i}"] or 0.0 for i in range(k)])
    h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return row["like"] or 0.0, g, h


def cox(df: DataFrame, time: str, event: Column, predictors: list[str], steps: int = 25) -> DataFrame:
    """A row per predictor: coef, se, z, p, hazard_ratio, low, high; n, events, log_likelihood and c_index on each.

    Ties are Breslow's. A step is halved while the likelihood falls. Incomplete
    rows are left out. No event, too few rows (5 a predictor and 10 at least) or
    predictors that depend on each other are an error.
    """
    k = len(predictors)
    compact = _own(df, time, event, predictors).persist()
    own = compact
    try:
        sums = [F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("e") * F.col("n")).alias("d"), *(F.sum(F.col(f"x{i}") * F.col("n")).alias(f"s{i}") for i in range(k))]
        first = own.agg(*sums).first()
        if (first["n"] or 0) < max(10, 5 * k) or not first["d"]:
            raise ValueError(f"{first['n'] or 0} complete rows with {int(first['d'] or 0)} events are too few")
        chunks = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), first["rows"] // ROWS + 1)
        own = chunked(compact, ["back"], chunks).coalesce(chunks).persist()
        shift = np.array([first[f"s{i}"] / first["n"] for i in range(k)])
        b = np.zeros(k)
        like, g, h = _step(own, b, shift)
        for _ in range(steps):
            move = np.linalg.solve(h, g)
            if np.abs(move * np.sqrt(np.abs(np.diag(h)))).max() < 1e-9:
                break
            now = _step(own, b + move, shift)
            while now[0] < like - 1e-9 * abs(like) and np.abs(move).max() > 1e-12:
                move = move / 2
                now = _step(own, b + move, shift)
            b = b + move
            like, g, h = now
        se = np.sqrt(np.diag(np.linalg.inv(h)))
        risk = sum((float(b[i]) * F.col(f"x{i}") for i in range(k)), F.lit(0.0))
        c = concordance(own.withColumn("risk", F.round(risk, 12)), "t", F.col("e"), "risk", F.col("n")).first()["c_index"]
    finally:
        compact.unpersist()
        own.unpersist()
    rows = [
        (name, float(v), float(s), float(v / s), float(normal_two_sided(v / s)), math.exp(v), math.exp(v - 1.96 * s), math.exp(v + 1.96 * s), first["n"], int(first["d"]), float(like), c)
        for name, v, s in zip(predictors, b, se, strict=True)
    ]
    schema = "term string, coef double, se double, z double, p double, hazard_ratio double, low double, high double, n long, events long, log_likelihood double, c_index double"
    return df.sparkSession.createDataFrame(rows, schema)
