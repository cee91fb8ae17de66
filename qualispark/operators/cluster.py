"""k-means with parallel seeding, and a choice of k by a silhouette from sums.

Seeding passes over the rows a few times and picks rows by a hash with chances
in proportion to their squared distance from what is picked already (a few
times k in all, whatever the rows); what is picked, weighted by the rows nearest
to it, is thinned to k centres on the driver. A Lloyd step is one aggregate by
nearest centre. The silhouette compares mean squared distances: a row's mean
squared distance from all rows of a cluster follows from the cluster's count,
sum and sum of squares, so it needs no pair of rows. Rows that agree in all
columns are one row with a weight.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.functions.safe import over

MAX_K = 64
#: Passes of the seeding, and rows asked for in each as a multiple of k.
PASSES, OVERSAMPLE = 4, 3


#: Centres up to which a row's nearest one is found without an array.
FEW = 8
#: Distinct rows of a task in a pass.
TASK_ROWS = 50_000


def _scaled(df: DataFrame, columns: list[str], standardize: bool) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """x0.. of distinct complete rows and their number w; centre, scale and number of all rows."""
    own = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop(subset=[f"x{i}" for i in range(len(columns))])
    s = own.agg(F.count("*").alias("n"), *(f(f"x{i}").alias(f"{a}{i}") for i in range(len(columns)) for a, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    n = s["n"]
    if n < 4:
        raise ValueError(f"{n} complete rows are too few")
    center = np.array([s[f"m{i}"] for i in range(len(columns))])
    scale = np.array([s[f"s{i}"] or 1.0 for i in range(len(columns))]) if standardize else np.ones(len(columns))
    own = own.groupBy(*(F.col(f"x{i}").alias(f"r{i}") for i in range(len(columns)))).agg(F.count("*").alias("w"))  # r0.. as they are, for hashes that no order of sums changes
    return own.withColumns({f"x{i}": (F.col(f"r{i}") - float(center[i])) / float(scale[i]) for i in range(len(columns))}), center, scale, n


def _distance(center: np.ndarray) -> Column:
    return sum(((F.col(f"x{i}") - float(c)) * (F.col(f"x{i}") - float(c)) for i, c in enumerate(center)), F.lit(0.0))


def _nearest(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """The rows with their nearest centre (the first of equally near ones) and the squared distance."""
    if 1 < len(centers) <= FEW:
        rows = rows.withColumn("__d", F.least(*(_distance(c) for c in centers)))
        at = F.when(_distance(centers[0]) == F.col("__d"), 0)
        for i, c in enumerate(centers[1:], 1):
            at = at.when(_distance(c) == F.col("__d"), i)
        return rows.withColumn("__k", at)
    far = F.array(*(_distance(c) for c in centers))
    rows = rows.withColumn("__far", far).withColumn("__d", F.array_min("__far"))
    return rows.withColumn("__k", (F.array_position("__far", F.col("__d")) - 1).cast("int")).drop("__far")


def _seeds(rows: DataFrame, k: int, seed: int, p: int) -> np.ndarray:
    names = [f"x{i}" for i in range(p)]
    raw = [f"r{i}" for i in range(p)]
    chance = lambda turn: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), *raw), F.lit(1 << 40)) / float(1 << 40)
    first = rows.orderBy(chance(0), *raw).select(*names).limit(1).collect()
    picked = np.array([tuple(first[0])])
    for turn in range(1, PASSES + 1):
        near = _nearest(rows, picked)
        cost = near.agg(F.sum(F.col("__d") * F.col("w")).alias("c")).first()["c"]
        if not cost:
            break
        asked = OVERSAMPLE * k
        # about ``asked`` rows; equal rows share their hash, so a frequent row is taken as one
        new = near.filter(chance(turn) < F.least(F.lit(1.0), asked * F.col("__d") / cost)).select(*names, *raw).distinct().orderBy(chance(turn), *raw).limit(4 * asked).collect()
        if new:
            picked = np.concatenate((picked, np.array([tuple(r)[:p] for r in new])))
    picked = np.unique(picked, axis=0)
    weight = np.zeros(len(picked))
    for r in _nearest(rows, picked).groupBy("__k").agg(F.sum("w").alias("n")).collect():
        weight[r["__k"]] = r["n"]
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(picked)):
        far = ((picked[:, None] - picked[chosen]) ** 2).sum(2).min(1) * weight
        chosen.append(int(rng.choice(len(picked), p=far / far.sum())) if far.sum() else next(i for i in range(len(picked)) if i not in chosen))
    centers = picked[chosen]
    for _ in range(50):  # thinned by weighted steps among the picked rows
        at = ((picked[:, None] - centers) ** 2).sum(2).argmin(1)
        moved = np.array([np.average(picked[at == j], axis=0, weights=weight[at == j]) if weight[at == j].sum() else centers[j] for j in range(len(centers))])
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def _lloyd(rows: DataFrame, centers: np.ndarray, steps: int) -> np.ndarray:
    p = centers.shape[1]
    for _ in range(steps):
        sums = _nearest(rows, centers).groupBy("__k").agg(*(over(F.sum(F.col(f"x{i}") * F.col("w")), F.sum("w")).alias(f"m{i}") for i in range(p))).collect()  # a row a centre
        moved = centers.copy()
        for r in sums:
            moved[r["__k"]] = [r[f"m{i}"] for i in range(p)]
        still = np.abs(moved - centers).max() < 1e-9
        centers = moved
        if still:
            break
    return centers


def _silhouette(rows: DataFrame, centers: np.ndarray) -> tuple[float, float, dict[int, int]]:
    """Mean silhouette by squared distances, inertia, and the size of each cluster."""
    p = centers.shape[1]
    near = _nearest(rows, centers)
    square = sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(p)), F.lit(0.0))
    sums = {r["__k"]: r for r in near.groupBy("__k").agg(F.sum("w").alias("n"), F.sum(square * F.col("w")).alias("q"), *(F.sum(F.col(f"x{i}") * F.col("w")).alias(f"s{i}") for i in range(p)), F.sum(F.col("__d") * F.col("w")).alias("d")).collect()}
    if len(sums) < 2:
        return 0.0, sum(r["d"] for r in sums.values()), {k: r["n"] for k, r in sums.items()}

    def mean_square(r, own: bool) -> Column:
        """Mean squared distance from the cluster's rows (the row itself left out if it is one)."""
        whole = r["n"] * square - 2 * sum((float(r[f"s{i}"]) * F.col(f"x{i}") for i in range(p)), F.lit(0.0)) + float(r["q"])
        return F.greatest(whole, F.lit(0.0)) / (r["n"] - 1 if own else r["n"])

    terms = []
    for k, r in sums.items():
        others = [mean_square(o, False) for j, o in sums.items() if j != k]
        b = reduce(lambda x, y: F.least(x, y), others)
        score = F.lit(0.0)
        if r["n"] > 1:
            a = mean_square(r, True)
            score = F.coalesce(over(b - a, F.greatest(a, b)), F.lit(0.0))
        terms.append(F.when(F.col("__k") == k, score))
    s = near.agg((F.sum(F.coalesce(*terms) * F.col("w")) / F.sum("w")).alias("s")).first()["s"]
    return float(s), float(sum(r["d"] for r in sums.values())), {k: r["n"] for k, r in sums.items()}


def kmeans(df: DataFrame, columns: list[str], k: int | None = None, k_max: int = 8, standardize: bool = True, seed: int = 1, steps: int = 100) -> DataFrame:
    """A row per cluster: k, silhouette, inertia, cluster, n, and its centre in the columns' own units.

    Without ``k`` the best silhouette of 2 to ``k_max`` decides (the smaller k
    of equal ones). Columns are scaled to unit deviation first; a constant
    column counts for nothing. Incomplete rows are left out; fewer than four
    rows, or k beyond ``MAX_K``, are an error. Clusters are ordered by centre;
    fewer distinct rows than k give fewer clusters.
    """
    if k is not None and not 1 <= k <= MAX_K or k_max > MAX_K:
        raise ValueError(f"k is between 1 and {MAX_K}")
    rows, center, scale, n = _scaled(df, columns, standardize)
    kept = rows.persist()
    try:
        rows = kept.coalesce(kept.count() // TASK_ROWS + 1)  # a pass is short: no more tasks than rows call for
        found = None
        for kk in [k] if k else range(2, min(k_max, n - 1) + 1):
            centers = _lloyd(rows, _seeds(rows, kk, seed, len(columns)), steps)
            score, inertia, sizes = _silhouette(rows, centers)
            if found is None or score > found[0] + 1e-12:
                found = (score, inertia, sizes, centers)
    finally:
        kept.unpersist()
    score, inertia, sizes, centers = found
    placed = sorted((tuple((centers[j] * scale + center).tolist()), m) for j, m in sizes.items())
    out = [(len(placed), score, inertia, i, m, *c) for i, (c, m) in enumerate(placed)]
    schema = "k int, silhouette double, inertia double, cluster int, n long, " + ", ".join(f"`{c}` double" for c in columns)
    return df.sparkSession.createDataFrame(out, schema)


def assign(df: DataFrame, clusters: DataFrame, columns: list[str], standardize: bool = True) -> DataFrame:
    """``df`` with the ``cluster`` of each complete row (null for others), from a result of ``kmeans`` on the same rows."""
    centers = [(r["cluster"], [r[c] for c in columns]) for r in clusters.collect()]  # a row a cluster
    spread = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop().agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    scale = [spread[c] or 1.0 if standardize else 1.0 for c in columns]
    far = [F.struct(sum((F.pow((F.col(c).cast("double") - float(v)) / float(s), F.lit(2.0)) for c, v, s in zip(columns, at, scale, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, at in centers]
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.withColumn("cluster", F.when(whole, F.array_min(F.array(*far))["i"]))
