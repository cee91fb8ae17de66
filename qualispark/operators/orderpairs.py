"""Sums over ordered pairs of rows, and the measures that rest on them.

``pair_sums`` adds a_i * b_j over all pairs with x_i < x_j, split by whether
y_i is below, equal to or above y_j, without forming a pair. Rows are cut into
chunks by x and into bins by y. A pair is counted in one of three places:

* of different chunks and different bins: by the small table of chunk and bin totals;
* of one chunk: in the task of the chunk;
* of different chunks but one bin: in the task of the bin.

Inside a task the pairs are found bit by bit of the rank of y: at the first
differing bit the smaller has 0 and the larger 1, so a running sum for each
prefix counts them all. Equal rows (x, y) are one row with a weight, and a value
of x (or of y) that fills several chunks (bins) is a chunk of its own: its pairs
are ties, which need no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.special import normal_two_sided
from qualispark.operators.ordered import bucket, cuts

#: Chunks and bins at most: their table of totals has as many rows as the square.
CELLS = 512


def counted(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of a_i * b_j over x_i < x_j with y_i < y_j, and with y_i = y_j."""
    if not len(x):
        return 0, 0
    rank = np.unique(y, return_inverse=True)[1]
    order = np.lexsort((-rank, x))  # of equal x the larger y comes first, so that it is below none of its ties
    rank, a, b, x = rank[order], a[order].astype(object), b[order].astype(object), x[order]
    if int(a.sum()) * int(b.sum()) < 1 << 62:
        a, b = a.astype(np.int64), b.astype(np.int64)
    below = 0
    for bit in reversed(range(int(rank.max()).bit_length())):
        prefix = rank >> (bit + 1)
        at = np.argsort(prefix, kind="stable")
        zero = ((rank[at] >> bit) & 1) == 0
        first = np.concatenate(([True], prefix[at][1:] != prefix[at][:-1]))
        seen = np.cumsum(np.where(zero, a[at], 0))
        base = np.concatenate(([0], seen[:-1]))[np.flatnonzero(first)]
        earlier = seen - base[np.cumsum(first) - 1]
        below += int((b[at] * earlier * ~zero).sum())
    at = np.lexsort((x, rank))
    new_y = np.concatenate(([True], rank[at][1:] != rank[at][:-1]))
    new_x = new_y | np.concatenate(([True], x[at][1:] != x[at][:-1]))
    before = np.concatenate(([0], np.cumsum(a[at])[:-1]))
    of_x = before[np.flatnonzero(new_x)][np.cumsum(new_x) - 1]  # sum before the first row with this x
    of_y = before[np.flatnonzero(new_y)][np.cumsum(new_y) - 1]
    return below, int((b[at] * (of_x - of_y)).sum())


def _cut(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """``name``: even for a range, odd (before the rest of its range) for a value that alone fills a chunk."""
    found = [x + 0.0 for x in cuts(df, F.col(column), n)]
    own = sorted({x for x in found if found.count(x) > 1})
    even = 2 * F.col(name).cast("int")
    return bucket(df, column, sorted(set(found)), name).withColumn(name, F.when(F.col(column).isin(own), even - 1).otherwise(even) if own else even)


def pair_sums(df: DataFrame, x: str, y: str, a: Column | None = None, b: Column | None = None) -> dict[str, int]:
    """below, equal, above: sums of a_i * b_j over pairs with x_i < x_j by the order of y_i and y_j.

    ``a`` and ``b`` are integer columns (1 if left out). Rows with a null or NaN
    in x or y are left out.
    """
    n = min(CELLS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    zero = F.lit(0.0)  # no negative zero
    own = df.select((F.col(x).cast("double") + zero).alias("x"), (F.col(y).cast("double") + zero).alias("y"), (a if a is not None else F.lit(1)).cast("long").alias("a"), (b if b is not None else F.lit(1)).cast("long").alias("b"))
    own = own.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    cut = _cut(_cut(own, "x", "chunk", n), "y", "bin", n)
    points = cut.groupBy("chunk", "bin", "x", "y").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).persist()
    try:
        return _sums(points)
    finally:
        points.unpersist()


def _sums(points: DataFrame) -> dict[str, int]:
    """``pair_sums`` of the distinct points (chunk, bin, x, y) with their sums a and b."""

    def inside(kind: str):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []

            def total() -> pd.DataFrame:
                g = pd.concat(held)
                if kind == "chunk":
                    found = counted(g.x.to_numpy(), g.y.to_numpy(), g.a.to_numpy(), g.b.to_numpy())
                else:
                    g = g.groupby(["chunk", "y"], as_index=False)[["a", "b"]].sum()
                    found = counted(g.chunk.to_numpy(), g.y.to_numpy(), g.a.to_numpy(), g.b.to_numpy())
                return pd.DataFrame({"below": [str(found[0])], "equal": [str(found[1])]})

            for batch in batches:
                for _, part in batch.groupby(kind, sort=False):
                    if held and held[-1][kind].iat[-1] != part[kind].iat[0]:
                        yield total()
                        held = []
                    held.append(part)
            if held:
                yield total()

        # a chunk of one x has no pairs; a bin of one y has ties alone, and its rows are one a chunk
        rows = points if kind == "bin" else points.filter("chunk % 2 = 0")
        if kind == "bin":
            rows = rows.groupBy("chunk", "bin", "y").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        dealt = rows.repartition(kind).sortWithinPartitions(kind)
        found = dealt.mapInPandas(count, "below string, equal string")
        return found.select(*(F.col(c).cast("decimal(38,0)").alias(c) for c in ("below", "equal")))

    both = inside("chunk").unionByName(inside("bin")).agg(F.sum("below").alias("below"), F.sum("equal").alias("equal")).first()
    cells = points.groupBy("chunk", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()  # CELLS squared at most
    across = counted(*(cells[c].to_numpy() for c in ("chunk", "bin", "a", "b")))[0] if len(cells) else 0
    tops = cells.groupby("chunk", sort=True)[["a", "b"]].sum()
    # all pairs with x_i < x_j: of different chunks by their totals, of one chunk by its distinct x
    sums_a, sums_b = [int(v) for v in tops.a], [int(v) for v in tops.b]
    all_pairs, seen = 0, 0
    for va, vb in zip(sums_a, sums_b, strict=True):
        all_pairs += seen * vb
        seen += va
    all_pairs += _within(points)
    below = int(both["below"] or 0) + across
    equal = int(both["equal"] or 0)
    return {"below": below, "equal": equal, "above": all_pairs - below - equal}


def _within(points: DataFrame) -> int:
    """Sum of a_i * b_j over pairs of one chunk with x_i < x_j."""
    per = points.filter("chunk % 2 = 0").groupBy("chunk", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("chunk").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    made = F.coalesce(F.sum("a").over(w), F.lit(0)).cast("decimal(19,0)") * F.col("b").cast("decimal(19,0)")
    return int(per.select(made.alias("v")).agg(F.sum("v")).first()[0] or 0)


def _ties(df: DataFrame, *columns: str) -> DataFrame:
    """n2, n3, n5: sums over the groups of equal values of t(t-1), t(t-1)(t-2), t(t-1)(2t+5)."""
    c = F.col("c").cast("double")
    g = df.groupBy(*columns).agg(F.count("*").alias("c"))
    return g.agg(F.sum(c * (c - 1)).alias("n2"), F.sum(c * (c - 1) * (c - 2)).alias("n3"), F.sum(c * (c - 1) * (2 * c + 5)).alias("n5"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, concordant, discordant, tau (b), z, p: normal p with tied variances.

    Pairs with a null are left out; a constant column or fewer than two rows
    give null for tau, z and p.
    """
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    sums = pair_sums(own, "x", "y")
    tx, ty, n = _ties(own, "x").first(), _ties(own, "y").first(), own.count()
    con, dis = sums["below"], sums["above"]
    pairs = n * (n - 1) / 2
    free_x, free_y = pairs - (tx["n2"] or 0) / 2, pairs - (ty["n2"] or 0) / 2
    tau = z = None
    if n > 1 and free_x > 0 and free_y > 0:
        tau = (con - dis) / (free_x * free_y) ** 0.5
        v = (n * (n - 1) * (2 * n + 5) - tx["n5"] - ty["n5"]) / 18 + tx["n2"] * ty["n2"] / (2 * n * (n - 1))
        v += tx["n3"] * ty["n3"] / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
        z = (con - dis) / v**0.5 if v > 0 else None
    row = [(n, float(con), float(dis), tau, z, normal_two_sided(z) if z is not None else None)]
    return df.sparkSession.createDataFrame(row, "n long, concordant double, discordant double, tau double, z double, p double")


def concordance(df: DataFrame, time: str, event: Column, risk: str, weight: Column | None = None) -> DataFrame:
    """permissible, concordant, tied, c_index: pairs in which the other outlasted an event, and had the lower risk.

    ``weight`` is how many rows a row stands for (1 if left out).
    """
    n = (weight if weight is not None else F.lit(1)).cast("long").alias("n")
    own = df.select(F.col(time).cast("double").alias("t"), (-F.col(risk).cast("double")).alias("low"), event.cast("long").alias("e"), n).filter("e is not null")
    s = pair_sums(own, "t", "low", F.col("e") * F.col("n"), F.col("n"))
    every = s["below"] + s["equal"] + s["above"]
    c = (s["below"] + s["equal"] / 2) / every if every else None
    return df.sparkSession.createDataFrame([(float(every), float(s["below"]), float(s["equal"]), c)], "permissible double, concordant double, tied double, c_index double")

