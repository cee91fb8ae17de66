"""Tables behind charts of points, categories and periods, each with the meaning of its chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.operators import orderstats
from qualispark.operators.ordered import running

MISSING = "(missing)"
BINS = 2048


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def _number(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def cumsum(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """order, x, cumsum: the running sum of deviations from the mean; rows without a value are left out."""
    own = df.select(*order, _number(value).alias("x")).filter("x is not null")
    mean = own.agg(F.avg("x").alias("__mean"))
    moved = own.join(F.broadcast(mean)).withColumn("__d", F.col("x") - F.col("__mean")).drop("__mean")
    return running(moved, order, cumsum=("__d", "sum")).drop("__d")


def pyramid(df: DataFrame, column: str) -> DataFrame:
    """category, n, share of every category; a pyramid draws them by rising n."""
    n = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("all"))
    return n.join(F.broadcast(every)).select("category", "n", over(F.col("n"), F.col("all")).alias("share"))


def quadrant(df: DataFrame, x: str, y: str, keep: list[str] | None = None) -> DataFrame:
    """The complete points with the medians of x and y, and whether they lie right of and above them."""
    own = df.select(*(keep or []), _number(x).alias("x"), _number(y).alias("y")).filter("x is not null and y is not null")
    middle = orderstats.median(own, "x", name="x_median").select("x_median").join(F.broadcast(orderstats.median(own, "y", name="y_median").select("y_median")))
    return own.join(F.broadcast(middle)).withColumns({"right": F.col("x") >= F.col("x_median"), "top": F.col("y") >= F.col("y_median")})


def race(df: DataFrame, entity: str, time: str, value: str, order: list[str], top: int = 12) -> DataFrame:
    """step, entity, value, rank: the last value (by ``order``) of each entity in each time step, the ``top`` largest of a step."""
    own = df.select(_named(time).alias("step"), _named(entity).alias("entity"), _number(value).alias("value"), F.struct(*order).alias("at")).filter("value is not null")
    last = own.groupBy("step", "entity").agg(F.max_by("value", "at").alias("value"))
    within = Window.partitionBy("step").orderBy(F.col("value").desc(), "entity")
    return last.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)


def network(df: DataFrame, source: str, target: str, top: int = 50) -> DataFrame:
    """source, target, n, source_degree, target_degree: edges without loops among the ``top`` nodes by degree (rows at either end)."""
    edges = df.select(_named(source).alias("source"), _named(target).alias("target")).filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "n")
    nodes = ends.groupBy("node").agg(F.sum("n").alias("degree")).orderBy(F.col("degree").desc(), "node").limit(top)
    a, b = (nodes.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_degree")) for end in ("source", "target"))
    return edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target").select("source", "target", "n", "source_degree", "target_degree")


def timeline(df: DataFrame, label: str, start: str, end: str) -> DataFrame:
    """label, start, end of every row that has both, by start."""
    own = df.select(_named(label).alias("label"), F.col(start).alias("start"), F.col(end).alias("end"))
    return own.filter("start is not null and end is not null").orderBy("start", "end", "label")


def drift(df: DataFrame, value: str, period: str, points: int = 121) -> DataFrame:
    """period, i, x, density, mean, n: each period's kernel density on a shared grid, with one bandwidth of all rows.

    The grid reaches 5 % beyond the range; rows are counted in ``BINS`` first, a
    bin standing at its mean. All values equal give the density of a spike of
    bandwidth 1e-9 n ** (-1/5).
    """
    own = df.select(_named(period).alias("period"), _number(value).alias("v")).filter("v is not null")
    ends = own.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("all"), F.stddev_samp("v").alias("s"))
    width = F.col("high") - F.col("low")
    cut = own.join(F.broadcast(ends)).withColumn("bin", F.least(F.lit(BINS - 1), F.coalesce(F.floor(over(F.col("v") - F.col("low"), width) * BINS), F.lit(0))))
    bins = cut.groupBy("period", "bin").agg(F.count("*").alias("c"), F.avg("v").alias("at"))
    sizes = own.groupBy("period").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    pad = F.when(width > 0, 0.05 * width).otherwise(1.0)
    grid = bins.join(F.broadcast(ends)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    place = F.col("low") - pad + (width + 2 * pad) * F.col("i") / (points - 1)
    h = 1.06 * F.when(F.col("s") > 0, F.col("s")).otherwise(1e-9) * F.pow("all", F.lit(-0.2))
    kernel = F.col("c") * F.exp(-0.5 * F.pow((place - F.col("at")) / h, 2)) / (h * 2.5066282746310002)
    sums = grid.groupBy("period", "i").agg(F.first(place).alias("x"), F.sum(kernel).alias("k"))
    return sums.join(F.broadcast(sizes), "period").select("period", "i", "x", (F.col("k") / F.col("n")).alias("density"), "mean", "n")


def slope(df: DataFrame, entity: str, before: str, after: str, top: int = 50) -> DataFrame:
    """entity, before, after, delta: means of complete rows, the ``top`` largest rises."""
    own = df.select(_named(entity).alias("entity"), _number(before).alias("b"), _number(after).alias("a")).filter("a is not null and b is not null")
    means = own.groupBy("entity").agg(F.avg("b").alias("before"), F.avg("a").alias("after")).withColumn("delta", F.col("after") - F.col("before"))
    return means.orderBy(F.col("delta").desc(), "entity").limit(top)


def sunburst(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """inner, outer, n, share (of all), within (of the inner part)."""
    n = df.groupBy(_named(inner).alias("inner"), _named(outer).alias("outer")).agg(F.count("*").alias("n"))
    parts = n.groupBy("inner").agg(F.sum("n").alias("part"))
    every = n.agg(F.sum("n").alias("all"))
    return n.join(parts, "inner").join(F.broadcast(every)).select("inner", "outer", "n", over(F.col("n"), F.col("all")).alias("share"), over(F.col("n"), F.col("part")).alias("within"))


def multiline(df: DataFrame, time: str, value: str, group: str) -> DataFrame:
    """time, group, mean, n of each pair that has a value."""
    own = df.select(F.col(time).alias("time"), _named(group).alias("group"), _number(value).alias("v")).filter("time is not null and v is not null")
    return own.groupBy("time", "group").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def run_chart(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """order, x, median, side (-1, 0, 1), run: points about the median, runs of one side numbered from 1; points on it are in no run."""
    own = df.select(*order, _number(value).alias("x")).filter("x is not null")
    middle = orderstats.median(own, "x").select("median")
    sides = own.join(F.broadcast(middle)).withColumn("side", F.signum(F.col("x") - F.col("median")).cast("int"))
    from qualispark.operators.ordered import with_history

    off = with_history(sides.filter("side <> 0"), order, "side", 1, "__was")
    new = F.coalesce((F.try_element_at("__was", F.lit(1)) != F.col("side")).cast("long"), F.lit(1).cast("long"))
    counted = running(off.withColumn("__new", new).drop("__was"), order, run=("__new", "sum")).drop("__new")
    on = sides.filter("side = 0").withColumn("run", F.lit(None).cast("long"))
    return counted.unionByName(on)
