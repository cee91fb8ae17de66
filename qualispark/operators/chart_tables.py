"""More tables behind charts: each is one or two aggregates, small whatever the data.

Nulls in the columns used are dropped; results have one row a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.operators.ordered import running, with_history


def _numbers(df: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop()


def density(df: DataFrame, x: str, group: str | None = None, points: int = 241, bins: int = 2048) -> DataFrame:
    """Gaussian kernel density on a shared grid of ``points`` (12 % beyond the range), for each group if there is one.

    The bandwidth is 1.06 s n^(-1/5). Rows are counted in ``bins`` first, so
    that the grid meets bins, not rows; a bin stands at its mean.
    """
    keys = [group] if group else []
    own = _numbers(df, x, keep=tuple(keys))
    ends = own.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    own = own.join(F.broadcast(ends))
    bin_ = F.least(F.lit(bins - 1), F.floor(over(F.col(x) - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))) * bins))
    cut = own.groupBy(*keys, "low", "high", F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"), F.avg(x).alias("at"))
    spread = own.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp(x).alias("s"))
    cut = cut.join(F.broadcast(spread), keys) if keys else cut.join(F.broadcast(spread))
    width = F.col("high") - F.col("low")
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    grid = cut.select(*keys, "c", "at", "n", "s", step, (F.col("low") - 0.12 * width).alias("from"), (1.24 * width / (points - 1)).alias("by"))
    place, h = F.col("from") + F.col("by") * F.col("i"), 1.06 * F.col("s") * F.pow("n", F.lit(-0.2))
    grid = grid.withColumns({"x": place, "k": over(F.col("c") * F.exp(-0.5 * F.pow(over(place - F.col("at"), h), 2)), F.col("n") * h * 2.5066282746310002)})
    return grid.groupBy(*keys, "i").agg(F.first("x").alias("x"), F.sum("k").alias("density"))


def hexbin(df: DataFrame, x: str, y: str, columns: int = 30) -> DataFrame:
    """Counts on a grid of ``columns`` whose odd rows are moved by half a cell."""
    own = _numbers(df, x, y)
    ends = own.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    row = F.floor(over(F.col(y) - F.col("y0"), F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))) * columns)
    own = own.join(F.broadcast(ends)).withColumn("row", F.coalesce(row, F.lit(0)))
    across = over(F.col(x) - F.col("x0"), F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))) * columns
    return own.groupBy(F.coalesce(F.floor(across + F.when(F.col("row") % 2 == 1, 0.5).otherwise(0.0)), F.lit(0)).alias("column"), "row").agg(F.count("*").alias("n"))


def mosaic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts, the share of each a, and of each b within its a (also stacked bars and marimekko)."""
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    within, every = Window.partitionBy("a"), Window.partitionBy()  # one row a cell
    return n.withColumns({"width": over(F.sum("n").over(within), F.sum("n").over(every)), "height": over(F.col("n"), F.sum("n").over(within))})


def treemap(df: DataFrame, levels: list[str], value: str | None = None, most: int = 50) -> DataFrame:
    """Sums (or counts) of every level and its parents, the ``most`` largest leaves kept (also sunburst)."""
    size = F.sum(F.col(value).cast("double")) if value else F.count("*").cast("double")
    top = df.groupBy(*levels).agg(size.alias("size")).orderBy(F.col("size").desc(), *levels).limit(most)
    return top.rollup(*levels).agg(F.sum("size").alias("size"), F.grouping_id().alias("level"))


def bubble(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return _numbers(df, x, y, keep=(group,)).groupBy(group).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def ohlc(df: DataFrame, time: str, value: str, order: list[str], period: str = "day") -> DataFrame:
    """First, highest, lowest and last value of each period."""
    key, o = F.date_trunc(period, F.col(time)).alias("period"), F.struct(*order)
    return df.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(key).agg(
        F.min_by(value, o).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, o).alias("close"), F.count("*").alias("n")
    )


def range_band(df: DataFrame, time: str, value: str, period: str = "month") -> DataFrame:
    """Lowest, mean and highest value of each period (range area, range bars, spans)."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.date_trunc(period, F.col(time)).alias("period")).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))


def cumulative(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The running total at each row, null values left out."""
    return running(df.filter(F.col(value).isNotNull()), order, total=(value, "sum"))


def lag_pairs(df: DataFrame, value: str, order: list[str], lag: int = 1) -> DataFrame:
    """Each value and the one ``lag`` rows before it."""
    own = with_history(df.filter(F.col(value).isNotNull()), order, value, lag)
    return own.filter(F.size("history") == lag).withColumn("before", F.col("history")[0]).drop("history")


def slope_periods(df: DataFrame, group: str, time: str, value: str, period: str = "year") -> DataFrame:
    """Mean of the first and of the last period of each group."""
    per = df.groupBy(group, F.date_trunc(period, F.col(time)).alias("p")).agg(F.avg(value).alias("m"))
    return per.groupBy(group).agg(F.min_by("m", "p").alias("first"), F.max_by("m", "p").alias("last"))


def race_totals(df: DataFrame, group: str, time: str, value: str, period: str = "year") -> DataFrame:
    """Running total of each group by period, and its rank in the period."""
    per = df.groupBy(F.col(group).alias("g"), F.date_trunc(period, F.col(time)).alias("period")).agg(F.sum(value).alias("v"))
    upto = Window.partitionBy("g").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    within = Window.partitionBy("period").orderBy(F.col("total").desc(), "g")
    return per.withColumn("total", F.sum("v").over(upto)).withColumn("rank", F.row_number().over(within)).drop("v")


def stem_leaf(df: DataFrame, x: str, unit: float = 1.0) -> DataFrame:
    """Leaves (tens of the unit cut off) of each stem: how often each digit occurs."""
    own = _numbers(df, x).withColumn("v", F.floor(F.col(x) / unit))
    return own.groupBy(F.floor(F.col("v") / 10).alias("stem"), F.pmod("v", F.lit(10)).alias("leaf")).agg(F.count("*").alias("n"))


def wind_rose(df: DataFrame, angle: str, strength: str, sectors: int = 16, rings: list[float] = (10.0, 20.0, 50.0)) -> DataFrame:
    """Counts by sector of the angle (degrees) and ring of the strength."""
    own = _numbers(df, angle, strength)
    sector = F.floor(over(F.pmod(F.col(angle) + 180.0 / sectors, F.lit(360.0)), (360.0 / sectors)))
    ring = sum(((F.col(strength) >= r).cast("int") for r in rings), F.lit(0))
    return own.groupBy(sector.alias("sector"), ring.alias("ring")).agg(F.count("*").alias("n"))


def pyramid_sides(df: DataFrame, x: str, side: Column, width: float) -> DataFrame:
    """Counts of both sides by bins of ``width``."""
    own = df.filter(F.col(x).isNotNull() & side.isNotNull())
    return own.groupBy((F.floor(F.col(x).cast("double") / width) * width).alias("bin")).agg(F.count_if(side).alias("left"), F.count_if(~side).alias("right"))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts and means in the four quadrants about the means."""
    own = _numbers(df, x, y)
    means = own.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    cut = own.join(F.broadcast(means))
    return cut.groupBy((F.col(x) >= F.col("mx")).alias("right"), (F.col(y) >= F.col("my")).alias("top")).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def radar(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean of each column by group, scaled to the range of the column's means."""
    means = df.groupBy(F.col(group).alias("g")).agg(*(F.avg(c).alias(c) for c in columns))
    long = means.select("g", F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).alias("mean")) for c in columns))).alias("e")).select("g", "e.axis", "e.mean")
    w = Window.partitionBy("axis")  # one row a group
    return long.withColumn("scaled", F.try_divide(F.col("mean") - F.min("mean").over(w), F.max("mean").over(w) - F.min("mean").over(w)))


def network_degrees(df: DataFrame, source: str, target: str) -> DataFrame:
    """Edges with their counts, and the degrees of both ends."""
    e = df.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("n"))
    return e.withColumns({"out_degree": F.count("*").over(Window.partitionBy("source")), "in_degree": F.count("*").over(Window.partitionBy("target"))})


def timeline_spans(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """First start, last end and number of spans of each group."""
    return df.groupBy(F.col(group).alias("g")).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def drift_index(df: DataFrame, x: str, period: Column, baseline: Column, edges: list[float]) -> DataFrame:
    """Population stability index of each period against the baseline rows, over bins cut at ``edges``."""
    own = df.filter(F.col(x).isNotNull())
    bin_ = sum(((F.col(x) >= e).cast("int") for e in edges), F.lit(0)).alias("bin")
    n = own.groupBy(period.alias("period"), bin_).agg(F.count("*").alias("n"), F.count_if(baseline).alias("b"))
    every = n.select("period").distinct().select("period", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("bin"))
    filled = every.join(n, ["period", "bin"], "left").na.fill(0)
    base = filled.groupBy("bin").agg(F.sum("b").alias("base"))
    base = base.withColumn("q", over(F.col("base") + 0.5, F.sum("base").over(Window.partitionBy()) + 0.5 * (len(edges) + 1)))  # one row a bin
    p = over(F.col("n") + 0.5, F.sum("n").over(Window.partitionBy("period")) + 0.5 * (len(edges) + 1))
    return filled.withColumn("p", p).join(F.broadcast(base), "bin").groupBy("period").agg(F.sum("n").alias("n"), F.sum((F.col("p") - F.col("q")) * F.log(over(F.col("p"), F.col("q")))).alias("psi"))
