"""Data behind charts: small tables, whatever the size of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.operators import orderstats


def boxplot(df: DataFrame, value: str, group: str) -> DataFrame:
    marks = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return orderstats.quantiles(df.filter(F.col(group).isNotNull()), value, marks, [group])


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, low, high, n over the range; the last bin takes the maximum."""
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null")
    s = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    w = (F.col("b") - F.col("a")) / bins
    at = F.least(F.lit(bins - 1), F.floor(over(F.col("x") - F.col("a"), w))).cast("int")
    counts = x.join(F.broadcast(s)).groupBy(at.alias("bin"), "a", "b").count()
    return counts.select("bin", (F.col("a") + F.col("bin") * w).alias("low"), (F.col("a") + (F.col("bin") + 1) * w).alias("high"), F.col("count").alias("n"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows up to each distinct value; ordered in chunks."""
    from qualispark.operators.ordered import running

    c = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    return running(c, ["x"], upto=("n", "sum")).join(F.broadcast(total)).select("x", "n", over(F.col("upto"), F.col("all")).alias("share"))


def heatmap(df: DataFrame, x: str, y: str, value: str | None = None) -> DataFrame:
    """Counts, or means of ``value``, by two categories."""
    f = F.count("*").alias("v") if value is None else F.avg(value).alias("v")
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(f)


def sankey(df: DataFrame, steps: list[str], value: str | None = None) -> DataFrame:
    """Flows between neighbouring steps: step, source, target, weight."""
    w = F.count("*").cast("double") if value is None else F.sum(value)
    pairs = F.array(*(F.struct(F.lit(i).alias("step"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")) for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))))
    keep = [F.col(value)] if value else []
    return df.select(F.explode(pairs).alias("p"), *keep).groupBy("p.step", "p.source", "p.target").agg(w.alias("weight"))


def cohorts(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Active users by first month and months since."""
    m = df.select(F.col(user).alias("u"), F.trunc(F.col(ts).cast("date"), "month").alias("m")).na.drop().distinct()
    first = m.groupBy("u").agg(F.min("m").alias("cohort"))
    age = F.months_between("m", "cohort").cast("int")
    return m.join(first, "u").groupBy("cohort", age.alias("age")).agg(F.count_distinct("u").alias("users"))


def calendar(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Rows and mean by day."""
    return df.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).filter("day is not null")


def funnel(df: DataFrame, user: str, stage: str, stages: list[str]) -> DataFrame:
    """Users at each stage and their share of the first."""
    n = df.filter(F.col(stage).isin(*stages)).groupBy(stage).agg(F.count_distinct(user).alias("users"))
    first = n.filter(F.col(stage) == stages[0]).select(F.col("users").alias("first"))
    return n.join(F.broadcast(first)).select(stage, "users", over(F.col("users"), F.col("first")).alias("share"))


def venn(df: DataFrame, user: str, label: str, a: str, b: str) -> DataFrame:
    """Users with only a, only b, both."""
    u = df.groupBy(user).agg(F.max((F.col(label) == a).cast("int")).alias("a"), F.max((F.col(label) == b).cast("int")).alias("b"))
    return u.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


def main_effects(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """Mean of ``value`` at each level of each factor, in one pass."""
    levels = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))
    return df.select(F.explode(levels).alias("l"), F.col(value).alias("v")).groupBy("l.factor", "l.level").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def variability(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), F.stddev_samp(value).alias("sd"))


def waterfall(df: DataFrame, category: str, value: str) -> DataFrame:
    """Each category's sum with where its bar starts and ends."""
    g = df.groupBy(category).agg(F.sum(value).alias("v"))
    end = F.sum("v").over(Window.orderBy(category).rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("end", end).withColumn("start", F.col("end") - F.col("v"))
