"""Row order at scale: lags, running totals and numbers without a single-task sort.

The order key's range is cut at approximate quantiles (one small aggregate) and
each chunk is sorted in a task of its own. What passes a chunk's border is
small: its last k values, its totals. That table has one row a chunk.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def place(df: DataFrame, column: str) -> Column:
    """A number that never falls as ``column`` rises: times in microseconds, text by its first six bytes."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind.startswith(("string", "char", "varchar")):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def cuts(df: DataFrame, key: Column, n: int) -> list[float]:
    """Approximate quantiles of ``key`` that cut its rows into n chunks; a frequent key is repeated."""
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    return [x for x in found if x == x]


def below(bounds: Column, value: Column, most: int) -> Column:
    """How many of the rising ``bounds`` (``most`` at most) are at or below ``value``, by halving steps; its expression is of one size."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, most).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def bucket(df: DataFrame, column: str, splits: list[float], name: str) -> DataFrame:
    """``name``: how many of the rising ``splits`` are at or below ``column`` (a double); nulls and NaN come last."""
    cut = [float("-inf"), *(splits or [0.0]), float("inf")]
    return Bucketizer(splits=cut, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def chunked(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` with its chunk number; rows without a key come last.

    A value of the first key that fills several chunks is cut again by the
    second key, if there is one, into a few more parts than chunks. The cuts of
    such values are a small table that is joined, so the plan doesn't grow with
    their number.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__key", place(df, order[0]) + F.lit(0.0))  # no negative zero
    found = [x + 0.0 for x in cuts(df, F.col("__key"), n)]
    splits = sorted(set(found))
    out = bucket(df, "__key", splits, _CHUNK)
    heavy = sorted({x for x in found if found.count(x) > 1})
    if heavy and len(order) > 1:
        many = F.percentile_approx(place(df, order[1]), [i / n for i in range(1, n)], 10_000)
        # a row for each of fewer than n keys
        inner = {r["__key"]: r["at"] or [] for r in df.filter(F.col("__key").isin(heavy)).groupBy("__key").agg(many.alias("at")).collect()}
        parts = []
        for key in heavy:
            step = max(1, n // (found.count(key) + 2))
            parts.append((key, splits.index(key) + 1.0, sorted(set(inner.get(key, [])[step - 1 :: step]))))
        table = df.sparkSession.createDataFrame(parts, "__own double, __home double, __at array<double>")
        most = max(len(at) for _, _, at in parts)
        # a heavy value's rows lie below half a chunk, the rest of its chunk above
        home, keys = F.broadcast(table.select("__home")), F.broadcast(table.select("__own", "__at"))
        out = out.join(keys, F.col("__key") == F.col("__own"), "left").join(home, F.col(_CHUNK) == F.col("__home"), "left")
        second = place(df, order[1])
        part = F.when(second.isNull(), most).otherwise(below(F.col("__at"), second, most)) / (2.0 * (most + 1))
        part = F.when(F.col("__own").isNotNull(), part).when(F.col("__home").isNotNull(), F.lit(0.5)).otherwise(0.0)
        out = out.withColumn(_CHUNK, F.col(_CHUNK) + part).drop("__own", "__at", "__home")
    return out.drop("__key")


def _within(order: list[str]):
    return Window.partitionBy(_CHUNK).orderBy(*(F.col(c).asc_nulls_last() for c in order))


def with_history(df: DataFrame, order: list[str], value: str, k: int, name: str = "history") -> DataFrame:
    """``name``: the k values (fewer at the start) before each row, oldest first; no nulls in ``value``."""
    cut = chunked(df, order)
    back = Window.partitionBy(_CHUNK).orderBy(*(F.col(c).desc_nulls_first() for c in order))
    tails = (
        cut.select(_CHUNK, *order, value)
        .withColumn("__n", F.row_number().over(back))
        .filter(F.col("__n") <= k)
        .groupBy(_CHUNK)
        .agg(F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("__n", value))), lambda e: e[value])).alias("t"))
    )
    before = Window.orderBy(_CHUNK).rowsBetween(-k, -1)  # one row a chunk
    carried = tails.select(_CHUNK, F.flatten(F.collect_list("t").over(before)).alias("__before"))
    inside = F.collect_list(value).over(_within(order).rowsBetween(-k, -1))
    every = F.concat("__before", F.col("__inside"))
    size = F.size(every)
    return (
        cut.withColumn("__inside", inside)
        .join(F.broadcast(carried), _CHUNK)
        .withColumn(name, F.when(size > k, F.slice(every, size - k + 1, k)).otherwise(every))
        .drop("__inside", "__before", _CHUNK)
    )


def previous(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the value of the row before within the same ``by`` (null at its first row).

    A group is spread over the chunks of the order; its last value of each
    chunk, one row a group and chunk, goes on to the group's next chunk.
    """
    cut = chunked(df, order)
    inside = Window.partitionBy(by, _CHUNK).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    tails = cut.groupBy(F.col(by).alias("__by"), F.col(_CHUNK).alias("__at")).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in order))).alias("__last"))
    before = Window.partitionBy("__by").orderBy("__at").rowsBetween(-1, -1)  # one row a chunk
    carried = tails.select("__by", "__at", F.first("__last").over(before).alias("__carry"))
    rows = cut.withColumns({"__in": F.lag(F.struct(F.col(value).alias("v"))).over(inside)})
    out = rows.join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col(_CHUNK) == F.col("__at")))
    return out.withColumn(name, F.coalesce("__in", "__carry")["v"]).drop("__in", "__by", "__at", "__carry", _CHUNK)


def running(df: DataFrame, order: list[str], **totals: tuple[str, str]) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` up to each row: name=(column, function)."""
    return running_in(chunked(df, order), order, **totals)


def running_in(cut: DataFrame, order: list[str], **totals: tuple[str, str]) -> DataFrame:
    """``running`` of rows that have their chunk number already."""
    per = cut.groupBy(_CHUNK).agg(*(getattr(F, f)(c).alias(f"__{n}") for n, (c, f) in totals.items()))
    before = Window.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    carried = per.select(_CHUNK, *(getattr(F, f)(f"__{n}").over(before).alias(f"__{n}") for n, (_, f) in totals.items()))
    upto = _within(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", *(getattr(F, f)(c).over(upto).alias(n) for n, (c, f) in totals.items()))
    out = out.join(F.broadcast(carried), _CHUNK)
    join = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "min": lambda a, b: F.least(a, b),
        "max": lambda a, b: F.greatest(a, b),
    }
    made = {n: join[f](F.col(f"__{n}"), F.col(n)) for n, (_, f) in totals.items()}
    return out.withColumns(made).drop(*(f"__{n}" for n in totals), _CHUNK)


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """``name``: the row's number from 0."""
    return (
        running(df.withColumn("__one", F.lit(1).cast("long")), order, **{name: ("__one", "sum")})
        .withColumn(name, F.col(name) - 1)
        .drop("__one")
    )


def last(history: Column, n: int) -> Column:
    """The last n items of an array; null if it has fewer."""
    return F.when(F.size(history) >= n, F.slice(history, -n, n))
