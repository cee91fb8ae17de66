"""Row and column transforms. Each takes a DataFrame and gives a lazy one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.operators import orderstats
from qualispark.functions.expressions import compile_expression

TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")


def _known(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def compute(df: DataFrame, name: str, expression: str, overwrite: bool = False) -> DataFrame:
    if name in df.columns and not overwrite:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, compile_expression(expression, df.columns))


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(F.coalesce(compile_expression(expression, df.columns), F.lit(False)))


def recode(df: DataFrame, column: str, mapping: dict, default=None, new_column: str | None = None) -> DataFrame:
    """Keys are compared as text; what isn't mapped passes through, or is ``default``."""
    _known(df, column)
    text = F.col(column).cast("string")
    out: Column = F.lit(default) if default is not None else text
    if mapping:
        table = F.create_map(*(F.lit(str(x)) for kv in mapping.items() for x in kv))
        out = F.coalesce(F.try_element_at(table, text), out)
    return df.withColumn(new_column or column, out)


def retype(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Cast to number, int, date, bool or string; what can't be is null."""
    _known(df, column)
    c = F.col(column)
    low = F.lower(F.trim(c.cast("string")))
    whole = c.try_cast("double")
    cast = {
        "number": whole, "float": whole, "int": F.when(whole == F.floor(whole), whole.try_cast("long")),
        "date": c.try_cast("timestamp"), "datetime": c.try_cast("timestamp"), "string": c.cast("string"),
        "bool": F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False),
    }
    return df.withColumn(column, cast["bool" if kind == "boolean" else kind])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    _known(df, *mapping)
    return df.withColumnsRenamed(mapping)


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    _known(df, *columns)
    return df.drop(*columns)


def impute(df: DataFrame, column: str, strategy: str, value=None, order: list[str] | None = None) -> DataFrame:
    """mean, median, mode (the least of several), constant, ffill, bfill (by ``order``)."""
    _known(df, column)
    c = F.col(column)
    if strategy == "constant":
        return df.withColumn(column, F.coalesce(c, F.lit(value)))
    if strategy in ("ffill", "bfill"):
        from qualispark.operators.ordered import numbered

        # an island is a value and the empty rows after (before) it: numbered by values seen so far
        rows = numbered(df, order, "__row")
        sign = 1 if strategy == "ffill" else -1
        known = rows.filter(c.isNotNull()).select(F.col("__row").alias("__at"), c.alias("__value"))
        from qualispark.operators.ordered import running

        both = rows.withColumn("__pos", sign * F.col("__row")).withColumn("__seen", F.when(c.isNotNull(), F.col("__pos")))
        held = running(both, ["__pos"], __last=("__seen", "max"))
        out = held.join(known, sign * F.col("__last") == F.col("__at"), "left").withColumn(column, F.coalesce(c, "__value"))
        return out.select(*df.columns)
    if strategy == "median":
        fill = orderstats.median(df, column, name="__fill").select("__fill")
    else:
        fill = df.agg({"mean": F.avg(c), "mode": F.mode(c, True)}[strategy].alias("__fill"))
    return df.join(F.broadcast(fill)).withColumn(column, F.coalesce(c, "__fill")).drop("__fill")


def stack(df: DataFrame, ids: list[str], values: list[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    _known(df, *ids, *values)
    return df.unpivot(ids, values, var_name, value_name)


def unstack(df: DataFrame, ids: list[str], var: str, value: str, how: str = "first") -> DataFrame:
    """Wide by the sorted values of ``var``; rows with a null id go."""
    _known(df, *ids, var, value)
    f = {"first": F.first, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    keyed = df.filter(" and ".join(f"`{c}` is not null" for c in ids))
    names = [r[0] for r in keyed.select(var).distinct().filter(F.col(var).isNotNull()).orderBy(var).limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError(f"{var} has more than 10000 values")
    return keyed.groupBy(*ids).pivot(var, names).agg(f(value))


def log(df: DataFrame, column: str, new_column: str | None = None) -> DataFrame:
    """Natural log; if a value is 0 or less, all are shifted so that the least is 1."""
    low = df.agg(F.min(F.col(column).cast("double")).alias("__low"))
    shift = F.when(F.col("__low") <= 0, 1 - F.col("__low")).otherwise(0.0)
    return df.join(F.broadcast(low)).withColumn(new_column or f"log_{column}", F.log(F.col(column) + shift)).drop("__low")


def standardize(df: DataFrame, column: str, new_column: str | None = None) -> DataFrame:
    s = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    z = F.try_divide(F.col(column) - F.col("__m"), F.col("__s"))
    return df.join(F.broadcast(s)).withColumn(new_column or f"z_{column}", z).drop("__m", "__s")


def bin_column(df: DataFrame, column: str, bins: int, strategy: str = "equal_width", new_column: str | None = None) -> DataFrame:
    """Bin number from 0: right-closed, the least value in the first bin; equal quantile edges are merged."""
    c = F.col(column).cast("double")
    if strategy == "quantile":
        edges = orderstats.quantiles(df, column, {f"__e{i}": i / bins for i in range(bins + 1)})
        s = edges.select(F.array_sort(F.array_distinct(F.array(*(f"__e{i}" for i in range(bins + 1))))).alias("__e"))
        n = F.size(F.filter("__e", lambda e: e < c)) - 1
        out = F.when(c.isNotNull(), F.greatest(n, F.lit(0)))
        return df.join(F.broadcast(s)).withColumn(new_column or f"{column}_bin", out).drop("__e")
    s = df.agg(F.min(c).alias("__a"), F.max(c).alias("__b"))
    at = F.ceil((c - F.col("__a")) / ((F.col("__b") - F.col("__a")) / bins)) - 1
    out = F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0)))).cast("int"))
    return df.join(F.broadcast(s)).withColumn(new_column or f"{column}_bin", out).drop("__a", "__b")


def set_cell(df: DataFrame, key: str, at, column: str, value) -> DataFrame:
    _known(df, key, column)
    return df.withColumn(column, F.when(F.col(key) == F.lit(at), F.lit(value)).otherwise(F.col(column)))


def outliers(df: DataFrame, columns: list[str], policy: str = "iqr", k: float = 1.5) -> DataFrame:
    """``outlier``: whether any of the columns is beyond its fences."""
    out = df
    for i, c in enumerate(columns):  # one row each
        if policy == "iqr":
            stats = orderstats.quantiles(df, c, {"a": 0.25, "b": 0.75}).select(F.array("a", "b").alias(f"__s{i}"))
        elif policy == "zscore":
            x = F.col(c).cast("double")
            stats = df.agg(F.array(F.avg(x), F.stddev_samp(x)).alias(f"__s{i}"))
        else:
            stats = orderstats.mad(df, c).select(F.col("median").alias(f"__m{i}"), F.col("mad").alias(f"__d{i}"))
            stats = stats.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias(f"__m{i}"), F.lit(None).cast("double").alias(f"__d{i}")))
            stats = stats.agg(F.max(f"__m{i}").alias(f"__m{i}"), F.max(f"__d{i}").alias(f"__d{i}"))  # nulls if there is no value
        out = out.join(F.broadcast(stats))
    flag = F.lit(False)
    for i, c in enumerate(columns):
        x, s = F.col(c), F.col(f"__s{i}")
        if policy == "iqr":
            width = s[1] - s[0]
            far = (x < s[0] - k * width) | (x > s[1] + k * width)
        elif policy == "zscore":
            far = F.abs(x - s[0]) > k * s[1]
        else:
            far = F.abs(x - F.col(f"__m{i}")) > k * 1.4826 * F.col(f"__d{i}")
        flag = flag | F.coalesce(far, F.lit(False))
    return out.withColumn("outlier", flag).select(*df.columns, "outlier")


def boxcox_lambda(df: DataFrame, column: str, low: float = -3.0, high: float = 3.0, rounds: int = 4) -> float:
    """The likelihood's best power: a grid of 25 powers in each pass, then finer."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x > 0").withColumn("l", F.log("x"))
    best = 0.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / 24 for i in range(25)]
        made = [F.var_pop(F.when(F.lit(abs(g) < 1e-12), F.col("l")).otherwise((F.exp(g * F.col("l")) - 1) / (g if abs(g) >= 1e-12 else 1.0))).alias(f"v{i}") for i, g in enumerate(grid)]
        row = x.agg(F.count("x").alias("n"), F.sum("l").alias("s"), *made).first()
        import math

        like = [(-row["n"] / 2 * math.log(row[f"v{i}"]) + (g - 1) * row["s"] if row[f"v{i}"] else -math.inf, g) for i, g in enumerate(grid)]
        best = max(like)[1]
        step = (high - low) / 24
        low, high = best - step, best + step
    return best


def boxcox(df: DataFrame, column: str, new_column: str | None = None) -> DataFrame:
    """Box-Cox by maximum likelihood; null where not positive."""
    g = boxcox_lambda(df, column)
    x = F.col(column).cast("double")
    out = F.log(x) if abs(g) < 1e-9 else (F.pow(x, g) - 1) / g
    return df.withColumn(new_column or f"bc_{column}", F.when(x > 0, out))
