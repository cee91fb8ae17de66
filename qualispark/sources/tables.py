"""Reading delimited text, and the profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")


def sniff(lines: list[str]) -> tuple[int, str]:
    """Lines to skip (blank or comment, 20 at most) and the delimiter with the most even counts."""
    skip = 0
    while skip < min(20, len(lines)) and (not lines[skip].strip() or lines[skip].lstrip()[:1] in "#%"):
        skip += 1
    body = [x for x in lines[skip : skip + 20] if x.strip()]

    def even(d: str) -> int:
        n = [x.count(d) for x in body]
        return 10 * min(n) + 10 - (max(n) - min(n)) if n and max(n) else -1

    return skip, max(DELIMITERS, key=even)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header; columns over 95 % numeric become double, empty ones go.

    The head alone is looked at to find the delimiter; one aggregate finds the
    numeric columns.
    """
    skip, sep = sniff([r["value"] for r in spark.read.text(path).limit(40).collect()])
    read = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    df = (read.option("comment", "#") if skip else read).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    plain = lambda c: F.regexp_replace(F.col(f"`{c}`"), ",", "").try_cast("double")
    row = df.agg(*(F.struct(F.count(f"`{c}`").alias("n"), F.count(plain(c)).alias("k")).alias(f"s{i}") for i, c in enumerate(df.columns))).first()
    kept = [(c, row[f"s{i}"]) for i, c in enumerate(df.columns) if row[f"s{i}"]["n"]]
    return df.select(*(plain(c).alias(c) if s["k"] > 0.95 * s["n"] else F.col(f"`{c}`") for c, s in kept))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: kind, nulls, distinct values, range, mean and flags, in one pass."""
    kinds = dict(df.dtypes)
    kind = {c: "number" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "date" if t.startswith(("timestamp", "date")) else "bool" if t == "boolean" else "text" for c, t in kinds.items()}
    made = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        number = kind[c] == "number"
        d = x.try_cast("double") if number or kind[c] == "text" else F.lit(None).cast("double")
        made.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind[c]).alias("kind"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("n_null"), F.count_distinct(x).alias("n_unique"),
                F.min(d if number else F.lit(None).cast("double")).alias("min"), F.max(d if number else F.lit(None).cast("double")).alias("max"),
                F.avg(d if number else F.lit(None).cast("double")).alias("mean"), F.count(d).alias("n_numeric"),
            )
        )
    t = df.agg(F.array(*made).alias("x")).select(F.inline("x"))
    known = F.col("rows") - F.col("n_null")
    unique, null = F.try_divide(100.0 * F.col("n_unique"), known), F.try_divide(100.0 * F.col("n_null"), "rows")
    numeric = F.try_divide(100.0 * F.col("n_numeric"), known)
    flags = F.array_compact(
        F.array(
            F.when((F.col("kind") == "text") & (numeric >= 40) & (numeric < 100), "mixed"), F.when(F.col("n_unique") <= 1, "constant"),
            F.when(null >= 30, "many nulls").when(null >= 10, "some nulls"), F.when((F.col("kind") == "text") & (unique > 95) & (F.col("n_unique") > 20), "like an id"),
            F.when((F.col("kind") == "text") & (F.col("n_unique") > 20) & (F.col("n_unique") < known) & (unique > 50), "many values"),
        )
    )
    return t.withColumn("flags", F.array_join(flags, ",")).drop("n_numeric")


UNITS = {
    ("mm", "m"): 1e-3, ("cm", "m"): 1e-2, ("km", "m"): 1e3, ("in", "m"): 0.0254, ("ft", "m"): 0.3048, ("g", "kg"): 1e-3,
    ("lb", "kg"): 0.45359237, ("s", "min"): 1 / 60, ("min", "h"): 1 / 60, ("s", "h"): 1 / 3600, ("h", "d"): 1 / 24,
}


def materialize(sources: list[dict]) -> DataFrame:
    """One table of several sources: each {df, id, rename, columns, units, filter} in turn, by name."""
    out = None
    for s in sources:
        df = s["df"].withColumnsRenamed(s.get("rename", {}))
        if "columns" in s:
            df = df.select(*(c for c in s["columns"] if c in df.columns))
        for c, (a, b) in s.get("units", {}).items():
            factor = UNITS[a, b] if (a, b) in UNITS else 1 / UNITS[b, a] if (b, a) in UNITS else None
            if factor is None:
                raise ValueError(f"no conversion from {a} to {b}")
            df = df.withColumn(c, F.col(c).cast("double") * factor)
        if s.get("filter"):
            from qualispark.operators.wrangle import filter_rows

            df = filter_rows(df, s["filter"])
        df = df.withColumn("_source", F.lit(s["id"]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
