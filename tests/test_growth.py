"""Plans and passes that must not grow with the number of cuts, keys or steps."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from qualispark.functions.special import chi2_sf, f_sf, normal_two_sided
from qualispark.operators import multivariate, orderpairs, survival
from qualispark.operators.ordered import chunked, numbered


def plan_size(df):
    return len(df._jdf.queryExecution().analyzed().toString())


def test_many_frequent_first_keys_are_cut_by_a_joined_table(spark):
    """hosmer_lemeshow: 40 frequent scores and 120 chunks were 40 nested expressions of 119 literals each."""
    rng = np.random.default_rng(1)
    k = rng.integers(0, 40, 8000).astype(float)
    k[rng.random(8000) < 0.02] = -0.0
    i = rng.permutation(8000).astype(float)
    i[:50] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": k, "i": i, "j": np.arange(8000)})).withColumn("i", F.nanvl("i", F.lit(None).cast("double")))
    cut = chunked(df, ["k", "i", "j"], 120)
    assert plan_size(cut) < 20_000
    got = cut.toPandas().sort_values(["k", "i", "j"], na_position="last")
    assert len(got) == 8000 and (np.diff(got["__chunk"]) >= 0).all()
    assert got["__chunk"].nunique() >= 120 and got["__chunk"].value_counts().max() < 8000 / 40
    order = numbered(df, ["k", "i", "j"], "row").toPandas().sort_values("row")
    assert order["row"].tolist() == list(range(8000)) and order["j"].tolist() == got["j"].tolist()


def test_cuts_of_pairs_are_expressions_of_one_size(spark):
    """kendall: each halving step named the one before three times, and each held all cuts."""
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    small, large = (orderpairs._cut(df, "x", "chunk", n) for n in (4, 256))
    assert plan_size(large) < 1.5 * plan_size(small)
    assert large.agg(F.countDistinct("chunk")).first()[0] == 256
    zero = spark.createDataFrame([(-0.0, 1.0), (0.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert orderpairs.pair_sums(zero, "x", "y") == {"below": 2, "equal": 0, "above": 0}


def test_cox_reads_its_source_once(spark):
    rng = np.random.default_rng(2)
    n = 400
    rows = pd.DataFrame({"t": rng.integers(1, 30, n).astype(float), "e": rng.integers(0, 2, n), "x": rng.integers(0, 5, n).astype(float)})
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(rows).mapInPandas(counted, "t double, e long, x double")
    out = survival.cox(df, "t", F.col("e"), ["x"]).first()
    assert read.value == n
    apart = survival.cox(spark.createDataFrame(rows.assign(x=rows.x + rng.normal(size=n) * 1e-9)), "t", F.col("e"), ["x"]).first()
    assert out["n"] == n and abs(out["coef"] - apart["coef"]) < 1e-6 and abs(out["se"] - apart["se"]) < 1e-6 and abs(out["log_likelihood"] - apart["log_likelihood"]) < 1e-4


def test_discriminant_tells_classes_apart_in_many_rows(spark):
    """Scores shrink as rows grow in number; rounded at a fixed digit, rows near the border fell to the first class."""
    n = 400_000
    i = np.arange(n, dtype=np.int64)
    a, b = i * 7919 % 10_007 / 100.0, i * 104_729 % 99_991 / 1000.0
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("g"), (F.col("id") * 7919 % 10_007 / 100.0).alias("a"), (F.col("id") * 104_729 % 99_991 / 1000.0).alias("b"))
    got = {(r["actual"], r["predicted"]): r["n"] for r in multivariate.discriminant(df, ["a", "b"], "g").collect()}
    x, first = np.column_stack([a, b]), i % 2 == 0
    means = [x[first].mean(0), x[~first].mean(0)]
    within = sum((x[c] - m).T @ (x[c] - m) for c, m in zip((first, ~first), means, strict=True))
    told = (x - (means[0] + means[1]) / 2) @ np.linalg.solve(within / n, means[0] - means[1]) >= 0
    want = {("F", "F"): told[first].sum(), ("F", "O"): (~told[first]).sum(), ("O", "F"): told[~first].sum(), ("O", "O"): (~told[~first]).sum()}
    assert got == want


def test_tails_converge_at_any_size():
    for d in (2e4, 2e6, 4e7, 4e8):
        assert abs(f_sf(1.0, d, d) - 0.5) < 1e-6
        z = 1.5  # the logarithm of F is about normal
        assert abs(2 * f_sf(np.exp(z * 2 / np.sqrt(d)), d, d) - normal_two_sided(z)) < 20 / d + 1e-6
        assert abs(chi2_sf(d, d) - 0.5) < 1 / np.sqrt(d)
