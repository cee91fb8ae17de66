"""Hypothesis tests from grouped sufficient statistics.

Data are read once into counts, sums or ranks; the statistic is a projection of
that small row and the p-value a tail function of it. Nulls are dropped on the
columns used; groups are in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualispark.functions.safe import over
from qualispark.operators import orderstats
from qualispark.functions.special import as_column, chi2_sf, f_sf, normal_two_sided, t_sf


#: Cells of a table of two columns' categories at most.
CATEGORY_CELLS = 1_000_000


def _clean(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    cols = [F.col(value).cast("double").alias("x")] + ([F.col(group).alias("g")] if group else [])
    out = df.select(*cols).filter("x is not null and not isnan(x)")
    return out.filter("g is not null") if group else out


def _stats(df: DataFrame, value: str, group: str) -> DataFrame:
    return _clean(df, value, group).groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))


def _with_p(out: DataFrame, f, *cols: str) -> DataFrame:
    return out.withColumn("p", as_column(f, *(F.col(c) for c in cols)))


def one_sample_t(df: DataFrame, value: str, mu: float = 0.0) -> DataFrame:
    out = _clean(df, value).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    out = out.withColumns({"t": over(F.col("mean") - mu, over(F.col("sd"), F.sqrt("n"))), "df": F.col("n") - 1, "d": over(F.col("mean") - mu, F.col("sd"))})
    return _with_p(out, t_sf, "t", "df")


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """One-sample t of a - b over complete pairs."""
    return one_sample_t(df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("x")), "x")


def _two(df: DataFrame, value: str, group: str) -> DataFrame:
    """The first and the last of two groups side by side."""
    g = _stats(df, value, group)
    return g.agg(
        F.count("*").alias("groups"),
        *(x for s, f in (("1", F.min_by), ("2", F.max_by)) for x in (f("n", "g").alias("n" + s), f("m", "g").alias("m" + s), f("v", "g").alias("v" + s))),
    ).filter(_exactly_two())


def _exactly_two() -> Column:
    """A condition on ``groups``: other than two is an error, not an empty result."""
    message = F.concat(F.lit("the test needs exactly two groups, found "), F.col("groups").cast("string"))
    return F.when(F.col("groups") == 2, True).otherwise(F.raise_error(message).cast("boolean"))


def two_sample_t(df: DataFrame, value: str, group: str, equal_var: bool = False) -> DataFrame:
    """Welch's t, or the pooled one."""
    o = _two(df, value, group)
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2")
    pooled = over((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    if equal_var:
        se, dof = F.sqrt(pooled * (over(1, n1) + over(1, n2))), (n1 + n2 - 2).cast("double")
    else:
        se = F.sqrt(over(v1, n1) + over(v2, n2))
        dof = over(F.pow(over(v1, n1) + over(v2, n2), 2), over(F.pow(over(v1, n1), 2), n1 - 1) + over(F.pow(over(v2, n2), 2), n2 - 1))
    diff = F.col("m1") - F.col("m2")
    out = o.select("n1", "n2", "m1", "m2", diff.alias("diff"), over(diff, se).alias("t"), dof.alias("df"), over(diff, F.sqrt(pooled)).alias("d"))
    return _with_p(out, t_sf, "t", "df")


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F, eta squared and omega squared; sums of squares about the group means."""
    g = _stats(df, value, group)
    grand = g.agg(over(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"))
    o = g.join(F.broadcast(grand)).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"),
    )
    o = o.withColumns({"df1": F.col("k") - 1, "df2": F.col("n") - F.col("k")})
    ms = over(F.col("ss_within"), F.col("df2"))
    total = F.col("ss_between") + F.col("ss_within")
    o = o.withColumns(
        {
            "f": over(over(F.col("ss_between"), F.col("df1")), ms),
            "eta_sq": over(F.col("ss_between"), total),
            "omega_sq": over(F.col("ss_between") - F.col("df1") * ms, total + ms),
        }
    )
    return _with_p(o, f_sf, "f", "df1", "df2")


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    g = _stats(df, value, group).withColumn("w", over(F.col("n"), F.col("v")))
    sums = g.agg(F.sum("w").alias("sw"), over(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("mw"), F.count("*").alias("k"))
    o = g.join(F.broadcast(sums)).groupBy("k").agg(
        F.sum(F.col("w") * F.pow(F.col("m") - F.col("mw"), 2)).alias("a"),
        F.sum(over(F.pow(1 - over(F.col("w"), F.col("sw")), 2), F.col("n") - 1)).alias("h"),
    )
    k = F.col("k")
    o = o.select(
        "k",
        over(over(F.col("a"), k - 1), 1 + over(2 * (k - 2), k * k - 1) * F.col("h")).alias("f"),
        (k - 1).alias("df1"),
        over(k * k - 1, 3 * F.col("h")).alias("df2"),
    )
    return _with_p(o, f_sf, "f", "df1", "df2")


def brown_forsythe_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F* with Satterthwaite's degrees of freedom."""
    g = _stats(df, value, group)
    sums = g.agg(F.sum("n").alias("t"), over(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"), F.count("*").alias("k"))
    c = (1 - over(F.col("n"), F.col("t"))) * F.col("v")
    o = g.join(F.broadcast(sums)).groupBy("k").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.sum(c).alias("c"), F.sum(over(c * c, F.col("n") - 1)).alias("cc")
    )
    o = o.select("k", over(F.col("b"), F.col("c")).alias("f"), (F.col("k") - 1).alias("df1"), over(F.col("c") * F.col("c"), F.col("cc")).alias("df2"))
    return _with_p(o, f_sf, "f", "df1", "df2")


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """ANOVA of distances to the group medians."""
    own = _clean(df, value, group)
    mid = orderstats.median(own, "x", ["g"], "mid").select("g", "mid")
    return one_way_anova(own.join(mid, "g").select("g", F.abs(F.col("x") - F.col("mid")).alias("dist")), "dist", "g")


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    g = _stats(df, value, group).filter("n > 1")
    o = g.agg(
        F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("d"), F.sum((F.col("n") - 1) * F.col("v")).alias("s"),
        F.sum((F.col("n") - 1) * F.log("v")).alias("l"), F.sum(over(1, F.col("n") - 1)).alias("r"),
    )
    k, d = F.col("k"), F.col("d")
    stat = over(d * F.log(over(F.col("s"), d)) - F.col("l"), 1 + over(F.col("r") - over(1, d), 3 * (k - 1)))
    return _with_p(o.select("k", stat.alias("t"), (k - 1).alias("df")), chi2_sf, "t", "df")


def f_test(df: DataFrame, value: str, group: str) -> DataFrame:
    o = _two(df, value, group).select("n1", "n2", over(F.col("v1"), F.col("v2")).alias("f"))
    one = as_column(f_sf, F.col("f"), F.col("n1") - 1, F.col("n2") - 1)
    return o.withColumn("upper", one).select("n1", "n2", "f", (2 * F.least("upper", 1 - F.col("upper"))).alias("p"))


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Average ranks by distinct values: counts are aggregated before they are ordered.

    The order runs over the distinct values' counts, cut into chunks, and the
    ranks go back by an equi-join, so no task sorts all rows.
    """
    from qualispark.operators.ordered import running

    counts = df.groupBy(value).agg(F.count("*").alias("__c"))
    placed = running(counts, [value], __upto=("__c", "sum"))
    placed = placed.select(value, (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name), F.col("__c").alias("ties"))
    return df.join(placed, value)


def _tie_sum() -> Column:
    """Sum of t^3 - t over tie groups, as a sum over rows."""
    return F.sum(F.col("ties").cast("double") * F.col("ties") - 1)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group, r = 1 - 2U/n1n2, normal p with continuity and ties."""
    r = average_ranks(_clean(df, value, group), "x")
    g = r.groupBy("g").agg(F.count("*").alias("n"), F.sum("rank").alias("s"), _tie_sum().alias("t"))
    o = g.agg(F.count("*").alias("groups"), F.min_by("n", "g").alias("n1"), F.max_by("n", "g").alias("n2"), F.min_by("s", "g").alias("s1"), F.sum("t").alias("ties")).filter(_exactly_two())
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    o = o.withColumn("u", F.col("s1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - over(F.col("ties"), n * (n - 1))))
    z = over(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, sd)
    o = o.select("n1", "n2", "u", (1 - over(2 * F.col("u"), n1 * n2)).alias("r"), z.alias("z"))
    return _with_p(o, normal_two_sided, "z")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H corrected for ties, epsilon squared."""
    r = average_ranks(_clean(df, value, group), "x")
    g = r.groupBy("g").agg(F.count("*").alias("n"), F.sum("rank").alias("s"), _tie_sum().alias("t"))
    o = g.agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(over(F.col("s") * F.col("s"), F.col("n"))).alias("q"), F.sum("t").alias("ties"))
    n = F.col("n")
    h = over(over(12, n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - over(F.col("ties"), n * n * n - n))
    o = o.select("k", h.alias("h"), (F.col("k") - 1).alias("df"), over(h, n - 1).alias("epsilon_sq"))
    return _with_p(o, chi2_sf, "h", "df")


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of non-zero differences; normal p with ties."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).filter("d is not null and d <> 0")
    r = average_ranks(d.withColumn("x", F.abs("d")), "x")
    o = r.agg(
        F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0)).alias("minus"), _tie_sum().alias("ties"),
    )
    n = F.col("n")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    o = o.select("n", F.least("plus", "minus").alias("w"), over(F.least("plus", "minus") - n * (n + 1) / 4, sd).alias("z"))
    return _with_p(o, normal_two_sided, "z")


def mood_median(df: DataFrame, value: str, group: str) -> DataFrame:
    own = _clean(df, value, group)
    mid = orderstats.median(own, "x", name="mid").select("mid")
    above = own.join(F.broadcast(mid)).select("g", (F.col("x") > F.col("mid")).alias("above"))
    return chi_square(above, "g", "above")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns; Yates for 2 x 2; Cramer's V."""
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count()
    rows, cols = n.groupBy("a").agg(F.sum("count").alias("ra")), n.groupBy("b").agg(F.sum("count").alias("cb"))
    sizes = n.agg(F.sum("count").alias("total"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    wide = sizes.first()
    if wide["r"] * wide["c"] > CATEGORY_CELLS:
        raise ValueError(f"{wide['r']} by {wide['c']} categories are too many for a table")
    grid = rows.crossJoin(cols).join(n, ["a", "b"], "left").join(F.broadcast(sizes))  # CATEGORY_CELLS rows at most
    e = over(F.col("ra") * F.col("cb"), F.col("total"))
    gap = F.abs(F.coalesce(F.col("count"), F.lit(0)) - e)
    gap = F.when((F.col("r") == 2) & (F.col("c") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    o = grid.groupBy("total", "r", "c").agg(F.sum(over(gap * gap, e)).alias("chi2"), F.count_if(e < 5).alias("sparse_cells"))
    o = o.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.sqrt(over(F.col("chi2"), F.col("total") * (F.least("r", "c") - 1))).alias("cramers_v"), "sparse_cells")
    return _with_p(o, chi2_sf, "chi2", "df")


def sign_test(df: DataFrame, value: str, median: float = 0.0) -> DataFrame:
    x = F.col(value).cast("double") - median
    o = df.agg(F.count_if(x > 0).alias("above"), F.count_if(x < 0).alias("below"))
    from qualispark.functions.special import binomial_cdf

    n, k = F.col("above") + F.col("below"), F.least("above", "below")
    p = as_column(lambda k, n: min(1.0, 2 * binomial_cdf(int(k), int(n), 0.5)), k, n)
    return o.withColumn("p", p)


def one_proportion(df: DataFrame, success: Column, p0: float = 0.5) -> DataFrame:
    """Share of rows with ``success``, Wilson interval and Cohen's h."""
    z = 1.959963984540054
    o = df.agg(F.count_if(success.isNotNull()).cast("double").alias("n"), F.count_if(success).cast("double").alias("k")).withColumn("share", F.col("k") / F.col("n"))
    n, p = F.col("n"), F.col("share")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return o.select("n", "k", "share", (mid - half).alias("low"), (mid + half).alias("high"), (2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(F.lit(p0)))).alias("h"))


def two_proportions(df: DataFrame, success: Column, group: str) -> DataFrame:
    g = df.filter(F.col(group).isNotNull() & success.isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").cast("double").alias("n"), F.count_if(success).cast("double").alias("k"))
    o = g.agg(F.count("*").alias("groups"), F.min_by("n", "g").alias("n1"), F.max_by("n", "g").alias("n2"), F.min_by("k", "g").alias("k1"), F.max_by("k", "g").alias("k2")).filter(_exactly_two())
    p1, p2 = F.col("k1") / F.col("n1"), F.col("k2") / F.col("n2")
    p = (F.col("k1") + F.col("k2")) / (F.col("n1") + F.col("n2"))
    o = o.select(p1.alias("p1"), p2.alias("p2"), ((p1 - p2) / F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2")))).alias("z"))
    return _with_p(o, normal_two_sided, "z")


def grubbs(df: DataFrame, value: str) -> DataFrame:
    """G of the most extreme value."""
    own = _clean(df, value)
    s = own.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    return own.join(F.broadcast(s)).groupBy("n", "m", "sd").agg(F.max(F.abs(F.col("x") - F.col("m"))).alias("far")).select("n", (F.col("far") / F.col("sd")).alias("g"))


def cochrans_q(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q over complete rows of 0/1 columns."""
    own = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    row = sum((F.col(c) for c in columns), F.lit(0.0))
    sums = own.agg(*(F.sum(c).alias(c) for c in columns), F.sum(row).alias("t"), F.sum(row * row).alias("rr"))
    k = len(columns)
    top = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    q = (k - 1) * (k * top - F.col("t") * F.col("t")) / (k * F.col("t") - F.col("rr"))
    return _with_p(sums.select(q.alias("q"), F.lit(k - 1).alias("df")), chi2_sf, "q", "df")


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Discordant counts with the corrected chi-square."""
    o = df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return _with_p(o.withColumns({"chi2": F.try_divide(gap * gap, n), "df": F.lit(1)}), chi2_sf, "chi2", "df")


def friedman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ranks within each complete row, chi-square corrected for ties."""
    own = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    below = lambda c: sum(((F.col(o) < F.col(c)).cast("int") for o in columns), F.lit(0))
    equal = lambda c: sum(((F.col(o) == F.col(c)).cast("int") for o in columns), F.lit(0))
    rank = [below(c) + (equal(c) + 1) / 2 for c in columns]
    ties = sum((F.pow(equal(c), F.lit(2)) - 1 for c in columns), F.lit(0.0))
    s = own.agg(F.count("*").cast("double").alias("n"), F.sum(ties).alias("t"), *(F.sum(r).alias(f"r{i}") for i, r in enumerate(rank)))
    k, n = len(columns), F.col("n")
    top = sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(k)), F.lit(0.0))
    chi = over(over(12, n * k * (k + 1)) * top - 3 * n * (k + 1), 1 - over(F.col("t"), n * k * (k * k - 1)))
    return _with_p(s.select("n", chi.alias("chi2"), F.lit(k - 1).alias("df")), chi2_sf, "chi2", "df")


def tost_one_sample(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Two one-sided t statistics against the bounds of equivalence."""
    o = _clean(df, value).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    se = F.col("s") / F.sqrt("n")
    o = o.select("n", ((F.col("m") - low) / se).alias("t_low"), ((F.col("m") - high) / se).alias("t_high"))
    one_sided = lambda t, n: t_sf(t, n - 1) / 2 if t > 0 else 1 - t_sf(t, n - 1) / 2
    p = F.greatest(as_column(one_sided, F.col("t_low"), F.col("n")), as_column(one_sided, -F.col("t_high"), F.col("n")))
    return o.withColumn("p", p)


def tost_two_sample(df: DataFrame, value: str, group: str, low: float, high: float) -> DataFrame:
    """Two one-sided pooled t tests of the difference of two groups against the bounds of equivalence."""
    o = two_sample_t(df, value, group, equal_var=True)
    se = over(F.col("diff"), F.col("t"))
    o = o.select("diff", "df", over(F.col("diff") - low, se).alias("t_low"), over(F.col("diff") - high, se).alias("t_high"))
    one_sided = lambda t, d: t_sf(t, d) / 2 if t > 0 else 1 - t_sf(t, d) / 2
    p = F.greatest(as_column(one_sided, F.col("t_low"), F.col("df")), as_column(one_sided, -F.col("t_high"), F.col("df")))
    return o.withColumn("p", p)


def fisher_exact(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """The 2 x 2 table of two conditions, its odds ratio and the two-sided hypergeometric p."""
    both = a.isNotNull() & b.isNotNull()
    o = df.filter(both).agg(
        F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n12"), F.count_if(~a & b).alias("n21"), F.count_if(~a & ~b).alias("n22")
    )
    ratio = F.try_divide(F.col("n11").cast("double") * F.col("n22"), F.col("n12").cast("double") * F.col("n21"))
    o = o.withColumn("odds_ratio", ratio)
    return _with_p(o, hypergeometric_two_sided, "n11", "n12", "n21", "n22")


def hypergeometric_two_sided(n11: float, n12: float, n21: float, n22: float) -> float:
    """Chance of all tables with the same margins that are no likelier than this one."""
    from math import exp, lgamma

    def choose(n: float, k: float) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    row, column, total = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    whole = choose(total, column)
    own = choose(row, n11) + choose(total - row, column - n11) - whole
    first, last = int(max(0, row + column - total)), int(min(row, column))
    logs = (choose(row, k) + choose(total - row, column - k) - whole for k in range(first, last + 1))
    return min(1.0, sum(exp(x) for x in logs if x <= own + 1e-7))


def runs(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Runs about the median (ties with it dropped) in row order; normal p."""
    from qualispark.operators.ordered import with_history

    own = df.select(*order, F.col(value).cast("double").alias("x")).filter("x is not null")
    mid = orderstats.median(own, "x", name="mid").select("mid")
    sides = own.join(F.broadcast(mid)).filter("x <> mid").select(*order, (F.col("x") > F.col("mid")).cast("int").alias("up"))
    h = with_history(sides, order, "up", 1)
    new = F.coalesce(F.get("history", F.lit(0)) != F.col("up"), F.lit(True))
    o = h.agg(F.count_if(new).cast("double").alias("runs"), F.sum("up").cast("double").alias("n1"), F.count_if(F.col("up") == 0).cast("double").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    mean = over(2 * n1 * n2, n) + 1
    sd = F.sqrt(over(2 * n1 * n2 * (2 * n1 * n2 - n), n * n * (n - 1)))
    return _with_p(o.withColumns({"expected": mean, "z": over(F.col("runs") - mean, sd)}), normal_two_sided, "z")


def _square(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def mcnemar_bowker(df: DataFrame, a: str, b: str) -> DataFrame:
    """Symmetry of the square table of two ratings; k (k - 1) / 2 degrees of freedom over the categories met."""
    n = _square(df, a, b)
    kinds = n.select("a").union(n.select("b")).agg(F.count_distinct("a").alias("k"))
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    pairs = n.filter("a <> b").groupBy(low, high).agg(F.sum(F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(-F.col("n"))).alias("gap"), F.sum("n").alias("both"))
    o = pairs.agg(F.coalesce(F.sum(F.col("gap") * F.col("gap") / F.col("both")), F.lit(0.0)).alias("chi2")).join(F.broadcast(kinds))
    return _with_p(o.select("chi2", (F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("df")), chi2_sf, "chi2", "df")


def stuart_maxwell(df: DataFrame, a: str, b: str) -> DataFrame:
    """Homogeneity of the margins of the square table of two ratings (categories alone reach the driver)."""
    import numpy as np

    cells = _square(df, a, b).limit(10_001).collect()
    if len(cells) > 10_000:
        raise ValueError("more than 10,000 pairs of ratings: these are no categories")
    names = sorted({r["a"] for r in cells} | {r["b"] for r in cells})
    table = np.zeros((len(names), len(names)))
    for r in cells:
        table[names.index(r["a"]), names.index(r["b"])] = r["n"]
    d = (table.sum(1) - table.sum(0))[:-1]
    s = -(table + table.T)[:-1, :-1]
    np.fill_diagonal(s, (table.sum(1) + table.sum(0) - 2 * np.diag(table))[:-1])
    chi = float(d @ np.linalg.pinv(s) @ d) if len(d) else 0.0
    return df.sparkSession.createDataFrame([(chi, len(d), chi2_sf(chi, len(d)) if len(d) else 1.0)], "chi2 double, df long, p double")


def rm_anova(df: DataFrame, value: str, subject: str, within: str) -> DataFrame:
    """F of one factor within subjects, over cell means; incomplete subjects are an error."""
    cells = df.select(F.col(subject).alias("s"), F.col(within).alias("w"), F.col(value).cast("double").alias("x")).na.drop().groupBy("s", "w").agg(F.avg("x").alias("x"))
    every = cells.agg(F.avg("x").alias("g"), F.count_distinct("s").alias("ns"), F.count_distinct("w").alias("nw"), F.count("*").alias("cells"), F.var_pop("x").alias("v"))
    by_s = cells.groupBy("s").agg(F.avg("x").alias("m")).join(F.broadcast(every)).agg(F.sum(F.pow(F.col("m") - F.col("g"), 2)).alias("ss_s"))
    by_w = cells.groupBy("w").agg(F.avg("x").alias("m")).join(F.broadcast(every)).agg(F.sum(F.pow(F.col("m") - F.col("g"), 2)).alias("ss_w"))
    o = every.join(F.broadcast(by_s)).join(F.broadcast(by_w))
    whole = F.when(F.col("cells") == F.col("ns") * F.col("nw"), F.col("cells")).otherwise(F.raise_error(F.lit("every subject needs every level")).cast("long"))
    treat, error = F.col("ss_w") * F.col("ns"), F.col("v") * whole - F.col("ss_s") * F.col("nw") - F.col("ss_w") * F.col("ns")
    o = o.select(treat.alias("ss_within"), error.alias("ss_error"), (F.col("nw") - 1).alias("df1"), ((F.col("nw") - 1) * (F.col("ns") - 1)).alias("df2"))
    o = o.withColumn("f", over(over(F.col("ss_within"), F.col("df1")), over(F.col("ss_error"), F.col("df2"))))
    return _with_p(o, f_sf, "f", "df1", "df2")


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """Largest distance to the fitted normal, and its limiting p; counts of distinct values are ordered in chunks."""
    from qualispark.functions.special import kolmogorov_sf, norm_cdf, tail
    from qualispark.operators.ordered import running

    own = _clean(df, value)
    s = own.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    placed = running(own.groupBy("x").agg(F.count("*").alias("c")), ["x"], upto=("c", "sum")).join(F.broadcast(s))
    cdf = placed.withColumn("f", tail(norm_cdf, (F.col("x") - F.col("m")) / F.col("sd")))
    d = F.greatest(F.col("upto") / F.col("n") - F.col("f"), F.col("f") - (F.col("upto") - F.col("c")) / F.col("n"))
    return _with_p(cdf.groupBy("n").agg(F.max(d).alias("d")), kolmogorov_sf, "d", "n")


def anderson_darling(df: DataFrame, value: str) -> DataFrame:
    """A squared against the fitted normal, its small-sample form and p; by distinct values and their counts."""
    from qualispark.functions.special import anderson_p, norm_cdf, tail
    from qualispark.operators.ordered import running

    own = _clean(df, value)
    s = own.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    placed = running(own.groupBy("x").agg(F.count("*").cast("double").alias("c")), ["x"], upto=("c", "sum")).join(F.broadcast(s))
    z = (F.col("x") - F.col("m")) / F.col("sd")
    cut = lambda v: max(v, 1e-300)
    logs = placed.withColumns({"low": F.log(tail(lambda v: cut(norm_cdf(v)), z)), "high": F.log(tail(lambda v: cut(norm_cdf(-v)), z))})
    before, c, n = F.col("upto") - F.col("c"), F.col("c"), F.col("n")
    # over the ranks before + 1 .. upto of equal values: sums of 2i - 1 and of 2(n - i) + 1
    first = c * (2 * before + c)
    last = c * (2 * (n - F.col("upto")) + c)
    o = logs.groupBy("n").agg((-F.col("n") - F.sum(first * F.col("low") + last * F.col("high")) / F.col("n")).alias("a2"))
    return _with_p(o.withColumn("a2_star", F.col("a2") * (1 + 0.75 / n + 2.25 / (n * n))), anderson_p, "a2_star")
