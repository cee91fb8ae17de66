"""Registered queries of the resampling, order-pair, survival, scan and grouped models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.catalogue import PF, PN, R, query, rounded, table
from qualispark.operators import cluster, control, distributions, likelihood, mixed, multivariate, orderpairs, orderstats, resample, smoothing, survival
from qualispark.streaming import live

# ------------------------------------------------------------ bootstrap

_MASK = "4294967295::UBIGINT"


def _mixed(rows: str, h: str = "h") -> str:
    """Rows with column h mixed, one step a subquery."""
    a, b = resample.MULTIPLIERS
    for step in ("xor({h}, {h} >> 16)", f"({{h}} * {a}::UBIGINT) & {_MASK}", "xor({h}, {h} >> 15)", f"({{h}} * {b}::UBIGINT) & {_MASK}", "xor({h}, {h} >> 15)"):
        rows = f"(SELECT * REPLACE ({step.format(h=h)} AS {h}) FROM {rows})"
    return rows


def _replicated(source: str, replicates: int) -> str:
    """CTEs o (g, x, h) and b (g, r, weighted sums w, s1, s2): keys below 2 ** 32, seed 0."""
    weight = " + ".join(f"(k >= {s})::INT" for s in resample.STEPS)
    turned = _mixed(f"(SELECT g, x, r, (h + ((r * {resample.GOLDEN}) & {_MASK})) & {_MASK} AS h FROM o, (SELECT unnest(range({replicates}))::UBIGINT AS r))")
    return f"""c AS (SELECT avg(x) AS c FROM {source}), o AS MATERIALIZED (SELECT g, x, h FROM {_mixed(f"(SELECT g, x - c AS x, key::UBIGINT AS h FROM {source}, c)")}),
 b AS (SELECT g, r, sum(w)::DOUBLE AS w, sum(w * x) AS s1, sum(w * x * x) AS s2 FROM (SELECT g, x, r, {weight} AS w FROM (SELECT g, x, r, h >> {32 - resample.TABLE_BITS} AS k FROM {turned})) GROUP BY g, r)"""


_LINES = "k AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS x, l_orderkey * 8 + l_linenumber AS key FROM lineitem WHERE l_quantity IS NOT NULL)"


def _line_key():
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")


def _interval(value: str, plain: str) -> str:
    return f"""WITH {_LINES}, {_replicated('k', 200)}, v AS (SELECT g, {value} AS v FROM b, c), p AS (SELECT g, count(*) AS n, {plain} AS e FROM k GROUP BY g)
 SELECT g AS l_returnflag, n, {R('any_value(e)', 'estimate')}, {R('quantile_cont(v, 0.025)', 'low')}, {R('quantile_cont(v, 0.975)', 'high')}, {R('stddev_samp(v)', 'se')} FROM p JOIN v USING (g) GROUP BY g, n"""


@query(_interval("c + s1 / w", "avg(x)"))
def bootstrap_mean(spark, sf):
    return rounded(resample.bootstrap(table(spark, sf, "lineitem"), "l_quantity", "mean", "l_returnflag", replicates=200, key=_line_key()))


@query(_interval("sqrt((s2 - s1 * s1 / w) / (w - 1))", "stddev_samp(x)"))
def bootstrap_std(spark, sf):
    return rounded(resample.bootstrap(table(spark, sf, "lineitem"), "l_quantity", "std", "l_returnflag", replicates=200, key=_line_key()))


def bootstrap_bca(spark, sf):
    """Bias-corrected and accelerated interval; tests hold it against plain resamples."""
    return rounded(resample.bootstrap(table(spark, sf, "lineitem"), "l_extendedprice", "mean", "l_returnflag", replicates=200, method="bca", key=_line_key()))


query()(bootstrap_bca)


@query(
    f"""WITH k AS (SELECT o_orderpriority AS g, o_totalprice::DOUBLE AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
 s AS (SELECT DISTINCT g, n, ceil(n * 0.5) AS k FROM k), j AS (SELECT g, n, k, unnest(range(greatest(1, (n / 2 - 4 * sqrt(n))::BIGINT), least(n, (n / 2 + 4 * sqrt(n))::BIGINT))) AS j FROM s),
 i AS (SELECT g, n, j, k, unnest(range(k::BIGINT, n + 1)) AS i FROM j),
 t AS (SELECT g, n, j, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(j / n) + (n - i) * ln(1 - j / n))) AS p FROM i GROUP BY g, n, j),
 r AS (SELECT g, min(j) FILTER (p >= 0.025) AS a, min(j) FILTER (p >= 0.975) AS b FROM t GROUP BY g)
 SELECT g AS o_orderpriority, n, {R('median(x)', 'estimate')}, {R('max(x) FILTER (i = a)', 'low')}, {R('max(x) FILTER (i = b)', 'high')}, NULL::DOUBLE AS se FROM k JOIN r USING (g) GROUP BY g, n"""
)
def bootstrap_median(spark, sf):
    return rounded(resample.bootstrap(table(spark, sf, "orders"), "o_totalprice", "median", "o_orderpriority"))


def _effect(kind: str, spark, sf) -> DataFrame:
    return rounded(resample.effect_size(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus", kind, replicates=200, key=_line_key()))


_STATUS = _LINES.replace("l_returnflag", "l_linestatus")
_SIDES = "SELECT {r} a.w AS n1, b.w AS n2, a.s1 / a.w - b.s1 / b.w AS gap, a.s2 - a.s1 * a.s1 / a.w AS q1, b.s2 - b.s1 * b.s1 / b.w AS q2 FROM {t} a JOIN {t} b ON a.g = 'F' AND b.g = 'O' {on}"


def _effect_sql(kind: str, value: str) -> str:
    return f"""WITH {_STATUS}, {_replicated('k', 200)}, q AS (SELECT g, count(*)::DOUBLE AS w, sum(x) AS s1, sum(x * x) AS s2 FROM o GROUP BY g),
 v AS (SELECT {value} AS v FROM ({_SIDES.format(r='', t='b', on='AND a.r = b.r')})), e AS (SELECT (n1 + n2)::BIGINT AS n, {value} AS e FROM ({_SIDES.format(r='', t='q', on='')}))
 SELECT '{kind}' AS kind, any_value(n) AS n, {R('any_value(e)', 'estimate', 7)}, {R('quantile_cont(v, 0.025)', 'low', 7)}, {R('quantile_cont(v, 0.975)', 'high', 7)} FROM v, e"""


@query(_effect_sql("cohens_d", "gap / sqrt((q1 + q2) / (n1 + n2 - 2))").replace(", 7)", ", 5)"))
def effect_cohens_d(spark, sf):
    return _effect("cohens_d", spark, sf)


@query(_effect_sql("glass_delta", "gap / sqrt(q2 / (n2 - 1))").replace(", 7)", ", 5)"))
def effect_glass_delta(spark, sf):
    return _effect("glass_delta", spark, sf)


@query(
    f"""WITH {_LINES}, {_replicated('k', 200)}, q AS (SELECT g, count(*)::DOUBLE AS w, sum(x) AS s1, sum(x * x) AS s2 FROM o GROUP BY g),
 v AS (SELECT (sum(s1 * s1 / w) - sum(s1) * sum(s1) / sum(w)) / (sum(s2) - sum(s1) * sum(s1) / sum(w)) AS v FROM b GROUP BY r),
 e AS (SELECT sum(w)::BIGINT AS n, (sum(s1 * s1 / w) - sum(s1) * sum(s1) / sum(w)) / (sum(s2) - sum(s1) * sum(s1) / sum(w)) AS e FROM q)
 SELECT 'eta_squared' AS kind, any_value(n) AS n, {R('any_value(e)', 'estimate')}, {R('quantile_cont(v, 0.025)', 'low')}, {R('quantile_cont(v, 0.975)', 'high')} FROM v, e"""
)
def effect_eta_squared(spark, sf):
    return rounded(resample.effect_size(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "eta_squared", replicates=200, key=_line_key()))


# ------------------------------------------------------------ order statistics


def normal_tolerance(spark, sf):
    return rounded(orderstats.normal_tolerance(table(spark, sf, "lineitem"), "l_extendedprice"))


query()(normal_tolerance)


@query(
    f"""WITH x AS (SELECT l_extendedprice::DOUBLE AS x, row_number() OVER (ORDER BY l_extendedprice) AS i FROM lineitem), n AS (SELECT count(*) AS n FROM x),
 p AS (SELECT n, k, exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln(0.05) + (n - k) * ln(0.95)) AS p FROM n, range(0, (SELECT n + 1 FROM n)) AS t(k)),
 t AS (SELECT n, k, sum(p) OVER (ORDER BY k DESC) AS up FROM p), m AS (SELECT n, max(k) AS m, arg_max(up, k) AS c FROM t WHERE up >= 0.95 GROUP BY n),
 w AS (SELECT n, c, a.i AS lr, b.i AS hr, a.x AS lo, b.x AS hi FROM m, x a JOIN x b ON b.i = a.i + (SELECT n - m + 1 FROM m) WHERE a.i <= m - 1)
 SELECT n, {R('lo', 'low')}, {R('hi', 'high')}, lr AS low_rank, hr AS high_rank, {R('c', 'achieved')} FROM w ORDER BY hi - lo, lr LIMIT 1"""
)
def free_tolerance(spark, sf):
    return rounded(orderstats.free_tolerance(table(spark, sf, "lineitem"), "l_extendedprice"))


# ------------------------------------------------------------ ordered pairs and survival


@query(
    f"""WITH k AS (SELECT o_totalprice::DOUBLE AS x, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS y FROM orders),
 s AS (SELECT sum((sign(a.x - b.x) * sign(a.y - b.y) > 0)::INT)::DOUBLE AS c, sum((sign(a.x - b.x) * sign(a.y - b.y) < 0)::INT)::DOUBLE AS d FROM k a JOIN k b ON a.x < b.x),
 n AS (SELECT count(*)::DOUBLE AS n FROM k), tx AS (SELECT sum(t * (t - 1)) AS n2, sum(t * (t - 1) * (t - 2)) AS n3, sum(t * (t - 1) * (2 * t + 5)) AS n5 FROM (SELECT count(*)::DOUBLE AS t FROM k GROUP BY x)),
 ty AS (SELECT sum(t * (t - 1)) AS n2, sum(t * (t - 1) * (t - 2)) AS n3, sum(t * (t - 1) * (2 * t + 5)) AS n5 FROM (SELECT count(*)::DOUBLE AS t FROM k GROUP BY y)),
 z AS (SELECT n, c, d, (c - d) / sqrt((n * (n - 1) / 2 - tx.n2 / 2) * (n * (n - 1) / 2 - ty.n2 / 2)) AS tau,
  (c - d) / sqrt((n * (n - 1) * (2 * n + 5) - tx.n5 - ty.n5) / 18 + tx.n2 * ty.n2 / (2 * n * (n - 1)) + tx.n3 * ty.n3 / (9 * n * (n - 1) * (n - 2))) AS z FROM s, n, tx, ty)
 SELECT n::BIGINT AS n, c AS concordant, d AS discordant, {R('tau', 'tau', 8)}, {R('z', 'z')}, {R(PN('z'), 'p')} FROM z"""
)
def kendall(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day"))
    out = orderpairs.kendall(orders, "o_totalprice", "day")
    return rounded(out.withColumn("tau", F.round("tau", 8)), "n", "concordant", "discordant", "z", "p").join(out.select(F.round("tau", 8).alias("tau")))


def _cox_sql(rounds: int = 8) -> str:
    """Newton's steps for one predictor, one step a CTE."""
    steps = []
    for i in range(rounds + 1):
        now = "0.0::DOUBLE" if i == 0 else f"(SELECT b FROM n{i - 1})"
        steps.append(
            f"""m{i} AS (SELECT t, sum(e) AS d, sum(e * x) AS dx, sum(exp(b * x)) AS w, sum(x * exp(b * x)) AS wx, sum(x * x * exp(b * x)) AS wxx, any_value(b) AS b FROM k, (SELECT {now} AS b) GROUP BY t),
 r{i} AS (SELECT t, d, dx, b, sum(w) OVER v AS w, sum(wx) OVER v AS wx, sum(wxx) OVER v AS wxx FROM m{i} WINDOW v AS (ORDER BY t DESC)),
 n{i} AS (SELECT any_value(b) AS b_at, any_value(b) + sum(dx - d * wx / w) / sum(d * (wxx / w - power(wx / w, 2))) AS b, sum(d * (wxx / w - power(wx / w, 2))) AS h, sum(b * dx - d * ln(w)) AS ll FROM r{i})"""
        )
    return ", ".join(steps)


@query(
    f"""WITH k AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS t, (l_returnflag = 'R')::INT AS e, l_quantity - (SELECT avg(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_cox_sql()},
 g AS (SELECT t, x, sum(e) AS e, count(*) AS n FROM k GROUP BY t, x), f AS (SELECT b_at AS b, 1 / sqrt(h) AS s, ll FROM n8),
 c AS (SELECT sum(a.e * b.n)::DOUBLE AS every, sum(CASE WHEN a.x * f.b > b.x * f.b THEN a.e * b.n WHEN a.x = b.x THEN 0.5 * a.e * b.n ELSE 0 END)::DOUBLE AS good FROM f, g a JOIN g b ON b.t > a.t)
 SELECT 'l_quantity' AS term, {R('b', 'coef', 7)}, {R('s', 'se', 7)}, {R('b / s', 'z')}, {R(PN('b / s'), 'p')}, {R('exp(b)', 'hazard_ratio', 7)}, {R('exp(b - 1.96 * s)', 'low', 7)}, {R('exp(b + 1.96 * s)', 'high', 7)},
  (SELECT count(*) FROM k) AS n, (SELECT sum(e) FROM k)::BIGINT AS events, {R('ll', 'log_likelihood', 3)}, {R('good / every', 'c_index')} FROM f, c"""
)
def cox(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lives = joined.select(F.datediff("l_shipdate", "o_orderdate").alias("days"), "l_returnflag", "l_quantity")
    out = survival.cox(lives, "days", F.col("l_returnflag") == "R", ["l_quantity"])
    digits = {"z": 5, "p": 5, "c_index": 5, "log_likelihood": 3}
    return out.select(*(F.round(c, digits.get(c, 7)).alias(c) + 0.0 if k == "double" else F.col(c) for c, k in out.dtypes)).toDF(*out.columns)


# ------------------------------------------------------------ recursions

_DAYS = "k AS (SELECT o_orderdate::DATE::VARCHAR AS day, sum(o_totalprice)::DOUBLE / 1e6 AS x, count(*)::DOUBLE AS c FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM k)"


def _days(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg((F.sum("o_totalprice").cast("double") / 1e6).alias("x"), F.count("*").cast("double").alias("c"))


@query(
    f"""WITH {_DAYS}, s AS (SELECT avg(x) AS mx, avg(c) AS mc, var_samp(x) AS a, covar_samp(x, c) AS b, var_samp(c) AS d FROM i),
 z AS (SELECT p.day, p.i, sum(0.2 * power(0.8, p.i - q.i) * (q.x - mx)) AS u, sum(0.2 * power(0.8, p.i - q.i) * (q.c - mc)) AS v FROM i p JOIN i q ON q.i <= p.i AND q.i > p.i - 180, s GROUP BY p.day, p.i),
 t AS (SELECT day, i + 1 AS i, (d * u * u - 2 * b * u * v + a * v * v) / (a * d - b * b) / (0.2 / 1.8 * (1 - power(0.8, 2 * (i + 1)))) AS t2, 2 + 2 * sqrt(2) * ln(2) + 4 AS ucl FROM z, s)
 SELECT day, {R('t2', 't2')}, {R('ucl', 'ucl')}, t2 > ucl AS out FROM t"""
)
def mewma(spark, sf):
    return rounded(control.mewma(_days(spark, sf), ["x", "c"], ["day"]))


@query(
    f"""WITH RECURSIVE {_DAYS}, h AS (
 SELECT 0 AS i, x AS l, (SELECT x FROM i WHERE i = 1) - x AS b, 0.0::DOUBLE AS sse, 0 AS n FROM i WHERE i = 0
 UNION ALL SELECT h.i + 1, 0.3 * x + 0.7 * (l + b), 0.1 * (0.3 * x + 0.7 * (l + b) - l) + 0.9 * b, sse + power(x - l - b, 2), n + 1 FROM h JOIN i ON i.i = h.i + 1),
 e AS (SELECT * FROM h ORDER BY i DESC LIMIT 1)
 SELECT s::INT AS step, {R('l + s * b', 'forecast')}, 0.3::DOUBLE AS alpha, 0.1::DOUBLE AS beta, NULL::DOUBLE AS gamma, {R('sse', 'sse')}, n::BIGINT AS n FROM e, range(1, 13) AS t(s)"""
)
def holt(spark, sf):
    return rounded(smoothing.forecast(_days(spark, sf), "x", ["day"], 12, trend=True, alpha=0.3, beta=0.1))


@query(
    f"""WITH RECURSIVE {_DAYS}, a AS (SELECT list(x ORDER BY i) AS f FROM i WHERE i < 14), h AS (
 SELECT 6 AS i, list_avg(f[1:7]) AS l, (list_avg(f[8:14]) - list_avg(f[1:7])) / 7 AS b, list_transform(f[1:7], lambda v: v - list_avg(f[1:7])) AS s, 0.0::DOUBLE AS sse, 0 AS n FROM a
 UNION ALL SELECT h.i + 1, 0.3 * (x - s[1]) + 0.7 * (l + b), 0.1 * (0.3 * (x - s[1]) + 0.7 * (l + b) - l) + 0.9 * b, list_append(s[2:7], 0.2 * (x - l - b) + 0.8 * s[1]), sse + power(x - l - b - s[1], 2), n + 1
 FROM h JOIN i ON i.i = h.i + 1), e AS (SELECT * FROM h ORDER BY i DESC LIMIT 1)
 SELECT k::INT AS step, {R('l + k * b + s[(k - 1) % 7 + 1]', 'forecast')}, 0.3::DOUBLE AS alpha, 0.1::DOUBLE AS beta, 0.2::DOUBLE AS gamma, {R('sse', 'sse')}, n::BIGINT AS n FROM e, range(1, 15) AS t(k)"""
)
def holt_winters(spark, sf):
    return rounded(smoothing.forecast(_days(spark, sf), "x", ["day"], 14, trend=True, season=7, alpha=0.3, beta=0.1, gamma=0.2))


@query(
    f"""WITH RECURSIVE {_DAYS}, h AS (
 SELECT 0 AS i, x AS l, (SELECT x FROM i WHERE i = 1) - x AS b, x, 0.0::DOUBLE AS f, day FROM i WHERE i = 0
 UNION ALL SELECT h.i + 1, 0.3 * i.x + 0.7 * (l + b), 0.1 * (0.3 * i.x + 0.7 * (l + b) - l) + 0.9 * b, i.x, l + b, i.day FROM h JOIN i ON i.i = h.i + 1)
 SELECT day, {R('x', 'x', 8)}, {R('l', 'level', 8)}, {R('b', 'trend', 8)}, {R('f', 'fitted', 8)} FROM h WHERE i > 0"""
)
def holt_fitted(spark, sf):
    return rounded(smoothing.smoothed(_days(spark, sf), "x", ["day"], 0.3, 0.1), digits=8)


def smoothing_fit(spark, sf):
    """Parameters by least squares; tests hold them against a plain search."""
    return rounded(smoothing.forecast(_days(spark, sf), "x", ["day"], 12, trend=True))


query()(smoothing_fit)

# ------------------------------------------------------------ grouped models


def _lmm_sql(rounds: int = 12) -> str:
    """The same profile likelihood for one predictor, its grid closing in."""
    like = "-0.5 * ((n - 2) * ln(2 * pi() * rss / (n - 2)) + (n - 2) + ld + ln(a00 * a11 - a01 * a01))"
    steps = ["w0 AS (SELECT -12.0::DOUBLE AS lo, 12.0::DOUBLE AS hi)"]
    for i in range(rounds):
        steps.append(
            f"""p{i} AS (SELECT lo + (hi - lo) * k / 12 AS e, (hi - lo) / 12 AS step, exp(lo + (hi - lo) * k / 12) AS r FROM w{i}, range(13) AS t(k)),
 f{i} AS (SELECT e, step, r, any_value(n_all) AS n, any_value(q00) - sum(r / (1 + r * n) * n * n) AS a00, any_value(q01) - sum(r / (1 + r * n) * n * sx) AS a01, any_value(q11) - sum(r / (1 + r * n) * sx * sx) AS a11,
   any_value(q0y) - sum(r / (1 + r * n) * n * sy) AS a0y, any_value(q1y) - sum(r / (1 + r * n) * sx * sy) AS a1y, any_value(qyy) - sum(r / (1 + r * n) * sy * sy) AS ayy, sum(ln(1 + r * n)) AS ld FROM p{i}, g, q GROUP BY e, step, r),
 l{i} AS (SELECT *, (a11 * a0y - a01 * a1y) / (a00 * a11 - a01 * a01) AS b0, (a00 * a1y - a01 * a0y) / (a00 * a11 - a01 * a01) AS b1 FROM f{i}),
 k{i} AS (SELECT *, {like} AS ll FROM (SELECT *, ayy - b0 * a0y - b1 * a1y AS rss FROM l{i})),
 w{i + 1} AS (SELECT arg_max(e, ll) - any_value(step) AS lo, arg_max(e, ll) + any_value(step) AS hi FROM k{i})"""
        )
    return ", ".join(steps)


@query(
    f"""WITH d AS (SELECT l_suppkey AS g, l_extendedprice::DOUBLE / 1000 + 5 * (l_suppkey % 7) AS y, l_quantity::DOUBLE AS x FROM lineitem), c AS (SELECT avg(x) AS mx, avg(y) AS my FROM d),
 e AS (SELECT g, x - mx AS x, y - my AS y FROM d, c), g AS (SELECT g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy FROM e GROUP BY g),
 q AS (SELECT count(*)::DOUBLE AS n_all, count(*)::DOUBLE AS q00, sum(x) AS q01, sum(x * x) AS q11, sum(y) AS q0y, sum(x * y) AS q1y, sum(y * y) AS qyy FROM e), {_lmm_sql()},
 b AS (SELECT *, rss / (n - 2) AS v, a00 * a11 - a01 * a01 AS det FROM k11 ORDER BY ll DESC LIMIT 1),
 t AS (SELECT 'intercept' AS term, b0 - b1 * mx + my AS coef, sqrt(v * (a11 + 2 * mx * a01 + mx * mx * a00) / det) AS se, b.* FROM b, c UNION ALL SELECT 'l_quantity', b1, sqrt(v * a00 / det), b.* FROM b)
 SELECT term, {R('coef', 'coef', 4)}, {R('se', 'se', 4)}, {R('coef / se', 'z', 2)}, {R(PN('coef / se'), 'p', 4)}, {R('coef - 1.959963984540054 * se', 'low', 4)}, {R('coef + 1.959963984540054 * se', 'high', 4)},
  {R('r * v', 'group_variance', 3)}, {R('v', 'residual_variance', 3)}, {R('r / (1 + r)', 'icc', 4)}, {R('ll', 'log_likelihood', 3)}, n::BIGINT AS n, (SELECT count(*) FROM g) AS groups FROM t"""
)
def lmm(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_extendedprice").cast("double") / 1000 + 5 * (F.col("l_suppkey") % 7)).alias("price"))
    out = mixed.lmm(lines, "price", ["l_quantity"], "l_suppkey")
    digits = {"z": 2, "group_variance": 3, "residual_variance": 3, "log_likelihood": 3}
    return out.select(*((F.round(c, digits.get(c, 4)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


def _gee_sql(rounds: int = 14) -> str:
    """Gaussian, exchangeable: every step from the sums of the groups."""
    steps = ["s0 AS (SELECT (SELECT avg(y) FROM d) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS a)"]
    for i in range(rounds + 1):
        steps.append(
            f"""u{i} AS (SELECT g.*, b0, b1, a, a / (1 + (n - 1) * a) AS c, sy - b0 * n - b1 * sx AS e, sxy - b0 * sx - b1 * sxx AS ex, syy - 2 * b0 * sy - 2 * b1 * sxy + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS ee FROM g, s{i}),
 v{i} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(a) AS a, sum((e - c * n * e) / (1 - a)) AS u0, sum((ex - c * sx * e) / (1 - a)) AS u1, sum((n - c * n * n) / (1 - a)) AS h00, sum((sx - c * n * sx) / (1 - a)) AS h01,
   sum((sxx - c * sx * sx) / (1 - a)) AS h11, sum(power((e - c * n * e) / (1 - a), 2)) AS m00, sum((e - c * n * e) / (1 - a) * (ex - c * sx * e) / (1 - a)) AS m01, sum(power((ex - c * sx * e) / (1 - a), 2)) AS m11,
   sum(ee) / (sum(n) - 2) AS scale, sum(e * e - ee) / 2 AS pairs, sum(n * (n - 1)) / 2 - 2 AS free, sum(n) AS n, count(*) AS groups FROM u{i}),
 s{i + 1} AS (SELECT b0 + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01) AS b1, pairs / (free * scale) AS a FROM v{i})"""
        )
    return ", ".join(steps)


@query(
    f"""WITH d AS (SELECT l_suppkey AS g, l_extendedprice::DOUBLE / 1000 + 5 * (l_suppkey % 7) AS y, l_quantity::DOUBLE AS x FROM lineitem),
 g AS (SELECT g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d GROUP BY g), {_gee_sql()},
 f AS (SELECT *, h00 * h11 - h01 * h01 AS det FROM v14),
 t AS (SELECT 'intercept' AS term, b0 AS coef, sqrt(h11 * h11 * m00 - 2 * h11 * h01 * m01 + h01 * h01 * m11) / det AS se, f.* FROM f
  UNION ALL SELECT 'l_quantity', b1, sqrt(h01 * h01 * m00 - 2 * h01 * h00 * m01 + h00 * h00 * m11) / det, f.* FROM f)
 SELECT term, {R('coef', 'coef')}, {R('se', 'se')}, {R('coef / se', 'z', 3)}, {R(PN('coef / se'), 'p')}, {R('coef - 1.959963984540054 * se', 'low')}, {R('coef + 1.959963984540054 * se', 'high')}, {R('a', 'alpha')}, {R('scale', 'scale')}, n::BIGINT AS n, groups FROM t"""
)
def gee(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_extendedprice").cast("double") / 1000 + 5 * (F.col("l_suppkey") % 7)).alias("price"))
    out = mixed.gee(lines, "price", ["l_quantity"], "l_suppkey")
    return out.select(*((F.round(c, 3 if c == "z" else 5) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


# ------------------------------------------------------------ likelihood fits and vectors


def _lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"), F.col("l_discount").cast("double").alias("d"))


def quantile_regression(spark, sf):
    """Tests hold it against the exact optimum over all pairs of points."""
    return rounded(likelihood.quantile_regression(_lines(spark, sf), "price", ["q"], 0.75), digits=3)


def ordinal_logit(spark, sf):
    """Tests hold it against a likelihood with numeric derivatives."""
    return rounded(likelihood.ordinal_logit(_lines(spark, sf), "l_returnflag", ["q", "price"]), digits=4)


query()(quantile_regression)
query()(ordinal_logit)


def _mixture_sql(rounds: int = 25) -> str:
    steps = ["s0 AS (SELECT quantile_cont(x, 0.25) AS m1, quantile_cont(x, 0.75) AS m2, stddev_samp(x) AS s1, stddev_samp(x) AS s2, 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2, NULL::DOUBLE AS ll, count(*) AS n FROM x)"]
    for i in range(rounds):
        steps.append(
            f"""d{i} AS (SELECT x, m1, m2, greatest(w1 / (s1 * sqrt(2 * pi())) * exp(-0.5 * power((x - m1) / s1, 2)), 1e-300) AS d1, greatest(w2 / (s2 * sqrt(2 * pi())) * exp(-0.5 * power((x - m2) / s2, 2)), 1e-300) AS d2 FROM x, s{i}),
 r{i} AS (SELECT x, m1, m2, d1 / (d1 + d2) AS p, ln(d1 + d2) AS l FROM d{i}),
 t{i} AS (SELECT sum(p) AS n1, sum(1 - p) AS n2, sum(p * (x - m1)) / sum(p) AS a1, sum((1 - p) * (x - m2)) / sum(1 - p) AS a2, sum(p * power(x - m1, 2)) / sum(p) AS q1, sum((1 - p) * power(x - m2, 2)) / sum(1 - p) AS q2, sum(l) AS ll, count(*) AS n, any_value(m1) AS m1, any_value(m2) AS m2 FROM r{i}),
 s{i + 1} AS (SELECT m1 + a1 AS m1, m2 + a2 AS m2, sqrt(q1 - a1 * a1) AS s1, sqrt(q2 - a2 * a2) AS s2, n1 / n AS w1, n2 / n AS w2, ll, n FROM t{i})"""
        )
    return ", ".join(steps)


@query(
    f"""WITH x AS (SELECT value::DOUBLE AS x FROM events WHERE value IS NOT NULL), {_mixture_sql()}, o AS (SELECT 1 AS component, m1 AS mean, s1 AS sd, w1 AS weight, ll, n FROM s25 UNION ALL SELECT 2, m2, s2, w2, ll, n FROM s25)
 SELECT component::INT AS component, {R('mean', 'mean', 4)}, {R('sd', 'sd', 4)}, {R('weight', 'weight', 4)}, {R('ll', 'log_likelihood', 2)}, {R('10 - 2 * ll', 'aic', 2)}, {R('5 * ln(n) - 2 * ll', 'bic', 2)}, 25::INT AS steps, n FROM o"""
)
def mixture(spark, sf):
    out = likelihood.mixture(table(spark, sf, "events"), "value", 2, steps=25, tolerance=0.0)
    digits = {"log_likelihood": 2, "aic": 2, "bic": 2}
    return out.select(*((F.round(c, digits.get(c, 4)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


_VECTORS = """x AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE / 1000 AS b FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb, count(*) AS n FROM x),
 s AS (SELECT g, count(*) AS n, avg(a) AS a, avg(b) AS b, sum(a * a) - count(*) * power(avg(a), 2) AS aa, sum(b * b) - count(*) * power(avg(b), 2) AS bb, sum(a * b) - count(*) * avg(a) * avg(b) AS ab FROM x GROUP BY g),
 w AS (SELECT sum(aa) AS waa, sum(bb) AS wbb, sum(ab) AS wab, sum(s.n * power(a - ma, 2)) AS baa, sum(s.n * power(b - mb, 2)) AS bbb, sum(s.n * (a - ma) * (b - mb)) AS bab, count(*) AS k, sum(s.n) AS n FROM s, m)"""


@query(
    f"""WITH {_VECTORS}, e AS (SELECT *, waa * wbb - wab * wab AS dw, (wbb * baa - 2 * wab * bab + waa * bbb) / (waa * wbb - wab * wab) AS tr, (baa * bbb - bab * bab) / (waa * wbb - wab * wab) AS de FROM w),
 r AS (SELECT *, (tr + sqrt(tr * tr - 4 * de)) / 2 AS r1, (tr - sqrt(tr * tr - 4 * de)) / 2 AS r2, n - k AS v, (n - k - 3) / 2.0 AS kk FROM e),
 f AS (SELECT 'wilks' AS statistic, 1 / ((1 + r1) * (1 + r2)) AS value, (sqrt((1 + r1) * (1 + r2)) - 1) * (2 * (v - 1)) / 4 AS f, 4.0 AS df1, 2.0 * (v - 1) AS df2 FROM r
 UNION ALL SELECT 'pillai', r1 / (1 + r1) + r2 / (1 + r2), (r1 / (1 + r1) + r2 / (1 + r2)) / (2 - r1 / (1 + r1) - r2 / (1 + r2)) * (2 * (2 * kk + 3)) / 4, 4.0, 2 * (2 * kk + 3) FROM r
 UNION ALL SELECT 'hotelling_lawley', r1 + r2, (4 + 6 / ((2 + 2 * kk) * (2 + 2 * kk) / (2 * (2 * kk + 1) * (kk - 1)) - 1)) / 4 * (r1 + r2) / ((2 + 6 / ((2 + 2 * kk) * (2 + 2 * kk) / (2 * (2 * kk + 1) * (kk - 1)) - 1)) / (2 * kk)), 4.0, 4 + 6 / ((2 + 2 * kk) * (2 + 2 * kk) / (2 * (2 * kk + 1) * (kk - 1)) - 1) FROM r
 UNION ALL SELECT 'roy', r1, v / 2.0 * r1, 2.0, v FROM r)
 SELECT statistic, {R('value', 'value', 7)}, {R('f', 'f')}, {R('df1', 'df1')}, {R('df2', 'df2', 3)}, {R(PF('f', 'df1', 'df2'), 'p')} FROM f"""
)
def manova(spark, sf):
    out = multivariate.manova(_lines(spark, sf), ["q", "price"], "l_returnflag")
    digits = {"value": 7, "df2": 3}
    return out.select(*((F.round(c, digits.get(c, 5)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(
    f"""WITH {_VECTORS}, c AS (SELECT m.n, ma - 25 AS da, mb - 50 AS db, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM x, m GROUP BY ALL), t AS (SELECT n, n * (bb * da * da - 2 * ab * da * db + aa * db * db) / (aa * bb - ab * ab) AS t2 FROM c),
 f AS (SELECT n, t2, t2 * (n - 2) / ((n - 1) * 2) AS f FROM t) SELECT n, {R('t2', 't2')}, {R('f', 'f')}, 2::INT AS df1, n - 2 AS df2, {R(PF('f', '2', '(n - 2)'), 'p')} FROM f"""
)
def hotelling_test(spark, sf):
    return rounded(multivariate.hotelling_test(_lines(spark, sf), ["q", "price"], [25.0, 50.0]))


_TWO = _VECTORS.replace("l_returnflag", "l_linestatus")


@query(
    f"""WITH {_TWO}, d AS (SELECT max(a) FILTER (g = 'F') - max(a) FILTER (g = 'O') AS da, max(b) FILTER (g = 'F') - max(b) FILTER (g = 'O') AS db, (max(a) FILTER (g = 'F') + max(a) FILTER (g = 'O')) / 2 AS ca, (max(b) FILTER (g = 'F') + max(b) FILTER (g = 'O')) / 2 AS cb FROM s),
 v AS (SELECT (wbb * da - wab * db) AS va, (waa * db - wab * da) AS vb, ca, cb FROM w, d), p AS (SELECT g AS actual, CASE WHEN va * (a - ca) + vb * (b - cb) >= 0 THEN 'F' ELSE 'O' END AS predicted FROM x, v),
 t AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL) SELECT actual, predicted, n, {R('(SELECT sum(n) FILTER (actual = predicted) / sum(n) FROM t)', 'accuracy')} FROM t"""
)
def discriminant(spark, sf):
    return rounded(multivariate.discriminant(_lines(spark, sf), ["q", "price"], "l_linestatus"))


@query(
    f"""WITH {_TWO}, d AS (SELECT max(a) FILTER (g = 'F') - max(a) FILTER (g = 'O') AS da, max(b) FILTER (g = 'F') - max(b) FILTER (g = 'O') AS db FROM s),
 v AS (SELECT wbb * da - wab * db AS va, waa * db - wab * da AS vb, w.* FROM w, d), u AS (SELECT *, sqrt(waa * va * va + 2 * wab * va * vb + wbb * vb * vb) * sign(CASE WHEN abs(va) >= abs(vb) THEN va ELSE vb END) AS z, (wbb * baa - 2 * wab * bab + waa * bbb) / (waa * wbb - wab * wab) AS r FROM v)
 SELECT 1::INT AS axis, {R('r', 'eigenvalue', 7)}, 1.0::DOUBLE AS share, 'q' AS "column", {R('va / z', 'weight', 7)} FROM u UNION ALL SELECT 1, {R('r', 'eigenvalue', 7)}, 1.0, 'price', {R('vb / z', 'weight', 7)} FROM u"""
)
def discriminant_axes(spark, sf):
    return rounded(multivariate.discriminant_axes(_lines(spark, sf), ["q", "price"], "l_linestatus"), digits=7)


@query(
    f"""WITH o AS (SELECT *, value::DOUBLE AS x, row_number() OVER w AS i FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
 m AS (SELECT *, avg(x) OVER w AS c, abs(x - lag(x) OVER (PARTITION BY event_type ORDER BY i)) AS r FROM o WINDOW w AS (PARTITION BY event_type ORDER BY i)),
 s AS (SELECT *, sum(coalesce(r, 0)) OVER w / nullif(i - 1, 0) / 1.128 AS s, sign(round(x - c, 9)) AS d FROM m WINDOW w AS (PARTITION BY event_type ORDER BY i)),
 b AS (SELECT *, (d = 0 OR d <> lag(d) OVER w OR i = 1)::INT AS nw FROM s WINDOW w AS (PARTITION BY event_type ORDER BY i)), k AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY i) AS run FROM b),
 t AS (SELECT *, CASE WHEN d <> 0 THEN row_number() OVER (PARTITION BY event_type, run ORDER BY i) END AS len FROM k), a AS (SELECT *, 'beyond_3sigma' AS rule FROM t WHERE i > 1 AND (x > c + 3 * s OR x < c - 3 * s) UNION ALL SELECT *, 'run_of_9' FROM t WHERE len = 9)
 SELECT event_type, event_id, {R('x', 'value')}, rule, {R('c', 'center', 4)}, {R('c - 3 * coalesce(s, 0)', 'lcl', 4)}, {R('c + 3 * coalesce(s, 0)', 'ucl', 4)} FROM a"""
)
def live_signals(spark, sf):
    """A stream over the files of events, ended when they are read."""
    told = live.signals_of_files(spark, f"{sf}/events.parquet", "event_type", ["ts", "event_id"], "value")
    return rounded(told.withColumns({c: F.round(c, 4) for c in ("center", "lcl", "ucl")}), "event_type", "event_id", "value", "rule", "center", "lcl", "ucl")


def kmeans(spark, sf):
    """Clusters of orders' lines; tests hold it against plain steps."""
    return rounded(cluster.kmeans(_lines(spark, sf), ["q", "price"], 3), digits=3)


query()(kmeans)


def distribution_id(spark, sf):
    """Fits of nine families; tests hold them against perturbed likelihoods and sorted samples."""
    return rounded(distributions.distribution_id(table(spark, sf, "lineitem"), "l_extendedprice"), digits=3)


query()(distribution_id)
