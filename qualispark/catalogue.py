"""The registered queries of the library and the SQL they are checked against.

Each query applies one operator to a whole table. Doubles are rounded so that
the order of summation doesn't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualispark.operators import capability as cap
from qualispark.operators import charts, control, models, posthoc, regression, wrangle
from qualispark.operators import chart_tables as tabs
from qualispark.operators import hypothesis as hyp
from qualispark.operators.ordered import numbered
from qualispark.sources.tables import profile
from qualispark.streaming.monitor import windowed_signals

QUERIES: dict = {}
ORACLES: dict = {}

#: Order of the events.
TIME = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'")


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    """The columns asked for, doubles rounded."""
    kinds = dict(df.dtypes)
    names = columns or tuple(df.columns)
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names))


def query(sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def R(expr: str, name: str, digits: int = 5) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"


def _area(f: str, upper: str, n: int = 2000) -> str:
    """SQL of the integral of ``f`` of y from 0 to ``upper`` (Simpson's rule); columns alone, no aggregates."""
    inner = re.sub(r"\by\b", f"(({upper}) * k / {n})", f)
    return f"(({upper}) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda k: (CASE WHEN k IN (0, {n}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {inner})))"


# Tails in SQL, by integration of the densities; independent of functions/special.py.
def PT(t: str, df: str) -> str:
    return f"1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * 3.141592653589793) * " + _area(f"power(1 + y * y / {df}, -({df} + 1) / 2.0)", f"least(abs({t}), 60.0)")


def PF(f: str, a: str, b: str) -> str:
    front = f"lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0) + {a} / 2.0 * ln({a}::DOUBLE / {b})"
    return "1 - 2 * " + _area(f"exp({front} + ({a} - 1.0) * ln(greatest(y, 1e-300)) - ({a} + {b}) / 2.0 * ln(1 + {a}::DOUBLE / {b} * y * y))", f"least(sqrt({f}), 60.0)")


def PC(x: str, k: str) -> str:
    return f"1 - 2 * exp(-lgamma({k} / 2.0) - {k} / 2.0 * ln(2)) * " + _area(f"power(y, {k} - 1.0) * exp(-y * y / 2)", f"least(sqrt({x}), 60.0)")


def PN(z: str) -> str:
    return PC(f"power({z}, 2)", "1")


P = """p AS (SELECT event_id, ts, user_id, value AS x, row_number() OVER (ORDER BY ts, event_id) AS i
  FROM events WHERE event_type = 'purchase' AND value IS NOT NULL)"""
MR = P + """, m AS (SELECT *, abs(x - lag(x) OVER (ORDER BY i)) AS mr FROM p),
 l AS (SELECT avg(x) AS c, avg(mr) AS b, avg(mr) / 1.128 AS s, stddev_samp(x) AS sd, count(*) AS n FROM m)"""

# ------------------------------------------------------------ control charts


@query(f"WITH {MR} SELECT n, {R('c', 'center')}, {R('s', 'sigma')}, {R('c + 3 * s', 'ucl')}, {R('c - 3 * s', 'lcl')}, {R('3.267 * b', 'mr_ucl')} FROM l")
def imr_limits(spark, sf):
    return rounded(control.imr_limits(purchases(spark, sf), "value", TIME), "n", "center", "sigma", "ucl", "lcl", "mr_ucl")


@query(f"WITH {MR} SELECT event_id, {R('x', 'x')}, {R('mr', 'mr')}, (x > c + 3 * s OR x < c - 3 * s) AS out, coalesce(mr > 3.267 * b, false) AS mr_out FROM m, l")
def imr_flags(spark, sf):
    return rounded(control.imr_flags(purchases(spark, sf), "value", TIME), "event_id", "x", "mr", "out", "mr_out")


def _frame(n: int, test: str) -> str:
    return f"(count(*) OVER w{n} = {n} AND {test})"


_RULES = f"""WITH {MR}, d AS (SELECT event_id, i, x - c AS d, s FROM m, l),
 t AS (SELECT *, d - lag(d) OVER (ORDER BY i) AS g FROM d),
 u AS (SELECT *, sign(g) * sign(lag(g) OVER (ORDER BY i)) AS a FROM t)
SELECT event_id, abs(d) > 3 * s AS r1,
 (count(*) OVER w9 = 9 AND (min(sign(d)) OVER w9 = 1 OR max(sign(d)) OVER w9 = -1)) AS r2,
 (count(g) OVER w5 = 5 AND (min(sign(g)) OVER w5 = 1 OR max(sign(g)) OVER w5 = -1)) AS r3,
 (count(a) OVER w12 = 12 AND max(a) OVER w12 < 0) AS r4,
 (count(*) OVER w3 = 3 AND (sum((d > 2 * s)::INT) OVER w3 >= 2 OR sum((d < -2 * s)::INT) OVER w3 >= 2)) AS r5,
 (count(*) OVER w5 = 5 AND (sum((d > s)::INT) OVER w5 >= 4 OR sum((d < -s)::INT) OVER w5 >= 4)) AS r6,
 (count(*) OVER w15 = 15 AND max(abs(d)) OVER w15 < min(s) OVER w15) AS r7,
 (count(*) OVER w8 = 8 AND min(abs(d)) OVER w8 > min(s) OVER w8) AS r8
FROM u WINDOW {', '.join(f'w{n} AS (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (3, 5, 8, 9, 12, 15))}"""


@query(_RULES)
def run_rules(spark, sf):
    return control.run_rules(purchases(spark, sf), "value", TIME).select("event_id", *(f"r{i}" for i in range(1, 9)))


@query(
    f"""WITH {P}, q AS (SELECT *, month(ts) AS ph FROM p), z AS (SELECT *, coalesce((lag(ph) OVER (ORDER BY i) <> ph)::INT, 1) AS nw FROM q),
 r AS (SELECT *, sum(nw) OVER (ORDER BY i) AS run FROM z), k AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY run ORDER BY i)) AS mr FROM r)
 SELECT run::BIGINT AS run, ph AS month, count(*) AS n, {R('avg(x)', 'center')}, {R('avg(mr) / 1.128', 'sigma')} FROM k GROUP BY run, ph"""
)
def phased_imr(spark, sf):
    df = purchases(spark, sf).withColumn("month", F.month("ts").cast("long"))
    return rounded(control.phased_imr(df, "value", "month", TIME))


_SUB = """g AS (SELECT l_orderkey AS p, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
 s AS (SELECT avg(x) AS m, max(x) - min(x) AS r, stddev_samp(x) AS d FROM g GROUP BY p, (i - 1) // 5 HAVING count(*) = 5)"""


def _subgroups(spark, sf):
    """All full subgroups of five lines of each order."""
    return control.subgrouped(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 5)


@query(f"WITH {_SUB} SELECT count(*) AS k, {R('avg(m)', 'center')}, {R('avg(r)', 'r_bar')}, {R('avg(m) + 0.577 * avg(r)', 'ucl')}, {R('avg(m) - 0.577 * avg(r)', 'lcl')}, {R('2.114 * avg(r)', 'r_ucl')}, 0.0::DOUBLE AS r_lcl FROM s")
def xbar_r(spark, sf):
    return rounded(control.xbar_r(_subgroups(spark, sf), "l_quantity", "subgroup"), "k", "center", "r_bar", "ucl", "lcl", "r_ucl", "r_lcl")


@query(f"WITH {_SUB} SELECT count(*) AS k, {R('avg(m)', 'center')}, {R('avg(d)', 's_bar')}, {R('avg(m) + 1.427 * avg(d)', 'ucl')}, {R('avg(m) - 1.427 * avg(d)', 'lcl')}, {R('2.089 * avg(d)', 's_ucl')}, 0.0::DOUBLE AS s_lcl FROM s")
def xbar_s(spark, sf):
    return rounded(control.xbar_s(_subgroups(spark, sf), "l_quantity", "subgroup"), "k", "center", "s_bar", "ucl", "lcl", "s_ucl", "s_lcl")


_SUB_ALL = """g AS (SELECT l_partkey AS p, l_quantity AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS i FROM lineitem),
 s AS (SELECT avg(x) AS m, max(x) - min(x) AS r, stddev_samp(x) AS d FROM g GROUP BY p, (i - 1) // 5 HAVING count(*) = 5)"""


def _subgroups_all(spark, sf):
    return control.subgrouped(table(spark, sf, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], 5)


@query(f"WITH {_SUB_ALL} SELECT count(*) AS k, {R('avg(m)', 'center')}, {R('avg(r)', 'r_bar')}, {R('avg(m) + 0.577 * avg(r)', 'ucl')}, {R('avg(m) - 0.577 * avg(r)', 'lcl')}, {R('2.114 * avg(r)', 'r_ucl')}, 0.0::DOUBLE AS r_lcl FROM s")
def xbar_r_all(spark, sf):
    return rounded(control.xbar_r(_subgroups_all(spark, sf), "l_quantity", "subgroup"), "k", "center", "r_bar", "ucl", "lcl", "r_ucl", "r_lcl")


@query(f"WITH {_SUB_ALL} SELECT count(*) AS k, {R('avg(m)', 'center')}, {R('avg(d)', 's_bar')}, {R('avg(m) + 1.427 * avg(d)', 'ucl')}, {R('avg(m) - 1.427 * avg(d)', 'lcl')}, {R('2.089 * avg(d)', 's_ucl')} FROM s")
def xbar_s_all(spark, sf):
    return rounded(control.xbar_s(_subgroups_all(spark, sf), "l_quantity", "subgroup"), "k", "center", "s_bar", "ucl", "lcl", "s_ucl")


_DAYS = """d AS (SELECT ts::DATE::VARCHAR AS day, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS bad FROM events GROUP BY 1)"""


def _days(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))


@query(f"""WITH {_DAYS}, c AS (SELECT sum(bad)::DOUBLE / sum(n) AS c FROM d), l AS (SELECT *, bad / n::DOUBLE AS p, 3 * sqrt(c * (1 - c) / n) AS h FROM d, c)
 SELECT day, {R('p', 'p')}, {R('least(1, c + h)', 'ucl')}, {R('greatest(0, c - h)', 'lcl')}, (p > least(1, c + h) OR p < greatest(0, c - h)) AS out FROM l""")
def p_chart(spark, sf):
    return rounded(control.p_chart(_days(spark, sf), "bad", "n"), "day", "p", "ucl", "lcl", "out")


@query(f"""WITH {_DAYS}, c AS (SELECT sum(bad)::DOUBLE / sum(n) AS c FROM d), l AS (SELECT *, bad / n::DOUBLE AS u, 3 * sqrt(c / n) AS h FROM d, c)
 SELECT day, {R('u', 'u')}, {R('c + h', 'ucl')}, {R('greatest(0, c - h)', 'lcl')}, (u > c + h OR u < greatest(0, c - h)) AS out FROM l""")
def u_chart(spark, sf):
    return rounded(control.u_chart(_days(spark, sf), "bad", "n"), "day", "u", "ucl", "lcl", "out")


@query(f"WITH {_DAYS} SELECT {R('avg(bad)', 'center')}, {R('avg(bad) + 3 * sqrt(avg(bad))', 'ucl')}, {R('greatest(0, avg(bad) - 3 * sqrt(avg(bad)))', 'lcl')} FROM d")
def c_chart(spark, sf):
    return rounded(control.c_chart(_days(spark, sf), "bad"))


@query(f"WITH {_DAYS} SELECT {R('avg(bad)', 'center')}, {R('least(1000, avg(bad) + 3 * sqrt(avg(bad) * (1 - avg(bad) / 1000)))', 'ucl')}, {R('greatest(0, avg(bad) - 3 * sqrt(avg(bad) * (1 - avg(bad) / 1000)))', 'lcl')} FROM d")
def np_chart(spark, sf):
    return rounded(control.np_chart(_days(spark, sf), "bad", 1000))


@query(f"""WITH {_DAYS}, c AS (SELECT sum(bad)::DOUBLE / sum(n) AS c FROM d), z AS (SELECT day, c, (bad / n::DOUBLE - c) / sqrt(c * (1 - c) / n) AS z FROM d, c),
 m AS (SELECT c, abs(z - lag(z) OVER (ORDER BY day)) AS mr FROM z), o AS (SELECT count(*) AS k, any_value(c) AS center, avg(mr) / 1.128 AS s FROM m)
 SELECT k, {R('center', 'center')}, {R('s', 'sigma_z')}, CASE WHEN s > 1.2 THEN 'over' WHEN s < 0.8 THEN 'under' ELSE 'none' END AS dispersion FROM o""")
def laney(spark, sf):
    return rounded(control.laney(_days(spark, sf).withColumn("day", F.to_date("day")), "bad", "n", ["day"]))


@query(f"""WITH {MR}, u AS (SELECT event_id, i, sd, sum(x - c - 0.5 * sd) OVER w AS pp, sum(c - 0.5 * sd - x) OVER w AS q FROM m, l WINDOW w AS (ORDER BY i)),
 v AS (SELECT *, pp - least(0, min(pp) OVER w) AS a, q - least(0, min(q) OVER w) AS b FROM u WINDOW w AS (ORDER BY i))
 SELECT event_id, {R('a', 'c_plus', 3)}, {R('b', 'c_minus', 3)}, (a > 4 * sd OR b > 4 * sd) AS out FROM v""")
def cusum(spark, sf):
    return rounded(control.cusum(purchases(spark, sf), "value", TIME), "event_id", "c_plus", "c_minus", "out", digits=3)


@query(f"""WITH RECURSIVE {MR}, z AS (SELECT i, event_id, c AS z FROM m, l WHERE i = 1 UNION ALL SELECT m.i, m.event_id, 0.2 * m.x + 0.8 * z.z FROM z JOIN m ON m.i = z.i + 1),
 k AS (SELECT event_id, z, c, 3 * sd * sqrt(0.2 / 1.8 * (1 - power(0.8, 2 * i))) AS h FROM z, l)
 SELECT event_id, {R('z', 'z')}, {R('c + h', 'ucl')}, {R('c - h', 'lcl')}, (z > c + h OR z < c - h) AS out FROM k""")
def ewma(spark, sf):
    return rounded(control.ewma(purchases(spark, sf), "value", TIME), "event_id", "z", "ucl", "lcl", "out")


@query(f"""WITH {MR}, a AS (SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN avg(x) OVER w END AS ma, c, sd FROM m, l WINDOW w AS (ORDER BY i ROWS 4 PRECEDING))
 SELECT event_id, {R('ma', 'ma')}, coalesce(abs(ma - c) > 3 * sd / sqrt(5), false) AS out FROM a""")
def moving_average(spark, sf):
    return rounded(control.moving_average(purchases(spark, sf), "value", TIME), "event_id", "ma", "out")


@query(f"""WITH {P}, q AS (SELECT i, power(x, 1 / 3.6) AS x FROM p WHERE x > 0), m AS (SELECT x, abs(x - lag(x) OVER (ORDER BY i)) AS mr FROM q),
 l AS (SELECT count(*) AS n, avg(x) AS c, avg(mr) / 1.128 AS s FROM m)
 SELECT n, {R('power(c, 3.6)', 'center', 3)}, {R('power(c + 3 * s, 3.6)', 'ucl', 3)}, {R('power(greatest(0, c - 3 * s), 3.6)', 'lcl', 3)} FROM l""")
def t_chart(spark, sf):
    return rounded(control.t_chart(purchases(spark, sf), "value", TIME), digits=3)


@query(f"""WITH g AS (SELECT avg(l_linenumber) AS mean, 1 / (avg(l_linenumber) + 1) AS p FROM lineitem)
 SELECT {R('mean', 'mean')}, {R('p', 'p')}, {R('greatest(0, ceil(ln(0.00135) / ln(1 - p)) - 1)', 'ucl')}, {R('greatest(0, ceil(ln(1 - 0.00135) / ln(1 - p)) - 1)', 'lcl')} FROM g""")
def g_chart(spark, sf):
    return rounded(control.g_chart(table(spark, sf, "lineitem"), "l_linenumber"))


@query(f"""WITH m AS (SELECT event_id, event_type, value AS x, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS mr FROM events WHERE value IS NOT NULL),
 s AS (SELECT event_type, avg(x) AS a, avg(mr) / 1.128 AS s FROM m GROUP BY 1 HAVING count(*) >= 2)
 SELECT event_id, event_type, {R('(x - a) / nullif(s, 0)', 'z')}, abs((x - a) / nullif(s, 0)) > 3 AS out FROM m JOIN s USING (event_type)""")
def z_mr(spark, sf):
    return rounded(control.z_mr(table(spark, sf, "events"), "value", "event_type", TIME), "event_id", "event_type", "z", "out")


@query(f"""WITH m AS (SELECT value - avg(value) OVER (PARTITION BY event_type) AS dev, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS mr FROM events WHERE value IS NOT NULL)
 SELECT count(dev) AS n, {R('avg(mr) / 1.128', 'sigma')}, {R('3 * avg(mr) / 1.128', 'ucl')}, {R('-3 * avg(mr) / 1.128', 'lcl')} FROM m""")
def short_run(spark, sf):
    return rounded(control.short_run(table(spark, sf, "events"), "value", "event_type", TIME))


# ------------------------------------------------- capability, Pareto, flow


@query(f"""WITH {MR} SELECT n, {R('c', 'mean')}, {R('100 / (6 * s)', 'cp')}, {R('least(100 - c, c) / (3 * s)', 'cpk')}, {R('100 / (6 * sd)', 'pp')}, {R('least(100 - c, c) / (3 * sd)', 'ppk')},
 {R('100 / (6 * sqrt(sd * sd + (c - 50) * (c - 50)))', 'cpm')} FROM l""")
def capability(spark, sf):
    return rounded(cap.capability(purchases(spark, sf), "value", TIME, 0.0, 100.0), "n", "mean", "cp", "cpk", "pp", "ppk", "cpm")


@query(f"""WITH q AS (SELECT quantile_cont(l_quantity, 0.00135) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.99865) AS c FROM lineitem)
 SELECT {R('b', 'median')}, {R('60 / (c - a)', 'pp')}, {R('least((60 - b) / (c - b), b / (b - a))', 'ppk')} FROM q""")
def clements(spark, sf):
    return rounded(cap.clements(table(spark, sf, "lineitem"), "l_quantity", 0.0, 60.0))


@query(f"""WITH {P}, r AS (SELECT event_id, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s FROM p WINDOW w AS (ORDER BY i ROWS 29 PRECEDING))
 SELECT event_id, {R('m', 'm', 4)}, {R('least(100 - m, m) / (3 * s)', 'cpk', 4)} FROM r WHERE n = 30""")
def rolling_cpk(spark, sf):
    return rounded(cap.rolling_cpk(purchases(spark, sf), "value", TIME, 0.0, 100.0), "event_id", "m", "cpk", digits=4)


@query(f"""WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)
 SELECT f AS factor, {R('least(60 - m, m) / (3 * s * f)', 'cpk')} FROM s, (VALUES (1.0::DOUBLE), (0.9), (0.8), (0.7), (0.5)) AS v(f)""")
def predictive_cpk(spark, sf):
    return rounded(cap.predictive_cpk(table(spark, sf, "lineitem"), "l_quantity", 0.0, 60.0))


_PARETO = """g AS (SELECT {c} AS category, {v} AS total FROM {t} GROUP BY 1), h AS (SELECT *, 100 * total / sum(total) OVER () AS share FROM g),
 k AS (SELECT *, sum(share) OVER w AS cum FROM h WINDOW w AS (ORDER BY total DESC, category ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_PARETO.format(c='p_type', v='count(*)::DOUBLE', t='part')} SELECT category, {R('total', 'total')}, {R('share', 'share')}, {R('cum', 'cum')}, coalesce(lag(cum) OVER (ORDER BY total DESC, category), 0) < 80 AS vital FROM k")
def pareto(spark, sf):
    return rounded(cap.pareto(table(spark, sf, "part"), "p_type"), "category", "total", "share", "cum", "vital")


@query(f"""WITH g AS (SELECT p_brand AS category, count(*)::DOUBLE AS n, sum(p_retailprice) AS cost FROM part GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS n_rank, row_number() OVER (ORDER BY cost DESC, category) AS cost_rank FROM g)
 SELECT category, {R('n', 'n')}, {R('cost', 'cost', 3)}, n_rank::INT AS n_rank, cost_rank::INT AS cost_rank, n_rank <> cost_rank AS disagrees FROM r""")
def cost_pareto(spark, sf):
    out = cap.cost_pareto(table(spark, sf, "part"), "p_brand", "p_retailprice")
    return rounded(out.withColumn("cost", F.round("cost", 3)), "category", "n", "cost", "n_rank", "cost_rank", "disagrees")


_STOP = ", ".join(f"'{w}'" for w in sorted(cap.STOP))
_STEM = "CASE WHEN regexp_full_match(w, '.{3,}ies') THEN substr(w, 1, length(w) - 3) || 'y' " + " ".join(
    f"WHEN regexp_full_match(w, '.{{3,}}{e}') THEN substr(w, 1, length(w) - {len(e)})" for e in ("ing", "ied", "es", "ed", "s")
) + " ELSE w END"


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) AS w FROM documents), s AS (SELECT {_STEM} AS term FROM t WHERE length(w) > 2 AND w NOT IN ({_STOP})),
 g AS (SELECT term, count(*) AS n FROM s GROUP BY 1) SELECT term, n, {R('100.0 * n / (SELECT sum(n) FROM g)', 'share')} FROM g ORDER BY n DESC, term LIMIT 25""")
def text_pareto(spark, sf):
    return rounded(cap.text_pareto(table(spark, sf, "documents"), "text", 25))


@query(f"""WITH {_DAYS}, s AS (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / sum(n) AS p FROM d), z AS (SELECT *, 1.959963984540054 AS z FROM s)
 SELECT {R('n', 'n')}, {R('p', 'rate')}, {R('p * 1e6', 'dpmo', 3)}, {R('(p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)', 'low')},
 {R('(p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)', 'high')} FROM z""")
def attribute_capability(spark, sf):
    out = cap.attribute_capability(_days(spark, sf), "bad", "n")
    return rounded(out.withColumn("dpmo", F.round("dpmo", 3)))


@query(f"""WITH d AS (SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT count(*) AS n, {R('avg(d)', 'mean')}, {R('quantile_cont(d, 0.5)', 'p50')}, {R('quantile_cont(d, 0.7)', 'p70')}, {R('quantile_cont(d, 0.85)', 'p85')}, {R('quantile_cont(d, 0.95)', 'p95')} FROM d WHERE d >= 0""")
def cycle_time(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(cap.cycle_time(j, "o_orderdate", "l_shipdate"))


# --------------------------------------------------------- hypothesis tests

_TWO = """g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
 t AS (SELECT arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(m, g) AS m1, arg_max(m, g) AS m2, arg_min(v, g) AS v1, arg_max(v, g) AS v2 FROM g)"""


@query(f"""WITH {_TWO}, z AS (SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, m1, m2, m1 - m2 AS diff, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS df,
 (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM t) SELECT n1, n2, {R('m1', 'm1')}, {R('m2', 'm2')}, {R('diff', 'diff')}, {R('t', 't')}, {R('df', 'df', 3)}, {R('d', 'd')}, {R(PT('t', 'df'), 'p')} FROM z""")
def welch_t(spark, sf):
    out = hyp.two_sample_t(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus")
    return rounded(out.withColumn("df", F.round("df", 3)))


@query(f"""WITH {_TWO}, z AS (SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, m1, m2, m1 - m2 AS diff, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS df,
 (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM t) SELECT n1, n2, {R('m1', 'm1')}, {R('m2', 'm2')}, {R('diff', 'diff')}, {R('t', 't')}, {R('df', 'df')}, {R('d', 'd')}, {R(PT('t', 'df'), 'p')} FROM z""")
def pooled_t(spark, sf):
    return rounded(hyp.two_sample_t(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus", True))


@query(f"""WITH {_TWO}, z AS (SELECT n1, n2, v1 / v2 AS f FROM t), q AS (SELECT *, {PF('f', '(n1 - 1)', '(n2 - 1)')} AS u FROM z)
 SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, {R('f', 'f')}, {R('2 * least(u, 1 - u)', 'p')} FROM q""")
def f_test(spark, sf):
    return rounded(hyp.f_test(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus"))


@query(f"""WITH s AS (SELECT count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem), z AS (SELECT *, (mean - 25) / (sd / sqrt(n)) AS t, n - 1 AS df FROM s)
 SELECT n, {R('mean', 'mean')}, {R('sd', 'sd')}, {R('t', 't')}, df, {R('(mean - 25) / sd', 'd')}, {R(PT('t', 'df'), 'p')} FROM z""")
def one_sample_t(spark, sf):
    return rounded(hyp.one_sample_t(table(spark, sf, "lineitem"), "l_quantity", 25.0))


@query(f"""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem), s AS (SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d), z AS (SELECT *, mean / (sd / sqrt(n)) AS t, n - 1 AS df FROM s)
 SELECT n, {R('mean', 'mean')}, {R('sd', 'sd')}, {R('t', 't')}, df, {R('mean / sd', 'd')}, {R(PT('t', 'df'), 'p')} FROM z""")
def paired_t(spark, sf):
    return rounded(hyp.paired_t(table(spark, sf, "lineitem"), "l_discount", "l_tax"))


_GROUPS = "g AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)"


@query(f"""WITH {_GROUPS}, a AS (SELECT sum(n * m) / sum(n) AS gm FROM g), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * (m - gm) * (m - gm)) AS b, sum((n - 1) * v) AS w FROM g, a),
 z AS (SELECT *, k - 1 AS df1, (n - k)::BIGINT AS df2, b / (k - 1) / (w / (n - k)) AS f FROM s)
 SELECT k, n::BIGINT AS n, {R('b', 'ss_between', 3)}, {R('w', 'ss_within', 1)}, df1, df2, {R('f', 'f')}, {R('b / (b + w)', 'eta_sq', 7)}, {R('(b - (k - 1) * w / (n - k)) / (b + w + w / (n - k))', 'omega_sq', 7)}, {R(PF('f', 'df1', 'df2'), 'p')} FROM z""")
def anova(spark, sf):
    out = hyp.one_way_anova(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    digits = {"ss_between": 3, "ss_within": 1, "f": 5, "eta_sq": 7, "omega_sq": 7, "p": 5}
    return out.withColumns({c: F.round(c, d) + 0.0 for c, d in digits.items()})


@query(f"""WITH {_GROUPS}, w AS (SELECT *, n / v AS w FROM g), s AS (SELECT sum(w) AS sw, sum(w * m) / sum(w) AS mw, count(*) AS k FROM w),
 h AS (SELECT any_value(k) AS k, sum(w * (m - mw) * (m - mw)) AS a, sum((1 - w / sw) * (1 - w / sw) / (n - 1)) AS h FROM w, s),
 z AS (SELECT k, k - 1 AS df1, (a / (k - 1)) / (1 + 2.0 * (k - 2) / (k * k - 1) * h) AS f, (k * k - 1) / (3 * h) AS df2 FROM h)
 SELECT k, {R('f', 'f')}, df1, {R('df2', 'df2', 3)}, {R(PF('f', 'df1', 'df2'), 'p')} FROM z""")
def welch_anova(spark, sf):
    return rounded(hyp.welch_anova(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").withColumn("df2", F.round("df2", 3)))


@query(f"""WITH {_GROUPS}, s AS (SELECT sum(n) AS t, sum(n * m) / sum(n) AS gm, count(*) AS k FROM g), c AS (SELECT *, (1 - n / t) * v AS c FROM g, s),
 z AS (SELECT any_value(k) AS k, sum(n * (m - gm) * (m - gm)) / sum(c) AS f, any_value(k) - 1 AS df1, sum(c) * sum(c) / sum(c * c / (n - 1)) AS df2 FROM c)
 SELECT k, {R('f', 'f')}, df1, {R('df2', 'df2', 3)}, {R(PF('f', 'df1', 'df2'), 'p')} FROM z""")
def brown_forsythe(spark, sf):
    return rounded(hyp.brown_forsythe_anova(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").withColumn("df2", F.round("df2", 3)))


@query(f"""WITH m AS (SELECT l_returnflag AS g, median(l_quantity) AS md FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag AS g, abs(l_quantity - md) AS x FROM lineitem JOIN m ON l_returnflag = g),
 g AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
 z AS (SELECT count(*) - 1 AS df1, (sum(n) - count(*))::BIGINT AS df2, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM g, a)
 SELECT df1, df2, {R('f', 'f')}, {R(PF('f', 'df1', 'df2'), 'p')} FROM z""")
def levene(spark, sf):
    return rounded(hyp.levene(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), "df1", "df2", "f", "p")


@query(f"""WITH {_GROUPS}, s AS (SELECT count(*) AS k, sum(n - 1) AS d, sum((n - 1) * v) AS s, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS r FROM g),
 z AS (SELECT k, k - 1 AS df, (d * ln(s / d) - l) / (1 + (r - 1 / d) / (3 * (k - 1))) AS t FROM s) SELECT k, {R('t', 't')}, df, {R(PC('t', 'df'), 'p')} FROM z""")
def bartlett(spark, sf):
    return rounded(hyp.bartlett(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"))


_RANKED = "c AS (SELECT value AS x, event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY value)::DOUBLE AS t FROM events WHERE value IS NOT NULL{w})"


@query(f"""WITH {_RANKED.format(w="")}, g AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS s, sum(t * t - 1) AS t FROM c GROUP BY g), o AS (SELECT count(*) AS k, sum(n) AS n, sum(s * s / n) AS q, sum(t) AS t FROM g),
 h AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, k - 1 AS df FROM o) SELECT k, {R('h', 'h', 4)}, df, {R('h / (n - 1)', 'epsilon_sq')}, {R(PC('h', 'df'), 'p', 4)} FROM h""")
def kruskal(spark, sf):
    out = hyp.kruskal(table(spark, sf, "events"), "value", "event_type")
    return rounded(out.withColumn("h", F.round("h", 4)).withColumn("p", F.round("p", 4)))


@query(f"""WITH {_RANKED.format(w=" AND event_type IN ('purchase', 'click')")}, g AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS s, sum(t * t - 1) AS t FROM c GROUP BY g), o AS (SELECT arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(s, g) AS s1, sum(t) AS t FROM g),
 u AS (SELECT *, s1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM o), z AS (SELECT *, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u)
 SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, {R('u', 'u')}, {R('1 - 2 * u / (n1 * n2)', 'r')}, {R('z', 'z')}, {R(PN('z'), 'p')} FROM z""")
def mann_whitney(spark, sf):
    df = table(spark, sf, "events").filter("event_type in ('purchase', 'click')")
    out = hyp.mann_whitney(df, "value", "event_type")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("n1", "n2")}))


@query(f"""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d))::DOUBLE AS t FROM d),
 s AS (SELECT count(*)::DOUBLE AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(t * t - 1) AS t FROM r),
 z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24) AS z FROM s) SELECT {R('n', 'n')}, {R('w', 'w', 1)}, {R('z', 'z', 4)}, {R(PN('z'), 'p')} FROM z""")
def wilcoxon(spark, sf):
    out = hyp.wilcoxon(table(spark, sf, "lineitem"), "l_discount", "l_tax")
    return rounded(out.withColumns({"w": F.round("w", 1), "z": F.round("z", 4)}))


_CHI = """n AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1), k AS (SELECT b, sum(n) AS cb FROM n GROUP BY 1),
 e AS (SELECT coalesce(n, 0) AS o, ra * cb / (SELECT sum(n) FROM n) AS e FROM r CROSS JOIN k LEFT JOIN n USING (a, b)), s AS (SELECT sum((o - e) * (o - e) / e) AS x FROM e)"""


@query(f"""WITH {_CHI.format(a='l_returnflag', b='l_linenumber', t='lineitem')}, d AS (SELECT count(DISTINCT a) AS r, count(DISTINCT b) AS c, sum(n) AS n FROM n), z AS (SELECT x, (r - 1) * (c - 1) AS df, sqrt(x / (n * (least(r, c) - 1))) AS v FROM s, d)
 SELECT {R('x', 'chi2')}, df, {R('v', 'cramers_v')}, (SELECT count(*) FROM e WHERE e < 5) AS sparse_cells, {R(PC('x', 'df'), 'p')} FROM z""")
def chi_square(spark, sf):
    return rounded(hyp.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber"))


@query(f"""WITH m AS (SELECT median(l_quantity) AS md FROM lineitem), q AS (SELECT l_returnflag, l_quantity > md AS above FROM lineitem, m), {_CHI.format(a='l_returnflag', b='above', t='q')},
 z AS (SELECT x, (SELECT count(DISTINCT a) - 1 FROM n) AS df FROM s) SELECT {R('x', 'chi2')}, df, {R(PC('x', 'df'), 'p')} FROM z""")
def mood_median(spark, sf):
    return rounded(hyp.mood_median(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), "chi2", "df", "p")


@query(f"""WITH s AS (SELECT sum((p_size > 25)::INT)::BIGINT AS above, sum((p_size < 25)::INT)::BIGINT AS below FROM part), z AS (SELECT *, above + below AS n, least(above, below) AS k FROM s)
 SELECT above, below, {R('least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2)))))', 'p')} FROM z""")
def sign_test(spark, sf):
    return rounded(hyp.sign_test(table(spark, sf, "part"), "p_size", 25.0))


@query(f"""WITH s AS (SELECT count(*)::DOUBLE AS n, sum((l_returnflag = 'R')::INT)::DOUBLE AS k, 1.959963984540054 AS z FROM lineitem), q AS (SELECT *, k / n AS p FROM s)
 SELECT n, k, {R('p', 'share')}, {R('(p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)', 'low')}, {R('(p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)', 'high')}, {R('2 * asin(sqrt(p)) - 2 * asin(sqrt(0.5))', 'h')} FROM q""")
def one_proportion(spark, sf):
    return rounded(hyp.one_proportion(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R"))


@query(f"""WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, sum((l_returnflag = 'R')::INT)::DOUBLE AS k FROM lineitem GROUP BY 1), t AS (SELECT arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(k, g) AS k1, arg_max(k, g) AS k2 FROM g),
 p AS (SELECT *, (k1 + k2) / (n1 + n2) AS p FROM t), z AS (SELECT k1 / n1 AS p1, k2 / n2 AS p2, (k1 / n1 - k2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM p) SELECT {R('p1', 'p1')}, {R('p2', 'p2')}, {R('z', 'z')}, {R(PN('z'), 'p')} FROM z""")
def two_proportions(spark, sf):
    return rounded(hyp.two_proportions(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", "l_linestatus"))


@query(f"""WITH {_GROUPS}, s AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse, sum(n - 1) AS df FROM g), z AS (SELECT a.g AS g1, b.g AS g2, a.m - b.m AS diff, sqrt(mse * (1 / a.n + 1 / b.n)) AS se, df FROM g a JOIN g b ON a.g < b.g, s),
 t AS (SELECT *, diff / se AS t FROM z) SELECT g1, g2, {R('diff', 'diff')}, {R('se', 'se')}, {R('t', 't')}, df::BIGINT AS df, {R(PT('t', 'df'), 'p')} FROM t""")
def fisher_lsd(spark, sf):
    return rounded(posthoc.fisher_lsd(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"))


@query(f"""WITH {_GROUPS}, z AS (SELECT a.g AS g1, b.g AS g2, a.m - b.m AS diff, a.v / a.n AS x, b.v / b.n AS y, a.n AS n1, b.n AS n2 FROM g a JOIN g b ON a.g < b.g)
 SELECT g1, g2, {R('diff', 'diff')}, {R('sqrt(x + y)', 'se')}, {R('diff / sqrt(x + y)', 't')}, {R('(x + y) * (x + y) / (x * x / (n1 - 1) + y * y / (n2 - 1))', 'df', 3)} FROM z""")
def games_howell(spark, sf):
    """The p of the studentized range has no SQL; tests hold it against published values."""
    out = posthoc.games_howell(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("p", "low", "high")
    return rounded(out.withColumn("df", F.round("df", 3)))


@query(f"WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders) SELECT any_value(n) AS n, {R('max(abs(o_totalprice - m)) / any_value(s)', 'g')} FROM orders, s")
def grubbs(spark, sf):
    return rounded(hyp.grubbs(table(spark, sf, "orders"), "o_totalprice"))


@query(f"""WITH b AS (SELECT (l_quantity > 25)::INT AS a, (l_discount > 0.05)::INT AS b, (l_tax > 0.04)::INT AS c FROM lineitem), s AS (SELECT sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(c)::DOUBLE AS c, sum((a + b + c) * (a + b + c))::DOUBLE AS rr FROM b),
 z AS (SELECT 2 * (3 * (a * a + b * b + c * c) - (a + b + c) * (a + b + c)) / (3 * (a + b + c) - rr) AS q, 2 AS df FROM s) SELECT {R('q', 'q', 4)}, df, {R(PC('q', 'df'), 'p', 4)} FROM z""")
def cochrans_q(spark, sf):
    df = table(spark, sf, "lineitem").select(*((F.col(c) > v).cast("int").alias(c) for c, v in (("l_quantity", 25), ("l_discount", 0.05), ("l_tax", 0.04))))
    return rounded(hyp.cochrans_q(df, ["l_quantity", "l_discount", "l_tax"]), digits=4)


@query(f"""WITH s AS (SELECT sum((l_quantity > 25 AND NOT l_discount > 0.05)::INT)::BIGINT AS only_a, sum((NOT l_quantity > 25 AND l_discount > 0.05)::INT)::BIGINT AS only_b FROM lineitem),
 z AS (SELECT *, power(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) AS x, 1 AS df FROM s) SELECT only_a, only_b, {R('x', 'chi2')}, df, {R(PC('x', 'df'), 'p')} FROM z""")
def mcnemar(spark, sf):
    return rounded(hyp.mcnemar(table(spark, sf, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05))


@query(f"""WITH s AS (SELECT count(l_quantity) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem), z AS (SELECT n, n - 1 AS df, (m - 25.4) / (s / sqrt(n)) AS a, (m - 25.7) / (s / sqrt(n)) AS b FROM s),
 q AS (SELECT *, {PT('a', 'df')} / 2 AS pa, {PT('b', 'df')} / 2 AS pb FROM z)
 SELECT n, {R('a', 't_low')}, {R('b', 't_high')}, {R('greatest(CASE WHEN a > 0 THEN pa ELSE 1 - pa END, CASE WHEN b < 0 THEN pb ELSE 1 - pb END)', 'p')} FROM q""".replace("1 - 2 * exp", "(1 - 2 * exp").replace("))) / 2 AS", ")))) / 2 AS"))
def tost(spark, sf):
    return rounded(hyp.tost_one_sample(table(spark, sf, "lineitem"), "l_quantity", 25.4, 25.7))


# ----------------------------------------------------- models and reliability


@query(f"SELECT regr_count(l_extendedprice, l_quantity)::BIGINT AS n, {R('regr_slope(l_extendedprice, l_quantity)', 'slope', 3)}, {R('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 3)}, {R('regr_r2(l_extendedprice, l_quantity)', 'r2')} FROM lineitem")
def ols_simple(spark, sf):
    out = models.simple_line(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(out.withColumn("slope", F.round("slope", 3)).withColumn("intercept", F.round("intercept", 3)))


_T975 = "(1.959963984540054 + 2.372271287 / (dof * 1.0) + 2.822785 / power(dof, 2))"  # Cornish and Fisher's expansion, for many degrees of freedom


@query(
    f"""WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_samp(l_quantity) * (count(*) - 1) AS a, var_samp(l_discount) * (count(*) - 1) AS c, covar_samp(l_quantity, l_discount) * (count(*) - 1) AS b,
 covar_samp(l_extendedprice, l_quantity) * (count(*) - 1) AS y1, covar_samp(l_extendedprice, l_discount) * (count(*) - 1) AS y2, var_samp(l_extendedprice) * (count(*) - 1) AS yy FROM lineitem),
 b AS (SELECT *, a * c - b * b AS det, (c * y1 - b * y2) / (a * c - b * b) AS b1, (a * y2 - b * y1) / (a * c - b * b) AS b2, n - 3 AS dof FROM m), r AS (SELECT *, yy - b1 * y1 - b2 * y2 AS rss FROM b),
 e AS (SELECT *, rss / dof AS mse, (yy - rss) / 2 / (rss / dof) AS f, n * ln(2 * pi()) + n * ln(rss / n) + n AS ll FROM r),
 t AS (SELECT 'l_quantity' AS term, b1 AS coef, sqrt(mse * c / det) AS se, a * c / det AS vif, e.* FROM e UNION ALL SELECT 'l_discount', b2, sqrt(mse * a / det), a * c / det, e.* FROM e
  UNION ALL SELECT 'intercept', my - b1 * m1 - b2 * m2, sqrt(mse * (1 / n + (m1 * m1 * c - 2 * m1 * m2 * b + m2 * m2 * a) / det)), NULL, e.* FROM e)
 SELECT term, {R('coef', 'coef', 2)}, {R('se', 'se', 2)}, {R('coef / se', 't', 3)}, {R(PT('(coef / se)', 'dof'), 'p', 4)}, {R(f'coef - {_T975} * se', 'low', 1)}, {R(f'coef + {_T975} * se', 'high', 1)}, {R('vif', 'vif')}, n::BIGINT AS n, {R('1 - rss / yy', 'r2', 6)}, {R('1 - mse / (yy / (n - 1))', 'adj_r2', 6)},
  {R('f', 'f', 3)}, {R(PF('f', '2', 'dof'), 'f_p', 4)}, {R('sqrt(mse)', 'rmse', 2)}, {R('ll + 6', 'aic', 1)}, {R('ll + 3 * ln(n)', 'bic', 1)} FROM t"""
)
def ols_multi(spark, sf):
    out = models.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    digits = {"coef": 2, "se": 2, "t": 3, "p": 4, "low": 1, "high": 1, "r2": 6, "adj_r2": 6, "f": 3, "f_p": 4, "rmse": 2, "aic": 1, "bic": 1}
    return out.select(*((F.round(c, digits.get(c, 5)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {R(f'corr({a}, {b})', 'r', 6)} FROM lineitem"
        for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
    )
)
def correlation(spark, sf):
    return rounded(models.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), digits=6)


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
 SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, {R('corr(a, b)', 'r', 6)} FROM r""")
def spearman(spark, sf):
    return rounded(models.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman"), digits=6)


_KM = """t AS (SELECT (l_shipdate::DATE - DATE '1992-01-01')::DOUBLE AS t, (l_returnflag = 'R')::INT AS e FROM lineitem), q AS (SELECT t, sum(e)::BIGINT AS d, count(*) AS c FROM t GROUP BY 1),
 n AS (SELECT *, sum(c) OVER (ORDER BY t DESC)::BIGINT AS n FROM q), k AS (SELECT * FROM n WHERE d > 0)"""


def _lives(spark, sf):
    return table(spark, sf, "lineitem").withColumn("life", F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")))


_POWER = "CASE WHEN s > 0 AND s < 1 THEN power(s, exp({} 1.959963984540054 * sqrt(v) / abs(ln(s)))) END"


@query(
    f"""WITH {_KM}, r AS (SELECT t, n, d, CASE WHEN max((d = n)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d::DOUBLE / n) ELSE 0 END) OVER w) END AS s,
 sum(CASE WHEN d < n THEN d::DOUBLE / (n::DOUBLE * (n - d)) END) OVER w AS v FROM k WINDOW w AS (ORDER BY t))
 SELECT {R('t', 't')}, n, d, {R('s', 's')}, {R('v', 'v')}, {R(_POWER.format('+'), 'low')}, {R(_POWER.format('-'), 'high')} FROM r"""
)
def kaplan_meier(spark, sf):
    return rounded(models.kaplan_meier(_lives(spark, sf), "life", F.col("l_returnflag") == "R"), "t", "n", "d", "s", "v", "low", "high")


_KSAMPLE = """t AS (SELECT (l_shipdate::DATE - DATE '1992-01-01')::DOUBLE AS t, (l_returnflag = 'R')::INT AS e, {g} AS g FROM lineitem),
 x AS (SELECT t, sum(e)::DOUBLE AS d, count(*) AS c FROM t GROUP BY 1), r AS (SELECT t, d, (sum(c) OVER (ORDER BY t DESC))::DOUBLE AS n FROM x), w AS (SELECT t, g, sum(e)::DOUBLE AS d1, count(*) AS c1 FROM t GROUP BY 1, 2),
 a AS (SELECT r.t, g.g, coalesce(w.d1, 0) AS d1, coalesce(w.c1, 0) AS c1, r.d, r.n FROM r CROSS JOIN (SELECT DISTINCT g FROM t) g LEFT JOIN w ON w.t = r.t AND w.g = g.g), b AS (SELECT *, (sum(c1) OVER (PARTITION BY g ORDER BY t DESC))::DOUBLE AS n1 FROM a),
 s AS (SELECT g, sum(d1) AS o, sum(d * n1 / n) AS e FROM b WHERE d > 0 GROUP BY 1)"""


@query(f"""WITH {_KSAMPLE.format(g='l_linestatus')}, v AS (SELECT sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * n1 / n * (1 - n1 / n) ELSE 0 END) AS v FROM b WHERE d > 0 AND g = (SELECT min(g) FROM s)), z AS (SELECT power(o - e, 2) / v AS x, 1 AS df FROM s, v WHERE g = (SELECT min(g) FROM s))
 SELECT g, {R('o', 'observed', 3)}, {R('e', 'expected', 3)}, {R('x', 'chi2', 3)}, df::INT AS df, {R(PC('x', 'df'), 'p')} FROM s, z""")
def log_rank(spark, sf):
    out = models.log_rank(_lives(spark, sf), "life", F.col("l_returnflag") == "R", "l_linestatus")
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("observed", "expected", "chi2")}))


@query(f"""WITH {_KSAMPLE.format(g="CASE WHEN l_quantity < 18 THEN 'a' WHEN l_quantity < 35 THEN 'b' ELSE 'c' END")}, q AS (SELECT t, max(CASE WHEN g = 'a' THEN n1 END) AS na, max(CASE WHEN g = 'b' THEN n1 END) AS nb, any_value(d) AS d, any_value(n) AS n FROM b WHERE d > 0 GROUP BY 1),
 v AS (SELECT sum(k * na / n * (1 - na / n)) AS aa, sum(k * nb / n * (1 - nb / n)) AS bb, sum(-k * na / n * nb / n) AS ab FROM (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS k FROM q)),
 d AS (SELECT (SELECT o - e FROM s WHERE g = 'a') AS da, (SELECT o - e FROM s WHERE g = 'b') AS db), z AS (SELECT (bb * da * da - 2 * ab * da * db + aa * db * db) / (aa * bb - ab * ab) AS x, 2 AS df FROM v, d)
 SELECT g, {R('o', 'observed', 3)}, {R('e', 'expected', 3)}, {R('x', 'chi2', 3)}, df::INT AS df, {R(PC('x', 'df'), 'p', 4)} FROM s, z""")
def log_rank_three(spark, sf):
    lives = _lives(spark, sf).withColumn("g", F.when(F.col("l_quantity") < 18, "a").when(F.col("l_quantity") < 35, "b").otherwise("c"))
    out = models.log_rank(lives, "life", F.col("l_returnflag") == "R", "g")
    return out.withColumns({c: F.round(c, 4 if c == "p" else 3) + 0.0 for c in ("observed", "expected", "chi2", "p")})


@query(f"""WITH t AS (SELECT value AS t FROM events WHERE event_type = 'purchase' AND value > 0), e AS (SELECT max(t) AS e FROM t), s AS (SELECT count(*) AS n, any_value(e) AS e, sum(ln(e / t)) AS s FROM t, e)
 SELECT n, {R('n / s', 'beta')}, {R('n / power(e, n / s)', 'scale')} FROM s""")
def crow_amsaa(spark, sf):
    return rounded(models.crow_amsaa(purchases(spark, sf), "value"), "n", "beta", "scale")


@query(f"SELECT sum((l_returnflag = 'R')::INT)::BIGINT AS failures, {R('sum((l_returnflag = $$R$$)::INT) / sum(l_quantity)', 'rate')}, {R('sum(l_quantity) / sum((l_returnflag = $$R$$)::INT)', 'mtbf')} FROM lineitem")
def exponential_life(spark, sf):
    return rounded(models.exponential_life(table(spark, sf, "lineitem"), "l_quantity", F.col("l_returnflag") == "R"), "failures", "rate", "mtbf")


_ITEMS = ("l_quantity", "l_discount", "l_tax")


@query(f"WITH s AS (SELECT var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax) AS a, var_samp(l_quantity + l_discount + l_tax) AS b FROM lineitem) SELECT i AS item, {R('1.5 * (1 - a / b)', 'alpha')} FROM s, (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) AS v(i)")
def survey_alpha(spark, sf):
    return rounded(models.survey_alpha(table(spark, sf, "lineitem"), list(_ITEMS)), "item", "alpha")


@query(f"""WITH {P}, c AS (SELECT avg(x) AS m FROM p), d AS (SELECT i, x - m AS d FROM p, c), k AS (SELECT unnest(range(0, 11))::INT AS lag), z AS (SELECT sum(d * d) AS z FROM d)
 SELECT lag, {R('sum(a.d * b.d) / any_value(z)', 'r')} FROM k, d a JOIN d b ON a.i = b.i + lag, z GROUP BY lag""")
def acf(spark, sf):
    return rounded(models.acf(purchases(spark, sf), "value", TIME, 10))


@query(f"""WITH p AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value AS y, user_id::DOUBLE AS x FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), k AS (SELECT unnest(range(0, 4))::INT AS lag)
 SELECT lag, {R('corr(a.y, b.x)', 'r')} FROM k, p a JOIN p b ON a.i = b.i + lag GROUP BY lag""")
def cross_correlation(spark, sf):
    return rounded(models.cross_correlation(table(spark, sf, "events"), "user_id", "value", TIME, 3))


@query(f"""WITH {P}, t AS (SELECT i - 1 AS i, x, CASE WHEN count(*) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(x) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(x, 6) OVER (ORDER BY i) + lead(x, 6) OVER (ORDER BY i)) / 2) / 12 END AS t FROM p),
 f AS (SELECT i % 12 AS phase, avg(x - t) AS s FROM t WHERE t IS NOT NULL GROUP BY 1) SELECT phase, {R('s - avg(s) OVER ()', 'seasonal')} FROM f""")
def decompose(spark, sf):
    return rounded(models.decompose(purchases(spark, sf), "value", TIME, 12))


@query(f"""WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2), e AS (SELECT *, avg(mean) OVER () AS g, avg(mean) OVER (PARTITION BY l_returnflag) AS a, avg(mean) OVER (PARTITION BY l_linenumber) AS b FROM c)
 SELECT l_returnflag, l_linenumber, n, {R('mean', 'mean')}, {R('a - g', 'a_effect')}, {R('b - g', 'b_effect')}, {R('mean - a - b + g', 'interaction')} FROM e""")
def two_way_cells(spark, sf):
    out = models.two_way_cells(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "l_linenumber")
    return rounded(out, "l_returnflag", "l_linenumber", "n", "mean", "a_effect", "b_effect", "interaction")


# ------------------------------------------------------------------- charts


@query(f"SELECT l_returnflag, count(l_quantity) AS n, {R('min(l_extendedprice)', 'low')}, {R('quantile_cont(l_extendedprice, 0.25)', 'q1')}, {R('median(l_extendedprice)', 'median')}, {R('quantile_cont(l_extendedprice, 0.75)', 'q3')}, {R('max(l_extendedprice)', 'high')} FROM lineitem GROUP BY 1")
def boxplot(spark, sf):
    return rounded(charts.boxplot(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(f"""WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), k AS (SELECT least(19, floor((o_totalprice - a) / ((b - a) / 20)))::INT AS bin, a, (b - a) / 20 AS w FROM orders, s)
 SELECT bin, {R('any_value(a + bin * w)', 'low', 3)}, {R('any_value(a + (bin + 1) * w)', 'high', 3)}, count(*) AS n FROM k GROUP BY bin""")
def histogram(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "orders"), "o_totalprice"), digits=3)


@query(f"WITH c AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT {R('x', 'x')}, n, {R('sum(n) OVER (ORDER BY x) / sum(n) OVER ()', 'share')} FROM c")
def ecdf(spark, sf):
    return rounded(charts.ecdf(table(spark, sf, "lineitem"), "l_quantity"))


@query(f"SELECT o_orderstatus, o_orderpriority, {R('avg(o_totalprice)', 'v', 3)} FROM orders GROUP BY 1, 2")
def heatmap(spark, sf):
    return rounded(charts.heatmap(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice"), digits=3)


@query("""SELECT 0 AS step, l_returnflag AS source, l_linestatus AS target, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 2, 3
 UNION ALL SELECT 1, l_linestatus, l_linenumber::VARCHAR, count(*)::DOUBLE FROM lineitem GROUP BY 2, 3""")
def sankey(spark, sf):
    return charts.sankey(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""WITH m AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate)::DATE AS m FROM orders), f AS (SELECT u, min(m) AS cohort FROM m GROUP BY 1)
 SELECT cohort::VARCHAR AS cohort, ((year(m) - year(cohort)) * 12 + month(m) - month(cohort))::INT AS age, count(DISTINCT u) AS users FROM m JOIN f USING (u) GROUP BY 1, 2""")
def cohorts(spark, sf):
    return charts.cohorts(table(spark, sf, "orders"), "o_custkey", "o_orderdate").withColumn("cohort", F.col("cohort").cast("string"))


@query(f"SELECT ts::DATE::VARCHAR AS day, count(*) AS n, {R('avg(value)', 'mean')} FROM events GROUP BY 1")
def calendar(spark, sf):
    return rounded(charts.calendar(table(spark, sf, "events"), "ts", "value").withColumn("day", F.col("day").cast("string")))


@query(f"WITH n AS (SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1) SELECT event_type, users, {R('users / (SELECT users FROM n WHERE event_type = $$view$$)', 'share')} FROM n WHERE EXISTS (SELECT 1 FROM n WHERE event_type = 'view')")
def funnel(spark, sf):
    return rounded(charts.funnel(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "purchase"]))


@query("WITH u AS (SELECT user_id, max((event_type = 'click')::INT) AS a, max((event_type = 'purchase')::INT) AS b FROM events GROUP BY 1) SELECT sum((a = 1 AND b = 0)::INT)::BIGINT AS only_a, sum((a = 0 AND b = 1)::INT)::BIGINT AS only_b, sum((a = 1 AND b = 1)::INT)::BIGINT AS both FROM u")
def venn(spark, sf):
    return charts.venn(table(spark, sf, "events"), "user_id", "event_type", "click", "purchase")


@query(f"SELECT 'l_returnflag' AS factor, l_returnflag AS level, count(*) AS n, {R('avg(l_quantity)', 'mean')} FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*), {R('avg(l_quantity)', 'mean')} FROM lineitem GROUP BY 2")
def main_effects(spark, sf):
    return rounded(charts.main_effects(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linenumber"]))


@query(f"SELECT p_brand, count(*) AS n, {R('avg(p_size)', 'mean')}, max(p_size) - min(p_size) AS range, {R('stddev_samp(p_size)', 'sd')} FROM part GROUP BY 1")
def variability(spark, sf):
    return rounded(charts.variability(table(spark, sf, "part"), "p_size", "p_brand"))


@query(f"WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, {R('v', 'v', 2)}, {R('sum(v) OVER (ORDER BY o_orderpriority)', 'end', 2).replace(' AS end', ' AS "end"')} FROM g")
def waterfall(spark, sf):
    return rounded(charts.waterfall(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), "o_orderpriority", "v", "end", digits=2)


# ------------------------------------------------- wrangling, profile, stream


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {R('l_extendedprice * (1 - l_discount) / l_quantity', 'net')} FROM lineitem WHERE l_quantity >= 10 AND (l_tax < 0.03 OR l_returnflag <> 'N')")
def compute_filter(spark, sf):
    df = wrangle.compute(table(spark, sf, "lineitem"), "net", "l_extendedprice * (1 - l_discount) / l_quantity")
    df = wrangle.filter_rows(df, "l_quantity >= 10 and (l_tax < 0.03 or l_returnflag != 'N')")
    return rounded(df, "l_orderkey", "l_linenumber", "l_partkey", "net")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
def recode(spark, sf):
    return wrangle.recode(table(spark, sf, "orders"), "o_orderstatus", {"F": "done", "O": "open"}, "other", "status").select("o_orderkey", "status")


@query("SELECT o_orderkey, TRY_CAST(replace(o_orderpriority, '-', '') AS DOUBLE) AS number, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE)::BIGINT AS first FROM orders")
def retype(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.regexp_replace("o_orderpriority", "-", "").alias("number"), F.substring("o_orderpriority", 1, 1).alias("first"))
    return wrangle.retype(wrangle.retype(df, "number", "number"), "first", "int")


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id, {R('coalesce(v, (SELECT median(v) FROM e))', 'v')} FROM e""")
def impute_median(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return rounded(wrangle.impute(df, "v", "median"))


@query(f"""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id, {R('coalesce(v, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id))', 'v')} FROM e""")
def impute_ffill(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return rounded(wrangle.impute(df, "v", "ffill", order=TIME), "event_id", "v")


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS variable, {R(c, 'value')} FROM lineitem" for c in ("l_discount", "l_tax")))
def stack(spark, sf):
    return rounded(wrangle.stack(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"]))


@query(f"SELECT l_linenumber, {', '.join(R(f'sum(CASE WHEN l_returnflag = $${f}$$ THEN l_quantity END)', f) for f in 'ANR')} FROM lineitem GROUP BY 1")
def unstack(spark, sf):
    return rounded(wrangle.unstack(table(spark, sf, "lineitem"), ["l_linenumber"], "l_returnflag", "l_quantity", "sum"), "l_linenumber", "A", "N", "R")


@query(f"WITH s AS (SELECT min(c_acctbal) AS m FROM customer) SELECT c_custkey, {R('ln(c_acctbal + CASE WHEN m <= 0 THEN 1 - m ELSE 0 END)', 'log_c_acctbal')} FROM customer, s")
def log_shifted(spark, sf):
    return rounded(wrangle.log(table(spark, sf, "customer"), "c_acctbal"), "c_custkey", "log_c_acctbal")


@query(f"SELECT c_custkey, {R('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ()', 'z_c_acctbal')} FROM customer")
def standardize(spark, sf):
    return rounded(wrangle.standardize(table(spark, sf, "customer"), "c_acctbal"), "c_custkey", "z_c_acctbal")


@query("WITH s AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part) SELECT p_partkey, greatest(0, least(6, ceil((p_size - a) / ((b - a) / 7)) - 1))::INT AS p_size_bin FROM part, s")
def bin_equal_width(spark, sf):
    return wrangle.bin_column(table(spark, sf, "part"), "p_size", 7).select("p_partkey", "p_size_bin")


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, ((p_retailprice > a)::INT + (p_retailprice > b)::INT + (p_retailprice > c)::INT) AS p_retailprice_bin FROM part, q")
def bin_quantile(spark, sf):
    return wrangle.bin_column(table(spark, sf, "part"), "p_retailprice", 4, "quantile").select("p_partkey", "p_retailprice_bin")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, (o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)) AS outlier FROM orders, q")
def outliers_iqr(spark, sf):
    return wrangle.outliers(table(spark, sf, "orders"), ["o_totalprice"], "iqr", 0.5).select("o_orderkey", "outlier")


@query("WITH m AS (SELECT median(o_totalprice) AS m FROM orders), d AS (SELECT median(abs(o_totalprice - m)) AS d FROM orders, m) SELECT o_orderkey, abs(o_totalprice - m) > 1.5 * 1.4826 * d AS outlier FROM orders, m, d")
def outliers_mad(spark, sf):
    return wrangle.outliers(table(spark, sf, "orders"), ["o_totalprice"], "mad", 1.5).select("o_orderkey", "outlier")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row FROM events")
def row_numbers(spark, sf):
    return numbered(table(spark, sf, "events").select("event_id", "ts"), TIME).select("event_id", "row")


@query(f"""SELECT 'c_acctbal' AS "column", 'number' AS kind, count(*) AS rows, count(*) - count(c_acctbal) AS n_null, count(DISTINCT c_acctbal) AS n_unique, {R('min(c_acctbal)', 'min')}, {R('max(c_acctbal)', 'max')}, {R('avg(c_acctbal)', 'mean')} FROM customer
 UNION ALL SELECT 'c_mktsegment', 'text', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), NULL, NULL, NULL FROM customer""")
def table_profile(spark, sf):
    out = profile(table(spark, sf, "customer").select("c_acctbal", "c_mktsegment"))
    return rounded(out, "column", "kind", "rows", "n_null", "n_unique", "min", "max", "mean")


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, sum((abs(value - 50) > 60)::INT)::BIGINT AS signals, {R('avg(value)', 'mean')} FROM events WHERE value IS NOT NULL GROUP BY 1")
def daily_signals(spark, sf):
    out = windowed_signals(table(spark, sf, "events"), "ts", "value", 50.0, 20.0)
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


# --------------------------------------------------------- further comparisons


_DUNN = f"{_RANKED.format(w='')}, g AS (SELECT g, count(*)::DOUBLE AS n, avg(r) AS m, sum(t * t - 1) AS t FROM c GROUP BY g), s AS (SELECT sum(n) AS n, sum(t) AS t FROM g)"


@query(f"""WITH {_GROUPS}, s AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse, sum(n - 1) AS df FROM g), z AS (SELECT a.g AS g1, b.g AS g2, a.m - b.m AS diff, sqrt(mse * (1 / a.n + 1 / b.n)) AS se, df FROM g a JOIN g b ON a.g < b.g, s)
 SELECT g1, g2, {R('diff', 'diff')}, {R('se', 'se')}, {R('diff / se', 't')}, df::BIGINT AS df FROM z""")
def tukey_hsd(spark, sf):
    """The p and interval of the studentized range have no SQL; tests hold them against published values."""
    return rounded(posthoc.tukey_hsd(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("p", "low", "high"))


@query(f"""WITH {_GROUPS}, s AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse, sum(n - 1) AS df, count(*) AS k FROM g), z AS (SELECT a.g AS g, a.m - b.m AS diff, sqrt(mse * (1 / a.n + 1 / b.n)) AS se, df, k FROM g a, g b, s WHERE a.g <> 'N' AND b.g = 'N'),
 t AS (SELECT *, diff / se AS t FROM z) SELECT g, {R('diff', 'diff')}, {R('se', 'se')}, {R('t', 't')}, df::BIGINT AS df, least(1, {R('(k - 1) * (' + PT('t', 'df') + ')', 'p').replace(' AS p', '')}) AS p FROM t""")
def dunnett(spark, sf):
    return rounded(posthoc.dunnett(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "N"))


@query(f"""WITH {_DUNN}, z AS (SELECT a.g AS g1, b.g AS g2, a.m - b.m AS diff, sqrt((s.n * (s.n + 1) / 12 - s.t / (12 * (s.n - 1))) * (1 / a.n + 1 / b.n)) AS se FROM g a JOIN g b ON a.g < b.g, s),
 p AS (SELECT *, diff / se AS z FROM z), q AS (SELECT *, {PN('z')} AS p FROM p), h AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, g1, g2) + 1) AS h FROM q)
 SELECT g1, g2, {R('diff', 'diff', 3)}, {R('se', 'se', 3)}, {R('z', 'z', 4)}, {R('p', 'p', 4)}, {R('least(1, max(h) OVER (ORDER BY p, g1, g2))', 'p_adjusted', 4)} FROM h""")
def dunn(spark, sf):
    out = posthoc.dunn(table(spark, sf, "events"), "value", "event_type")
    return out.withColumns({c: F.round(c, d) + 0.0 for c, d in {"diff": 3, "se": 3, "z": 4, "p": 4, "p_adjusted": 4}.items()})


@query(f"""WITH {_GROUPS}, s AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse, sum(n - 1) AS df FROM g), z AS (SELECT a.g, a.n, a.m, a.m - max(b.m) AS diff, sqrt(any_value(mse) * (1 / a.n + 1 / arg_max(b.n, b.m))) AS se, any_value(df) AS df FROM g a JOIN g b ON a.g <> b.g, s GROUP BY 1, 2, 3)
 SELECT g, n::BIGINT AS n, {R('m', 'm')}, {R('diff', 'diff')}, {R('se', 'se')}, df::BIGINT AS df FROM z""")
def hsu_mcb(spark, sf):
    return rounded(posthoc.hsu_mcb(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("low", "high"))


@query(f"""WITH {_TWO}, z AS (SELECT m1 - m2 AS diff, n1 + n2 - 2 AS df, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS se FROM t), q AS (SELECT *, (diff + 0.5) / se AS a, (diff - 0.5) / se AS b FROM z), w AS (SELECT *, ({PT('a', 'df')}) / 2 AS pa, ({PT('b', 'df')}) / 2 AS pb FROM q)
 SELECT {R('diff', 'diff')}, {R('df', 'df')}, {R('a', 't_low')}, {R('b', 't_high')}, {R('greatest(CASE WHEN a > 0 THEN pa ELSE 1 - pa END, CASE WHEN b < 0 THEN pb ELSE 1 - pb END)', 'p')} FROM w""")
def tost_two_sample(spark, sf):
    return rounded(hyp.tost_two_sample(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus", -0.5, 0.5))


_C = "lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"
_HYPER = f"exp({_C.format(n='r', k='k')} + {_C.format(n='(t - r)', k='(c - k)')} - ({_C.format(n='t', k='c')}))"


@query(f"""WITH n AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS n11, sum((quality = 1 AND toxic <> 1)::INT)::BIGINT AS n12, sum((quality <> 1 AND toxic = 1)::INT)::BIGINT AS n21, sum((quality <> 1 AND toxic <> 1)::INT)::BIGINT AS n22 FROM labels),
 m AS (SELECT *, n11 + n12 AS r, n11 + n21 AS c, n11 + n12 + n21 + n22 AS t FROM n), k AS (SELECT *, unnest(range(greatest(0, r + c - t), least(r, c) + 1)) AS k FROM m), p AS (SELECT *, {_HYPER} AS p FROM k)
 SELECT any_value(n11) AS n11, any_value(n12) AS n12, any_value(n21) AS n21, any_value(n22) AS n22, {R('CASE WHEN any_value(n12 * n21) > 0 THEN any_value(n11 * n22) / any_value(n12 * n21)::DOUBLE END', 'odds_ratio')}, {R('least(1, sum(CASE WHEN p <= (SELECT p FROM p WHERE k = n11) * 1.0000001 THEN p ELSE 0 END))', 'p')} FROM p""")
def fisher_exact(spark, sf):
    return rounded(hyp.fisher_exact(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


@query(f"""WITH m AS (SELECT median(value) AS md FROM events), s AS (SELECT ts, event_id, value > md AS up FROM events, m WHERE value <> md), h AS (SELECT up, up <> lag(up) OVER (ORDER BY ts, event_id) AS new FROM s),
 n AS (SELECT sum((coalesce(new, true))::INT)::DOUBLE AS runs, sum(up::INT)::DOUBLE AS n1, sum((NOT up)::INT)::DOUBLE AS n2 FROM h), z AS (SELECT *, 2 * n1 * n2 / (n1 + n2) + 1 AS expected, sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))) AS sd FROM n), q AS (SELECT *, (runs - expected) / sd AS z FROM z)
 SELECT runs, n1, n2, {R('expected', 'expected')}, {R('z', 'z')}, {R(PN('z'), 'p')} FROM q""")
def runs_test(spark, sf):
    return rounded(hyp.runs(table(spark, sf, "events"), "value", TIME))


_RATED = "SELECT (CASE WHEN l_quantity < 18 THEN 'a' WHEN l_quantity < 35 THEN 'b' ELSE 'c' END) AS a, (CASE WHEN l_extendedprice < 30000 THEN 'a' WHEN l_extendedprice < 60000 THEN 'b' ELSE 'c' END) AS b FROM lineitem"


def _ratings(spark, sf):
    cut = lambda c, x, y: F.when(F.col(c) < x, "a").when(F.col(c) < y, "b").otherwise("c")
    return table(spark, sf, "lineitem").select(cut("l_quantity", 18, 35).alias("a"), cut("l_extendedprice", 30000, 60000).alias("b"))


@query(f"""WITH q AS ({_RATED}), n AS (SELECT a, b, count(*)::DOUBLE AS n FROM q GROUP BY 1, 2), p AS (SELECT least(a, b) AS x, greatest(a, b) AS y, sum(CASE WHEN a < b THEN n ELSE -n END) AS gap, sum(n) AS tot FROM n WHERE a <> b GROUP BY 1, 2),
 z AS (SELECT coalesce(sum(gap * gap / tot), 0) AS x, (SELECT count(DISTINCT c) * (count(DISTINCT c) - 1) // 2 FROM (SELECT a AS c FROM n UNION ALL SELECT b FROM n)) AS df FROM p) SELECT {R('x', 'chi2', 3)}, df, {R(PC('x', 'df'), 'p')} FROM z""")
def mcnemar_bowker(spark, sf):
    return rounded(hyp.mcnemar_bowker(_ratings(spark, sf), "a", "b").withColumn("chi2", F.round("chi2", 3)))


@query(f"""WITH q AS ({_RATED}), m AS (SELECT a, b, count(*)::DOUBLE AS n FROM q GROUP BY 1, 2), r AS (SELECT a AS c, sum(n) AS r FROM m GROUP BY 1), k AS (SELECT b AS c, sum(n) AS k FROM m GROUP BY 1), d AS (SELECT c, r - k AS d FROM r JOIN k USING (c)),
 o AS (SELECT least(a, b) AS x, greatest(a, b) AS y, sum(n) / 2 AS h FROM m WHERE a <> b GROUP BY 1, 2), v AS (SELECT (SELECT d FROM d WHERE c = 'a') AS da, (SELECT d FROM d WHERE c = 'b') AS db, (SELECT d FROM d WHERE c = 'c') AS dc,
 (SELECT h FROM o WHERE x = 'a' AND y = 'b') AS ab, (SELECT h FROM o WHERE x = 'a' AND y = 'c') AS ac, (SELECT h FROM o WHERE x = 'b' AND y = 'c') AS bc), z AS (SELECT (bc * da * da + ac * db * db + ab * dc * dc) / (2 * (ab * bc + ab * ac + ac * bc)) AS x, 2 AS df FROM v)
 SELECT {R('x', 'chi2', 3)}, df::BIGINT AS df, {R(PC('x', 'df'), 'p')} FROM z""")
def stuart_maxwell(spark, sf):
    return rounded(hyp.stuart_maxwell(_ratings(spark, sf), "a", "b").withColumn("chi2", F.round("chi2", 3)))


@query(f"""WITH c AS (SELECT c_nationkey AS s, c_mktsegment AS w, avg(c_acctbal) AS x FROM customer GROUP BY 1, 2), k AS (SELECT s FROM c GROUP BY 1 HAVING count(*) = 5), f AS (SELECT * FROM c WHERE s IN (SELECT s FROM k)), g AS (SELECT avg(x) AS g, count(DISTINCT s)::DOUBLE AS ns, count(DISTINCT w)::DOUBLE AS nw, var_pop(x) * count(*) AS tot FROM f),
 a AS (SELECT sum((m - g) * (m - g)) AS a FROM (SELECT s, avg(x) AS m FROM f GROUP BY 1), g), b AS (SELECT sum((m - g) * (m - g)) AS b FROM (SELECT w, avg(x) AS m FROM f GROUP BY 1), g),
 z AS (SELECT b * ns AS ss, tot - a * nw - b * ns AS se, (nw - 1)::BIGINT AS df1, ((nw - 1) * (ns - 1))::BIGINT AS df2 FROM a, b, g), q AS (SELECT *, ss / df1 / (se / df2) AS f FROM z) SELECT {R('ss', 'ss_within', 0)}, {R('se', 'ss_error', 0)}, df1, df2, {R('f', 'f')}, {R(PF('f', 'df1', 'df2'), 'p')} FROM q""")
def rm_anova(spark, sf):
    c = table(spark, sf, "customer")
    whole = c.groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("k")).filter("k = 5")
    out = hyp.rm_anova(c.join(whole, "c_nationkey", "left_semi"), "c_acctbal", "c_nationkey", "c_mktsegment")
    return rounded(out.withColumns({k: F.round(k, 0) for k in ("ss_within", "ss_error")}))


@query(f"""WITH b AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem), r AS (SELECT (b < a)::INT + (c < a)::INT + ((b = a)::INT + (c = a)::INT + 2) / 2.0 AS ra, (a < b)::INT + (c < b)::INT + ((a = b)::INT + (c = b)::INT + 2) / 2.0 AS rb, (a < c)::INT + (b < c)::INT + ((a = c)::INT + (b = c)::INT + 2) / 2.0 AS rc,
 power(1 + (a = b)::INT + (a = c)::INT, 2) + power(1 + (a = b)::INT + (b = c)::INT, 2) + power(1 + (a = c)::INT + (b = c)::INT, 2) - 3 AS t FROM b), s AS (SELECT count(*)::DOUBLE AS n, sum(ra) AS a, sum(rb) AS b, sum(rc) AS c, sum(t) AS t FROM r),
 z AS (SELECT n, 2 AS df, (12 / (n * 12) * (a * a + b * b + c * c) - 12 * n) / (1 - t / (n * 24)) AS x FROM s) SELECT {R('n', 'n')}, {R('x', 'chi2', 3)}, df, {R(PC('x', 'df'), 'p')} FROM z""")
def friedman(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return rounded(hyp.friedman(df, ["a", "b", "c"]).withColumn("chi2", F.round("chi2", 3)))


# --------------------------------------------------------- more chart tables


@query(f"""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS n, stddev_samp(o_totalprice) AS s FROM orders), c AS (SELECT least(2047, floor((o_totalprice - a) / (b - a) * 2048)) AS bin, count(*) AS c, avg(o_totalprice) AS mid FROM orders, e GROUP BY 1),
 g AS (SELECT i, a - 0.12 * (b - a) + 1.24 * (b - a) / 240 * i AS x, n, 1.06 * s * power(n, -0.2) AS h FROM e, (SELECT unnest(range(0, 241)) AS i)) SELECT i::INT AS i, {R('any_value(x)', 'x', 3)}, {R('1e6 * sum(c * exp(-0.5 * power((x - mid) / h, 2)) / (n * h * 2.5066282746310002))', 'density')} FROM g, c GROUP BY i""")
def density(spark, sf):
    out = tabs.density(table(spark, sf, "orders"), "o_totalprice")
    return rounded(out.withColumns({"x": F.round("x", 3), "density": F.col("density") * 1e6}))


@query(f"""WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), s AS (SELECT l_returnflag AS g, count(*) AS n, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1),
 c AS (SELECT l_returnflag AS g, least(2047, floor((l_quantity - a) / (b - a) * 2048)) AS bin, count(*) AS c, avg(l_quantity) AS mid FROM lineitem, e GROUP BY 1, 2), k AS (SELECT i, g, a - 0.12 * (b - a) + 1.24 * (b - a) / 60 * i AS x, n, 1.06 * s * power(n, -0.2) AS h FROM e, s, (SELECT unnest(range(0, 61)) AS i))
 SELECT k.g AS l_returnflag, i::INT AS i, {R('any_value(x)', 'x')}, {R('sum(c * exp(-0.5 * power((x - mid) / h, 2)) / (n * h * 2.5066282746310002))', 'density', 6)} FROM k JOIN c USING (g) GROUP BY 1, 2""")
def violin(spark, sf):
    out = tabs.density(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", points=61)
    return rounded(out.withColumn("x", F.round("x", 5)), digits=6)


@query("""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem), r AS (SELECT l_quantity, x0, x1, floor((l_extendedprice - y0) / (y1 - y0) * 30) AS row FROM lineitem, e)
 SELECT floor((l_quantity - x0) / (x1 - x0) * 30 + CASE WHEN row % 2 = 1 THEN 0.5 ELSE 0 END)::BIGINT AS "column", row::BIGINT AS row, count(*) AS n FROM r GROUP BY 1, 2""")
def hexbin(spark, sf):
    return tabs.hexbin(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(f"WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a, b, n, {R('sum(n) OVER (PARTITION BY a) / sum(n) OVER ()', 'width')}, {R('n / sum(n) OVER (PARTITION BY a)', 'height')} FROM n")
def mosaic(spark, sf):
    return rounded(tabs.mosaic(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query(f"""WITH t AS (SELECT p_brand, p_type, sum(p_retailprice) AS size FROM part GROUP BY 1, 2 ORDER BY size DESC, p_brand, p_type LIMIT 50) SELECT p_brand, p_type, {R('sum(size)', 'size', 2)}, grouping_id(p_brand, p_type)::BIGINT AS level FROM t GROUP BY ROLLUP (p_brand, p_type)""")
def treemap(spark, sf):
    return rounded(tabs.treemap(table(spark, sf, "part"), ["p_brand", "p_type"], "p_retailprice"), digits=2)


@query(f"SELECT p_brand, {R('avg(p_size)', 'x')}, {R('avg(p_retailprice)', 'y')}, count(*) AS n FROM part GROUP BY 1")
def bubble(spark, sf):
    return rounded(tabs.bubble(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice"))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS period, {R('arg_min(value, (ts, event_id))', 'open')}, {R('max(value)', 'high')}, {R('min(value)', 'low')}, {R('arg_max(value, (ts, event_id))', 'close')}, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def ohlc(spark, sf):
    out = tabs.ohlc(table(spark, sf, "events"), "ts", "value", TIME)
    return rounded(out.withColumn("period", F.col("period").cast("timestamp_ntz")))


@query(f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, {R('min(o_totalprice)', 'low')}, {R('avg(o_totalprice)', 'mean')}, {R('max(o_totalprice)', 'high')} FROM orders GROUP BY 1")
def range_band(spark, sf):
    out = tabs.range_band(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(out.withColumn("period", F.col("period").cast("timestamp_ntz")))


@query(f"SELECT event_id, {R('sum(value) OVER (ORDER BY ts, event_id)', 'total', 3)} FROM events WHERE value IS NOT NULL")
def cumulative(spark, sf):
    return rounded(tabs.cumulative(table(spark, sf, "events"), "value", TIME), "event_id", "total", digits=3)


@query(f"WITH p AS (SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) AS before FROM events WHERE value IS NOT NULL) SELECT event_id, {R('value', 'value')}, {R('before', 'before')} FROM p WHERE before IS NOT NULL")
def lag_pairs(spark, sf):
    return rounded(tabs.lag_pairs(table(spark, sf, "events"), "value", TIME), "event_id", "value", "before")


@query(f"WITH p AS (SELECT o_orderpriority, date_trunc('year', o_orderdate) AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT o_orderpriority, {R('arg_min(m, p)', 'first', 3)}, {R('arg_max(m, p)', 'last', 3)} FROM p GROUP BY 1")
def slope_periods(spark, sf):
    return rounded(tabs.slope_periods(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice"), digits=3)


@query(f"""WITH p AS (SELECT o_orderpriority AS g, date_trunc('year', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT g, period, sum(v) OVER (PARTITION BY g ORDER BY period) AS total FROM p)
 SELECT g, period, {R('total', 'total', 2)}, row_number() OVER (PARTITION BY period ORDER BY total DESC, g)::INT AS rank FROM t""")
def race_totals(spark, sf):
    out = tabs.race_totals(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")
    return rounded(out.withColumn("period", F.col("period").cast("timestamp_ntz")), digits=2)


@query("SELECT floor(floor(c_acctbal / 10) / 10)::BIGINT AS stem, ((floor(c_acctbal / 10)::BIGINT % 10 + 10) % 10)::BIGINT AS leaf, count(*) AS n FROM customer GROUP BY 1, 2")
def stem_leaf(spark, sf):
    return tabs.stem_leaf(table(spark, sf, "customer"), "c_acctbal", 10.0)


@query("SELECT floor(((user_id * 7 % 360) + 11.25) % 360 / 22.5)::BIGINT AS sector, ((value >= 10)::INT + (value >= 20)::INT + (value >= 50)::INT) AS ring, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def wind_rose(spark, sf):
    df = table(spark, sf, "events").withColumn("angle", F.col("user_id") * 7 % 360)
    return tabs.wind_rose(df, "angle", "value")


@query("SELECT floor(l_quantity / 5) * 5.0 AS bin, sum((l_linestatus = 'F')::INT)::BIGINT AS left, sum((l_linestatus <> 'F')::INT)::BIGINT AS right FROM lineitem GROUP BY 1".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def pyramid_sides(spark, sf):
    return tabs.pyramid_sides(table(spark, sf, "lineitem"), "l_quantity", F.col("l_linestatus") == "F", 5.0).withColumn("bin", F.col("bin").cast("double"))


@query(f"""WITH m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my FROM part) SELECT p_size >= mx AS "right", p_retailprice >= my AS top, count(*) AS n, {R('avg(p_size)', 'x')}, {R('avg(p_retailprice)', 'y')} FROM part, m GROUP BY 1, 2""")
def quadrants(spark, sf):
    return rounded(tabs.quadrants(table(spark, sf, "part"), "p_size", "p_retailprice"))


@query(f"""WITH g AS (SELECT l_returnflag AS g, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1), l AS (SELECT g, 'l_quantity' AS axis, a AS mean FROM g UNION ALL SELECT g, 'l_discount', b FROM g UNION ALL SELECT g, 'l_tax', c FROM g)
 SELECT g, axis, {R('mean', 'mean')}, {R('(mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w)', 'scaled')} FROM l WINDOW w AS (PARTITION BY axis)""")
def radar(spark, sf):
    return rounded(tabs.radar(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]))


@query("WITH e AS (SELECT c_mktsegment AS source, c_nationkey AS target, count(*) AS n FROM customer GROUP BY 1, 2) SELECT source, target, n, count(*) OVER (PARTITION BY source) AS out_degree, count(*) OVER (PARTITION BY target) AS in_degree FROM e")
def network_degrees(spark, sf):
    return tabs.network_degrees(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT o_orderstatus AS g, min(o_orderdate)::TIMESTAMP AS start, max(l_shipdate)::TIMESTAMP AS end, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1".replace("AS end", 'AS "end"'))
def timeline_spans(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return tabs.timeline_spans(j, "o_orderstatus", "o_orderdate", "l_shipdate").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"""WITH b AS (SELECT event_type AS period, (value >= 10)::INT + (value >= 25)::INT + (value >= 60)::INT AS bin, (user_id % 2 = 0) AS base FROM events WHERE value IS NOT NULL), n AS (SELECT period, bin, count(*) AS n, sum(base::INT) AS b FROM b GROUP BY 1, 2),
 e AS (SELECT period, unnest([0, 1, 2, 3]) AS bin FROM (SELECT DISTINCT period FROM n)), f AS (SELECT e.period, e.bin, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM e LEFT JOIN n USING (period, bin)), q AS (SELECT bin, (sum(b) + 0.5) / (sum(sum(b)) OVER () + 2) AS q FROM f GROUP BY 1),
 p AS (SELECT *, (n + 0.5) / (sum(n) OVER (PARTITION BY period) + 2) AS p FROM f) SELECT period, sum(n)::BIGINT AS n, {R('sum((p - q) * ln(p / q))', 'psi', 6)} FROM p JOIN q USING (bin) GROUP BY 1""")
def drift_index(spark, sf):
    df = table(spark, sf, "events")
    return rounded(tabs.drift_index(df, "value", F.col("event_type"), F.col("user_id") % 2 == 0, [10.0, 25.0, 60.0]), digits=6)


# --------------------------------------------- limits, designs and regressions


@query(f"""WITH {_DAYS}, c AS (SELECT sum(bad)::DOUBLE / sum(n) AS c FROM d), z AS (SELECT day, n, bad / n::DOUBLE AS p, c, (bad / n::DOUBLE - c) / sqrt(c * (1 - c) / n) AS z FROM d, c), m AS (SELECT *, abs(z - lag(z) OVER (ORDER BY day)) AS mr FROM z), o AS (SELECT avg(mr) / 1.128 AS s FROM m),
 h AS (SELECT day, p, c, 3 * s * sqrt(c * (1 - c) / n) AS h FROM z, o) SELECT day::TIMESTAMP AS day, {R('p', 'p')}, {R('greatest(0, c - h)', 'low')}, {R('least(1, c + h)', 'high')}, p < greatest(0, c - h) OR p > least(1, c + h) AS out FROM h""")
def laney_limits(spark, sf):
    out = control.laney_limits(_days(spark, sf).withColumn("day", F.to_date("day")), "bad", "n", ["day"])
    return rounded(out.withColumn("day", F.col("day").cast("timestamp_ntz")))


@query(f"""WITH s AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS c, covar_samp(p_size, p_retailprice) AS b FROM part)
 SELECT p_partkey, {R('(c * (p_size - mx) * (p_size - mx) - 2 * b * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) * (p_retailprice - my)) / (a * c - b * b)', 't2')} FROM part, s""")
def t2_chart(spark, sf):
    return rounded(control.t2_chart(table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"]), "p_partkey", "t2")


_CELLS = "c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_CELLS}, g AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS g, sum((n - 1) * v) AS w FROM c), a AS (SELECT sum(n * (m - g) * (m - g)) AS ss FROM (SELECT a, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1), (SELECT g FROM g)),
 t AS (SELECT sum(n * (m - g) * (m - g)) AS ss FROM c, (SELECT g FROM g)) SELECT 'l_returnflag' AS term, {R('a.ss', 'ss', 2)} FROM a UNION ALL SELECT 'within', {R('w', 'ss', 2)} FROM g UNION ALL SELECT 'total', {R('w + t.ss', 'ss', 2)} FROM g, t""")
def two_way_anova(spark, sf):
    """Type 1; the terms that SQL gives without solving a system (tests hold all three types against least squares)."""
    out = regression.two_way_anova(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus", 1)
    return rounded(out.filter("term in ('l_returnflag', 'within', 'total')"), "term", "ss", digits=2)


_RATES = "s AS (SELECT sum(y) FILTER (f = 1) AS yf, count(*) FILTER (f = 1)::DOUBLE AS nf, sum(y) FILTER (f = 0) AS yo, count(*) FILTER (f = 0)::DOUBLE AS no, count(*) AS n FROM (SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, (l_linestatus = 'F')::INT AS f FROM lineitem))"
_FIT = f"SELECT term, {R('coef', 'coef')}, {R('se', 'se')}, {R('coef / se', 'z', 3)}, {R(PN('(coef / se)'), 'p', 4)}, {R('exp(coef)', 'ratio')}, {R('dev', 'deviance', 3)}, n FROM t"


def _rates(spark, sf, family: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("f"))
    out, digits = regression.glm(df, "y", ["f"], family), {"z": 3, "p": 4, "deviance": 3}
    return out.select(*((F.round(c, digits.get(c, 5)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(f"""WITH {_RATES}, d AS (SELECT *, -2 * (yf * ln(yf / nf) + yo * ln(yo / no)) AS dev FROM s),
 t AS (SELECT 'intercept' AS term, ln(yo / no) AS coef, 1 / sqrt(yo) AS se, dev, n FROM d UNION ALL SELECT 'f', ln(yf / nf) - ln(yo / no), sqrt(1 / yf + 1 / yo), dev, n FROM d) {_FIT}""")
def poisson_rate(spark, sf):
    return _rates(spark, sf, "poisson")


@query(f"""WITH {_RATES}, d AS (SELECT *, -2 * (yf * ln(yf / nf) + (nf - yf) * ln(1 - yf / nf) + yo * ln(yo / no) + (no - yo) * ln(1 - yo / no)) AS dev FROM s),
 t AS (SELECT 'intercept' AS term, ln(yo / (no - yo)) AS coef, sqrt(1 / yo + 1 / (no - yo)) AS se, dev, n FROM d UNION ALL SELECT 'f', ln(yf / (nf - yf)) - ln(yo / (no - yo)), sqrt(1 / yf + 1 / (nf - yf) + 1 / yo + 1 / (no - yo)), dev, n FROM d) {_FIT}""")
def logit_rate(spark, sf):
    return _rates(spark, sf, "binomial")


@query(f"""WITH s AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mx, covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem), b AS (SELECT *, c * n / (v * n + 1000.0 * v) AS b FROM s)
 SELECT 'l_quantity' AS term, {R('b', 'coef', 3)} FROM b UNION ALL SELECT 'intercept', {R('my - b * mx', 'coef', 3)} FROM b""")
def ridge(spark, sf):
    return rounded(regression.ridge(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], 1000.0), digits=3)


@query(f"""WITH s AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mx, covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) AS c, stddev_pop(l_quantity) AS s FROM lineitem), b AS (SELECT *, sign(c) * greatest(abs(c) - 500, 0) / s AS b FROM s)
 SELECT 'l_quantity' AS term, {R('b', 'coef', 3)} FROM b UNION ALL SELECT 'intercept', {R('my - b * mx', 'coef', 3)} FROM b""")
def lasso(spark, sf):
    return rounded(regression.elastic_net(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], 500.0), digits=3)


@query(" UNION ALL ".join(f"SELECT '{c}' AS terms, 1 AS size, {R(f'power(corr(l_extendedprice, {c}), 2)', 'r2', 6)} FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def best_subsets(spark, sf):
    out = regression.best_subsets(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return rounded(out.filter("size = 1"), "terms", "size", "r2", digits=6)


from qualispark import catalogue_charts, catalogue_models, catalogue_studies  # noqa: E402, F401  they register their queries
