"""Registered queries of the charts in ``operators/chart_lens.py``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualispark.catalogue import TIME, P, R, purchases, query, rounded, table
from qualispark.operators import chart_lens


@query(f"WITH {P}, m AS (SELECT avg(x) AS m FROM p) SELECT event_id, {R('x', 'x')}, {R('sum(x - m) OVER (ORDER BY i)', 'cumsum', 4)} FROM p, m")
def cumsum(spark, sf):
    out = chart_lens.cumsum(purchases(spark, sf), "value", TIME)
    return out.select("event_id", F.round("x", 5).alias("x"), (F.round("cumsum", 4) + 0.0).alias("cumsum"))


@query(f"SELECT o_orderpriority AS category, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()', 'share')} FROM orders GROUP BY 1")
def pyramid(spark, sf):
    return rounded(chart_lens.pyramid(table(spark, sf, "orders"), "o_orderpriority"))


@query(
    f"""WITH m AS (SELECT median(p_size) AS a, median(p_retailprice) AS b FROM part) SELECT p_partkey, p_size::DOUBLE AS x, {R('p_retailprice', 'y')}, {R('a', 'x_median')}, {R('b', 'y_median')}, p_size >= a AS "right", p_retailprice >= b AS top FROM part, m"""
)
def quadrant(spark, sf):
    return rounded(chart_lens.quadrant(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_partkey"]))


@query(
    f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS step, 'u' || (user_id % 40) AS entity, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY value DESC, entity)::INT AS rank FROM e) SELECT step, entity, {R('value', 'value')}, rank FROM r WHERE rank <= 12"""
)
def race(spark, sf):
    df = table(spark, sf, "events").select("ts", "event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("who"))
    return rounded(chart_lens.race(df, "who", "day", "value", TIME))


@query(
    """WITH e AS (SELECT 'n' || (l_suppkey % 90) AS source, 'n' || (l_partkey % 90) AS target, count(*) AS n FROM lineitem WHERE l_suppkey % 90 <> l_partkey % 90 GROUP BY 1, 2),
 d AS (SELECT node, sum(n)::BIGINT AS degree FROM (SELECT source AS node, n FROM e UNION ALL SELECT target, n FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
 SELECT source, target, n, a.degree AS source_degree, b.degree AS target_degree FROM e JOIN d a ON a.node = source JOIN d b ON b.node = target"""
)
def network(spark, sf):
    ends = table(spark, sf, "lineitem").select(*(F.concat(F.lit("n"), (F.col(c) % 90).cast("string")).alias(c) for c in ("l_suppkey", "l_partkey")))
    return chart_lens.network(ends, "l_suppkey", "l_partkey")


@query("SELECT o_orderpriority AS label, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(l_shipdate, '%Y-%m-%d') AS \"end\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL")
def timeline(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = chart_lens.timeline(joined, "o_orderpriority", "o_orderdate", "l_shipdate")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})


@query(
    f"""WITH o AS (SELECT event_type AS period, value::DOUBLE AS v FROM events WHERE value IS NOT NULL), s AS (SELECT min(v) AS low, max(v) AS high, count(*) AS k, stddev_samp(v) AS s FROM o),
 b AS (SELECT period, least(2047, floor((v - low) / (high - low) * 2048)) AS bin, count(*) AS c, avg(v) AS at_ FROM o, s GROUP BY 1, 2), n AS (SELECT period, count(*) AS n, avg(v) AS mean FROM o GROUP BY 1),
 g AS (SELECT period, i, low - 0.05 * (high - low) + 1.1 * (high - low) * i / 120 AS x, c, at_, 1.06 * s * power(k, -0.2) AS h FROM b, s, range(121) AS t(i)),
 d AS (SELECT period, i, any_value(x) AS x, sum(c * exp(-0.5 * power((x - at_) / h, 2)) / (h * 2.5066282746310002)) AS k FROM g GROUP BY 1, 2)
 SELECT period, i::INT AS i, {R('x', 'x', 6)}, {R('k / n', 'density', 7)}, {R('mean', 'mean')}, n FROM d JOIN n USING (period)"""
)
def drift(spark, sf):
    out = chart_lens.drift(table(spark, sf, "events"), "value", "event_type")
    digits = {"x": 6, "density": 7}
    return out.select(*((F.round(c, digits.get(c, 5)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query(
    f"""WITH m AS (SELECT l_suppkey::VARCHAR AS entity, avg(l_discount) AS b, avg(l_tax) AS a FROM lineitem GROUP BY 1) SELECT entity, {R('b', 'before')}, {R('a', 'after')}, {R('a - b', 'delta')} FROM m ORDER BY a - b DESC, entity LIMIT 50"""
)
def slope(spark, sf):
    return rounded(chart_lens.slope(table(spark, sf, "lineitem"), "l_suppkey", "l_discount", "l_tax"))


@query(
    f"""WITH n AS (SELECT l_returnflag AS "inner", l_linestatus AS "outer", count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT "inner", "outer", n, {R('n / sum(n) OVER ()', 'share')}, {R('n / sum(n) OVER (PARTITION BY "inner")', 'within')} FROM n"""
)
def sunburst(spark, sf):
    return rounded(chart_lens.sunburst(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query(f"""SELECT strftime(o_orderdate, '%Y-%m') AS time, o_orderpriority AS "group", {R('avg(o_totalprice)', 'mean', 3)}, count(*) AS n FROM orders GROUP BY 1, 2""")
def multiline(spark, sf):
    df = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(chart_lens.multiline(df, "month", "o_totalprice", "o_orderpriority"), digits=3)


@query(
    f"""WITH {P}, m AS (SELECT median(x) AS median FROM p), s AS (SELECT event_id, i, x, median, sign(x - median)::INT AS side FROM p, m),
 w AS (SELECT *, coalesce((lag(side) OVER (ORDER BY i) <> side)::INT, 1) AS nw FROM s WHERE side <> 0)
 SELECT event_id, {R('x', 'x')}, {R('median', 'median')}, side, (sum(nw) OVER (ORDER BY i))::DOUBLE AS run FROM w UNION ALL SELECT event_id, {R('x', 'x')}, {R('median', 'median')}, side, NULL::DOUBLE FROM s WHERE side = 0"""
)
def run_chart(spark, sf):
    out = chart_lens.run_chart(purchases(spark, sf), "value", TIME)
    return rounded(out.withColumn("run", F.col("run").cast("double")), "event_id", "x", "median", "side", "run")
