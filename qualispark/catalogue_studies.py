"""Registered queries of regression diagnostics, capability studies and measurement studies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.catalogue import _SUB_ALL, MR, PC, PF, PT, TIME, R, _area, _subgroups_all, purchases, query, rounded, table
from qualispark.operators import capability_study as cs
from qualispark.operators import diagnostics, studies


def _digits(df: DataFrame, digits: dict[str, int], default: int = 5) -> DataFrame:
    return df.select(*((F.round(c, digits.get(c, default)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# ------------------------------------------------------------ regression

_LINE = """l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS y, l_quantity AS u, l_discount AS v FROM lineitem),
 m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(u) * count(*) AS a, var_pop(v) * count(*) AS c, covar_pop(u, v) * count(*) AS b, covar_pop(y, u) * count(*) AS yu, covar_pop(y, v) * count(*) AS yv, var_pop(y) * count(*) AS yy FROM l),
 f AS (SELECT *, a * c - b * b AS det, (c * yu - b * yv) / (a * c - b * b) AS b1, (a * yv - b * yu) / (a * c - b * b) AS b2 FROM m), g AS (SELECT *, (yy - b1 * yu - b2 * yv) / (n - 3) AS mse FROM f),
 e AS (SELECT l.*, n, mse, my + b1 * (u - mu) + b2 * (v - mv) AS fit, 1 / n + ((u - mu) * (u - mu) * c - 2 * (u - mu) * (v - mv) * b + (v - mv) * (v - mv) * a) / det AS h FROM l, g),
 t AS (SELECT *, y - fit AS e, (y - fit) / sqrt(mse * (1 - h)) AS t FROM e)"""


@query(
    f"""WITH {_LINE}, d AS (SELECT *, t * t * h / (3 * (1 - h)) AS cook, t * sqrt((n - 4) / (n - 3 - t * t)) * sqrt(h / (1 - h)) AS dff FROM t)
 SELECT l_orderkey, l_linenumber, l_suppkey, {R('fit', 'fitted', 1)}, {R('e', 'residual', 1)}, {R('h', 'leverage', 8)}, {R('t', 'studentized')}, {R('cook', 'cooks_d', 8)}, {R('dff', 'dffits', 6)},
  h > 6 / n AS high_leverage, cook > 4 / n AS high_cooks_d, abs(dff) > 2 * sqrt(3 / n) AS high_dffits, abs(t) > 3 AS outlier FROM d"""
)
def ols_influence(spark, sf):
    out = diagnostics.influence(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber", "l_suppkey"])
    return _digits(out, {"fitted": 1, "residual": 1, "leverage": 8, "cooks_d": 8, "dffits": 6})


_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


@query(f"WITH {_LINE}, d AS (SELECT e, e - lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, y) AS d FROM t) SELECT count(*) AS n, {R('sum(d * d) / sum(e * e)', 'dw')} FROM d")
def durbin_watson(spark, sf):
    return rounded(diagnostics.durbin_watson(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], _ORDER))


def stepwise(spark, sf):
    """Choice among three predictors; tests hold it against fits by least squares."""
    return rounded(diagnostics.stepwise(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "backward"))


query()(stepwise)

_SCORES = "s AS (SELECT (l_returnflag = 'R') AS y, l_quantity AS s, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem)"
_CURVE = f"""{_SCORES}, n AS (SELECT count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS q FROM s),
 c AS (SELECT s, sum(count(*) FILTER (y)) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(count(*) FILTER (NOT y)) OVER (ORDER BY s DESC)::BIGINT AS fp FROM s GROUP BY s)"""


def _returned(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("y", F.col("l_returnflag") == "R")


@query(f"WITH {_CURVE} SELECT s AS threshold, tp, fp, {R('tp / p', 'tpr')}, {R('fp / q', 'fpr')} FROM c, n")
def roc_curve(spark, sf):
    return rounded(diagnostics.roc_curve(_returned(spark, sf), "y", "l_quantity"))


@query(
    f"""WITH {_CURVE}, r AS (SELECT y, s, (rank() OVER (ORDER BY s))::DOUBLE + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s), a AS (SELECT (sum(r) FILTER (y) - any_value(p) * (any_value(p) + 1) / 2) / any_value(p) / any_value(q) AS auc FROM r, n),
 b AS (SELECT s, tp / p AS t, fp / q AS f FROM c, n ORDER BY tp / p - fp / q DESC, s DESC LIMIT 1) SELECT p::BIGINT AS positives, q::BIGINT AS negatives, {R('auc', 'auc')}, s AS best_threshold, {R('t', 'best_tpr')}, {R('f', 'best_fpr')} FROM n, a, b"""
)
def roc_summary(spark, sf):
    return rounded(diagnostics.roc_summary(_returned(spark, sf), "y", "l_quantity"))


@query(
    f"""WITH {_SCORES}, i AS (SELECT y, s / 150 AS s, row_number() OVER (ORDER BY s, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM s),
 g AS (SELECT y, s, CASE WHEN i < n % 10 * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - n % 10 * (n // 10 + 1)) // (n // 10) END + 1 AS g FROM i),
 o AS (SELECT g::INT AS "group", count(*) AS n, count(*) FILTER (y) AS o1, sum(s) AS e1, count(*) FILTER (NOT y) AS o0, sum(1 - s) AS e0 FROM g GROUP BY 1),
 c AS (SELECT *, sum(power(o1 - e1, 2) / e1 + power(o0 - e0, 2) / e0) OVER () AS chi FROM o)
 SELECT "group", n, o1 AS observed_1, {R('e1', 'expected_1', 3)}, o0 AS observed_0, {R('e0', 'expected_0', 3)}, {R('chi', 'chi2', 3)}, 8 AS df, {R('greatest(0, ' + PC('chi', '8.0') + ')', 'p')} FROM c"""
)
def hosmer_lemeshow(spark, sf):
    df = _returned(spark, sf).withColumn("s", F.col("l_quantity") / 150)
    return _digits(diagnostics.hosmer_lemeshow(df, "y", "s", _ORDER), {"expected_1": 3, "expected_0": 3, "chi2": 3})


# ------------------------------------------------------------ capability

_NORMAL = "exp(-y * y / 2) / 2.5066282746310002"


def _capability(source: str, low: float | None, high: float, target: float | None) -> str:
    """SQL of the study of the row s (n, m, sd, w, below, above): normal tails by integration, their inverse by Newton's steps."""
    span = f"{high - low}" if low is not None else "NULL"
    cpl = lambda s: f"(m - {low}) / (3 * {s})" if low is not None else "NULL"
    cpu = lambda s: f"({high} - m) / (3 * {s})"
    cpk = lambda s: f"least({cpl(s)}, {cpu(s)})"
    half = lambda s: f"1.959963984540054 * sqrt(1 / (9.0 * n) + power({cpk(s)}, 2) / (2.0 * (n - 1)))"
    out = lambda s: " + ".join(f"0.5 - ({_area(_NORMAL, z)})" for z in ([f"((m - {low}) / {s})"] if low is not None else []) + [f"(({high} - m) / {s})"])
    cpm = f"{span} / (6 * sqrt(sd * sd + power(m - {target}, 2)))" if target is not None and low is not None else "NULL"
    return f"""WITH RECURSIVE {source}, t AS (SELECT *, {out('w')} AS pw, {out('sd')} AS po FROM s),
 z AS (SELECT 0 AS i, 0.0::DOUBLE AS z, pw FROM t UNION ALL SELECT i + 1, z + (0.5 - ({_area(_NORMAL, 'z')}) - pw) / (exp(-z * z / 2) / 2.5066282746310002), pw FROM z WHERE i < 40)
 SELECT n, {R('m', 'mean')}, {R('sd', 'sd')}, below, above, {R('w', 'within')}, {R(f'{span} / (6 * w)', 'cp')}, {R(cpl('w'), 'cpl')}, {R(cpu('w'), 'cpu')}, {R(cpk('w'), 'cpk')},
  {R(f'{span} / (6 * sd)', 'pp')}, {R(cpl('sd'), 'ppl')}, {R(cpu('sd'), 'ppu')}, {R(cpk('sd'), 'ppk')}, {R(cpm, 'cpm')},
  {R(cpk('w') + ' - ' + half('w'), 'cpk_low')}, {R(cpk('w') + ' + ' + half('w'), 'cpk_high')}, {R(cpk('sd') + ' - ' + half('sd'), 'ppk_low')}, {R(cpk('sd') + ' + ' + half('sd'), 'ppk_high')},
  {R('1e6 * t.pw', 'ppm_within', 1)}, {R('1e6 * po', 'ppm_overall', 1)}, {R('z', 'z_bench', 4)}, NULL::DOUBLE AS power FROM t, (SELECT z FROM z WHERE i = 40)"""


_PPM = {"ppm_within": 1, "ppm_overall": 1, "z_bench": 4}


@query(_capability(f"{MR}, s AS (SELECT n, c AS m, sd, s AS w, 0::BIGINT AS below, (SELECT count(*) FROM p WHERE x > 120) AS above FROM l)", None, 120.0, None))
def capability_one_sided(spark, sf):
    return _digits(cs.capability_study(purchases(spark, sf), "value", usl=120.0, order=TIME), _PPM)


@query(
    _capability(
        f"{_SUB_ALL}, x AS (SELECT x FROM (SELECT p, x, i, count(*) OVER (PARTITION BY p) AS k FROM g) WHERE ((i - 1) // 5 + 1) * 5 <= k), s AS (SELECT count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, (SELECT avg(r) FROM s) / 2.326 AS w, count(*) FILTER (x < 5) AS below, count(*) FILTER (x > 60) AS above FROM x)".replace(" s AS (SELECT avg(x) AS m", " sub AS (SELECT avg(x) AS m").replace("FROM s)", "FROM sub)"),
        5.0, 60.0, 30.0,
    )
)
def capability_subgroups(spark, sf):
    return _digits(cs.capability_study(_subgroups_all(spark, sf), "l_quantity", 5.0, 60.0, 30.0, subgroup="subgroup"), _PPM)


def capability_boxcox(spark, sf):
    """Study of the best power; tests hold it against the likelihood and plain indices."""
    return rounded(cs.capability_study(table(spark, sf, "orders"), "o_totalprice", usl=600000.0, order=["o_orderdate", "o_orderkey"], transform="box-cox"))


query()(capability_boxcox)


# ------------------------------------------------------------ measurement studies


@query(
    f"""WITH k AS (SELECT 'o' || l_suppkey % 4 AS o, 'p' || l_partkey % 6 AS p, l_quantity AS x, row_number() OVER (PARTITION BY l_suppkey % 4, l_partkey % 6 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS i FROM lineitem),
 j AS (SELECT *, count(*) OVER (PARTITION BY o, p) AS many FROM k), own AS (SELECT o, p, x FROM j WHERE i <= (SELECT min(many) FROM j)),
 c AS (SELECT o, p, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS e FROM own GROUP BY o, p), ops AS (SELECT o, count(*) AS b, avg(m) AS mo, var_pop(m) * count(*) AS sp, sum(e) AS se, min(n) AS r FROM c GROUP BY o),
 t AS (SELECT count(*) AS operators, min(b) AS parts, min(r) AS replicates, min(r) * min(b) * var_pop(mo) * count(*) / (count(*) - 1) AS mso, min(r) * sum(sp) / (count(*) * (min(b) - 1)) AS msp, sum(se) / (count(*) * min(b) * (min(r) - 1)) AS mse FROM ops),
 v AS (SELECT *, mse AS e, greatest(0, (mso - msp) / (parts * replicates)) AS a, greatest(0, (msp - mse) / replicates) AS pv FROM t)
 SELECT operators, parts, replicates, {R('mso', 'ms_operator', 4)}, {R('msp', 'ms_part', 4)}, {R('mse', 'ms_error', 4)}, {R('e', 'repeatability', 4)}, {R('a', 'reproducibility', 4)}, {R('pv', 'part', 4)}, {R('100 * sqrt(e / (e + a + pv))', 'repeatability_share', 4)}, {R('100 * sqrt(a / (e + a + pv))', 'reproducibility_share', 4)},
  {R('100 * sqrt((e + a) / (e + a + pv))', 'grr_share', 4)}, {R('100 * sqrt(pv / (e + a + pv))', 'part_share', 4)}, {R('600 * sqrt(e + a) / 100', 'grr_of_tolerance', 4)}, {R('sqrt(2 * pv / (e + a))', 'ndc', 4)} FROM v"""
)
def nested_gauge(spark, sf):
    """Four groups of suppliers, six of parts each; of every cell as many lines as the smallest has (a nested study is balanced)."""
    from pyspark.sql import Window

    df = table(spark, sf, "lineitem").select("*", F.concat(F.lit("o"), F.col("l_suppkey") % 4).alias("o"), F.concat(F.lit("p"), F.col("l_partkey") % 6).alias("p"))
    least = df.groupBy("o", "p").count().agg(F.min("count").alias("least"))
    rows = df.withColumn("i", F.row_number().over(Window.partitionBy("o", "p").orderBy(*_ORDER))).join(F.broadcast(least)).filter("i <= least")
    return rounded(studies.nested_gauge(rows, "l_quantity", "p", "o", 100.0), digits=4)


# The reference of a part is its list price; a line's price for one piece is the measurement.
_PIECES = "SELECT p_partkey AS part, p_retailprice AS r, l_extendedprice / l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0"


def _pieces(spark, sf) -> DataFrame:
    own = table(spark, sf, "lineitem").filter("l_quantity > 0").select(F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return own.join(table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("r")), "part")


_PART = f"k AS ({_PIECES}), g AS (SELECT part, count(*) AS n, avg(r) AS reference, avg(x) AS mean, stddev_samp(x) AS sd, avg(x) - avg(r) AS bias FROM k GROUP BY part)"


@query(
    f"""WITH {_PART}, t AS (SELECT *, bias * sqrt(n) / nullif(sd, 0) AS t FROM g) SELECT part, n, {R('reference', 'reference', 3)}, {R('mean', 'mean', 3)}, {R('sd', 'sd', 3)}, {R('bias', 'bias', 3)}, {R('100 * bias / reference', 'bias_share', 3)}, {R('t', 't', 4)}, {R(PT('t', '(n - 1)'), 'p', 4)} FROM t"""
)
def gauge_bias(spark, sf):
    out = studies.gauge_bias(_pieces(spark, sf), "part", "r", "x")
    return _digits(out, {"t": 4, "p": 4}, 3)


_T975 = "(1.959963984540054 + 2.372271287 / (n - 1.0) + 2.822785 / power(n - 1.0, 2))"  # Cornish and Fisher's expansion, for many degrees of freedom


@query(
    f"""WITH {_PART}, a AS (SELECT count(*) AS n, avg(x - reference) AS mb, stddev_samp(x - reference) / sqrt(count(*)) AS se FROM k JOIN g USING (part)),
 f AS (SELECT count(*) AS parts, regr_slope(bias, reference) AS b, regr_intercept(bias, reference) AS i, regr_r2(bias, reference) AS r2, sqrt((regr_syy(bias, reference) - regr_slope(bias, reference) * regr_sxy(bias, reference)) / (count(*) - 2) / regr_sxx(bias, reference)) AS sb FROM g)
 SELECT parts, n, {R('b', 'slope')}, {R('i', 'intercept', 3)}, {R('r2', 'r2')}, {R('sb', 'se_slope')}, {R(PT('(b / sb)', '(parts - 2)'), 'p_slope', 4)}, {R('mb', 'mean_bias', 3)}, {R(f'mb - {_T975} * se', 'low', 2)}, {R(f'mb + {_T975} * se', 'high', 2)},
  {R('mb / se', 't', 3)}, {R(PT('(mb / se)', '(n - 1)'), 'p', 4)}, {R('100 * abs(b) * 500', 'linearity_share', 2)}, {R('100 * abs(mb) / 500', 'bias_share', 3)} FROM a, f"""
)
def gauge_linearity(spark, sf):
    out = studies.gauge_linearity(_pieces(spark, sf), "part", "r", "x", 500.0)
    return _digits(out, {"intercept": 3, "p_slope": 4, "mean_bias": 3, "low": 2, "high": 2, "t": 3, "p": 4, "linearity_share": 2, "bias_share": 3})


def _ratings(spark, sf, appraisers: int) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("who", F.concat(F.lit("a"), F.col("l_linenumber") % appraisers))


def _modes(appraisers: int) -> str:
    return f"""k AS (SELECT 'a' || l_linenumber % {appraisers} AS a, l_partkey AS p, l_returnflag AS r, count(*) AS c FROM lineitem GROUP BY 1, 2, 3), o AS (SELECT a, p, r, row_number() OVER (PARTITION BY a, p ORDER BY c DESC, r) AS i FROM k),
 m AS (SELECT a, p, r FROM o WHERE i = 1 AND p IN (SELECT p FROM k GROUP BY p HAVING count(DISTINCT a) = (SELECT count(DISTINCT a) FROM k)))"""


@query(
    """WITH c AS (SELECT 'a' || l_linenumber % 3 AS appraiser, l_partkey AS p, count(*) AS n, min(l_returnflag) = max(l_returnflag) AS same FROM lineitem GROUP BY 1, 2)
 SELECT appraiser, count(*) FILTER (n > 1 AND same) AS matched, count(*) FILTER (n > 1) AS total, """ + R("100 * count(*) FILTER (n > 1 AND same) / count(*) FILTER (n > 1)", "share") + " FROM c GROUP BY 1"
)
def within_appraiser(spark, sf):
    return rounded(studies.within_appraiser(_ratings(spark, sf, 3), "who", "l_partkey", "l_returnflag"))


@query(
    """WITH s AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'N' ELSE 'R' END AS s FROM lineitem), c AS (SELECT 'a' || l_linenumber % 3 AS appraiser, l_partkey AS p, bool_and(l_returnflag = s) AS same FROM s GROUP BY 1, 2)
 SELECT appraiser, count(*) FILTER (same) AS matched, count(*) AS total, """ + R("100 * count(*) FILTER (same) / count(*)", "share") + " FROM c GROUP BY 1"
)
def against_standard(spark, sf):
    """Return flags against a flag by part number."""
    at = F.col("l_partkey") % 3
    df = _ratings(spark, sf, 3).withColumn("s", F.when(at == 0, "A").when(at == 1, "N").otherwise("R"))
    return rounded(studies.against_standard(df, "who", "l_partkey", "l_returnflag", "s"))


@query(
    f"""WITH {_modes(3)}, x AS (SELECT p, r, count(*) AS c FROM m GROUP BY p, r), q AS (SELECT p, (sum(c * c) - 3) / 6.0 AS q, count(*) AS d FROM x GROUP BY p), e AS (SELECT sum(s * s) AS e FROM (SELECT sum(c) / (SELECT sum(c) FROM x) AS s FROM x GROUP BY r))
 SELECT 3::BIGINT AS appraisers, count(*) AS parts, count(*) FILTER (d = 1) AS matched, {R('avg(q)', 'p_observed')}, {R('any_value(e)', 'p_expected')}, {R('(avg(q) - any_value(e)) / (1 - any_value(e))', 'kappa')} FROM q, e"""
)
def fleiss_kappa(spark, sf):
    return rounded(studies.fleiss_kappa(_ratings(spark, sf, 3), "who", "l_partkey", "l_returnflag"))


@query(
    f"""WITH {_modes(2)}, i AS (SELECT a, p, (dense_rank() OVER (ORDER BY r) - 1)::DOUBLE AS i FROM m), b AS (SELECT x.i AS u, y.i AS v FROM i x JOIN i y ON x.p = y.p AND x.a = 'a0' AND y.a = 'a1'), top AS (SELECT max(i) AS k FROM i),
 s AS (SELECT count(*) AS parts, count(*) FILTER (u = v) AS matched, 1 - avg(power((u - v) / k, 2)) AS po, 1 - (avg(u * u) + avg(v * v) - 2 * avg(u) * avg(v)) / any_value(k * k) AS pe FROM b, top)
 SELECT parts, matched, {R('po', 'p_observed')}, {R('pe', 'p_expected')}, {R('(po - pe) / (1 - pe)', 'kappa')} FROM s"""
)
def cohen_kappa(spark, sf):
    return rounded(studies.cohen_kappa(_ratings(spark, sf, 2), "who", "l_partkey", "l_returnflag", "quadratic"))


def variance_budget(spark, sf):
    """Three crossed factors of unequal cells; tests hold it against least squares."""
    return rounded(studies.variance_budget(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_linenumber"]), digits=3)


query()(variance_budget)
