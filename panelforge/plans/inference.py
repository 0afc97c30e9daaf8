"""Queries: summaries, comparisons, costs, regimes, discovery rates, folds, rates of agreement, resampling, factors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import bayes, factors, lattice, resample, rollup, scoring, signals, stats
from .base import SERIES, daily, months, months_sql, r, rounded, series, stable, table, trades

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = stable(sql)
        return function

    return add


def horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    near = f"exp(-abs({x}) * abs({x}) / 2) * {horner_sql(numbers.TAIL_NUMERATOR, f'abs({x})')} / {horner_sql(numbers.TAIL_DENOMINATOR, f'abs({x})')}"
    return f"(CASE WHEN {x} > 0 THEN 1 - {near} ELSE {near} END)"


def inverse_sql(p: str) -> str:
    q = f"({p} - 0.5)"
    middle = f"({horner_sql(numbers.INVERSE_A, f'({q} * {q})')} * {q} / {horner_sql(numbers.INVERSE_B, f'({q} * {q})')})"
    tail = lambda z: f"({horner_sql(numbers.INVERSE_C, z)} / {horner_sql(numbers.INVERSE_D, z)})"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END)"


def summary_sql(by: str, source: str, date: str, value: str) -> str:
    return f"""x0 AS (SELECT {by}, {date} AS date, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {date}) AS k FROM {source} WHERE {value} IS NOT NULL),
s0 AS (SELECT {by}, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, min(date) AS first_date, max(date) AS last_date FROM x0 GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE least(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)), n - 1)::INT END AS lags FROM s0),
u0 AS (SELECT x0.{by}, k, v - m AS u, lags FROM x0 JOIN s1 USING ({by})),
h AS (SELECT a.{by}, sum((CASE WHEN a.k = b.k THEN 1.0 ELSE 2 * (1 - (a.k - b.k) / (a.lags + 1.0::DOUBLE)) END) * a.u * b.u) AS s FROM u0 a JOIN u0 b ON a.{by} = b.{by} AND b.k BETWEEN a.k - a.lags AND a.k GROUP BY 1)"""


SUMMARY = """SELECT {by}, n AS n_months, first_date, last_date, round(m, 8) AS average, round(m * 12, 8) AS annualised, round(CASE WHEN n >= 2 THEN sd END, 8) AS deviation,
  round(CASE WHEN n >= 2 AND sd > 0 THEN m / sd * sqrt(12.0::DOUBLE) END, 6) AS sharpe, round(CASE WHEN n >= 2 AND sd > 0 AND s > 0 THEN m / (sqrt(s) / n) END, 6) AS t_stat, lags FROM s1 LEFT JOIN h USING ({by})"""


def shown(out: DataFrame) -> DataFrame:
    return rounded(rounded(out, "average", "annualised", "deviation", digits=8), "sharpe", "t_stat")


@query(f"WITH {SERIES}, {summary_sql('name', 'series', 'date', 'value')} {SUMMARY.format(by='name')}")
def nw_tstat(spark: SparkSession, sf: str) -> DataFrame:
    return shown(stats.summary(series(spark, sf), ["name"], "date", "value"))


@query(f"WITH {months_sql('l_suppkey')}, {summary_sql('l_suppkey', 'months', 'month', 'ret')} {SUMMARY.format(by='l_suppkey')}")
def nw_tstat_each(spark: SparkSession, sf: str) -> DataFrame:
    return shown(stats.summary(months(spark, sf, "l_suppkey"), ["l_suppkey"], "month", "ret"))


PAIR = f"{SERIES}, a AS (SELECT date, value FROM series WHERE name = 'vw' AND month(date) <> 5), b AS (SELECT date, value FROM series WHERE name = 'ew' AND month(date) <> 8)"


def pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = series(spark, sf)
    return rows.filter("name = 'vw' and month(date) <> 5").select("date", "value"), rows.filter("name = 'ew' and month(date) <> 8").select("date", "value")


@query(f"""WITH {PAIR} SELECT count(*) AS n_overlap, round(corr(a.value, b.value), 8) AS correlation, round(avg((sign(a.value) = sign(b.value))::INT), 8) AS sign_agreement, round(avg(b.value - a.value), 8) AS mean_diff,
  round(stddev_samp(b.value - a.value), 8) AS tracking_error, round(max(abs(b.value - a.value)), 8) AS max_abs_diff FROM a JOIN b USING (date)""")
def series_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.similarity(*pair(spark, sf), "date", "value"), "correlation", "sign_agreement", "mean_diff", "tracking_error", "max_abs_diff", digits=8)


@query(f"""WITH {PAIR} SELECT count(a.value) AS n_a, count(b.value) AS n_b, count(*) FILTER (a.value IS NOT NULL AND b.value IS NOT NULL) AS n_common, round(avg(a.value), 8) AS mean_a, round(avg(b.value), 8) AS mean_b,
  round(avg(a.value) FILTER (b.value IS NOT NULL), 8) AS mean_a_common, round(avg(b.value) FILTER (a.value IS NOT NULL), 8) AS mean_b_common, round(avg(a.value - b.value), 8) AS paired_difference FROM a FULL JOIN b ON a.date = b.date""")
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.paired_difference(*pair(spark, sf), "date", "value"), "mean_a", "mean_b", "mean_a_common", "mean_b_common", "paired_difference", digits=8)


COSTS = f"{PAIR}, t AS (SELECT date, abs(value) / 2 AS turnover FROM b)"


def turnover(spark: SparkSession, sf: str) -> DataFrame:
    return pair(spark, sf)[1].select("date", (F.abs("value") / 2).alias("turnover"))


@query(f"WITH {COSTS} SELECT date, round(value - turnover * (25.0::DOUBLE / 1e4), 8) AS net, value AS gross, round(turnover, 8) AS turnover FROM a JOIN t USING (date)")
def net_of_costs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.net_of_costs(pair(spark, sf)[0], turnover(spark, sf), "date", "value", 25.0), "net", "turnover", digits=8)


@query(f"""WITH {COSTS}, m AS (SELECT avg(value) AS g, avg(turnover) AS t, count(*) AS n FROM a JOIN t USING (date))
SELECT n AS n_months, CASE WHEN n = 0 OR t <= 0 THEN 'zero_turnover' WHEN g <= 0 THEN 'non_positive_gross' ELSE 'found' END AS status, round(CASE WHEN n > 0 AND t > 0 AND g > 0 THEN g / t * 1e4 END, 6) AS break_even_bps FROM m""")
def cost_breakeven(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.break_even(pair(spark, sf)[0], turnover(spark, sf), "date", "value"), "break_even_bps")


@query(f"WITH {PAIR}, g AS (SELECT avg(value) AS g FROM a) SELECT t AS turnover, round(CASE WHEN t > 0 THEN g / t * 1e4 END, 6) AS break_even_bps FROM g, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 1.0])::DOUBLE AS t)")
def breakeven_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.break_even_grid(pair(spark, sf)[0], "value", [0.0, 0.1, 0.25, 0.5, 1.0]), "break_even_bps")


@query(f"WITH {PAIR} SELECT month(date) % 2 = 0 AS state, count(value) AS n_months, round(avg(value), 8) AS average, round(stddev_samp(value), 8) AS deviation FROM a GROUP BY 1")
def regime_split(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = pair(spark, sf)
    return rounded(stats.regime_split(a, a.select("date", (F.month("date") % 2 == 0).alias("state")), "date", "value", "state"), "average", "deviation", digits=8)


@query(f"""WITH {PAIR}, d AS (SELECT a.value - b.value AS d, month(date) <= 6 AS s FROM a JOIN b USING (date)), m AS (SELECT count(*) FILTER (s) AS n_target, count(*) FILTER (NOT s) AS n_other, avg(d) FILTER (s) AS t, avg(d) FILTER (NOT s) AS o FROM d)
SELECT n_target, n_other, round(t, 8) AS delta_target, round(o, 8) AS delta_other, sign(t) = 1 AS hit FROM m""")
def prediction_contrast(spark: SparkSession, sf: str) -> DataFrame:
    a, b = pair(spark, sf)
    out = stats.prediction_contrast(a, b, a.select("date", (F.month("date") <= 6).alias("state")), "date", "value", "state", 1)
    return rounded(out, "delta_target", "delta_other", digits=8)


@query(f"""WITH {PAIR}, x AS (SELECT date, a.value AS y, b.value AS f, row_number() OVER (ORDER BY date) AS k FROM a JOIN b USING (date)),
c AS (SELECT count(*) AS n, regr_slope(y, f) AS beta, regr_intercept(y, f) AS alpha, sum(f) AS sf, sum(f * f) AS sff, least(floor(4 * pow(count(*) / 100.0::DOUBLE, 2.0::DOUBLE / 9)), count(*) - 1)::INT AS lags FROM x),
u AS (SELECT k, f, y - alpha - beta * f AS e, lags FROM x, c),
p AS (SELECT CASE WHEN a.k = b.k THEN 1.0 ELSE 1 - (a.k - b.k) / (a.lags + 1.0::DOUBLE) END AS w, a.e * b.e AS ee, a.f AS fa, b.f AS fb, a.k = b.k AS own FROM u a JOIN u b ON b.k BETWEEN a.k - a.lags AND a.k),
s AS (SELECT sum(w * ee * (CASE WHEN own THEN 1 ELSE 2 END)) AS s11, sum(w * ee * (CASE WHEN own THEN fa ELSE fa + fb END)) AS s12, sum(w * ee * fa * fb * (CASE WHEN own THEN 1 ELSE 2 END)) AS s22 FROM p),
v AS (SELECT *, n * sff - sf * sf AS det FROM c, s),
e AS (SELECT *, (sff * (sff * s11 - sf * s12) - sf * (sff * s12 - sf * s22)) / (det * det) AS va, (-sf * (-sf * s11 + n * s12) + n * (-sf * s12 + n * s22)) / (det * det) AS vb FROM v)
SELECT 'alpha' AS term, round(alpha, 8) AS estimate, round(alpha / sqrt(va), 6) AS t_stat, n::INT AS n_months, lags FROM e UNION ALL SELECT 'f', round(beta, 8), round(beta / sqrt(vb), 6), n::INT, lags FROM e""")
def benchmark_regression(spark: SparkSession, sf: str) -> DataFrame:
    a, b = pair(spark, sf)
    return rounded(rounded(stats.regress(a, "date", "value", b.withColumnRenamed("value", "f"), ["f"]), "estimate", digits=8), "t_stat")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE pow((p_partkey * 7919 % 2003) / 2003.0::DOUBLE, 3) END AS p FROM part), q AS (SELECT *, coalesce(p, 1.0) AS pp FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY pp, p_partkey) AS rank, count(*) OVER () AS m FROM q), a AS (SELECT *, least(1.0, min(pp * m / rank) OVER (ORDER BY rank DESC)) AS adjusted FROM k)
SELECT p_partkey, rank::INT AS rank, round(adjusted, 8) AS adjusted_p, adjusted <= 0.1 AS rejected FROM a""")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("p_partkey") % 50 != 0, F.pow((F.col("p_partkey") * 7919 % 2003) / 2003.0, F.lit(3.0)))
    out = stats.benjamini_hochberg(table(spark, sf, "part").select("p_partkey", p.alias("p")), "p", ["p_partkey"], 0.1)
    return rounded(out.select("p_partkey", "rank", "adjusted_p", "rejected"), "adjusted_p", digits=8)


@query("""WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
SELECT l_suppkey, k, n, round(p, 8) AS rate, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 8) AS low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 8) AS high, n >= 600 AS reportable FROM p""")
def wilson_ci(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.proportion(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", 600)
    return rounded(out, "rate", "low", "high", digits=8)


@query("""WITH c AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS agree FROM c),
ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), e AS (SELECT sum(na * nb) AS s FROM ra JOIN rb ON a = b), v AS (SELECT n, agree / n AS po, s::DOUBLE / (n::DOUBLE * n) AS pe FROM t, e)
SELECT n::BIGINT AS n, round(po, 8) AS observed, round(pe, 8) AS expected, round((po - pe) / (1 - pe), 8) AS kappa FROM v""")
def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic"), "observed", "expected", "kappa", digits=8)


@query("""WITH c AS (SELECT o_orderpriority, sum((o_orderstatus = 'F')::INT) AS k, sum(1) AS n FROM orders GROUP BY 1), t AS (SELECT sum(k) AS ak, sum(n) AS an, avg(k / n) AS macro FROM c)
SELECT o_orderpriority, k::BIGINT AS k, n::BIGINT AS n, round(k / n, 8) AS rate, round(ak / an, 8) AS micro, round(macro, 8) AS macro, round((ak - k) / (an - n), 8) AS without FROM c, t""")
def micro_macro_loo(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("hit"), F.lit(1).alias("one"))
    return rounded(scoring.pooled(rows, "o_orderpriority", "hit", "one"), "rate", "micro", "macro", "without", digits=8)


_Z = "((sr - sr0) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))"


@query(f"""WITH {months_sql("l_suppkey")}, m AS (SELECT l_suppkey, count(ret) AS n, avg(ret) AS mu, var_pop(ret) AS v2 FROM months GROUP BY 1),
c AS (SELECT l_suppkey, avg(pow(ret - mu, 3)) AS c3, avg(pow(ret - mu, 4)) AS c4 FROM months JOIN m USING (l_suppkey) WHERE ret IS NOT NULL GROUP BY 1),
b AS (SELECT l_suppkey, n, mu / sqrt(v2 * n / (n - 1)) AS sr, c3 / pow(v2, 1.5) AS sk, c4 / (v2 * v2) AS ku FROM m JOIN c USING (l_suppkey)),
k AS (SELECT count(*) AS trials, stddev_samp(sr) AS sd FROM b), e AS (SELECT sd * ((1 - 0.5772156649015329::DOUBLE) * {inverse_sql("(1 - 1.0::DOUBLE / trials)")} + 0.5772156649015329::DOUBLE * {inverse_sql(f"(1 - 1.0::DOUBLE / (trials * {math.e!r}::DOUBLE))")}) AS sr0 FROM k)
SELECT l_suppkey, round(sr, 8) AS sharpe, round({cdf_sql(_Z.replace("sr0", "0"))}, 8) AS psr, round({cdf_sql(_Z)}, 8) AS dsr, CASE WHEN abs(sr) < 0.1 THEN 'Negligible' WHEN abs(sr) < 0.2 THEN 'Small' WHEN abs(sr) < 0.3 THEN 'Moderate' ELSE 'Large' END AS band FROM b, e""")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").filter("ret is not null")
    by = rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("sk"), (F.kurtosis("ret") + 3).alias("ku"))
    whole = F.broadcast(by.agg(F.count("*").alias("trials"), F.stddev_samp("sr").alias("sd")))
    rows = by.join(whole, F.lit(True))
    sr, n, sk, ku = (F.col(c) for c in ("sr", "n", "sk", "ku"))
    return rows.select("l_suppkey", r(sr, 8).alias("sharpe"), r(stats.probabilistic_sharpe(sr, n, F.lit(0.0), sk, ku), 8).alias("psr"), r(stats.deflated_sharpe(sr, n, F.col("trials"), F.col("sd"), sk, ku), 8).alias("dsr"), stats.effect_band(sr, 0.1, 0.2, 0.3).alias("band"))


FOLDS = """combos AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM generate_series(0, 5) x(a), generate_series(0, 5) y(b) WHERE a < b),
blocks AS (SELECT g, g * 13 + least(g, 2) AS lo, (g + 1) * 13 + least(g + 1, 2) - 1 AS hi FROM generate_series(0, 5) t(g)),
marked AS (SELECT fold, pos, a.lo AS l1, a.hi AS h1, b.lo AS l2, b.hi AS h2 FROM combos c JOIN blocks a ON a.g = c.a JOIN blocks b ON b.g = c.b, generate_series(0, 79) p(pos)),
folds AS (SELECT fold::INT AS fold, pos::INT AS pos, CASE WHEN pos BETWEEN l1 AND h1 OR pos BETWEEN l2 AND h2 THEN 'test' WHEN pos BETWEEN l1 - 2 AND h1 + 2 OR pos BETWEEN l2 - 2 AND h2 + 2 OR (l2 <> h1 + 1 AND pos > h1 AND pos <= h1 + 3) OR (pos > h2 AND pos <= h2 + 3) THEN 'dropped' ELSE 'train' END AS role FROM marked)"""


@query(f"WITH {FOLDS} SELECT * FROM folds")
def cpcv_folds(spark: SparkSession, sf: str) -> DataFrame:
    return stats.fold_table(spark, 80, 6, 2, 2, 3)


CANDIDATES = f"""{months_sql("l_suppkey")}, chosen AS (SELECT l_suppkey % 8 AS c, month AS date, round(avg(ret), 8) AS v FROM months WHERE ret IS NOT NULL GROUP BY ALL), placed AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY date) - 1 AS pos FROM chosen), {FOLDS},
sharpes AS (SELECT c, fold, role, count(v) AS n, round(CASE WHEN stddev_samp(v) > 0 THEN avg(v) / stddev_samp(v) * sqrt(12.0::DOUBLE) END, 8) AS sharpe FROM placed JOIN folds USING (pos) WHERE role <> 'dropped' GROUP BY ALL)"""


def fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").filter("ret is not null").groupBy((F.col("l_suppkey") % 8).alias("c"), F.col("month").alias("date")).agg(r(F.avg("ret"), 8).alias("v"))
    return rounded(stats.fold_sharpes(rows, ["c"], "date", "v", stats.fold_table(spark, 80, 6, 2, 2, 3)), "sharpe", digits=8)


@query(f"WITH {CANDIDATES} SELECT c, fold, role, n, sharpe FROM sharpes")
def cpcv_sharpes(spark: SparkSession, sf: str) -> DataFrame:
    return fold_rows(spark, sf)


@query(f"""WITH {CANDIDATES}, best AS (SELECT fold, c FROM sharpes WHERE role = 'train' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sharpe DESC, c) = 1),
ranked AS (SELECT fold, c, (rank() OVER (PARTITION BY fold ORDER BY sharpe) + (count(*) OVER (PARTITION BY fold, sharpe) - 1) / 2) / (count(*) OVER (PARTITION BY fold) + 1) AS omega FROM sharpes WHERE role = 'test')
SELECT count(*) AS n_folds, round(avg((ln(omega / (1 - omega)) < 0)::INT), 8) AS pbo, round(median(omega), 8) AS median_rank FROM best JOIN ranked USING (fold, c)""")
def pbo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.backtest_overfitting(fold_rows(spark, sf), "c"), "pbo", "median_rank", digits=8)


@query(f"""WITH {SERIES}, m AS (SELECT name, avg(value) AS a, stddev_samp(value) / sqrt(count(*)) AS se, stddev_samp(value) AS sd, count(*) AS n FROM series GROUP BY 1), p AS (SELECT *, 1 / (se * se) + 1 / pow(0.02::DOUBLE, 2) AS prec FROM m),
q AS (SELECT *, (a / (se * se) + 0.0 / pow(0.02::DOUBLE, 2)) / prec AS mean, 1 / sqrt(prec) AS dev FROM p)
SELECT name, round(mean, 8) AS mean, round(dev, 8) AS deviation, round({cdf_sql("(mean / dev)")}, 8) AS positive, round(({inverse_sql("0.975::DOUBLE")} + {inverse_sql("0.8::DOUBLE")}) * sd / sqrt(n), 8) AS detectable, round(2 * (1 - {cdf_sql("abs(a / se)")}), 8) AS p_value FROM q""")
def posterior_and_power(spark: SparkSession, sf: str) -> DataFrame:
    by = series(spark, sf).groupBy("name").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    by = by.withColumn("se", F.col("sd") / F.sqrt("n"))
    mean, sd, positive = stats.posterior(F.col("a"), F.col("se"), 0.0, 0.02)
    out = by.select("name", mean.alias("mean"), sd.alias("deviation"), positive.alias("positive"), stats.minimum_detectable(F.col("sd"), F.col("n")).alias("detectable"), stats.mean_p_value(F.col("a") / F.col("se")).alias("p_value"))
    return rounded(out, "mean", "deviation", "positive", "detectable", "p_value", digits=8)


@query("""WITH f AS (SELECT count(*) FILTER (o_totalprice > 1000) AS a, count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'F') AS b, count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey % 2 = 0) AS c FROM orders)
SELECT 0 AS step, 'valid' AS stage, a AS n FROM f UNION ALL SELECT 1, 'compiled', b FROM f UNION ALL SELECT 2, 'executed', c FROM f""")
def stage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.funnel(table(spark, sf, "orders"), {"valid": F.col("o_totalprice") > 1000, "compiled": F.col("o_orderstatus") == "F", "executed": F.col("o_custkey") % 2 == 0})


@query("""SELECT CASE WHEN NOT o_totalprice > 1000 THEN 'price' WHEN NOT o_orderstatus = 'F' THEN 'status' WHEN NOT o_custkey % 2 = 0 THEN 'customer' ELSE 'covered' END AS layer, count(*) AS n FROM orders GROUP BY 1""")
def layered_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.coverage(table(spark, sf, "orders"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") == "F", "customer": F.col("o_custkey") % 2 == 0})


@query(f"""WITH {months_sql("l_suppkey")}, c AS (SELECT l_suppkey, corr(price, volume) AS r FROM months GROUP BY 1), s AS (SELECT *, CASE WHEN r < -0.1 THEN 'low' WHEN r < 0.1 THEN 'middle' WHEN r IS NOT NULL THEN 'high' END AS stratum FROM c)
SELECT stratum, count(r) AS n, round(min(r), 8) AS least, round(median(r), 8) AS middle, round(max(r), 8) AS most FROM s GROUP BY 1""")
def agreement_strata(spark: SparkSession, sf: str) -> DataFrame:
    by = months(spark, sf, "l_suppkey").groupBy("l_suppkey").agg(F.corr("price", "volume").alias("r"))
    rows = by.withColumn("stratum", scoring.stratum(F.col("r"), [-0.1, 0.1], ["low", "middle", "high"]))
    return rounded(scoring.distribution(rows, ["stratum"], "r"), "least", "middle", "most", digits=8)


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS a, CASE WHEN event_id % 5 > 0 THEN (CASE WHEN event_id % 7 = 0 THEN 'other' ELSE ' ' || upper(event_type) END) END AS b, event_id % 11 > 0 AS fa, event_id % 13 > 0 AS fb, event_id % 3 AS sa, event_id % 2 AS sb FROM events),
v AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'not_stated' WHEN (a IS NOT NULL AND NOT fa) OR (b IS NOT NULL AND NOT fb) THEN 'quote_match_failure' WHEN a IS NULL OR b IS NULL THEN 'single_response' WHEN lower(trim(a)) <> lower(trim(b)) THEN 'disagreement' ELSE 'accepted' END AS verdict FROM x)
SELECT event_id, verdict, CASE WHEN verdict = 'accepted' THEN a END AS value, CASE WHEN verdict = 'accepted' THEN (CASE WHEN sb < sa THEN 'qb' ELSE 'qa' END) END AS quote FROM v""")
def rater_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(k % 4 > 0, F.col("event_type")).alias("a"), F.when(k % 5 > 0, F.when(k % 7 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("event_type")))).alias("b"),
        (k % 11 > 0).alias("fa"), (k % 13 > 0).alias("fb"), F.lit("qa").alias("qa"), F.lit("qb").alias("qb"), (k % 3).alias("sa"), (k % 2).alias("sb"),
    )
    return scoring.merge_raters(rows, "a", "b", "fa", "fb", "qa", "qb", "sa", "sb").select("event_id", "verdict", "value", "quote")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY ts, event_id) > 1 AS duplicate FROM events""")
def unique_proposals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return scoring.unique_proposals(rows, F.struct("user_id", "event_type", F.floor("value")), ["ts", "event_id"]).select("event_id", "duplicate")


@query()
def block_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return resample.intervals(resample.block_bootstrap(series(spark, sf), "name", "date", "value", 1000, 6))


@query()
def paired_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return resample.intervals(resample.paired_bootstrap(*pair(spark, sf), "date", "value", replicates=1000, block=4, scheme="stationary"))


@query()
def alpha_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    a, b = pair(spark, sf)
    return resample.intervals(resample.alpha_bootstrap(a, "date", "value", b.withColumnRenamed("value", "f"), ["f"], replicates=1000, block=4))


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("month")
    ranked = lambda c: ((F.rank().over(w.orderBy(c)) - 1) / (F.count("*").over(w) - 1) - 0.5).alias(f"z_{c}")
    rows = months(spark, sf, "l_suppkey").filter("ret is not null and volume > 0")
    return rows.select("l_suppkey", "month", "ret", ranked("price"), ranked("volume"), ranked("n_trades"), F.lit(1.0).alias("one"))


@query()
def ipca_fit(spark: SparkSession, sf: str) -> DataFrame:
    names = ["z_price", "z_volume", "z_n_trades", "one"]
    moments = factors.collect_moments(instruments(spark, sf), "month", names, "ret")
    fitted = factors.fit(moments, 2, 1e-5, 500)
    rows = [(n, k, float(fitted.gamma[i, k]), float(factors.managed_r2(moments, fitted))) for i, n in enumerate(names) for k in range(2)]
    return spark.createDataFrame(rows, "instrument string, factor int, loading double, managed_r2 double")


_EFFECT_CELLS = """trades AS (SELECT l_suppkey, l_shipdate::DATE AS day, l_extendedprice / l_quantity AS price, l_quantity AS qty, l_discount FROM lineitem),
prices AS (SELECT m.mask::INT AS mask, last_day(day) AS date, sum(price * qty) / sum(qty) AS p FROM trades, generate_series(0, 3) m(mask) WHERE (m.mask & 1 = 0 OR qty >= 10) AND (m.mask & 2 = 0 OR l_discount > 0.02) GROUP BY ALL),
rets AS (SELECT mask, date, round(p / lag(p) OVER (PARTITION BY mask ORDER BY date) - 1, 8) AS v FROM prices),
effects AS (SELECT t.mask::INT AS mask, s.date, round(2 * avg((CASE WHEN bit_count((t.mask & ~s.mask)::INT) % 2 = 0 THEN 1 ELSE -1 END) * s.v), 8) AS value FROM rets s, generate_series(0, 3) t(mask) WHERE s.v IS NOT NULL GROUP BY ALL HAVING count(*) = 4)"""


@query(f"""WITH {_EFFECT_CELLS}, {summary_sql("mask", "effects", "date", "value")}, e AS (SELECT mask, n, m, m / (sqrt(s) / n) AS t FROM s1 JOIN h USING (mask))
SELECT mask, n AS n_months, round(m, 8) AS effect, round(t, 6) AS t_stat, round(2 * (1 - {cdf_sql("abs(t)")}), 8) AS p_value, false AS inert FROM e""")
def doe_inference(spark: SparkSession, sf: str) -> DataFrame:
    rows = trades(spark, sf, "l_discount").withColumn("date", F.last_day("day"))
    cells = lattice.cells(rows, [F.col("qty") >= 10, F.col("l_discount") > 0.02], ["date"], {"pv": F.sum(F.col("price") * F.col("qty")), "v": F.sum("qty")})
    before = F.lag(F.col("pv") / F.col("v")).over(Window.partitionBy("mask").orderBy("date"))
    rets = cells.select("mask", "date", r(F.col("pv") / F.col("v") / before - 1, 8).alias("v"))
    out = lattice.infer_effects(rounded(lattice.monthly_effects(rets, "date", "v", 2), "value", digits=8), "date")
    return rounded(rounded(out, "effect", "p_value", digits=8), "t_stat")


@query("""WITH trades AS (SELECT l_suppkey, last_day(l_shipdate::DATE) AS month, l_shipdate::DATE AS day, l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem),
d AS (SELECT l_suppkey, month, day, sum(price * qty) / sum(qty) AS b, sum(price * qty) FILTER (qty >= 8) / sum(qty) FILTER (qty >= 8) AS v FROM trades GROUP BY ALL),
p AS (SELECT l_suppkey, month, round(arg_max(b, day), 6) AS b FROM d GROUP BY ALL), q AS (SELECT l_suppkey, month, round(arg_max(v, day), 6) AS v FROM d WHERE v IS NOT NULL GROUP BY ALL),
rb AS (SELECT l_suppkey, month, CASE WHEN lag(month) OVER w = last_day(month - INTERVAL 1 MONTH) THEN b / lag(b) OVER w - 1 END AS r FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
rv AS (SELECT l_suppkey, month, CASE WHEN lag(month) OVER w = last_day(month - INTERVAL 1 MONTH) THEN v / lag(v) OVER w - 1 END AS r FROM q WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
x AS (SELECT l_suppkey, month, r, lag(r) OVER (PARTITION BY l_suppkey ORDER BY month) AS one FROM rb WHERE r IS NOT NULL),
y AS (SELECT *, CASE WHEN count(one) OVER w = 6 THEN sum(ln(1 + one)) OVER w END AS six FROM x WINDOW w AS (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
c AS (SELECT quantile_cont(one, 0.1) AS a0, quantile_cont(one, 0.9) AS a1, quantile_cont(six, 0.1) AS b0, quantile_cont(six, 0.9) AS b1 FROM y),
z AS (SELECT y.*, (coalesce(one <= a0 OR one >= a1, false) OR coalesce(six <= b0 OR six >= b1, false))::INT AS far, rv.r AS v FROM y CROSS JOIN c LEFT JOIN rv USING (l_suppkey, month))
SELECT count(*) AS n, count(*) FILTER (v IS NULL OR abs(v - r) > 0) AS n_affected, round(count(*) FILTER (abs(v - r) >= 1e-4) / count(*), 8) AS share_moved, round(max(abs(v - r)), 8) AS max_move,
  round(avg(far) FILTER (v IS NULL OR abs(v - r) > 0) / avg(far) FILTER (v IS NOT NULL AND NOT abs(v - r) > 0), 8) AS lift FROM z""")
def variant_impact(spark: SparkSession, sf: str) -> DataFrame:
    def returns(least: float | None) -> DataFrame:
        rows = rounded(rollup.month_last_price(daily(spark, sf, "l_suppkey", least), "l_suppkey", "day"), "price")
        return signals.adjacent_return(rows, "l_suppkey", "month", "price")

    return rounded(rollup.variant_impact(returns(None), returns(8), "l_suppkey", "month", "ret"), "share_moved", "max_move", "lift", digits=8)


@query("""WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal / 100, 2) END AS m FROM supplier)
SELECT s_suppkey, (row_number() OVER (ORDER BY m DESC NULLS LAST, s_nationkey, s_suppkey))::INT AS place FROM s QUALIFY place <= 10""")
def selected_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The ten with the highest score, of equals the fewest changes, then the least id; missing scores last."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 7 != 0, r(F.col("s_acctbal") / 100, 2)).alias("m"))
    order = [F.col("m").desc_nulls_last(), F.col("s_nationkey"), F.col("s_suppkey")]
    return rows.orderBy(*order).limit(10).select("s_suppkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(f"""WITH {SERIES}, d AS (SELECT row_number() OVER (ORDER BY date) AS k, value FROM series WHERE name = 'ew'), g AS (SELECT q, avg(value * (CASE WHEN (k * 2654435761 + q * 40503) % 1000003 % 2 = 0 THEN 1 ELSE -1 END)) AS v FROM d, generate_series(1, 199) t(q) GROUP BY 1),
o AS (SELECT avg(value) AS obs FROM d) SELECT round((count(*) FILTER (abs(round(v, 10)) >= abs(round(obs, 10))) + 1) / (count(v) + 1), 8) AS p_value FROM g, o""")
def sign_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """A mean against 199 stated patterns of signs."""
    rows = series(spark, sf).filter("name = 'ew'").withColumn("k", F.row_number().over(Window.orderBy("date")))
    observed = rows.agg(r(F.avg("value"), 10)).first()[0]
    signs = rows.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(199))))
    sign = F.when((F.col("k").cast("long") * 2654435761 + F.col("q").cast("long") * 40503) % 1000003 % 2 == 0, 1).otherwise(-1)
    draws = signs.groupBy("q").agg(r(F.avg(F.col("value") * sign), 10).alias("v"))
    return rounded(stats.permutation_p(observed, draws, "v"), "p_value", digits=8)


@query()
def effect_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Posteriors of the mean returns of both series, their covariance from the bootstrap."""
    wide = resample.block_bootstrap(series(spark, sf), "name", "date", "value", 300, 6).groupBy("replicate").pivot("series", ["ew", "vw"]).agg(F.first("value")).orderBy("replicate").toPandas()
    draws = wide[["ew", "vw"]].to_numpy()
    found = bayes.normal_posterior(draws.mean(0), np.cov(draws.T), 0.02, 1e-10)
    return spark.createDataFrame(found.table(["ew", "vw"], 0.005), "name string, mean double, sd double, low double, high double, p_positive double, p_material double")


@query()
def effect_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """How common mean returns beyond half a per cent are among suppliers, by group of suppliers."""
    by = stats.summary(months(spark, sf, "l_suppkey"), ["l_suppkey"], "month", "ret")
    half = 1.959963984540054 * F.col("deviation") / F.sqrt("n_months")
    rows = by.select((F.col("l_suppkey") % 4).alias("coordinate"), F.col("average").alias("estimate"), (F.col("average") - half).alias("low"), (F.col("average") + half).alias("high"), (F.col("l_suppkey") % 10 == 0).alias("inert"))
    return bayes.populations(rows, "coordinate", "estimate", "low", "high", "inert", 0.005, 500)


@query()
def calibration_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Share of planted means of each size that a t test of 72 months finds."""
    def trial(size: float, rng) -> tuple[float, bool]:
        draw = rng.normal(size, 0.02, 72)
        return draw.mean(), abs(draw.mean() / (draw.std(ddof=1) / 72**0.5)) > 1.993

    return bayes.least_detected(bayes.calibrate(spark, [0.0, 0.0025, 0.005, 0.0075, 0.01], 40, trial))
