"""Queries: strategies in all cells of a grid of corrections, planted biases, crowding, costs, equivalence, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, factors, lattice, planted, scoring, screens, signals, sorts, stats, views
from .base import PANEL, months, months_sql, r, rounded, sort_panel, stable, table
from .inference import COSTS, PAIR, cdf_sql, instruments, pair, turnover
from .portfolio import group_sql, lagged_sql, legs_sql

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = stable(sql)
        return function

    return add


#: What an audit of the planted survivorship panel has to find (seed 2026, 60 entities, 72 months).
PLANTED = {
    "rows": 3843, "published_months": 71, "published_average": 0.011508669117050785, "published_t": 11.798346085461471, "published_annualised": 0.13810402940460942,
    "published_deviation": 0.006367290344441838, "published_sharpe": 6.261250409487398, "published_lags": 3, "published_rows_mean": 21.253521126760564, "published_rows_least": 17, "published_rows_most": 24,
    "corrected_months": 70, "corrected_average": 0.004406978016512072, "corrected_t": 1.4790514447209395, "corrected_annualised": 0.05288373619814486, "corrected_deviation": 0.014538290816636146, "corrected_sharpe": 1.0500697679954876,
    "common_months": 70, "cells": 32, "effect_meas_err": 0.0, "effect_stale_price": 0.0, "effect_survivorship": -0.007114344035270049, "effect_lib_gap": 0.0, "effect_lab_trim": 0.0,
    "least_excluded": 0.011521322051782124, "most_excluded": 0.011521322051782124, "least_kept": 0.004406978016512072, "most_kept": 0.004406978016512072,
}


@query("SELECT metric, round(value, 9) AS value FROM (VALUES " + ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in PLANTED.items()) + ") t(metric, value)")
def planted_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """A panel with planted survivorship, its strategy in all 32 cells, and what each correction does to its mean."""
    panel, signals = planted.clean_panel(spark, planted.Recipe(seed=2026))
    biased = planted.plant(panel, signals, "survivorship", 0.30)
    strategy = cells.Strategy("planted", (sorts.Rulebook(score="score", entity="cusip", by_size=False),))
    found = cells.strategy_cells(biased, signals, strategy).persist()
    told = []

    def tell(found_: DataFrame, /, **columns: str) -> None:
        values = [F.struct(F.lit(n).alias("metric"), F.expr(c).cast("double").alias("value")) for n, c in columns.items()]
        told.append(found_.select(F.inline(F.array(*values))))

    tell(biased.agg(F.count("*").alias("n")), rows="n")
    for mask, name in ((0, "published"), (31, "corrected")):
        own = found.filter(F.col("mask") == mask)
        own_summary = {f"{name}_months": "n_months", f"{name}_average": "average", f"{name}_t": "t_stat", f"{name}_annualised": "annualised", f"{name}_deviation": "deviation", f"{name}_sharpe": "sharpe"}
        tell(stats.summary(own, ["mask"], "date", "strategy_ret"), **own_summary, **({"published_lags": "lags"} if mask == 0 else {}))
        if mask == 0:
            tell(own.agg(F.avg("n_rows").alias("a"), F.min("n_rows").alias("b"), F.max("n_rows").alias("c")), published_rows_mean="a", published_rows_least="b", published_rows_most="c")
    common = cells.on_common_months(found, "date")
    means = common.groupBy("mask").agg(F.avg("strategy_ret").alias("value"), F.count("*").alias("n"))
    tell(means.agg(F.max("n").alias("n"), F.count("*").alias("k")), common_months="n", cells="k")
    kept = F.col("mask").bitwiseAND(F.lit(4)) != 0
    tell(means.agg(*[f(F.when(side, F.col("value"))).alias(n) for n, f, side in (("a", F.min, ~kept), ("b", F.max, ~kept), ("c", F.min, kept), ("d", F.max, kept))]), least_excluded="a", most_excluded="b", least_kept="c", most_kept="d")
    effects = lattice.walsh(means.select("mask", "value"))
    for bit, choice in enumerate(cells.CHOICES):
        tell(effects.filter(F.col("mask") == 1 << bit), **{f"effect_{choice}": "effect"})
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return rounded(out, "value", digits=9)


_CELLS = f"""{months_sql('l_suppkey')},
base AS (SELECT l_suppkey AS e, month AS d, volume AS size, ret AS rr, ret * 0.5 AS rc, price AS sr, n_trades::DOUBLE AS sc, month - last_day > 20 AS stale, l_suppkey % 7 = 0 AND month(month) = 6 AS gone FROM months),
marked AS (SELECT *, stale OR (coalesce(lag(stale) OVER w, false) AND coalesce(lag(d) OVER w = last_day(d - INTERVAL 1 MONTH), false)) AS old FROM base WINDOW w AS (PARTITION BY e ORDER BY d)),
v AS (SELECT m.mask::INT AS mask, e, d, size, CASE WHEN m.mask & 2 <> 0 AND old THEN NULL WHEN m.mask & 1 <> 0 THEN rc ELSE rr END AS ret, CASE WHEN m.mask & 1 <> 0 THEN sc ELSE sr END AS score
  FROM marked, generate_series(0, 31) m(mask) WHERE m.mask & 4 <> 0 OR NOT gone),
l AS (SELECT v.mask, v.e, v.d, v.size, n.ret AS next_ret, CASE WHEN v.mask & 8 <> 0 THEN b.score ELSE v.score END AS score FROM v JOIN v n ON n.mask = v.mask AND n.e = v.e AND n.d = last_day(v.d + INTERVAL 1 MONTH)
  LEFT JOIN v b ON b.mask = v.mask AND b.e = v.e AND b.d = last_day(v.d - INTERVAL 1 MONTH)),
ok AS (SELECT * FROM l WHERE size IS NOT NULL AND next_ret IS NOT NULL AND score IS NOT NULL),
bounds AS (SELECT mask, quantile_cont(next_ret, 0.1) AS lo, quantile_cont(next_ret, 0.9) AS hi FROM ok GROUP BY 1),
many AS (SELECT * FROM ok QUALIFY count(*) OVER (PARTITION BY mask, d) >= 3),
t AS (SELECT many.* FROM many JOIN bounds USING (mask) WHERE mask & 16 <> 0 OR next_ret BETWEEN lo AND hi),
t2 AS (SELECT *, count(*) OVER (PARTITION BY mask, d) AS k FROM t QUALIFY k >= 3),
g AS (SELECT *, floor((row_number() OVER (PARTITION BY mask, d ORDER BY score, e) - 1) * 3 / k)::INT AS g FROM t2),
legs AS (SELECT mask, d, sum(size * next_ret) FILTER (g = 2) / sum(size) FILTER (g = 2) AS l, sum(size * next_ret) FILTER (g = 0) / sum(size) FILTER (g = 0) AS s, count(*) FILTER (g <> 1) AS n FROM g GROUP BY ALL),
cells AS (SELECT mask, last_day(d + INTERVAL 1 MONTH) AS date, l - s AS v, n FROM legs WHERE l IS NOT NULL AND s IS NOT NULL)"""


def market_panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers' months as a panel of two families and its signals; some trade late, some leave in June."""
    rows = months(spark, sf, "l_suppkey").withColumnsRenamed({"l_suppkey": "entity", "month": "date"})
    gone = F.when((F.col("entity") % 7 == 0) & (F.month("date") == 6), "defaulted")
    panel = rows.select("entity", "date", F.col("volume").alias("size"), F.col("ret").alias("ret_raw"), (F.col("ret") * 0.5).alias("ret_corr"), *[F.col("last_day").alias(f"last_trade_date_{f}") for f in cells.FAMILIES], gone.alias("exit_reason"))
    return panel, rows.select("entity", "date", F.col("price").alias("score_raw"), F.col("n_trades").cast("double").alias("score_corr"))


@query(f"WITH {_CELLS} SELECT mask, count(*) AS n_months, round(avg(v), 8) AS average, sum(n)::BIGINT AS n_rows FROM cells GROUP BY 1")
def strategy_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy on suppliers' months in all 32 cells: months, mean and rows of each."""
    book = sorts.Rulebook(score="score", groups=3, trim="truncate", trim_low=0.1, trim_high=0.9, trim_percentile=True)
    found = cells.strategy_cells(*market_panel(spark, sf), cells.Strategy("tercile", (book,)), stale_days=20)
    return rounded(found.groupBy("mask").agg(F.count("*").alias("n_months"), F.avg("strategy_ret").alias("average"), F.sum("n_rows").alias("n_rows")), "average", digits=8)


def _regression_sql(source: str, y: str, x: list[str], lags: str) -> str:
    """CTEs: the coefficients of y on x (one or two columns) and a constant, as (term, estimate, error) in ``terms``; each
    is a weighted sum of y, and its error that of the series of weights times residuals."""
    one = len(x) == 1
    f, g = x[0], x[-1]
    sums = f"SELECT count(*)::DOUBLE AS n, sum({f}) AS sf, sum({f} * {f}) AS sff, sum({g}) AS sg, sum({g} * {g}) AS sgg, sum({f} * {g}) AS sfg FROM k0"
    if one:
        weights = {"alpha": f"(sff - sf * {f}) / (n * sff - sf * sf)", f: f"(n * {f} - sf) / (n * sff - sf * sf)"}
    else:
        det = "(n * (sff * sgg - sfg * sfg) - sf * (sf * sgg - sfg * sg) + sg * (sf * sfg - sff * sg))"
        weights = {
            "alpha": f"((sff * sgg - sfg * sfg) + (sg * sfg - sf * sgg) * {f} + (sf * sfg - sff * sg) * {g}) / {det}",
            f: f"((sg * sfg - sf * sgg) + (n * sgg - sg * sg) * {f} + (sf * sg - n * sfg) * {g}) / {det}",
            g: f"((sf * sfg - sff * sg) + (sf * sg - n * sfg) * {f} + (n * sff - sf * sf) * {g}) / {det}",
        }
    each = " UNION ALL ".join(f"SELECT '{t}' AS term, k, {f}, {g} AS g_, y, {w} AS w FROM k0, sums" for t, w in weights.items())
    fit = "b_alpha" + "".join(f" + b_{t} * {t}" for t in x)
    betas = ", ".join(f"sum(w * y) FILTER (term = '{t}') AS b_{t}" for t in weights)
    return f"""k0 AS (SELECT row_number() OVER (ORDER BY date) AS k, {y} AS y, {', '.join(x)} FROM {source}),
sums AS ({sums}), w0 AS ({each}), beta AS (SELECT {betas} FROM w0), res AS (SELECT k, y - ({fit}) AS e FROM k0, beta),
psi AS (SELECT term, k, w * e AS p FROM w0 JOIN res USING (k)), lagn AS (SELECT least({lags}, n - 1)::INT AS lags, n FROM sums),
terms AS (SELECT a.term, sum((CASE WHEN a.k = b.k THEN 1.0 ELSE 2 * (1 - (a.k - b.k) / (lags + 1.0::DOUBLE)) END) * a.p * b.p) AS variance, any_value(lags) AS lags, any_value(n)::INT AS n FROM psi a JOIN psi b ON a.term = b.term, lagn WHERE b.k BETWEEN a.k - lags AND a.k GROUP BY 1)"""


def _estimates(x: list[str]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS term, b_{t} AS estimate FROM beta" for t in ["alpha", *x]) + ")"


_SHARED = f"{PAIR}, both_ AS (SELECT a.date, a.value AS v, b.value AS f FROM a JOIN b USING (date) WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"


@query(f"""WITH {_SHARED}, {_regression_sql('both_', 'v', ['f'], 'floor(pow(n, 0.25) + 1e-12)')}
SELECT term, round(estimate, 8) AS estimate, round(estimate / sqrt(variance), 6) AS t_stat, n AS n_months, lags, n < 90 AS few FROM ({_estimates(['f'])}) JOIN terms USING (term)""")
def crowding_report(spark: SparkSession, sf: str) -> DataFrame:
    a, b = pair(spark, sf)
    out = stats.crowding(a, "date", "value", b.withColumnRenamed("value", "f"), ["f"], least=90)
    return rounded(rounded(out, "estimate", digits=8), "t_stat")


@query()
def crowding_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """A series on the out-of-sample factors of an instrumented model."""
    moments = factors.collect_moments(instruments(spark, sf), "month", ["z_price", "z_volume", "z_n_trades", "one"], "ret")
    frame, names = stats.factor_frame(spark, *factors.out_of_sample(moments, 2, 40), "date")
    return stats.crowding(pair(spark, sf)[0], "date", "value", frame, names)


_THIRD = "c_ AS (SELECT month AS date, avg(ret) AS g FROM months WHERE l_suppkey % 5 = 0 AND ret IS NOT NULL GROUP BY 1)"
_THREE = f"{_SHARED}, {_THIRD}, three AS (SELECT date, v, f, g FROM both_ JOIN c_ USING (date))"


@query(f"""WITH {_THREE}, {_regression_sql('three', 'v', ['f', 'g'], 'floor(pow(n, 0.25) + 1e-12)')},
one AS (SELECT (avg(v) - covar_pop(v, g) / var_pop(g) * avg(g)) AS alpha FROM three)
SELECT round(b_alpha, 8) AS alpha, round(b_alpha / sqrt(variance), 6) AS t_stat, round(1 - (SELECT sum(e * e) FROM res) / (SELECT sum((v - m) * (v - m)) FROM three, (SELECT avg(v) AS m FROM three)), 8) AS r2,
  round(abs((SELECT corr(f, g) FROM three)), 8) AS max_abs_corr, round(1 / (1 - pow((SELECT corr(f, g) FROM three), 2)), 6) AS vif_f, round(one.alpha, 8) AS alpha_without_f, terms.n AS n_months
FROM beta, terms, one WHERE term = 'alpha'""")
def spanning_report(spark: SparkSession, sf: str) -> DataFrame:
    a, b = pair(spark, sf)
    by = months(spark, sf, "l_suppkey").filter("l_suppkey % 5 = 0 and ret is not null").groupBy(F.col("month").alias("date")).agg(F.avg("ret").alias("g"))
    found = stats.spanning(a, "date", "value", b.withColumnRenamed("value", "f").join(by, "date"), ["f", "g"])
    out = spark.createDataFrame([(found["alpha"], found["t_stat"], found["r2"], found["max_abs_corr"], found["vif"]["f"], found["alpha_without"]["f"], found["n_months"])], "alpha double, t_stat double, r2 double, max_abs_corr double, vif_f double, alpha_without_f double, n_months int")
    return rounded(rounded(out, "alpha", "r2", "max_abs_corr", "alpha_without_f", digits=8), "t_stat", "vif_f")


@query()
def robustness_gate(spark: SparkSession, sf: str) -> DataFrame:
    a, b = pair(spark, sf)
    return stats.robustness(a, "date", "value", b.withColumnRenamed("value", "f"), ["f"], trials=20, sharpe_deviation=0.05, information_span=1, holding=1)


_ALPHA_COSTS = f"""{COSTS}, c2 AS (SELECT a.date, a.value AS gross, t.turnover, abs(a.value) + month(date) / 1000.0::DOUBLE AS f FROM a JOIN t USING (date) WHERE a.value IS NOT NULL AND t.turnover IS NOT NULL)"""


@query(f"""WITH {_ALPHA_COSTS}, x AS (SELECT avg(gross) - covar_pop(gross, f) / var_pop(f) * avg(f) AS g, avg(turnover) - covar_pop(turnover, f) / var_pop(f) * avg(f) AS t, count(*)::INT AS n FROM c2)
SELECT CASE WHEN g <= 0 THEN 'non_positive_gross' WHEN t <= 0 THEN 'non_positive_turnover_intercept' ELSE 'found' END AS status, round(CASE WHEN g > 0 AND t > 0 THEN g / t * 1e4 END, 6) AS break_even_bps,
  round(g, 8) AS alpha_gross, round(t, 8) AS alpha_turnover, n AS n_months, round(CASE WHEN t > 0 THEN g / t / (25.0::DOUBLE / 1e4) END, 6) AS multiple FROM x""")
def alpha_breakeven(spark: SparkSession, sf: str) -> DataFrame:
    gross = pair(spark, sf)[0]
    fac = gross.select("date", (F.abs("value") + F.month("date") / 1000.0).alias("f"))
    out = stats.break_even_alpha(gross, turnover(spark, sf), "date", "value", fac, ["f"], 25.0)
    return rounded(rounded(out, "alpha_gross", "alpha_turnover", digits=8), "break_even_bps", "multiple")


@query(f"""WITH {COSTS}, r AS (SELECT * FROM (VALUES ('low', 10.0::DOUBLE), ('high', 40.0::DOUBLE)) r(scenario, bps)), n AS (SELECT scenario, bps, value - bps / 1e4 * turnover AS net, turnover FROM a JOIN t USING (date), r)
SELECT scenario, bps, round(avg(net), 8) AS mean, round(avg(net) / stddev_samp(net) * sqrt(12.0::DOUBLE), 6) AS sharpe, round(bps * avg(turnover), 6) AS drag_bps FROM n GROUP BY scenario, bps""")
def cost_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    rates = spark.createDataFrame([("low", 10.0, 10.0), ("high", 40.0, 40.0), ("by rating", 10.0, 40.0), ("unknown", None, None)], "scenario string, ig_bps double, hy_bps double")
    out = stats.cost_scenarios(pair(spark, sf)[0], turnover(spark, sf), "date", "value", rates)
    return rounded(rounded(out, "mean", digits=8), "sharpe", "drag_bps")


_TAIL = """(CASE WHEN {d} % 2 = 0
  THEN 0.5 - 0.5 * {t} / sqrt({d} + {t} * {t}) * list_sum(list_transform(range(0, ({d} / 2)::BIGINT), lambda j: pow({d} / ({d} + {t} * {t}), j) * coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: (2 * i - 1.0::DOUBLE) / (2 * i)), 'product'), 1.0)))
  ELSE 0.5 - (atan({t} / sqrt({d})) + {t} / sqrt({d} + {t} * {t}) * list_sum(list_transform(range(0, (({d} - 1) / 2)::BIGINT), lambda j: sqrt({d} / ({d} + {t} * {t})) * pow({d} / ({d} + {t} * {t}), j) * coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: 2.0::DOUBLE * i / (2 * i + 1)), 'product'), 1.0)))) / pi() END)"""


@query(f"""WITH c AS (SELECT l_suppkey AS c, ((l_suppkey * 7919) % 400 - 200) / 1e5::DOUBLE AS alpha, 0.0008::DOUBLE + (l_suppkey % 5) / 1e4::DOUBLE AS se, 40 + l_suppkey % 50 AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0)
  UNION ALL SELECT s_suppkey + 1000000, 0.0005::DOUBLE, 0.001::DOUBLE, 80 FROM supplier WHERE s_suppkey <= 3),
d AS (SELECT *, n - 5 AS df, (alpha + 0.003) / se AS tl, (0.003 - alpha) / se AS tu, n >= 60 AS tested FROM c),
p AS (SELECT *, {_TAIL.format(t='tl', d='df')} AS pl, {_TAIL.format(t='tu', d='df')} AS pu FROM d),
q AS (SELECT *, greatest(pl, pu) AS p, min(c) OVER (PARTITION BY round_even(alpha * 1e12, 0), round_even(se * 1e12, 0), n) AS first FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY p, c) AS r, count(*) OVER () AS m FROM q WHERE tested), a AS (SELECT c, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS adj FROM k),
k2 AS (SELECT *, row_number() OVER (ORDER BY p, c) AS r, count(*) OVER () AS m FROM q WHERE tested AND c = first), a2 AS (SELECT c, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS adj FROM k2)
SELECT q.c::BIGINT AS c, CASE WHEN tested THEN 'tested' ELSE 'insufficient_window' END AS status, round(CASE WHEN tested THEN p END, 8) AS p_value, round(a.adj, 8) AS adjusted_p, a.adj <= 0.05 AS equivalent, round(a2.adj, 8) AS distinct_p
FROM q LEFT JOIN a ON a.c = q.c LEFT JOIN a2 ON a2.c = q.c""")
def equivalence_family(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by supplier, some of them the same hypothesis, tested for equivalence."""
    k = F.col("l_suppkey")
    own = table(spark, sf, "lineitem").filter("l_suppkey % 2 = 0").select("l_suppkey").distinct().select(k.cast("long").alias("c"), ((k * 7919 % 400 - 200) / 1e5).alias("alpha"), (0.0008 + (k % 5) / 1e4).alias("se"), (40 + k % 50).cast("int").alias("n"))
    more = table(spark, sf, "supplier").filter("s_suppkey <= 3").select((F.col("s_suppkey") + 1_000_000).cast("long").alias("c"), F.lit(0.0005).alias("alpha"), F.lit(0.001).alias("se"), F.lit(80).alias("n"))
    out = stats.equivalence_family(own.unionByName(more), "c", "alpha", "se", "n", 0.003, 0.05)
    return rounded(out.select("c", "status", "p_value", "adjusted_p", "equivalent", "distinct_p"), "p_value", "adjusted_p", "distinct_p", digits=8)


@query("""SELECT p_partkey, abs(p_size - 25.0) BETWEEN 2 AND 3 AS t_in_band, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 10 > 5 END AS many_parameters, lower(trim(p_brand)) IN ('brand#11', 'brand#23') OR p_partkey % 100 = 7 AS known_name,
  coalesce(abs(p_size - 25.0) BETWEEN 2 AND 3, false) OR coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 10 > 5 END, false) OR lower(trim(p_brand)) IN ('brand#11', 'brand#23') OR p_partkey % 100 = 7 AS flag FROM part""")
def multiple_testing(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a t statistic, a count of parameters, and names that are known, directly or by an alias."""
    label = F.when(F.col("p_partkey") % 100 == 7, " Also ").otherwise(F.col("p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", label.alias("label"), (F.col("p_size") - 25.0).alias("t"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 10).alias("k"))
    names = spark.createDataFrame([("BRAND#11",), ("brand#23 ",), ("known",)], "name string")
    out = lattice.multiple_testing_flag(rows, "label", "t", "k", (2.0, 3.0), 5, names, {"also": "Known"})
    return out.select("p_partkey", "t_in_band", "many_parameters", "known_name", "flag")


@query("""WITH v AS (SELECT (p_partkey * 7919 % 2003) / 2003.0::DOUBLE AS v FROM part), g AS (SELECT v, count(*) AS k FROM v GROUP BY 1), c AS (SELECT v, k, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS n FROM g),
d AS (SELECT max(n)::BIGINT AS n, max(greatest(upto / n - v, v - (upto - k) / n)) AS d FROM c), l AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS r FROM d)
SELECT n, round(d, 8) AS distance, round(CASE WHEN r < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * r * r))))) END, 6) AS p_value FROM l""")
def uniform_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select((F.col("p_partkey") * 7919 % 2003 / 2003.0).alias("v"))
    return rounded(rounded(stats.uniform_distance(rows, "v"), "distance", digits=8), "p_value")


@query("""WITH p AS (SELECT o_custkey % 50 AS k, (o_orderkey % 12)::DOUBLE AS x, round(avg(o_totalprice - 150000) + (o_orderkey % 12 - 6) * 2000 * ((o_custkey % 50) % 4), 6) AS y FROM orders GROUP BY 1, o_orderkey % 12, o_custkey % 50),
s AS (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM p WINDOW w AS (PARTITION BY k ORDER BY x)),
c AS (SELECT k, count(*) FILTER (py * y < 0) AS turns, bool_and(py IS NULL OR y >= py) OR bool_and(py IS NULL OR y <= py) AS monotone FROM s GROUP BY 1)
SELECT k::INT AS k, CASE WHEN turns > 1 THEN 'multiple_crossings' WHEN turns = 1 THEN 'one_crossover' WHEN monotone THEN 'sign_stable' ELSE 'non_monotone_sign_stable' END AS class, turns::INT AS n_crossings FROM c WHERE k < 8""")
def curve_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Effects over a grid, a curve for each of eight keys, by class."""
    rows = table(spark, sf, "orders").withColumns({"k": (F.col("o_custkey") % 50).cast("int"), "x": (F.col("o_orderkey") % 12).cast("double")})
    rows = rows.groupBy("k", "x").agg(F.avg(F.col("o_totalprice") - 150000).alias("m")).withColumn("y", F.col("m") + (F.col("x") - 6) * 2000 * (F.col("k") % 4))
    out = None
    for k in range(8):
        one = lattice.classify_curve(rounded(rows.filter(F.col("k") == k), "y"), "x", "y").select(F.lit(k).alias("k"), "class", F.size("crossings").alias("n_crossings"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def alpha_test(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the instrumented model leaves an alpha, by a wild bootstrap whose refits run in tasks."""
    moments = factors.collect_moments(instruments(spark, sf), "month", ["z_price", "z_volume", "z_n_trades", "one"], "ret")
    return factors.wild_alpha_test(spark, moments, 2, n=1000)


@query()
def panel_r2(spark: SparkSession, sf: str) -> DataFrame:
    names = ["z_price", "z_volume", "z_n_trades", "one"]
    panel = instruments(spark, sf)
    moments = factors.collect_moments(panel, "month", names, "ret")
    return factors.panel_r2(factors.fitted_rows(panel, "month", names, "ret", moments, factors.fit(moments, 2)), "l_suppkey", "ret")


_RECORDS = """r AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, CASE l_returnflag WHEN 'N' THEN 'T' WHEN 'R' THEN 'R' ELSE (CASE WHEN l_linenumber % 2 = 0 THEN 'W' END) END AS status,
  CASE l_linenumber % 6 WHEN 0 THEN 'A' WHEN 1 THEN '' WHEN 2 THEN 'R' WHEN 3 THEN 'D' WHEN 4 THEN NULL ELSE 'X' END AS late_code, CASE l_suppkey % 4 WHEN 0 THEN '@' WHEN 1 THEN 'Z' WHEN 2 THEN '' END AS cond, CASE l_linenumber WHEN 3 THEN 'Y' WHEN 4 THEN 'N' END AS special FROM lineitem)"""


@query(f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, coalesce(status = 'T', false) AS normal,
  coalesce(CASE WHEN coalesce(day + INTERVAL 15 YEAR < DATE '2012-02-06', false) THEN status = 'W' ELSE status IN ('R', 'X') END, false) OR coalesce(late_code = 'R', false) AS reversal,
  late_code IS NULL OR late_code IN ('', 'R', 'A') AS keep_late, late_code IS NULL OR late_code IN ('', 'R') AS keep_timely, (cond IS NULL OR cond IN ('', '@')) AND coalesce(special, '') <> 'Y' AS regular FROM r""")
def record_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Normal and reversing records, as-of codes and sales conditions that stay."""
    n, flag, mode = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_suppkey") % 4
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.add_months(F.to_date("l_shipdate"), 180).alias("day"), F.when(flag == "N", "T").when(flag == "R", "R").when(n % 2 == 0, "W").alias("status"),
        F.when(n % 6 == 0, "A").when(n % 6 == 1, "").when(n % 6 == 2, "R").when(n % 6 == 3, "D").when(n % 6 == 5, "X").alias("asof"),
        F.when(mode == 0, "@").when(mode == 1, "Z").when(mode == 2, "").alias("cond"), F.when(n == 3, "Y").when(n == 4, "N").alias("special"),
    )
    return rows.select("l_orderkey", "l_linenumber", screens.normal_record("status").alias("normal"), screens.reversal_record("day", "status", "asof").alias("reversal"), screens.asof_keep("asof").alias("keep_late"), screens.asof_keep("asof", late=False).alias("keep_timely"), screens.regular_sale("cond", "special").alias("regular"))


@query(f"""WITH {lagged_sql().replace('>= 10', '>= 5')}, g AS (SELECT *, {group_sql("size", 5)} AS c, {group_sql("score", 5)} AS g FROM eligible)
SELECT last_day(date + INTERVAL 1 MONTH) AS date, c AS control_group, g AS score_group, round(sum(size * next_ret) / sum(size), 8) AS ret, count(*) AS n_rows FROM g GROUP BY ALL""")
def sort_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The returns of all 5 x 5 groups."""
    panel = sort_panel(spark, sf).withColumn("volume", F.col("size"))
    return rounded(sorts.grid(panel, sorts.Rulebook(score="price", control="volume")), "ret", digits=8)


def _arm_sql(name: str, column: str) -> str:
    return f"""{name}_e AS (SELECT p.entity, p.date, p.size, p.price AS score, n.{column} AS next_ret FROM parts p JOIN parts n ON n.entity = p.entity AND n.date = last_day(p.date + INTERVAL 1 MONTH)
  WHERE p.size IS NOT NULL AND p.price IS NOT NULL AND n.{column} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY p.date) >= 5),
{name}_g AS (SELECT *, 0 AS c, {group_sql('score', 5)} AS g FROM {name}_e), {name}_l AS ({legs_sql(f'{name}_g', 'size')})"""


@query(f"""WITH {PANEL}, parts AS (SELECT *, ret * 0.75 AS price_part, CASE WHEN month(date) <> 3 THEN ret * 0.25 END AS carry_part FROM panel), {_arm_sql('total', 'ret')}, {_arm_sql('price', 'price_part')}, {_arm_sql('carry', 'carry_part')}
SELECT arm, last_day(date + INTERVAL 1 MONTH) AS date, round(l - s, 8) AS strategy_ret FROM (SELECT 'total' AS arm, * FROM total_l UNION ALL SELECT 'price', * FROM price_l UNION ALL SELECT 'carry', * FROM carry_l) WHERE l IS NOT NULL AND s IS NOT NULL""")
def three_arm_sort(spark: SparkSession, sf: str) -> DataFrame:
    """One signal's sort on the total return and on its two parts."""
    panel = sort_panel(spark, sf).withColumns({"price_part": F.col("ret") * 0.75, "carry_part": F.when(F.month("date") != 3, F.col("ret") * 0.25)})
    out = sorts.arms(panel, sorts.Rulebook(score="price"), {"total": "ret", "price": "price_part", "carry": "carry_part"})
    return rounded(out.select("arm", "date", "strategy_ret"), "strategy_ret", digits=8)


@query(f"""WITH {months_sql('l_suppkey')}, w AS (SELECT last_day(m)::DATE AS m FROM (SELECT unnest(generate_series(DATE '1991-10-01', DATE '1999-03-01', INTERVAL 1 MONTH)) AS m)), p AS (SELECT DISTINCT month AS m FROM months)
SELECT count(*) AS expected, count(p.m) AS present, count(*) - count(p.m) AS lacking FROM w LEFT JOIN p ON w.m = p.m""")
def window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    out = views.window_coverage(months(spark, sf, "l_suppkey"), "month", "1991-10-31", "1999-03-31")
    return out.select("expected", "present", F.size("missing").cast("long").alias("lacking"))


@query("""WITH a AS (SELECT o_orderpriority AS arm, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS refused FROM orders GROUP BY 1)
SELECT arm, completed, refused, round(completed / (completed + refused), 8) AS conservative, CASE WHEN completed > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS permissive FROM a""")
def completion_rates(spark: SparkSession, sf: str) -> DataFrame:
    arms = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("refused"))
    return rounded(scoring.completion(arms, "arm", "completed", "refused"), "conservative", digits=8)


@query("""WITH l AS (SELECT s_suppkey, (s_suppkey * 7919) % 100003 AS position, s_nationkey < 3 AS a FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY position) AS n, count(*) FILTER (a) OVER () AS size FROM l)
SELECT s_suppkey, position, CASE WHEN a THEN 'a' ELSE 'b' END AS arm FROM n WHERE a OR n <= least(size, 20)""")
def selected_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Refused members, and as many others, twenty at most, in a frozen list's order."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    listed = rows.select("s_suppkey", (F.col("s_suppkey") * 7919 % 100003).alias("position"))
    return scoring.select_arms(rows, "s_suppkey", F.col("s_nationkey") < 3, listed, "position", 20)


_GATED = f"""p AS (SELECT o_orderkey AS k, o_orderkey % 17 <> 0 AS schema_valid, o_orderkey % 13 <> 0 AS compiled, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 <> 0 END AS audit_clean, o_custkey AS signature,
  (o_totalprice - 100000) / 1e5::DOUBLE AS alpha, round((o_totalprice - 100000) / 4e4::DOUBLE, 6) AS t, o_orderkey % 3 <> 0 AS cpcv_qualified FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY k) = 1 AS not_duplicate FROM p), c AS (SELECT *, schema_valid AND not_duplicate AND compiled AND coalesce(audit_clean, false) AS clean FROM d),
q AS (SELECT k, 2 * (1 - {cdf_sql("abs(t)")}) AS p FROM c WHERE clean), o AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM q), f AS (SELECT k, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS adj FROM o)"""


@query(f"""WITH {_GATED} SELECT c.k, not_duplicate, round(adj, 6) AS adjusted_p, CASE WHEN NOT (schema_valid AND not_duplicate) THEN 'invalid_proposal' WHEN NOT compiled THEN 'execution_failure' WHEN NOT coalesce(audit_clean, false) THEN 'audit_failure'
  WHEN NOT coalesce(adj <= 0.1 AND alpha > 0, false) THEN 'no_development_evidence' WHEN NOT cpcv_qualified THEN 'not_advanced' ELSE 'advanced' END AS outcome FROM c LEFT JOIN f ON f.k = c.k""")
def gate_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals through all gates, with one family of tests for those that are clean."""
    k = F.col("o_orderkey")
    yes = {n: F.lit(True) for n in ("mechanism_authorised", "template_supported", "toggles_preserved", "inputs_available", "execution_verified")}
    rows = table(spark, sf, "orders").select(
        k.alias("k"), (k % 17 != 0).alias("schema_valid"), (k % 13 != 0).alias("compiled"), F.when(k % 11 != 0, k % 7 != 0).alias("audit_clean"), F.col("o_custkey").alias("signature"),
        ((F.col("o_totalprice") - 100000) / 1e5).alias("alpha"), r((F.col("o_totalprice") - 100000) / 4e4).alias("t"), (k % 3 != 0).alias("cpcv_qualified"),
    ).withColumns(yes)
    out = scoring.gate_stack(rows, "k", F.col("signature"), "alpha", "t", 0.1)
    return rounded(out.select("k", "not_duplicate", "adjusted_p", "outcome"), "adjusted_p")


@query("""WITH f AS (SELECT p_partkey AS spec, p_size % 3 AS leg, p_type AS value, CASE p_partkey % 4 WHEN 0 THEN 'INFERRED' ELSE 'STATED' END AS tag FROM part)
SELECT spec, leg::INT AS leg, 'kind' AS field, value, 'not that size' AS detail FROM f WHERE tag = 'STATED' AND value IN ('ECONOMY', 'SMALL')""")
def assumption_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "part").select(F.col("p_partkey").alias("spec"), (F.col("p_size") % 3).cast("int").alias("leg"), F.lit("kind").alias("field"), F.col("p_type").alias("value"), F.when(F.col("p_partkey") % 4 == 0, "INFERRED").otherwise("STATED").alias("tag"))
    rules = spark.createDataFrame([("kind", v, "not that size") for v in ("ECONOMY", "SMALL")], "field string, value string, detail string")
    return scoring.mismatches(fields, rules)


@query(f"""WITH {months_sql('l_suppkey')}, x AS (SELECT l_suppkey, month, ret, (year(month) * 12 + month(month)) AS i, row_number() OVER w AS k FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
v AS (SELECT *, list(ret) FILTER (ret IS NOT NULL) OVER (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS last36, stddev_samp(ret * 2) OVER (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS sd, count(ret) OVER (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS n24,
  list(ret) FILTER (ret > -1) OVER (PARTITION BY l_suppkey ORDER BY i RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS last6 FROM x)
SELECT l_suppkey, month, round(CASE WHEN len(last36) >= 24 THEN -list_sort(last36)[2] END, 8) AS var_5pct, round(CASE WHEN n24 >= 18 THEN sd END, 8) AS bond_vol, round(CASE WHEN len(last6) = 6 THEN list_aggregate(list_transform(last6, lambda y: 1 + y), 'product') - 1 END, 8) AS mom6 FROM v""")
def recomputed_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of return history made anew from a view's own returns."""
    view = months(spark, sf, "l_suppkey").select("l_suppkey", "month", "ret", (F.col("ret") * 2).alias("xret"), F.lit(0.0).alias("mom6"))
    out = signals.recompute(view, "l_suppkey", "month")
    return rounded(out.select("l_suppkey", "month", "var_5pct", "bond_vol", "mom6"), "var_5pct", "bond_vol", "mom6", digits=8)
