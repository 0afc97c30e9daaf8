"""Queries: returns, rolling signals, views, ranks, regimes, clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks, rollup, screens, signals, views
from .base import PANEL, daily, daily_sql, months, months_sql, r, rounded, sort_panel, stable

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = stable(sql)
        return function

    return add


SUPPLIERS = months_sql("l_suppkey")


@query(f"WITH {months_sql('l_partkey')} SELECT l_partkey, month, price, round(ret, 8) AS ret FROM months")
def adjacent_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(months(spark, sf, "l_partkey").select("l_partkey", "month", "price", "ret"), "ret", digits=8)


@query(f"""WITH {SUPPLIERS}, a AS (SELECT l_suppkey, month, price, (year(month) * 12 + month(month)) % 6 * 1.5 AS ai, CASE WHEN month(month) % 6 = 0 THEN 9.0 ELSE 0.0 END AS cpn FROM months),
b AS (SELECT *, lag(price + ai) OVER w AS before, lag(month) OVER w AS pm FROM a WINDOW w AS (PARTITION BY l_suppkey ORDER BY month))
SELECT l_suppkey, month, round(CASE WHEN pm = last_day(month - INTERVAL 1 MONTH) AND before > 0 THEN (price + ai + cpn - before) / before END, 8) AS ret FROM b""")
def total_return(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").withColumns({"ai": (F.year("month") * 12 + F.month("month")) % 6 * 1.5, "cpn": F.when(F.month("month") % 6 == 0, 9.0).otherwise(0.0)})
    out = signals.total_return(rows, "l_suppkey", "month", "price", "ai", "cpn")
    return rounded(out.select("l_suppkey", "month", "ret"), "ret", digits=8)


@query(f"""WITH {months_sql('l_partkey')}, s AS (SELECT *, last_day::DATE IS NOT NULL AND month - last_day > 14 AS stale FROM months),
p AS (SELECT *, coalesce(lag(stale) OVER w, false) AND lag(month) OVER w = last_day(month - INTERVAL 1 MONTH) AS after FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY month))
SELECT l_partkey, month, CASE WHEN NOT stale THEN price END AS price, round(CASE WHEN NOT stale AND NOT coalesce(after, false) THEN ret END, 8) AS ret FROM p""")
def stale_mask(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.stale_mask(months(spark, sf, "l_partkey"), "l_partkey", "month", "last_day", 14, "price", ["ret"])
    return rounded(out.select("l_partkey", "month", "price", "ret"), "ret", digits=8)


@query(f"""WITH {PANEL} SELECT p.entity, p.date, round(n.ret, 8) AS next_ret, s.price AS ranking_score FROM panel p LEFT JOIN panel n ON n.entity = p.entity AND n.date = last_day(p.date + INTERVAL 1 MONTH)
LEFT JOIN panel s ON s.entity = p.entity AND s.date = last_day(p.date - INTERVAL 2 MONTH)""")
def lead_lag_panel(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.lagged_panel(sort_panel(spark, sf), "entity", "date", "ret", "price", 2)
    return rounded(out.select("entity", "date", "next_ret", "ranking_score"), "next_ret", digits=8)


@query(f"""WITH {SUPPLIERS}, f AS (SELECT l_suppkey, month, count(ret) OVER w AS n, list(ret) FILTER (ret IS NOT NULL) OVER w AS v FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT l_suppkey, month, round(CASE WHEN n >= 24 THEN -(list_sort(v)[2]) END, 8) AS kth FROM f""")
def rolling_kth_lowest(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.rolling_kth_lowest(months(spark, sf, "l_suppkey"), "l_suppkey", "month", "ret")
    return rounded(out.select("l_suppkey", "month", "kth"), "kth", digits=8)


@query(f"""WITH {SUPPLIERS}, v AS (SELECT *, coalesce(ret > -1, false) AS ok, lag(month) OVER w = last_day(month - INTERVAL 1 MONTH) AS follows FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
n AS (SELECT *, CASE WHEN ok AND NOT (coalesce(follows, false) AND coalesce(lag(ok) OVER w, false)) THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
g AS (SELECT *, CASE WHEN ok THEN sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY month) END AS run FROM n)
SELECT l_suppkey, month, round(CASE WHEN run IS NOT NULL AND count(ret) OVER w = 6 THEN exp(sum(CASE WHEN ok THEN ln(1 + ret) END) OVER w) - 1 END, 8) AS momentum FROM g WINDOW w AS (PARTITION BY l_suppkey, run ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_momentum(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.rolling_compound(months(spark, sf, "l_suppkey"), "l_suppkey", "month", "ret")
    return rounded(out.select("l_suppkey", "month", "momentum"), "momentum", digits=8)


@query(f"""WITH {SUPPLIERS} SELECT l_suppkey, month, round(CASE WHEN count(ret) OVER w >= 18 THEN stddev_samp(ret) OVER w END, 8) AS vol FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_vol(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.rolling_std(months(spark, sf, "l_suppkey"), "l_suppkey", "month", "ret")
    return rounded(out.select("l_suppkey", "month", "vol"), "vol", digits=8)


@query(f"""WITH {SUPPLIERS} SELECT l_suppkey, month, price, CASE WHEN month BETWEEN DATE '1997-01-31' AND DATE '1998-12-31' THEN lead(price, 2) OVER w ELSE price END AS shifted FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)""")
def planted_lead(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").select("l_suppkey", "month", "price")
    return signals.shifted_inside(rows, "l_suppkey", "month", "price", 2, "1997-01-31", "1998-12-31", "shifted")


@query(f"""WITH {daily_sql("l_suppkey")},
grid AS (SELECT DISTINCT last_day(day) AS month FROM daily),
numbered AS (SELECT month, d::DATE AS d, row_number() OVER (PARTITION BY month ORDER BY d) AS a, row_number() OVER (PARTITION BY month ORDER BY d DESC) AS z FROM grid, unnest(generate_series(date_trunc('month', month)::TIMESTAMP, month::TIMESTAMP, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6),
cuts AS (SELECT month, max(d) FILTER (a <= 10) AS begin_cut, min(d) FILTER (z <= 10) AS end_cut FROM numbered GROUP BY 1),
win AS (SELECT l_suppkey, month, sum(vwap * volume) FILTER (day <= begin_cut) / nullif(sum(volume) FILTER (day <= begin_cut), 0) AS b, sum(vwap * volume) FILTER (day >= end_cut) / nullif(sum(volume) FILTER (day >= end_cut), 0) AS e
  FROM daily JOIN cuts ON last_day(day) = month WHERE day <= begin_cut OR day >= end_cut GROUP BY ALL),
l AS (SELECT *, lag(e) OVER w AS pe, lag(month) OVER w = last_day(month - INTERVAL 1 MONTH) AS follows FROM win WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
o AS (SELECT *, coalesce(follows AND pe > 0 AND b > 0 AND e IS NOT NULL, false) AS ok FROM l)
SELECT l_suppkey, month, round(CASE WHEN ok THEN e / b - 1 END, 8) AS ret_within, round(CASE WHEN ok THEN b / pe - 1 END, 8) AS ret_bridge, round(CASE WHEN ok THEN e / pe - 1 END, 8) AS ret_end FROM o""")
def return_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    win = rollup.month_window_prices(daily(spark, sf, "l_suppkey"), "l_suppkey", "day", 10)
    out = signals.return_parts(win, "l_suppkey", "month", "price_begin", "price_end")
    return rounded(out.drop("price_begin", "price_end"), "ret_within", "ret_bridge", "ret_end", digits=8)


@query(f"""WITH {PANEL}, v AS (SELECT entity, date, ret, CASE WHEN entity % 9 <> 0 THEN size END AS x FROM panel),
k AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2 END AS rk FROM v),
m AS (SELECT *, max(rk) OVER (PARTITION BY date) AS top FROM k)
SELECT entity, date, rk AS avg_rank, round(CASE WHEN rk IS NULL THEN NULL WHEN top > 1 THEN (rk - 1) / (top - 1) - 0.5 ELSE 0 END, 8) AS mapped FROM m""")
def rank_transform(spark: SparkSession, sf: str) -> DataFrame:
    rows = sort_panel(spark, sf).withColumn("x", F.when(F.col("entity") % 9 != 0, F.col("size")))
    out = ranks.rank_map(ranks.average_rank(rows, "x", ["date"], "avg_rank"), "x", ["date"], "mapped")
    return rounded(out.select("entity", "date", "avg_rank", "mapped"), "mapped", digits=8)


@query(f"""WITH {PANEL} SELECT entity, date, floor((row_number() OVER (PARTITION BY date ORDER BY price, entity) - 1) * 7 / count(*) OVER (PARTITION BY date))::INT AS bucket FROM panel""")
def quantile_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sort_panel(spark, sf).select("entity", "date", ranks.quantile_group("price", "entity", 7, ["date"]).alias("bucket"))


@query(f"""WITH {PANEL}, c AS (SELECT *, floor(count(*) OVER (PARTITION BY date) / 5) AS n, row_number() OVER (PARTITION BY date ORDER BY price, entity) AS up, row_number() OVER (PARTITION BY date ORDER BY price DESC, entity DESC) AS down FROM panel)
SELECT entity, date, CASE WHEN down <= n THEN 1 ELSE -1 END AS leg FROM c WHERE down <= n OR up <= n""")
def extreme_legs(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.extremes(sort_panel(spark, sf), ["date"], "price", "entity", 5).select("entity", "date", "leg")


@query(f"""WITH {PANEL}, k AS (SELECT entity, date, size, rank() OVER (PARTITION BY date ORDER BY size) + (count(*) OVER (PARTITION BY date, size) - 1) / 2 AS rk, count(size) OVER (PARTITION BY date) AS n FROM panel)
SELECT entity, date, size, 'top' AS side FROM k WHERE rk / n > 2.0::DOUBLE / 3 UNION ALL SELECT entity, date, size, 'bottom' FROM k WHERE rk / n <= 1.0::DOUBLE / 3""")
def tercile_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = sort_panel(spark, sf).select("entity", "date", "size")
    return screens.tercile(rows, "size", "date", True).withColumn("side", F.lit("top")).unionByName(screens.tercile(rows, "size", "date", False).withColumn("side", F.lit("bottom")))


_MACRO = f"""{SUPPLIERS}, macro AS (SELECT month AS date, round(avg(price), 6) AS v FROM months GROUP BY 1)"""


def macro(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf, "l_suppkey").groupBy(F.col("month").alias("date")).agg(r(F.avg("price")).alias("v"))


@query(f"""WITH {_MACRO}, m AS (SELECT date, v, count(v) OVER w AS n, quantile_cont(v, 0.5) OVER w AS med FROM macro WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)),
l AS (SELECT date, lag(v, 1) OVER (ORDER BY date) AS x FROM macro),
g AS (SELECT date, x, count(x) OVER w AS n, quantile_cont(x, 0.5) OVER w AS med FROM l WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT m.date, m.v, round(CASE WHEN m.n >= 12 THEN m.med END, 6) AS past_median, coalesce(CASE WHEN g.n >= 24 THEN g.x > g.med END, false) AS in_regime FROM m JOIN g USING (date)""")
def expanding_median_regime(spark: SparkSession, sf: str) -> DataFrame:
    rows = signals.expanding_past_median(macro(spark, sf), "date", "v", 2, 12, "past_median")
    return rounded(signals.expanding_regime(rows, "date", "v", 1, 24), "past_median")


@query(f"""WITH {PANEL}, macro AS (SELECT date, round(avg(price), 6) AS v FROM panel GROUP BY 1), l AS (SELECT date, lag(v, 1) OVER (ORDER BY date) AS x FROM macro),
g AS (SELECT date, x, count(x) OVER w AS n, quantile_cont(x, 0.5) OVER w AS med FROM l WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), s AS (SELECT date FROM g WHERE n >= 24 AND x > med)
SELECT date, count(*) AS n FROM panel WHERE date IN (SELECT date FROM s) GROUP BY 1""")
def regime_months(spark: SparkSession, sf: str) -> DataFrame:
    panel = sort_panel(spark, sf)
    series = panel.groupBy("date").agg(r(F.avg("price")).alias("v"))
    chosen = signals.expanding_regime(series, "date", "v", 1, 24).filter("in_regime")
    return signals.in_months(panel, chosen, "date").groupBy("date").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, b AS (SELECT quantile_cont(ret, 0.02) AS lo, quantile_cont(ret, 0.98) AS hi FROM panel)
SELECT entity, date, round(ret, 8) AS ret, round(least(greatest(ret, lo), hi), 8) AS clipped FROM panel, b WHERE ret IS NOT NULL""")
def winsor_ex_post(spark: SparkSession, sf: str) -> DataFrame:
    rows = sort_panel(spark, sf).filter("ret is not null").select("entity", "date", "ret")
    return rounded(screens.winsor_ex_post(rows, "ret", 0.02, 0.98, "clipped"), "ret", "clipped", digits=8)


@query(f"""WITH {SUPPLIERS}, p AS (SELECT l_suppkey, month, ret, year(month) * 12 + month(month) - 1 AS k FROM months WHERE ret IS NOT NULL),
b AS (SELECT k, quantile_cont(ret, 0.05) OVER w AS lo, quantile_cont(ret, 0.95) OVER w AS hi FROM p WINDOW w AS (ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), d AS (SELECT DISTINCT * FROM b)
SELECT l_suppkey, month, round(CASE WHEN lo IS NULL THEN ret ELSE least(greatest(ret, lo), hi) END, 8) AS clipped FROM p LEFT JOIN d USING (k)""")
def winsor_ex_ante(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").filter("ret is not null").withColumn("k", F.year("month") * 12 + F.month("month") - 1)
    out = screens.winsor_ex_ante(rows, "ret", "k", 0.05, 0.95, "clipped")
    return rounded(out.select("l_suppkey", "month", "clipped"), "clipped", digits=8)


@query(f"""WITH {PANEL}, b AS (SELECT quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM panel) SELECT entity, date, round(ret, 8) AS ret FROM panel, b WHERE ret >= lo AND ret <= hi""")
def trim_percentile(spark: SparkSession, sf: str) -> DataFrame:
    rows = sort_panel(spark, sf).select("entity", "date", "ret")
    return rounded(screens.truncate(rows, "ret", *screens.percentile_bounds(rows, "ret", 0.1, 0.9)), "ret", digits=8)


@query(f"""WITH {SUPPLIERS}, m AS (SELECT l_suppkey AS cusip, month AS date, volume AS size, last_day AS last_trade_date, price AS price_eom, round(ret, 8) AS ret, CASE WHEN l_suppkey % 10 = 0 AND month(month) = 12 THEN 'default' WHEN l_suppkey % 10 = 1 AND month(month) = 12 THEN 'call' END AS exit_reason FROM months),
s AS (SELECT *, date - last_trade_date > 3 AS stale, lag(date - last_trade_date > 3) OVER w AS ps, lag(date) OVER w AS pd FROM m WINDOW w AS (PARTITION BY cusip ORDER BY date))
SELECT cusip, date, size, last_trade_date, exit_reason, CASE WHEN NOT stale THEN price_eom END AS price_eom, CASE WHEN NOT stale AND NOT coalesce(ps AND pd = last_day(date - INTERVAL 1 MONTH), false) THEN ret END AS ret, round(price_eom / 2, 6) AS half FROM s WHERE exit_reason IS DISTINCT FROM 'default'""")
def panel_view(spark: SparkSession, sf: str) -> DataFrame:
    m = months(spark, sf, "l_suppkey")
    exit_ = F.when((F.col("l_suppkey") % 10 == 0) & (F.month("month") == 12), "default").when((F.col("l_suppkey") % 10 == 1) & (F.month("month") == 12), "call")
    panel = m.select(F.col("l_suppkey").alias("cusip"), F.col("month").alias("date"), F.col("volume").alias("size"), exit_.alias("exit_reason"), F.col("last_day").alias("last_trade_date_raw"), F.col("price").alias("price_eom_raw"), r(F.col("ret"), 8).alias("ret_raw"), (F.col("price") * 2).alias("price_eom_corr"), F.col("ret").alias("ret_corr"), F.col("last_day").alias("last_trade_date_corr"))
    extra = m.select(F.col("l_suppkey").alias("cusip"), F.col("month").alias("date"), r(F.col("price") / 2).alias("half_raw"), F.lit(0.0).alias("half_corr"))
    return views.view(panel, "raw", ["raw", "corr"], ["cusip", "date"], stale_days=3, drop_reasons=["default"], signals=extra, names=["half"])


@query(f"""WITH {SUPPLIERS}, w AS (SELECT l_suppkey, month, round(volume / sum(volume) OVER (PARTITION BY month), 8) AS weight FROM months),
n AS (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM w)), x AS (SELECT w.*, n.k FROM w JOIN n USING (month)),
c AS (SELECT coalesce(a.k, b.k + 1) AS k, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d FROM x a FULL JOIN x b ON a.l_suppkey = b.l_suppkey AND a.k = b.k + 1)
SELECT n.month, round(sum(d), 8) AS turnover FROM n JOIN c USING (k) GROUP BY 1""")
def weight_turnover(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = months(spark, sf, "l_suppkey").withColumn("weight", r(F.col("volume") / F.sum("volume").over(Window.partitionBy("month")), 8))
    return rounded(signals.turnover(rows, "l_suppkey", "month", "weight"), "turnover", digits=8)


@query(f"""WITH RECURSIVE {SUPPLIERS}, s AS MATERIALIZED (SELECT l_suppkey, month, volume, row_number() OVER (PARTITION BY l_suppkey ORDER BY month) AS k FROM months),
e AS (SELECT l_suppkey, month, k, volume::DOUBLE AS smooth FROM s WHERE k = 1 UNION ALL SELECT s.l_suppkey, s.month, s.k, e.smooth * 0.7 + s.volume * 0.3 FROM e JOIN s ON s.l_suppkey = e.l_suppkey AND s.k = e.k + 1)
SELECT l_suppkey, month, round(smooth, 6) AS smooth FROM e""")
def smoothed_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").select("l_suppkey", "month", "volume")
    return rounded(signals.ewma(rows, "l_suppkey", "month", "volume", 0.7, "smooth").drop("volume"), "smooth")


@query(f"""WITH {SUPPLIERS}, f AS (SELECT l_suppkey, month, price, volume, CASE WHEN lead(month) OVER w = last_day(month + INTERVAL 1 MONTH) THEN lead(ret) OVER w END AS nxt, greatest(abs(ret), 0.05) AS vol_scaler FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
c AS (SELECT *, nxt / vol_scaler AS target FROM f WHERE nxt / vol_scaler IS NOT NULL AND price IS NOT NULL AND volume IS NOT NULL)
SELECT l_suppkey, month, round(vol_scaler, 8) AS vol_scaler, round(target, 6) AS target FROM c QUALIFY count(*) OVER (PARTITION BY month) > 20""")
def factor_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").withColumn("size_of", F.abs("ret"))
    out = signals.next_month_feed(rows.filter("true"), "l_suppkey", "month", "ret", "size_of", ["price", "volume"], 0.05, 20)
    return rounded(rounded(out.select("l_suppkey", "month", "vol_scaler", "target"), "vol_scaler", digits=8), "target")
