"""Queries: roll-ups, screens, matching, as-of joins, outliers, sets and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import guards, match, outliers, ranks, rollup, screens, signals, views
from ..sources import files
from .base import TRADES, daily, daily_sql, months, months_sql, r, rounded, stable, table, trades

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = stable(sql)
        return function

    return add


@query(f"""WITH {daily_sql("l_partkey", "qty >= 10")}
SELECT l_partkey, day, round(vwap, 6) AS vwap, volume, n_trades, round(min_price, 6) AS min_price, round(max_price, 6) AS max_price FROM daily""")
def daily_vwap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(daily(spark, sf, "l_partkey", 10), "vwap", "min_price", "max_price")


@query(f"""WITH {TRADES}
SELECT l_suppkey, day, round(sum(price * qty) / sum(qty), 6) AS vwap, sum(qty) AS volume, count(*) AS n_trades FROM trades
WHERE price IS NOT NULL AND qty > 0 GROUP BY ALL""")
def daily_vwap_strict(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.daily_vwap(trades(spark, sf), "l_suppkey", "day", "price", "qty", strict=True)
    return rounded(out, "vwap").select("l_suppkey", "day", "vwap", "volume", "n_trades")


@query(f"""WITH {months_sql("l_partkey")} SELECT l_partkey, month, price, volume, n_trades, last_day FROM months""")
def month_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return months(spark, sf, "l_partkey").drop("ret")


@query(f"""WITH {daily_sql("l_suppkey")}
SELECT l_suppkey, last_day(day) AS month, round(arg_max(vwap, day), 6) AS price, max(day) AS last_day FROM daily GROUP BY ALL""")
def month_last_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.month_last_price(daily(spark, sf, "l_suppkey"), "l_suppkey", "day"), "price")


@query(f"""WITH {daily_sql("l_suppkey")},
grid AS (SELECT DISTINCT last_day(day) AS month FROM daily),
days AS (SELECT month, unnest(generate_series(date_trunc('month', month)::TIMESTAMP, month::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM grid),
numbered AS (SELECT month, d, row_number() OVER (PARTITION BY month ORDER BY d) AS a, row_number() OVER (PARTITION BY month ORDER BY d DESC) AS z FROM days WHERE isodow(d) < 6),
cuts AS (SELECT month, max(d) FILTER (a <= 5) AS begin_cut, min(d) FILTER (z <= 5) AS end_cut FROM numbered GROUP BY 1),
cut AS (SELECT d.*, c.* FROM daily d JOIN cuts c ON last_day(d.day) = c.month WHERE day <= begin_cut OR day >= end_cut)
SELECT l_suppkey, month,
  round(sum(vwap * volume) FILTER (day <= begin_cut) / nullif(sum(volume) FILTER (day <= begin_cut), 0), 6) AS price_begin,
  round(sum(vwap * volume) FILTER (day >= end_cut) / nullif(sum(volume) FILTER (day >= end_cut), 0), 6) AS price_end
FROM cut GROUP BY ALL""")
def month_window_vwap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.month_window_prices(daily(spark, sf, "l_suppkey"), "l_suppkey", "day", 5), "price_begin", "price_end")


@query(f"""WITH {months_sql("l_suppkey")}
SELECT month, round(sum(volume * ret) / sum(volume), 8) AS ret, count(*) AS n FROM months WHERE ret IS NOT NULL AND volume > 0 AND l_suppkey % 7 <> 0 GROUP BY 1""")
def market_factor(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.weighted_mean_by(months(spark, sf, "l_suppkey"), "month", "ret", "volume", F.col("l_suppkey") % 7 != 0)
    return rounded(out, "ret", digits=8)


@query(f"""WITH {daily_sql("l_suppkey")},
logs AS (SELECT l_suppkey, day, last_day(day) AS month, CASE WHEN vwap > 0 THEN ln(vwap) END AS p FROM daily),
gaps AS (
  SELECT *, lag(day) OVER w AS prev, p - lag(p) OVER w AS d FROM logs WINDOW w AS (PARTITION BY l_suppkey, month ORDER BY day)),
changes AS (
  SELECT *, CASE WHEN (SELECT 5 * ((day - DATE '1970-01-05') // 7) + least((day - DATE '1970-01-05') % 7, 5) - 5 * ((prev - DATE '1970-01-05') // 7) - least((prev - DATE '1970-01-05') % 7, 5)) <= 7 THEN d END AS x FROM gaps),
pairs AS (SELECT *, lead(x) OVER (PARTITION BY l_suppkey, month ORDER BY day) AS y FROM changes)
SELECT l_suppkey, month, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_pairs, count(DISTINCT day) AS days_traded,
  round(CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 5 THEN -covar_samp(x, y) END, 8) + 0.0 AS gamma,
  (SELECT count(*) FROM unnest(generate_series(date_trunc('month', month)::TIMESTAMP, month::TIMESTAMP, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6)::INT AS business_days
FROM pairs GROUP BY ALL""")
def serial_cov(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.serial_covariance(daily(spark, sf, "l_suppkey"), "l_suppkey", "day", "vwap"), "gamma", digits=8)


@query(f"""WITH {months_sql("l_suppkey")},
complete AS (SELECT month, price / 1000 AS a, ln(volume) AS b, n_trades::DOUBLE AS c, ret AS y FROM months WHERE ret IS NOT NULL AND volume > 0),
sums AS (SELECT month, count(*) AS n, avg(a*a) AS m0, avg(a*b) AS m1, avg(a*c) AS m2, avg(b*b) AS m3, avg(b*c) AS m4, avg(c*c) AS m5, avg(a*y) AS m6, avg(b*y) AS m7, avg(c*y) AS m8 FROM complete GROUP BY 1)
SELECT month, n, i, j, round(value, 6) + 0.0 AS value FROM (
  SELECT month, n, 0 AS i, 0 AS j, m0 AS value FROM sums UNION ALL SELECT month, n, 0, 1, m1 FROM sums UNION ALL SELECT month, n, 0, 2, m2 FROM sums
  UNION ALL SELECT month, n, 1, 1, m3 FROM sums UNION ALL SELECT month, n, 1, 2, m4 FROM sums UNION ALL SELECT month, n, 2, 2, m5 FROM sums
  UNION ALL SELECT month, n, 0, -1, m6 FROM sums UNION ALL SELECT month, n, 1, -1, m7 FROM sums UNION ALL SELECT month, n, 2, -1, m8 FROM sums)""")
def gram_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").filter("volume > 0").select("month", (F.col("price") / 1000).alias("a"), F.log("volume").alias("b"), F.col("n_trades").cast("double").alias("c"), F.col("ret").alias("y"))
    return rounded(rollup.gram_moments(rows, "month", ["a", "b", "c"], "y"), "value")


@query(f"""WITH {TRADES},
a AS (SELECT l_suppkey, day, sum(price * qty) / sum(qty) AS v FROM trades GROUP BY ALL),
b AS (SELECT l_suppkey, day, sum(price * qty) / sum(qty) AS v FROM trades WHERE qty >= 20 GROUP BY ALL)
SELECT count(*) AS n, round(avg((abs(a.v - b.v) >= 0.0001)::INT), 6) AS share_moved, round(avg(abs(a.v - b.v)), 6) AS mean_abs,
  round(quantile_cont(abs(a.v - b.v), 0.99), 6) AS p99_abs, round(max(abs(a.v - b.v)), 6) AS max_abs FROM a JOIN b USING (l_suppkey, day)""")
def diff_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.difference_profile(daily(spark, sf, "l_suppkey"), daily(spark, sf, "l_suppkey", 20), ["l_suppkey", "day"], "vwap")
    return rounded(out, "share_moved", "mean_abs", "p99_abs", "max_abs")


def trade_screens() -> dict:
    return {
        "price": screens.between("price", 950, 1800),
        "volume": screens.at_least("qty", 10),
        "status": screens.status_keep("l_returnflag", "day", "N", "A", "1997-01-01"),
        "code": screens.not_code("l_linestatus", "F"),
        "tax": screens.at_most_or_null("l_tax", 0.05),
        "discount": screens.positive("l_discount"),
    }


_SCREENS_SQL = f"""{TRADES},
s AS (SELECT coalesce(price BETWEEN 950 AND 1800, false) AS s0, coalesce(qty >= 10, false) AS s1,
  coalesce(l_returnflag = 'N' OR (l_returnflag = 'A' AND day < DATE '1997-01-01'), false) AS s2, coalesce(l_linestatus, '') <> 'F' AS s3,
  l_tax IS NULL OR l_tax <= 0.05 AS s4, coalesce(l_discount > 0, false) AS s5, * FROM trades)"""


@query(f"""WITH {_SCREENS_SQL}, w AS (SELECT count(*) AS all_rows,
  count(*) FILTER (NOT s0) AS f0, count(*) FILTER (s0) AS k0, count(*) FILTER (NOT s1) AS f1, count(*) FILTER (s0 AND s1) AS k1,
  count(*) FILTER (NOT s2) AS f2, count(*) FILTER (s0 AND s1 AND s2) AS k2, count(*) FILTER (NOT s3) AS f3, count(*) FILTER (s0 AND s1 AND s2 AND s3) AS k3,
  count(*) FILTER (NOT s4) AS f4, count(*) FILTER (s0 AND s1 AND s2 AND s3 AND s4) AS k4, count(*) FILTER (NOT s5) AS f5, count(*) FILTER (s0 AND s1 AND s2 AND s3 AND s4 AND s5) AS k5 FROM s)
SELECT all_rows, 0 AS step, 'price' AS screen, f0 AS fails, k0 AS "left" FROM w UNION ALL SELECT all_rows, 1, 'volume', f1, k1 FROM w
UNION ALL SELECT all_rows, 2, 'status', f2, k2 FROM w UNION ALL SELECT all_rows, 3, 'code', f3, k3 FROM w
UNION ALL SELECT all_rows, 4, 'tax', f4, k4 FROM w UNION ALL SELECT all_rows, 5, 'discount', f5, k5 FROM w""")
def screen_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return screens.cascade_counts(trades(spark, sf, "l_returnflag", "l_linestatus", "l_tax", "l_discount"), trade_screens())


@query(f"""WITH {_SCREENS_SQL} SELECT l_orderkey, l_linenumber, day, round(price, 6) AS price FROM s WHERE s0 AND s1 AND s3""")
def screened_trades(spark: SparkSession, sf: str) -> DataFrame:
    rows = screens.apply_screens(trades(spark, sf, "l_returnflag", "l_linestatus", "l_tax", "l_discount"), trade_screens(), ["code", "price", "volume"])
    return rounded(rows.select("l_orderkey", "l_linenumber", "day", "price"), "price")


@query(f"""WITH {TRADES}, k AS (SELECT l_orderkey, l_linenumber, price, CASE WHEN price > 1900 THEN 'dropped' WHEN price > 90 AND price <= 1000 THEN 'kept' WHEN price / 10 > 90 AND price / 10 <= 1000 THEN 'tenth'
  WHEN price / 100 > 90 AND price / 100 <= 1000 THEN 'hundredth' ELSE 'outside' END AS kind FROM trades)
SELECT l_orderkey, l_linenumber, kind, round(CASE kind WHEN 'dropped' THEN NULL WHEN 'tenth' THEN price / 10 WHEN 'hundredth' THEN price / 100 ELSE price END, 6) AS shifted FROM k""")
def decimal_shift(spark: SparkSession, sf: str) -> DataFrame:
    value, kind = screens.decimal_shift(F.col("price"), 90, 1000, 1900)
    return trades(spark, sf).select("l_orderkey", "l_linenumber", kind.alias("kind"), r(value).alias("shifted"))


@query("""WITH f AS (SELECT p_partkey, coalesce(p_size > 45, false) AS not_large, coalesce(p_type NOT LIKE '%BRASS%' AND p_type LIKE '%STEEL%', false) AS not_steel, coalesce(p_brand IN ('Brand#1', 'Brand#11'), false) AS not_brand FROM part)
SELECT *, NOT (not_large OR not_steel OR not_brand) AS eligible FROM f""")
def universe_flags(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"large": F.col("p_size") > 45, "steel": ~F.col("p_type").like("%BRASS%") & F.col("p_type").like("%STEEL%"), "brand": F.col("p_brand").isin("Brand#1", "Brand#11")}
    return screens.universe(table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand"), rules).select("p_partkey", "not_large", "not_steel", "not_brand", "eligible")


@query(f"""WITH {daily_sql("l_suppkey")}
SELECT l_suppkey, day, (abs(vwap - 1000) < 2 OR abs(vwap - 1250) < 2 OR abs(vwap - 1500) < 2) AS near_round,
  coalesce((min_price < 1500 OR max_price < 1500) AND (max_price - min_price) / ((min_price + max_price) / 2) > 0.3, false) AS wide FROM daily""")
def round_intraday(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf, "l_suppkey")
    return d.select("l_suppkey", "day", screens.near_round(F.col("vwap"), [1000, 1250, 1500], 2).alias("near_round"), screens.wide_intraday(F.col("min_price"), F.col("max_price"), 1500, 0.3).alias("wide"))


@query("""WITH c AS (SELECT DISTINCT l_suppkey, l_shipdate, l_quantity::INT::VARCHAR AS ref FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM c WHERE c.l_suppkey IS NOT DISTINCT FROM l.l_suppkey AND c.l_shipdate IS NOT DISTINCT FROM l.l_shipdate AND c.ref = l.l_quantity::INT::VARCHAR)""")
def cancel_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("seq"))
    out = match.cancel(rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag = 'R'").withColumnRenamed("seq", "refers"), ["l_suppkey", "l_shipdate"], "seq", "refers")
    return out.select("l_orderkey", "l_linenumber")


_NET = """pool AS (SELECT l_suppkey, l_shipdate, l_quantity, count(*) AS n FROM lineitem WHERE {consumer} GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate, l_quantity ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE {rows})
SELECT p.l_orderkey, p.l_linenumber FROM placed p LEFT JOIN pool USING (l_suppkey, l_shipdate, l_quantity) WHERE k > coalesce(n, 0)"""


@query("WITH " + _NET.format(consumer="l_returnflag = 'R'", rows="l_returnflag <> 'R'"))
def reversal_netout(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    out = match.net_out(rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag = 'R'"), ["l_suppkey", "l_shipdate", "l_quantity"], ["l_orderkey", "l_linenumber"], ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber")


@query("WITH " + _NET.format(consumer="l_linestatus = 'O'", rows="l_linestatus <> 'O'") + " UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'")
def multiset_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_linestatus")
    out = match.dedupe_sides(rows, "l_linestatus", "O", ["l_suppkey", "l_shipdate", "l_quantity"], ["l_orderkey", "l_linenumber"], ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders),
grid AS (SELECT c_custkey AS o_custkey, last_day(m)::TIMESTAMP AS month FROM customer, (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS m)),
f AS (SELECT g.o_custkey, g.month, max(struct_pack(d := e.o_orderdate, k := e.o_orderkey)) AS best FROM grid g LEFT JOIN e ON e.o_custkey = g.o_custkey AND e.o_orderdate <= g.month GROUP BY ALL)
SELECT f.o_custkey, f.month::DATE AS month, e.o_orderkey AS last_order, round(e.v, 2) AS last_value FROM f LEFT JOIN e ON e.o_orderkey = f.best.k""")
def asof_latest_event(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_order"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("last_value"))
    span = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1998-12-01").cast("date"), F.expr("interval 1 month")))
    grid = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), span.alias("m")).select("o_custkey", F.last_day("m").alias("month"))
    out = match.asof(grid, events, "o_custkey", "month", "o_orderdate", ["last_order", "last_value"], ["last_order"])
    return rounded(out, "last_value", digits=2)


_DISTRESS = outliers.DistressRules(ultra_low=1000.0, normal_ratio=1.4, spike_above=1500.0, spike_ratio=1.3, recovery=1.1, plateau_low=1300.0, plateau_days=2, displacement=1.05, rounds=(1000.0, 1200.0), tolerance=5.0, intraday_price=1100.0, intraday_range=0.05)

_NEAR = "list_filter(list_concat(list(p) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), list(p) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)), lambda x: x > p)"


@query(f"""WITH {daily_sql("l_suppkey")},
base AS (SELECT l_suppkey AS k, day, round(vwap, 0) AS p, min_price AS lo, max_price AS hi FROM daily),
f AS (SELECT *, (abs(p - 1000) < 5 OR abs(p - 1200) < 5) AS rnd, count(*) OVER (PARTITION BY k) >= 3 AS many, coalesce({_NEAR}, []) AS above,
  coalesce(list_filter(list(p) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: x < p), []) AS below,
  coalesce(list(p) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), []) AS ahead,
  coalesce(lag(p) OVER (PARTITION BY k ORDER BY day) <> p, true)::INT AS new FROM base),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY day) AS run FROM f),
runs AS (SELECT k, run, count(*) AS n, any_value(p) AS v, any_value(rnd) AS rr FROM g GROUP BY ALL),
odd AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY run) AS pre, lead(v) OVER (PARTITION BY k ORDER BY run) AS post FROM runs),
plat AS (SELECT k, run, (v < 1300 OR rr) AND n >= 2 AND (rr OR coalesce(pre / (v + 1e-10) >= 1.05, false) OR coalesce(post / (v + 1e-10) >= 1.05, false)) AS flag FROM odd),
x AS (SELECT g.k, g.day, many AND (p < 1000 OR rnd) AND coalesce(list_median(above) / (p + 1e-10) >= 1.4, false) AS flagged_anomaly,
  many AND (p > 1500 OR (rnd AND p > 0.5)) AND coalesce(p / (list_median(below) + 1e-10) >= 1.3, false) AND coalesce(len(list_filter(ahead, lambda y: y <= list_median(below) * 1.1)) > 0, false) AS flagged_spike,
  plat.flag AS flagged_plateau, coalesce((lo < 1100 OR hi < 1100) AND (hi - lo) / ((lo + hi) / 2) > 0.05, false) AS flagged_intraday
  FROM g JOIN plat USING (k, run))
SELECT k AS l_suppkey, day, flagged_anomaly, flagged_spike, flagged_plateau, flagged_intraday, NOT (flagged_anomaly OR flagged_spike OR flagged_plateau OR flagged_intraday) AS kept FROM x""")
def distress_filters(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf, "l_suppkey").withColumn("p", r(F.col("vwap"), 0))
    out = outliers.distress_flags(d, "l_suppkey", "day", "p", "min_price", "max_price", _DISTRESS)
    return out.select("l_suppkey", "day", "flagged_anomaly", "flagged_spike", "flagged_plateau", "flagged_intraday", "kept")


@query()
def bounce_back_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = trades(spark, sf).withColumn("id", F.col("l_suppkey").cast("string"))
    rules = outliers.BounceRules(threshold=300.0, tolerance=60.0, slack=10.0, par=1300.0, par_band=150.0)
    out = outliers.bounce_back(rows, outliers.segment_key("id", "id"), "price", ["day", "l_orderkey", "l_linenumber"], rules)
    return out.select("l_orderkey", "l_linenumber", "bounced")


@query("""SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.keep_one(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT l_suppkey, l_shipdate::DATE AS day, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    return guards.duplicate_keys(rows, ["l_suppkey", "day", "l_quantity"])


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT coalesce(a.k, b.k) AS l_partkey, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return views.set_difference(rows.filter("l_returnflag = 'R'"), rows.filter("l_quantity > 45"), "l_partkey")


@query(f"""WITH {months_sql("l_suppkey")}, a AS (SELECT l_suppkey, month, price FROM months WHERE l_suppkey % 3 <> 0), b AS (SELECT l_suppkey, month, price + (l_suppkey % 5) * 0.001 AS price FROM months WHERE l_suppkey % 4 <> 0)
SELECT count(*) FILTER (b.month IS NULL) AS only_left, count(*) FILTER (a.month IS NULL) AS only_right, count(*) FILTER (a.month IS NOT NULL AND b.month IS NOT NULL) AS in_both, round(max(abs(a.price - b.price)), 6) AS max_abs_diff
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.month = b.month""")
def keyed_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey")
    other = rows.filter("l_suppkey % 4 <> 0").withColumn("price", F.col("price") + (F.col("l_suppkey") % 5) * 0.001)
    return rounded(match.compare_keyed(rows.filter("l_suppkey % 3 <> 0"), other, ["l_suppkey", "month"], "price"), "max_abs_diff")


@query("""WITH a AS (SELECT p_brand AS key, count(*) AS n_left FROM part WHERE p_size < 10 GROUP BY 1), b AS (SELECT p_brand AS key, count(*) AS n_right FROM part WHERE p_size > 48 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.key = b.key""")
def record_pairing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    return match.pair_records(rows.filter("p_size < 10"), rows.filter("p_size > 48"), F.col("p_brand"))


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m') AS year_month, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL)
SELECT year_month, round(avg(v), 6) AS mean_value, round(arg_max(v, day), 6) AS last_value, round(avg(v) / 100 / 12, 8) AS rf FROM d GROUP BY 1""")
def macro_series(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    mean, last = rollup.month_of_daily(d, "date", "v"), rollup.month_of_daily(d, "date", "v", "last")
    monthly = mean.select("year_month", F.col("v").alias("mean_value"))
    both = guards.join_one(monthly, last.select("year_month", F.col("v").alias("last_value")), ["year_month"], both=True)
    rf = files.risk_free(mean.select(F.to_date(F.concat("year_month", F.lit("-01"))).alias("date"), "v"), "v").select("year_month", F.col("rf_monthly").alias("rf"))
    return rounded(rounded(guards.join_one(both, rf, ["year_month"]), "mean_value", "last_value"), "rf", digits=8)


@query(f"""WITH {months_sql("l_suppkey")}, a AS (SELECT month, avg(price) AS v FROM months WHERE l_suppkey % 2 = 0 GROUP BY 1), b AS (SELECT month, avg(price) AS v FROM months WHERE l_suppkey % 2 = 1 GROUP BY 1)
SELECT strftime(a.month, '%Y-%m') AS year_month, round(a.v - b.v, 6) + 0.0 AS spread FROM a JOIN b USING (month) WHERE strftime(a.month, '%Y-%m') <= '2000-12'""")
def spread_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf, "l_suppkey").withColumn("year_month", F.date_format("month", "yyyy-MM"))
    side = lambda k: rows.filter(F.col("l_suppkey") % 2 == k).groupBy("year_month").agg(F.avg("price").alias("v"))
    return rounded(rollup.spread(side(0), side(1), "year_month", "v", "2000-12"), "spread")


@query("""WITH b AS (SELECT p_partkey AS k, DATE '1999-01-15' + (p_partkey % 900)::INT AS maturity, (p_size % 9)::DOUBLE AS coupon, [1, 2, 4, 12, 0][(p_partkey % 5 + 1)::INT] AS freq,
  CASE WHEN p_partkey % 7 = 0 THEN DATE '1999-03-01' END AS dflt FROM part),
g AS (SELECT b.*, last_day(m)::DATE AS d FROM b, (SELECT unnest(generate_series(TIMESTAMP '1998-10-01', TIMESTAMP '1999-12-01', INTERVAL 1 MONTH)) AS m)),
i AS (SELECT *, year(d) * 12 + month(d) - 1 AS mt, year(maturity) * 12 + month(maturity) - 1 AS mm, year(dflt) * 12 + month(dflt) - 1 AS md FROM g),
s AS (SELECT *, coupon > 0 AND freq IN (1, 2, 4, 12) AND mt <= mm AND (dflt IS NULL OR mt < md) AS ok, CASE WHEN freq > 0 THEN ((mt - mm) % (12 // freq) + 12 // freq) % (12 // freq) END AS since FROM i),
c AS (SELECT *, make_date((mt - since) // 12, (mt - since) % 12 + 1, 1) AS first FROM s),
e AS (SELECT *, first + (least(day(maturity), day(last_day(first))) - 1)::INT AS cpn FROM c)
SELECT k AS p_partkey, d AS month, round(CASE WHEN ok THEN coupon * ((year(d) - year(cpn)) * 360 + (month(d) - month(cpn)) * 30 + least(day(d), 30) - least(day(cpn), 30)) / 360.0 ELSE 0 END, 8) + 0.0 AS accrued,
  round(CASE WHEN ok AND since = 0 THEN coupon / freq ELSE 0 END, 8) AS coupon_paid FROM e""")
def accrued_interest(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    bonds = table(spark, sf, "part").select(
        "p_partkey", F.date_add(F.lit("1999-01-15").cast("date"), (k % 900).cast("int")).alias("maturity"), (F.col("p_size") % 9).cast("double").alias("coupon"),
        F.element_at(F.array(*map(F.lit, (1, 2, 4, 12, 0))), (k % 5 + 1).cast("int")).alias("freq"), F.when(k % 7 == 0, F.lit("1999-03-01").cast("date")).alias("dflt"),
    )
    span = F.explode(F.sequence(F.lit("1998-10-01").cast("date"), F.lit("1999-12-01").cast("date"), F.expr("interval 1 month")))
    rows = bonds.withColumn("m", span).withColumn("month", F.last_day("m"))
    interest, paid = dates.accrued(F.col("month"), F.col("maturity"), F.col("coupon"), F.col("freq"), F.col("dflt"))
    return rows.select("p_partkey", "month", r(interest, 8).alias("accrued"), r(paid, 8).alias("coupon_paid"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + (o_orderkey % 60)::INT) AS b FROM orders)
SELECT o_orderkey, last_day(a) AS month, year(a) * 12 + month(a) - 1 AS month_no, ((year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + least(day(b), 30) - least(day(a), 30))::INT AS days_360,
  (SELECT count(*) FROM unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) AS business_gap FROM o""")
def calendar_columns(spark: SparkSession, sf: str) -> DataFrame:
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 60).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", dates.month_end(a).alias("month"), dates.month_index(a).cast("long").alias("month_no"), dates.days_30e_360(a, b).alias("days_360"), dates.business_gap(a, b).cast("long").alias("business_gap"))


@query("""WITH p AS (SELECT p_partkey, p_size, ['AAA','AA+','AA','AA-','A+','A','A-','BBB+','BBB','BBB-','BB+','BB','BB-','B+','B','B-','CCC+','CCC','CCC-','CC','C','D','NR','WD'][(p_partkey % 24 + 1)::INT] AS letters FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 24 < 22 THEN (p_partkey % 24 + 1)::INT END AS rating, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'SPR' END, CASE WHEN p_size % 3 = 0 THEN 'MR' END, CASE WHEN p_size % 5 = 0 THEN 'FR' END], lambda x: x IS NOT NULL), '+') AS agencies,
  CASE WHEN p_size % 4 = 0 AND (p_size % 6 <> 0 OR DATE '2000-01-01' + p_size::INT <= DATE '2000-01-20') THEN 'maturity' WHEN p_size % 6 = 0 THEN 'default' END AS exit_reason FROM p""")
def ratings_and_exits(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    letters = F.element_at(F.array(*map(F.lit, (*numbers.RATINGS, "NR", "WD"))), (k % 24 + 1).cast("int"))
    _, label = numbers.first_exit(maturity=F.when(size % 4 == 0, F.date_add(F.lit("2000-01-01").cast("date"), size)), default=F.when(size % 6 == 0, F.lit("2000-01-20").cast("date")))
    return table(spark, sf, "part").select("p_partkey", numbers.rating_number(letters).alias("rating"), numbers.agency_label(SPR=size % 2 == 0, MR=size % 3 == 0, FR=size % 5 == 0).alias("agencies"), label.alias("exit_reason"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n, max(value) AS v FROM events GROUP BY ALL)
SELECT user_id, day, n, round(v, 6) AS v FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, day) <= 3""")
def stratified_top_k(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("v"))
    return rounded(ranks.top_k(d, ["user_id"], [F.col("v").desc(), F.col("day")], 3), "v")


@query("""SELECT l_linestatus AS period, count(*) AS n, count(DISTINCT l_shipdate::DATE) AS days, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day FROM lineitem GROUP BY 1""")
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_linestatus", F.to_date("l_shipdate").alias("day"))
    return rows.groupBy(F.col("l_linestatus").alias("period")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"""WITH {daily_sql("l_suppkey")} , m AS (SELECT l_suppkey, last_day(day) AS month, count(DISTINCT day) AS days_traded FROM daily GROUP BY ALL)
SELECT *, round(days_traded / (SELECT count(*) FROM unnest(generate_series(date_trunc('month', month)::TIMESTAMP, month::TIMESTAMP, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6), 8) AS share FROM m""")
def trading_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf, "l_suppkey").groupBy("l_suppkey", F.last_day("day").alias("month")).agg(F.count_distinct("day").alias("days_traded"))
    return rows.withColumn("share", r(F.col("days_traded") / F.size(dates.business_days(F.col("month"))), 8))


@query(f"""WITH {months_sql("l_suppkey")}, d AS (SELECT l_suppkey, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER (PARTITION BY l_suppkey ORDER BY month) AS gap FROM months)
SELECT l_suppkey, count(*) AS n_rows, max(gap)::INT AS largest_gap FROM d GROUP BY 1""")
def largest_gap(spark: SparkSession, sf: str) -> DataFrame:
    return signals.largest_gap(months(spark, sf, "l_suppkey"), "l_suppkey", "month")
