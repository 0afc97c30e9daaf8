"""Queries: characteristic sorts, overlapping holds, composites, grids of choices and what results owe to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards, lattice, screens, sorts, views
from .base import PANEL, TRADES, months, months_sql, rounded, sort_panel, stable, table, trades

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = stable(sql)
        return function

    return add


def lagged_sql(score: str = "price", lag: int = 0) -> str:
    join = f"JOIN panel s ON s.entity = p.entity AND s.date = last_day(p.date - INTERVAL {lag} MONTH)" if lag else ""
    column = f"s.{score}" if lag else f"p.{score}"
    return f"""{PANEL},
lagged AS (SELECT p.entity, p.date, p.size, p.price, {column} AS score, n.ret AS next_ret FROM panel p JOIN panel n ON n.entity = p.entity AND n.date = last_day(p.date + INTERVAL 1 MONTH) {join}
  WHERE p.size IS NOT NULL AND n.ret IS NOT NULL AND {column} IS NOT NULL),
eligible AS (SELECT * FROM lagged QUALIFY count(*) OVER (PARTITION BY date) >= 10)"""


def group_sql(column: str, groups: int) -> str:
    return f"floor((row_number() OVER (PARTITION BY date ORDER BY {column}, entity) - 1) * {groups} / count(*) OVER (PARTITION BY date))::INT"


def legs_sql(source: str, weight: str | None, keys: str = "date, c", long: int = 4, short: int = 0) -> str:
    leg = (lambda g: f"avg(next_ret) FILTER (g = {g})") if weight is None else (lambda g: f"sum({weight} * next_ret) FILTER (g = {g}) / nullif(greatest(sum({weight}) FILTER (g = {g}), 0), 0)")
    return f"SELECT {keys}, {leg(long)} AS l, {leg(short)} AS s, count(*) AS n FROM {source} WHERE g IN ({long}, {short}) GROUP BY ALL"


MONTHLY = """SELECT last_day(date + INTERVAL 1 MONTH) AS date, round(avg(l - s), 8) AS strategy_ret, round(avg(l), 8) AS long_ret, round(avg(s), 8) AS short_ret, sum(n)::BIGINT AS n_rows, count(*) AS n_stripes FROM legs WHERE l IS NOT NULL AND s IS NOT NULL GROUP BY 1"""


def shown(out: DataFrame) -> DataFrame:
    return rounded(out, "strategy_ret", "long_ret", "short_ret", digits=8)


@query(f"""WITH {lagged_sql()}, g AS (SELECT *, 0 AS c, {group_sql("score", 5)} AS g FROM eligible), legs AS ({legs_sql("g", "size")}) {MONTHLY}""")
def single_sort_ls(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sorts.characteristic_sort(sort_panel(spark, sf), sorts.Rulebook(score="price", min_rows=10)))


@query(f"""WITH {lagged_sql("price", 1)}, g AS (SELECT *, 0 AS c, {group_sql("score", 3)} AS g FROM eligible), legs AS ({legs_sql("g", None, long=2)}) {MONTHLY}""")
def lagged_sort_ls(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sorts.characteristic_sort(sort_panel(spark, sf), sorts.Rulebook(score="price", lag=1, groups=3, by_size=False, min_rows=10)))


@query(f"""WITH {lagged_sql()}, g AS (SELECT *, {group_sql("size", 3)} AS c, {group_sql("score", 5)} AS g FROM eligible), legs AS ({legs_sql("g", None)}) {MONTHLY}""")
def double_sort_ls(spark: SparkSession, sf: str) -> DataFrame:
    panel = sort_panel(spark, sf).withColumn("volume", F.col("size"))
    return shown(sorts.characteristic_sort(panel, sorts.Rulebook(score="price", control="volume", control_groups=3, by_size=False, min_rows=10)))


@query(f"""WITH {lagged_sql()}, b AS (SELECT quantile_cont(next_ret, 0.05) AS lo, quantile_cont(next_ret, 0.95) AS hi FROM lagged),
t AS (SELECT e.* FROM eligible e, b WHERE next_ret BETWEEN lo AND hi), t2 AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY date) >= 10),
g AS (SELECT *, 0 AS c, {group_sql("score", 5)} AS g FROM t2), legs AS ({legs_sql("g", "size")}) {MONTHLY}""")
def trimmed_sort_ls(spark: SparkSession, sf: str) -> DataFrame:
    book = sorts.Rulebook(score="price", min_rows=10, trim="truncate", trim_low=0.05, trim_high=0.95, trim_percentile=True)
    return shown(sorts.characteristic_sort(sort_panel(spark, sf), book))


@query(f"""WITH {lagged_sql()}, g AS (SELECT *, {group_sql("score", 5)} AS g FROM eligible)
SELECT date AS formation, entity, CASE g WHEN 4 THEN 'long' ELSE 'short' END AS leg, size AS weight FROM g WHERE g IN (0, 4)""")
def sort_selections(spark: SparkSession, sf: str) -> DataFrame:
    return sorts.selections(sort_panel(spark, sf), sorts.Rulebook(score="price", min_rows=10))


@query(f"""WITH {lagged_sql()}, sel AS (SELECT date AS formation, entity, size, {group_sql("score", 5)} AS g FROM eligible),
held AS (SELECT formation, last_day(formation + to_months(h::INT)) AS m, sel.entity, sel.size, sel.g, panel.ret AS next_ret FROM sel, generate_series(1, 6) x(h), panel WHERE g IN (0, 4) AND panel.entity = sel.entity AND panel.date = last_day(formation + to_months(h::INT)) AND panel.ret IS NOT NULL),
legs AS ({legs_sql("held", "size", "formation, m")})
SELECT m AS date, round(avg(l) - avg(s), 8) AS strategy_ret, round(avg(l), 8) AS long_ret, round(avg(s), 8) AS short_ret, sum(n)::BIGINT AS n_rows, count(*) AS n_cohorts FROM legs WHERE l IS NOT NULL AND s IS NOT NULL GROUP BY 1""")
def overlap_hold_ls(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sorts.overlapping_sort(sort_panel(spark, sf), sorts.Rulebook(score="price", min_rows=10), 6))


@query(f"""WITH {lagged_sql()}, a AS (SELECT *, 0 AS c, {group_sql("price", 5)} AS g FROM eligible), b AS (SELECT *, 0 AS c, {group_sql("size", 5)} AS g FROM eligible),
la AS ({legs_sql("a", None)}), lb AS ({legs_sql("b", None)}),
legs AS (SELECT date, l - s AS v FROM la WHERE l IS NOT NULL AND s IS NOT NULL UNION ALL SELECT date, l - s FROM lb WHERE l IS NOT NULL AND s IS NOT NULL AND month(date) <> 6)
SELECT last_day(date + INTERVAL 1 MONTH) AS date, round(avg(v), 8) AS strategy_ret, count(*) AS n_parts FROM legs GROUP BY 1""")
def composite_factor(spark: SparkSession, sf: str) -> DataFrame:
    panel = sort_panel(spark, sf).withColumn("volume", F.col("size"))
    one = sorts.characteristic_sort(panel, sorts.Rulebook(score="price", by_size=False, min_rows=10))
    two = sorts.characteristic_sort(panel, sorts.Rulebook(score="volume", by_size=False, min_rows=10)).filter(F.month("date") != 7)
    return rounded(sorts.composite([one, two], "date", "strategy_ret", complete=False), "strategy_ret", digits=8)


def choices(least: float = 10) -> list[Column]:
    return [F.col("qty") >= least, F.col("price") <= 1800, F.col("l_discount") > 0.02]


_BOOK_COLUMNS = "f.l_partkey AS entity, f.month AS date, f.ret, f.volume AS size, round(f.price, 6) AS var_5pct, f.n_trades::DOUBLE AS gamma, -f.ret AS rev, f.volume / f.n_trades AS rating, f.ret AS xret"


def factor_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, date, ret, size) and the columns that the named factors sort on, from parts' months."""
    rows = months(spark, sf, "l_partkey")
    return rows.select(F.col("l_partkey").alias("entity"), F.col("month").alias("date"), "ret", F.col("volume").alias("size"), F.col("price").alias("var_5pct"), F.col("n_trades").cast("double").alias("gamma"), (-F.col("ret")).alias("rev"), (F.col("volume") / F.col("n_trades")).alias("rating"), F.col("ret").alias("xret"))


def factor_sql(name: str) -> str:
    score, control, long, short = {"drf": ("var_5pct", "rating", 4, 0), "lrf": ("gamma", "rating", 4, 0), "rev": ("rev", "rating", 0, 4), "crf_var": ("rating", "var_5pct", 4, 0), "crf_illiq": ("rating", "gamma", 4, 0), "crf_rev": ("rating", "xret", 4, 0)}[name]
    return f"""{name}_e AS (SELECT p.*, n.ret AS next_ret FROM fp p JOIN fp n ON n.entity = p.entity AND n.date = last_day(p.date + INTERVAL 1 MONTH)
  WHERE p.size IS NOT NULL AND n.ret IS NOT NULL AND p.{score} IS NOT NULL AND p.{control} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY p.date) >= 5),
{name}_g AS (SELECT *, {group_sql(control, 5)} AS c, {group_sql(score, 5)} AS g FROM {name}_e),
{name}_l AS ({legs_sql(f"{name}_g", "size", long=long, short=short)}),
{name} AS (SELECT '{name}' AS factor, last_day(date + INTERVAL 1 MONTH) AS date, avg(l - s) AS v FROM {name}_l WHERE l IS NOT NULL AND s IS NOT NULL GROUP BY 2)"""


_FACTORS_SQL = f"WITH {months_sql('l_partkey')}, fp AS (SELECT {_BOOK_COLUMNS} FROM months f), " + ", ".join(map(factor_sql, ("drf", "lrf", "rev", "crf_var", "crf_illiq", "crf_rev")))


@query(_FACTORS_SQL + " SELECT factor, date, round(v, 8) AS strategy_ret FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in ("drf", "lrf", "rev", "crf_var", "crf_illiq", "crf_rev")) + ")")
def named_factors(spark: SparkSession, sf: str) -> DataFrame:
    """All six named sorts by month."""
    panel, out = factor_panel(spark, sf), None
    for name in sorts.FACTORS:
        one = sorts.characteristic_sort(panel, sorts.factor_book(name)).select(F.lit(name).alias("factor"), "date", "strategy_ret")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "strategy_ret", digits=8)


@query(_FACTORS_SQL + " SELECT date, round(avg(v), 8) AS strategy_ret, count(*) AS n_parts FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in ("crf_var", "crf_illiq", "crf_rev")) + ") GROUP BY 1 HAVING count(*) = 3")
def credit_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sorts.credit_factor(factor_panel(spark, sf)), "strategy_ret", digits=8)


CELLS = f"""{TRADES}, cells AS (
  SELECT m.mask::INT AS mask, sum(price * qty) / sum(qty) AS value, count(*) AS n FROM trades, generate_series(0, 7) m(mask)
  WHERE (m.mask & 1 = 0 OR qty >= 10) AND (m.mask & 2 = 0 OR price <= 1800) AND (m.mask & 4 = 0 OR l_discount > 0.02) GROUP BY 1)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = lattice.cells(trades(spark, sf, "l_discount"), choices(), [], {"pv": F.sum(F.col("price") * F.col("qty")), "v": F.sum("qty"), "n": F.count("*")})
    return rows.select("mask", (F.col("pv") / F.col("v")).alias("value"), "n")


@query(f"WITH {CELLS} SELECT mask, round(value, 6) AS value, n FROM cells")
def lattice_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cells(spark, sf), "value")


@query(f"""WITH {CELLS} SELECT b.bit::INT AS bit, a.mask AS base, round(c.value - a.value, 6) AS marginal FROM cells a, generate_series(0, 2) b(bit), cells c WHERE a.mask & (1 << b.bit) = 0 AND c.mask = a.mask | (1 << b.bit)""")
def lattice_marginals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lattice.marginals(cells(spark, sf), 3), "marginal")


DIVIDENDS = f"{CELLS}, h AS (SELECT u.mask, sum((CASE WHEN bit_count(xor(u.mask, t.mask)) % 2 = 0 THEN 1 ELSE -1 END) * t.value) AS d FROM cells u, cells t WHERE t.mask & ~u.mask = 0 GROUP BY 1)"


@query(f"WITH {DIVIDENDS} SELECT mask, round(d, 6) AS dividend FROM h")
def lattice_dividends(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lattice.dividends(cells(spark, sf)), "dividend")


WALSH = f"{CELLS}, w AS (SELECT t.mask, avg((CASE WHEN bit_count(t.mask & ~s.mask) % 2 = 0 THEN 1 ELSE -1 END) * s.value) AS g FROM cells t, cells s GROUP BY 1)"


@query(f"WITH {WALSH} SELECT mask, round(g, 6) AS coefficient, round(2 * g, 6) AS effect FROM w")
def lattice_walsh(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lattice.walsh(cells(spark, sf)), "coefficient", "effect")


@query(f"WITH {DIVIDENDS} SELECT b.bit::INT AS bit, round(sum(d / bit_count(mask)), 6) AS share FROM h, generate_series(0, 2) b(bit) WHERE mask & (1 << b.bit) <> 0 GROUP BY 1")
def lattice_shapley(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lattice.shapley(cells(spark, sf), 3), "share")


@query(f"""WITH {DIVIDENDS} SELECT round(sum(d) FILTER (mask & 4 = 0), 6) AS first, round(sum(d) FILTER (mask = 4), 6) AS second, round(sum(d) FILTER (mask & 4 <> 0 AND mask <> 4), 6) AS both, round(sum(d), 6) AS gap FROM h WHERE mask > 0""")
def lattice_partition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lattice.partition_gap(cells(spark, sf), 4), "first", "second", "both", "gap")


@query(f"""WITH {WALSH} SELECT round(sum(CASE WHEN bit_count(mask) >= 3 THEN 4 * g * g ELSE 0 END) / sum(CASE WHEN bit_count(mask) >= 1 THEN 4 * g * g END), 8) AS compression FROM w""")
def lattice_compression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lattice.compression(lattice.walsh(cells(spark, sf))), "compression", digits=8)


CELL_MONTHS = f"""{TRADES}, months AS (SELECT DISTINCT m.mask::INT AS mask, last_day(day) AS date FROM trades, generate_series(0, 7) m(mask)
  WHERE (m.mask & 1 = 0 OR qty >= 45) AND (m.mask & 2 = 0 OR price <= 1800) AND (m.mask & 4 = 0 OR l_discount > 0.02))"""


def cell_months(spark: SparkSession, sf: str) -> DataFrame:
    rows = trades(spark, sf, "l_discount").withColumn("date", F.last_day("day"))
    return lattice.cells(rows, choices(45), ["date"], {"n": F.count("*")}).select("mask", "date")


@query(f"""WITH {CELL_MONTHS}, c AS (SELECT date FROM months GROUP BY 1 HAVING count(*) = 8)
SELECT (SELECT count(*) FROM c) AS n_common, (SELECT count(*) FROM months WHERE mask = 7) AS n_reference, (SELECT count(*) FROM c) >= 60 AND (SELECT count(*) FROM c) >= 0.5 * (SELECT count(*) FROM months WHERE mask = 7) AS passes""")
def common_support(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.support(cell_months(spark, sf), "date", 3)


@query(f"WITH {CELL_MONTHS} SELECT date FROM months GROUP BY 1 HAVING count(DISTINCT mask) = 8")
def common_months(spark: SparkSession, sf: str) -> DataFrame:
    return views.common_months(cell_months(spark, sf), "mask", "date")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 4 AS base FROM orders), v AS (SELECT base, count(*) FILTER (o_orderkey % 5 = 0 AND base >= 2) AS differ FROM r GROUP BY 1) SELECT base::INT AS base, differ = 0 AS same FROM v""")
def noop_invariance(spark: SparkSession, sf: str) -> DataFrame:
    """Switching on a choice that changes nothing in cells 0 and 1, and drops rows in cells 2 and 3."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("mask"))
    with_ = rows.filter(~((F.col("o_orderkey") % 5 == 0) & (F.col("mask") >= 2))).withColumn("mask", (F.col("mask") + 4).cast("int"))
    every = rows.unionByName(with_)
    return lattice.invariance(every, 2, guards.row_set_hash(every.select("o_orderkey")))


@query(f"""WITH {PANEL}, rho AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS rho), x AS (SELECT entity, date, ret, entity % 6 = 0 AND month(date) = 6 AS terminal FROM panel)
SELECT rho, round(avg(CASE WHEN terminal AND ret IS NULL THEN rho - 1 ELSE ret END), 8) AS value FROM x, rho GROUP BY 1""")
def recovery_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The mean return at every assumed recovery of rows that end without one."""
    panel = sort_panel(spark, sf).withColumn("terminal", (F.col("entity") % 6 == 0) & (F.month("date") == 6))
    grid = spark.createDataFrame([(k / 4,) for k in range(5)], "rho double")
    value = F.avg(screens.terminal_value(F.col("ret"), F.col("terminal"), F.col("rho") - 1))
    return rounded(lattice.sweep(panel, grid, value), "value", digits=8)
