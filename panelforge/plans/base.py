"""The driver tables as trades, panels and series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup, signals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Line items as trades: a part (or supplier) at a unit price, with a quantity as volume."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), *more)


def daily(spark: SparkSession, sf_dir: str, entity: str, least: float | None = None) -> DataFrame:
    return rollup.daily_vwap(trades(spark, sf_dir), entity, "day", "price", "qty", least)


def months(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """(entity, month, price, volume, n_trades, last_day, ret).  Days are dealt by entity, so that months and all that
    looks along an entity's months need no other shuffle."""
    rows = rollup.monthly(daily(spark, sf_dir, entity).repartition(entity), entity, "day").withColumn("price", r(F.col("price")))
    return signals.adjacent_return(rows, entity, "month", "price")


def sort_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, date, ret, size, price) by part and month."""
    return months(spark, sf_dir, "l_partkey").select(F.col("l_partkey").alias("entity"), F.col("month").alias("date"), "ret", F.col("volume").alias("size"), "price")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, name, value): monthly returns of the value-weighted and of the equal-weighted mean over suppliers."""
    panel = months(spark, sf_dir, "l_suppkey").filter("ret is not null")
    by = panel.groupBy(F.col("month").alias("date")).agg((F.sum(F.col("volume") * F.col("ret")) / F.sum("volume")).alias("vw"), F.avg("ret").alias("ew"))
    return by.select("date", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), r(F.col(n), 8).alias("value")) for n in ("vw", "ew")])))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(F.col(c), digits) for c in columns})


def r(value: Column, digits: int = 6) -> Column:
    """Rounded so that two engines agree: the boundary lies off the exact halves at which unit prices often are, so a
    sum's order doesn't decide.  ``stable`` makes the same of round() in SQL."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5001) / scale


def stable(sql: str) -> str:
    """SQL in which each round(x, n) is the rounding of ``r``."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, commas, end = 0, [], k + 5
        while True:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                commas.append(end)
            if depth == 0:
                break
            end += 1
        digits = int(sql[commas[-1] + 1 : end])
        out += [sql[at:k], f"(floor(({stable(sql[k + 6 : commas[-1]])}) * 1e{digits} + 0.5001) / 1e{digits})"]
        at = end + 1
    return "".join([*out, sql[at:]])


TRADES = """trades AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS day, l_extendedprice / l_quantity AS price, l_quantity AS qty,
         l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem)"""


def daily_sql(entity: str, where: str = "true") -> str:
    return f"""{TRADES},
daily AS (
  SELECT {entity}, day, sum(price * qty) / nullif(sum(qty), 0) AS vwap, sum(qty) AS volume, count(*) AS n_trades, min(price) AS min_price, max(price) AS max_price
  FROM trades WHERE {where} GROUP BY ALL)"""


def months_sql(entity: str) -> str:
    return f"""{daily_sql(entity)},
raw_months AS (
  SELECT {entity}, last_day(day) AS month, round(sum(vwap * volume) / nullif(sum(volume), 0), 6) AS price, sum(volume) AS volume, sum(n_trades)::BIGINT AS n_trades, max(day) AS last_day
  FROM daily GROUP BY ALL),
months AS (
  SELECT *, CASE WHEN lag(month) OVER w = last_day(month - INTERVAL 1 MONTH) AND lag(price) OVER w <> 0 THEN price / lag(price) OVER w - 1 END AS ret
  FROM raw_months WINDOW w AS (PARTITION BY {entity} ORDER BY month))"""


PANEL = months_sql("l_partkey") + """,
panel AS (SELECT l_partkey AS entity, month AS date, ret, volume AS size, price FROM months)"""

SERIES = months_sql("l_suppkey") + """,
means AS (SELECT month AS date, sum(volume * ret) / sum(volume) AS vw, avg(ret) AS ew FROM months WHERE ret IS NOT NULL GROUP BY 1),
series AS (SELECT date, 'vw' AS name, round(vw, 8) AS value FROM means UNION ALL SELECT date, 'ew', round(ew, 8) FROM means)"""
