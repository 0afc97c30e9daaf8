"""Signals over an entity's months: adjacent returns, rolling statistics, leads and lags, regimes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import dates
from .guards import GuardError


def by_time(entity: str, date: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def last_rows(entity: str, date: str, n: int) -> WindowSpec:
    return by_time(entity, date).rowsBetween(-(n - 1), 0)


def follows(entity: str, date: str) -> Column:
    """Whether the entity's previous row is in the month right before."""
    return F.coalesce(dates.adjacent(F.lag(date).over(by_time(entity, date)), F.col(date)), F.lit(False))


def adjacent_return(panel: DataFrame, entity: str, date: str, price: str, out: str = "ret") -> DataFrame:
    """price / previous price - 1 where the previous row is of the month right before; else null."""
    before = F.lag(price).over(by_time(entity, date))
    return panel.withColumn(out, F.when(follows(entity, date) & (before != 0), F.try_divide(F.col(price), before) - 1))


def total_return(panel: DataFrame, entity: str, date: str, price: str, accrued: str, coupon: str, out: str = "ret") -> DataFrame:
    """((P + A + C) - (P + A before)) / (P + A before) between adjacent months with a positive denominator."""
    base = F.col(price) + F.col(accrued)
    before = F.lag(base).over(by_time(entity, date))
    return panel.withColumn(out, F.when(follows(entity, date) & (before > 0), (base + F.col(coupon) - before) / before))


def stale_mask(panel: DataFrame, entity: str, date: str, last_trade: str, days: int, price: str, returns: Sequence[str]) -> DataFrame:
    """Price and returns null where the last trade is more than ``days`` before the month's end, and returns null also
    in the next row if it is of the next month.  A missing last trade isn't stale."""
    stale = F.coalesce(F.datediff(date, last_trade) > days, F.lit(False))
    rows = panel.withColumn("__stale__", stale)
    after = F.coalesce(F.lag("__stale__").over(by_time(entity, date)), F.lit(False)) & follows(entity, date)
    rows = rows.withColumn("__after__", after)
    masked = {c: F.when(~(F.col("__stale__") | F.col("__after__")), F.col(c)) for c in returns}
    return rows.withColumns(masked | {price: F.when(~F.col("__stale__"), F.col(price))}).drop("__stale__", "__after__")


def lagged_panel(panel: DataFrame, entity: str, date: str, ret: str, score: str, lag: int) -> DataFrame:
    """next_ret, the return of the month after, and ranking_score, the score of ``lag`` months before; null where that
    month has no row.

    Frames over month numbers find exactly that month, gaps or not, so the panel is read and shuffled once; a join of
    the panel with itself would do both once more for each column.  (entity, date) has to be unique.
    """
    months = Window.partitionBy(entity).orderBy(dates.month_index(F.col(date)))
    return panel.withColumns({"next_ret": F.first(ret).over(months.rangeBetween(1, 1)), "ranking_score": F.first(score).over(months.rangeBetween(-lag, -lag)) if lag else F.col(score)})


def rolling_kth_lowest(panel: DataFrame, entity: str, date: str, ret: str, k: int = 2, rows: int = 36, least: int = 24, out: str = "kth") -> DataFrame:
    """Minus the k-th lowest value of the last ``rows`` rows, where they have ``least`` values."""
    w = last_rows(entity, date, rows)
    values = F.array_sort(F.collect_list(ret).over(w))
    return panel.withColumn(out, F.when(F.count(ret).over(w) >= least, -F.get(values, k - 1)))


def run_id(panel: DataFrame, entity: str, date: str, valid: Column, out: str) -> DataFrame:
    """A number for each run of valid rows in consecutive months; null where a row isn't valid."""
    w = by_time(entity, date)
    rows = panel.withColumn("__ok__", F.coalesce(valid, F.lit(False)))
    begins = rows.withColumn("__new__", F.when(F.col("__ok__") & ~(follows(entity, date) & F.coalesce(F.lag("__ok__").over(w), F.lit(False))), 1).otherwise(0))
    return begins.withColumn(out, F.when(F.col("__ok__"), F.sum("__new__").over(w))).drop("__ok__", "__new__")


def rolling_compound(panel: DataFrame, entity: str, date: str, ret: str, months: int = 6, out: str = "momentum") -> DataFrame:
    """The compound return of the last ``months`` consecutive months; null where one is missing or is -1 or less."""
    rows = run_id(panel, entity, date, F.col(ret) > -1, "__run__")
    w = Window.partitionBy(entity, "__run__").orderBy(date).rowsBetween(-(months - 1), 0)
    total = F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(w)
    return rows.withColumn(out, F.when(F.col("__run__").isNotNull() & (F.count(ret).over(w) == months), F.expm1(total))).drop("__run__")


def rolling_std(panel: DataFrame, entity: str, date: str, ret: str, rows: int = 24, least: int = 18, out: str = "vol") -> DataFrame:
    """The sample deviation of the last ``rows`` rows, gaps allowed, where they have ``least`` values."""
    w = last_rows(entity, date, rows)
    return panel.withColumn(out, F.when(F.count(ret).over(w) >= least, F.stddev_samp(ret).over(w)))


def shifted_inside(panel: DataFrame, entity: str, date: str, value: str, k: int, start: object, end: object, out: str) -> DataFrame:
    """The value k rows later (earlier if negative) for dates in [start, end], the own value elsewhere: a planted error."""
    w = by_time(entity, date)
    moved = F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)
    return panel.withColumn(out, F.when(F.col(date).between(F.lit(start), F.lit(end)), moved).otherwise(F.col(value)))


def largest_gap(panel: DataFrame, entity: str, date: str) -> DataFrame:
    """By entity: rows and the greatest number of months between two of them in a row."""
    gap = dates.month_index(F.col(date)) - dates.month_index(F.lag(date).over(by_time(entity, date)))
    return panel.withColumn("__gap__", gap).groupBy(entity).agg(F.count("*").alias("n_rows"), F.max("__gap__").alias("largest_gap"))


def return_parts(panel: DataFrame, entity: str, date: str, begin: str, end: str) -> DataFrame:
    """Returns over the month (end on begin), across its start (begin on the end before) and end to end, all null
    unless every one of them is there: a common sample."""
    before = F.lag(end).over(by_time(entity, date))
    ok = follows(entity, date) & (before > 0) & (F.col(begin) > 0) & F.col(end).isNotNull()
    parts = {"ret_within": F.try_divide(F.col(end), F.col(begin)) - 1, "ret_bridge": F.try_divide(F.col(begin), before) - 1, "ret_end": F.try_divide(F.col(end), before) - 1}
    return panel.withColumns({n: F.when(ok, c) for n, c in parts.items()})


def expanding_past_median(series: DataFrame, date: str, value: str, lag: int, least: int, out: str) -> DataFrame:
    """For each row the median of the values more than ``lag`` rows back; null with fewer than ``least``.  A series of
    one row a month."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1 - lag)
    return series.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w)))


def expanding_regime(series: DataFrame, date: str, value: str, lag: int, least: int, high: bool = True, out: str = "in_regime") -> DataFrame:
    """Whether the value ``lag`` rows back is above (below) the median of all such lagged values so far, its own
    included; false before there are ``least``."""
    w = Window.orderBy(date)
    rows = series.withColumn("__lagged__", F.lag(value, lag).over(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    middle = F.when(F.count("__lagged__").over(so_far) >= least, F.percentile("__lagged__", 0.5).over(so_far))
    side = F.col("__lagged__") > middle if high else F.col("__lagged__") < middle
    return rows.withColumn(out, F.coalesce(side, F.lit(False))).drop("__lagged__")


def in_months(panel: DataFrame, months: DataFrame, date: str) -> DataFrame:
    """Rows of the panel in the months of another table."""
    return panel.join(months.select(date).distinct(), date, "left_semi")


def turnover(weights: DataFrame, entity: str, date: str, weight: str, start_at_zero: bool = True) -> DataFrame:
    """By date: the sum of absolute changes of the weights, a missing weight being zero; the first date's change is
    from zero, or nothing."""
    order = weights.select(date).distinct().withColumn("__n__", F.row_number().over(Window.orderBy(date)))
    rows = weights.join(order, date)
    after = rows.select(entity, (F.col("__n__") + 1).alias("__n__"), F.col(weight).alias("__before__"))
    both = rows.select(entity, "__n__", F.col(weight).alias("__now__")).join(after, [entity, "__n__"], "full")
    moved = both.groupBy("__n__").agg(F.sum(F.abs(F.coalesce("__now__", F.lit(0.0)) - F.coalesce("__before__", F.lit(0.0)))).alias("turnover"))
    out = order.join(moved, "__n__").select(date, F.when((F.col("__n__") > 1) | F.lit(start_at_zero), F.col("turnover")).otherwise(0.0).alias("turnover"))
    return out


def recompute(view: DataFrame, entity: str, date: str, ret: str = "ret", excess: str = "xret") -> DataFrame:
    """``view`` with var_5pct, bond_vol and mom6 made anew from its own returns, whatever choices those went through;
    other columns stay, signals of daily origin among them.  One partitioning serves all three."""
    out = view.drop("var_5pct", "bond_vol", "mom6")
    out = rolling_kth_lowest(out, entity, date, ret, out="var_5pct")
    return rolling_compound(rolling_std(out, entity, date, excess, out="bond_vol"), entity, date, ret, 6, out="mom6")


def ewma(rows: DataFrame, entity: str, date: str, value: str, keep: float, out: str) -> DataFrame:
    """s = keep * s before + (1 - keep) * value, from the first value, for 0 < keep < 1; a null value changes nothing.

    In blocks of rows short enough for keep ** -row to stay a number, s is keep ** row times a running sum, so windows
    give it in one pass over each entity.  Of earlier blocks only the last one weighs anything in double precision: what
    is before that has a weight under 1e-100."""
    if not 0 < keep < 1:
        raise GuardError("keep has to be between 0 and 1")
    block = max(2, int(230 / -math.log(keep)))  # keep ** block is about 1e-100
    order = by_time(entity, date)
    some = F.col(value).isNotNull()
    n = F.sum(some.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1  # the value's place, or the last one's
    marked = rows.withColumn("__n__", n).withColumns({"__b__": F.floor(F.greatest(F.col("__n__"), F.lit(0)) / block), "__j__": F.greatest(F.col("__n__"), F.lit(0)) % block})
    weight = F.when(F.col("__n__") == 0, 1.0).otherwise(1.0 - keep)
    term = F.when(some, weight * F.col(value).cast("double") * F.pow(F.lit(1 / keep), F.col("__j__")))
    inside = Window.partitionBy(entity, "__b__").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__s__", F.sum(term).over(inside) * F.pow(F.lit(keep), F.col("__j__")))
    previous = Window.partitionBy(entity).orderBy("__b__").rangeBetween(-1, -1)
    carried = F.last("__s__", ignorenulls=True).over(Window.partitionBy(entity, "__b__").orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = marked.withColumn("__end__", carried).withColumn("__end__", F.coalesce(F.max("__end__").over(previous), F.lit(0.0)))
    return marked.withColumn(out, F.col("__s__") + F.col("__end__") * F.pow(F.lit(keep), F.col("__j__") + 1)).drop("__n__", "__b__", "__j__", "__s__", "__end__")


def next_month_feed(panel: DataFrame, entity: str, date: str, ret: str, vol: str, features: Sequence[str], floor: float, least: int) -> DataFrame:
    """Rows for a factor model: the next month's return over the floored volatility, complete cases only, in months
    with more than ``least`` of them."""
    w = by_time(entity, date)
    after = F.when(dates.adjacent(F.col(date), F.lead(date).over(w)), F.lead(ret).over(w))
    rows = panel.withColumn("vol_scaler", F.greatest(F.col(vol), F.lit(floor))).withColumn("target", after / F.col("vol_scaler"))
    rows = rows.dropna(subset=["target", *features])
    return rows.withColumn("__n__", F.count("*").over(Window.partitionBy(date))).filter(F.col("__n__") > least).drop("__n__")
