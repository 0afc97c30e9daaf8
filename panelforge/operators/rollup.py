"""Aggregations from trades to days to months, market factors, moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .percentiles import percentiles


def daily_vwap(trades: DataFrame, entity: str, day: str, price: str, volume: str, min_volume: float | None = None, strict: bool = False) -> DataFrame:
    """(entity, day): volume-weighted price, volume, trades, least and greatest price.

    ``strict`` keeps only rows with a price and a positive volume.  An all-null sum is null.
    """
    rows = trades.filter(F.col(volume) >= min_volume) if min_volume is not None else trades
    rows = rows.filter(F.col(price).isNotNull() & (F.col(volume) > 0)) if strict else rows
    return rows.groupBy(entity, day).agg(
        F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("vwap"),
        F.sum(volume).alias("volume"),
        F.count("*").alias("n_trades"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
    )


def monthly(daily: DataFrame, entity: str, day: str) -> DataFrame:
    """(entity, month end): price over all days of the month by volume, sums, and the last day with a trade."""
    return daily.groupBy(entity, F.last_day(day).alias("month")).agg(
        F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("price"),
        F.sum("volume").alias("volume"),
        F.sum("n_trades").alias("n_trades"),
        F.max(day).alias("last_day"),
    )


def month_last_price(daily: DataFrame, entity: str, day: str) -> DataFrame:
    """(entity, month end): the price of the month's last day with a trade."""
    return daily.groupBy(entity, F.last_day(day).alias("month")).agg(F.max_by("vwap", day).alias("price"), F.max(day).alias("last_day"))


def month_window_prices(daily: DataFrame, entity: str, day: str, days: int = 5) -> DataFrame:
    """(entity, month end): volume-weighted prices of the month's first and last business days, ``days`` of each or as
    many as it has; null without volume there.  Cut dates come from one row a month."""
    months = daily.select(F.last_day(day).alias("month")).distinct()
    cuts = months.select("month", dates.nth_business_day(F.col("month"), days).alias("begin_cut"), dates.nth_business_day(F.col("month"), -days).alias("end_cut"))
    rows = daily.withColumn("month", F.last_day(day)).join(cuts, "month")

    def side(inside: Column) -> Column:
        total = F.sum(F.when(inside, F.col("volume")))
        return F.when(total > 0, F.try_divide(F.sum(F.when(inside, F.col("vwap") * F.col("volume"))), total))

    begin, end = F.col(day) <= F.col("begin_cut"), F.col(day) >= F.col("end_cut")
    rows = rows.filter(begin | end)
    return rows.groupBy(entity, "month").agg(side(begin).alias("price_begin"), side(end).alias("price_end"))


def weighted_mean_by(rows: DataFrame, date: str, value: str, weight: str, eligible: Column | None = None) -> DataFrame:
    """By date: the weighted mean of finite values with positive weights, and how many there are."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (F.col(weight) > 0)
    rows = rows.filter(ok if eligible is None else ok & F.coalesce(eligible, F.lit(False)))
    return rows.groupBy(date).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("ret"), F.count("*").alias("n"))


def serial_covariance(daily: DataFrame, entity: str, day: str, price: str, max_gap: int = 7, min_pairs: int = 5, sign: float = -1.0) -> DataFrame:
    """(entity, month end): the sample covariance of consecutive log price changes within the month, times ``sign``.

    A change counts if its days are at most ``max_gap`` business days apart; a pair is two changes in a row.  Null
    below ``min_pairs`` pairs; days traded and the month's business days come along.
    """
    rows = daily.withColumn("month", F.last_day(day)).withColumn("__log__", F.when(F.col(price) > 0, F.log(price)))
    w = Window.partitionBy(entity, "month").orderBy(day)
    change = F.when(dates.business_gap(F.lag(day).over(w), F.col(day)) <= max_gap, F.col("__log__") - F.lag("__log__").over(w))
    rows = rows.withColumn("__x__", change)
    rows = rows.withColumn("__y__", F.lead("__x__").over(w))
    both = F.col("__x__").isNotNull() & F.col("__y__").isNotNull()
    out = rows.groupBy(entity, "month").agg(
        F.count_if(both).alias("n_pairs"),
        F.covar_samp(F.when(both, F.col("__x__")), F.when(both, F.col("__y__"))).alias("__c__"),
        F.count_distinct(day).alias("days_traded"),
    )
    out = out.withColumn("gamma", F.when(F.col("n_pairs") >= min_pairs, sign * F.col("__c__"))).drop("__c__")
    return out.withColumn("business_days", F.size(dates.business_days(F.col("month"))))


def gram_moments(rows: DataFrame, date: str, features: Sequence[str], target: str) -> DataFrame:
    """By date: every mean product of two features and of a feature with the target, long: (date, i, j, value, n);
    j = -1 is the target.  Rows with a null in any of them are left out."""
    complete = rows.dropna(subset=[*features, target])
    names = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(features[i]) * F.col(features[j])).alias("v")) for i, j in names]
    pairs += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), (F.col(f) * F.col(target)).alias("v")) for i, f in enumerate(features)]
    sums = complete.groupBy(date).agg(F.count("*").alias("n"), *[F.avg(p["v"]).alias(f"m{k}") for k, p in enumerate(pairs)])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{k}").alias("value")) for k, (i, j) in enumerate([*names, *[(i, -1) for i in range(len(features))]])]
    return sums.select(date, "n", F.inline(F.array(*cells)))


def difference_profile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, moved: float = 1e-4) -> DataFrame:
    """Over shared keys: rows, share whose values differ by ``moved`` or more, mean, 99th percentile and greatest
    absolute difference."""
    both = left.select(*keys, F.col(value).alias("__a__")).join(right.select(*keys, F.col(value).alias("__b__")), list(keys))
    d = F.abs(F.col("__a__") - F.col("__b__"))
    return both.agg(F.count(d).alias("n"), F.avg((d >= moved).cast("double")).alias("share_moved"), F.avg(d).alias("mean_abs"), F.percentile(d, 0.99).alias("p99_abs"), F.max(d).alias("max_abs"))


def month_of_daily(rows: DataFrame, day: str, value: str, how: str = "mean") -> DataFrame:
    """A daily series by yyyy-MM: its mean or its last value."""
    found = rows.filter(F.col(value).isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("year_month"))
    return found.agg((F.avg(value) if how == "mean" else F.max_by(value, day)).alias(value))


def spread(a: DataFrame, b: DataFrame, on: str, value: str, until: str | None = None) -> DataFrame:
    """a - b on shared months, up to ``until``."""
    both = a.select(on, F.col(value).alias("__a__")).join(b.select(on, F.col(value).alias("__b__")), on)
    both = both.select(on, (F.col("__a__") - F.col("__b__")).alias("spread")).filter("spread is not null")
    return both.filter(F.col(on) <= until) if until is not None else both


def variant_impact(base: DataFrame, variant: DataFrame, entity: str, date: str, ret: str, share_of: float = 0.1, moved: float = 1e-4) -> DataFrame:
    """What another cleaning does to monthly returns: rows, affected rows, share moved by ``moved`` or more, greatest
    move, and how much likelier affected rows are to be in an extreme decile of two sorts on past returns.

    A row that the variant doesn't have is affected.  Deciles are exact and over the whole base.
    """
    w = Window.partitionBy(entity).orderBy(date)
    rows = base.filter(F.col(ret).isNotNull()).select(entity, date, F.col(ret).alias("__r__")).withColumn("__one__", F.lag("__r__").over(w))
    six = w.rowsBetween(-5, 0)
    rows = rows.withColumn("__six__", F.when(F.count("__one__").over(six) == 6, F.sum(F.log1p("__one__")).over(six)))
    sorts = ("__one__", "__six__")
    cuts = percentiles(rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("sort"), F.col(c).alias("past")) for c in sorts]))), "past", (share_of, 1 - share_of), "sort")
    far = lambda c: F.coalesce((F.col(c) <= cuts[c][0]) | (F.col(c) >= cuts[c][1]), F.lit(False)) if c in cuts else F.lit(False)
    rows = rows.withColumn("__far__", (far("__one__") | far("__six__")).cast("double"))
    both = rows.join(variant.select(entity, date, F.col(ret).alias("__v__")), [entity, date], "left")
    d = F.abs(F.col("__v__") - F.col("__r__"))
    hit = F.col("__v__").isNull() | (d > 0)
    out = both.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_affected"), (F.count_if(d >= moved) / F.count("*")).alias("share_moved"), F.max(d).alias("max_move"), F.avg(F.when(hit, F.col("__far__"))).alias("a"), F.avg(F.when(~hit, F.col("__far__"))).alias("b"))
    return out.select("n", "n_affected", "share_moved", "max_move", F.when(F.col("b") > 0, F.coalesce("a", F.lit(0.0)) / F.col("b")).alias("lift"))
