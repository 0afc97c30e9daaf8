"""Characteristic sorts: quantile groups by month, long-short legs, double sorts, overlapping holds, composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .guards import GuardError
from .ranks import quantile_group
from .screens import clip, percentile_bounds
from .signals import lagged_panel


@dataclass(frozen=True)
class Rulebook:
    """How a portfolio is formed.  Groups are numbered from 0, the lowest scores first; by default the highest is bought
    and the lowest sold, weighted by size, in months with a row a group at least, and the control has as many groups."""

    score: str
    entity: str = "entity"
    date: str = "date"
    ret: str = "ret"
    size: str = "size"
    lag: int = 0
    groups: int = 5
    long_group: int | None = None
    short_group: int = 0
    by_size: bool = True
    min_rows: int | None = None
    control: str | None = None
    control_groups: int | None = None
    trim: str = "none"  # none, truncate or winsorise
    trim_low: float | None = None
    trim_high: float | None = None
    trim_percentile: bool = False

    def __post_init__(self) -> None:
        for name, default in (("long_group", self.groups - 1), ("min_rows", self.groups), ("control_groups", self.groups)):
            if getattr(self, name) is None:
                object.__setattr__(self, name, default)
        if not (0 <= self.long_group < self.groups and 0 <= self.short_group < self.groups) or self.long_group == self.short_group:
            raise GuardError("the legs have to be two of the groups")
        if self.lag < 0 or self.groups < 2 or self.control_groups < (2 if self.control else 1) or self.min_rows < 1:
            raise GuardError("lag, groups and min_rows can't be that small")
        if self.trim not in ("none", "truncate", "winsorise"):
            raise GuardError(f"unknown trim {self.trim!r}")


def _eligible(book: Rulebook) -> Column:
    ok = F.col("ranking_score").isNotNull() & F.col(book.size).isNotNull() & F.col("next_ret").isNotNull()
    return ok & F.col(book.control).isNotNull() if book.control else ok


def resolve_trim(rows: DataFrame, book: Rulebook) -> Rulebook:
    """Percentile levels as absolute bounds, once, over all eligible next returns."""
    if book.trim == "none" or not book.trim_percentile:
        return book
    low, high = percentile_bounds(rows.filter(_eligible(book)), "next_ret", book.trim_low, book.trim_high)
    return replace(book, trim_low=low, trim_high=high, trim_percentile=False, trim="none" if low is None and high is None else book.trim)


def _trimmed(value: Column, book: Rulebook) -> Column:
    if book.trim == "none":
        return value
    if book.trim == "winsorise":
        return clip(value, book.trim_low, book.trim_high)
    inside = value.isNotNull()
    inside = inside & (value >= book.trim_low) if book.trim_low is not None else inside
    return F.when(inside & (value <= book.trim_high) if book.trim_high is not None else inside, value)


def grouped(panel: DataFrame, book: Rulebook) -> DataFrame:
    """Eligible rows with ranking_score, next_ret, score_group and control_group, in months with enough of them, both
    before and after the trim.  Groups are independent: each axis is cut over the whole month."""
    rows = lagged_panel(panel, book.entity, book.date, book.ret, book.score, book.lag)
    book = resolve_trim(rows, book)
    month = Window.partitionBy(book.date)
    rows = rows.filter(_eligible(book)).withColumn("__t__", _trimmed(F.col("next_ret"), book))
    # Whole months stay or go, so both counts come from one pass, which keeps a month's rows once.
    rows = rows.withColumns({"__n__": F.count("*").over(month), "__left__": F.count("__t__").over(month)})
    rows = rows.filter((F.col("__n__") >= book.min_rows) & (F.col("__left__") >= book.min_rows) & F.col("__t__").isNotNull())
    rows = rows.withColumn("next_ret", F.col("__t__")).drop("__t__", "__n__")
    left = F.col("__left__")
    rows = rows.withColumn("score_group", quantile_group("ranking_score", book.entity, book.groups, [book.date], left))
    control = quantile_group(book.control, book.entity, book.control_groups, [book.date], left) if book.control else F.lit(0)
    return rows.withColumn("control_group", control).drop("__left__")


def _legs(rows: DataFrame, keys: Sequence[str], value: str, weight: str | None, long: Column, short: Column) -> DataFrame:
    """By keys: both legs' mean returns and the rows in them; no row where a leg is empty or has no weight."""

    def leg(inside: Column) -> Column:
        if weight is None:
            return F.avg(F.when(inside, F.col(value)))
        total = F.sum(F.when(inside, F.col(weight)))
        return F.when(total > 0, F.sum(F.when(inside, F.col(weight) * F.col(value))) / total)

    out = rows.filter(long | short).groupBy(*keys).agg(leg(long).alias("long_ret"), leg(short).alias("short_ret"), F.count("*").alias("n_rows"))
    return out.filter("long_ret is not null and short_ret is not null")


def characteristic_sort(panel: DataFrame, book: Rulebook) -> DataFrame:
    """(date, strategy_ret, long_ret, short_ret, n_rows, n_stripes) by the month in which returns are realised.

    Each control group is a stripe with a long and a short leg; a stripe without one of them doesn't count, and the
    month is the mean of the others.  One pass over the panel, without a loop over months; its few rows are one part, as
    a file for each month's task would be written by executors that still have the memory of the ranks.
    """
    rows = grouped(panel, book)
    legs = _legs(rows, [book.date, "control_group"], "next_ret", book.size if book.by_size else None, F.col("score_group") == book.long_group, F.col("score_group") == book.short_group)
    out = legs.groupBy(book.date).agg(
        F.avg(F.col("long_ret") - F.col("short_ret")).alias("strategy_ret"), F.avg("long_ret").alias("long_ret"), F.avg("short_ret").alias("short_ret"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_stripes")
    )
    return out.withColumn(book.date, dates.shift_month_end(F.col(book.date), 1)).repartition(1)


def grid(panel: DataFrame, book: Rulebook) -> DataFrame:
    """(date, control_group, score_group, ret, n_rows): the return of every group, not of two legs alone."""
    rows = grouped(panel, book).groupBy(book.date, "control_group", "score_group")
    value = F.avg("next_ret") if not book.by_size else F.when(F.sum(book.size) > 0, F.sum(F.col(book.size) * F.col("next_ret")) / F.sum(book.size))
    out = rows.agg(value.alias("ret"), F.count("*").alias("n_rows"))
    return out.withColumn(book.date, dates.shift_month_end(F.col(book.date), 1))


def arms(panel: DataFrame, book: Rulebook, returns: Mapping[str, str]) -> DataFrame:
    """(arm, date, strategy_ret, ...): the sort run on each of several returns (arm: its column), such as a total return
    and its two parts; each arm has the months in which its own return is there."""
    out = None
    for name, column in returns.items():
        one = characteristic_sort(panel, replace(book, ret=column)).withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def selections(panel: DataFrame, book: Rulebook) -> DataFrame:
    """(formation, entity, leg, weight): the members of both legs in each formation month, with formation sizes."""
    rows = grouped(panel, book)
    leg = F.when(F.col("score_group") == book.long_group, "long").when(F.col("score_group") == book.short_group, "short")
    return rows.select(F.col(book.date).alias("formation"), book.entity, leg.alias("leg"), F.col(book.size).alias("weight")).filter("leg is not null")


def overlapping_sort(panel: DataFrame, book: Rulebook, months: int) -> DataFrame:
    """(date, strategy_ret, long_ret, short_ret, n_rows, n_cohorts): each formation is held for ``months``.

    A cohort's weights are its formation sizes over those that still have a return; a cohort without a leg doesn't
    count, and a month is the equal mean of the live ones.  With one month this is the plain sort.  The returns of the
    months ahead come from frames over month numbers beside the sort's own, so the panel is read and shuffled once by
    entity, and only rows of the legs become one a month held.
    """
    if book.control:
        raise GuardError("overlapping holds have no control axis")
    by_month = Window.partitionBy(book.entity).orderBy(dates.month_index(F.col(book.date)))
    ahead = [F.first(book.ret).over(by_month.rangeBetween(h, h)).alias(f"h{h}") for h in range(1, months + 1)]
    fixed = book
    if book.trim != "none" and book.trim_percentile:
        fixed = resolve_trim(lagged_panel(panel, book.entity, book.date, book.ret, book.score, book.lag), book)
    rows = grouped(panel.withColumn("__ahead__", F.array(*ahead)), fixed)
    leg = F.when(F.col("score_group") == book.long_group, "long").when(F.col("score_group") == book.short_group, "short")
    rows = rows.select(F.col(book.date).alias("formation"), leg.alias("leg"), F.col(book.size).alias("weight"), F.posexplode("__ahead__").alias("__h__", "__r__")).filter("leg is not null")
    rows = rows.withColumn("__r__", _trimmed(F.col("__r__"), fixed)).filter("__r__ is not null").withColumn("__m__", F.last_day(F.add_months("formation", F.col("__h__") + 1)))
    legs = _legs(rows, ["formation", "__m__"], "__r__", "weight" if book.by_size else None, F.col("leg") == "long", F.col("leg") == "short")
    return legs.groupBy(F.col("__m__").alias(book.date)).agg(
        (F.avg("long_ret") - F.avg("short_ret")).alias("strategy_ret"), F.avg("long_ret").alias("long_ret"), F.avg("short_ret").alias("short_ret"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_cohorts")
    )


def composite(parts: Sequence[DataFrame], date: str, value: str, complete: bool) -> DataFrame:
    """The equal mean of several series: on dates that all have, or of those that a date has."""
    rows = parts[0].select(date, value)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(date, value))
    out = rows.filter(F.col(value).isNotNull()).groupBy(date).agg(F.avg(value).alias(value), F.count("*").alias("n_parts"))
    return out.filter(F.col("n_parts") == len(parts)) if complete else out


#: Fixed table: the six sorts of the corporate-bond factors by name, with score, control, long and short group.
FACTORS = {
    "drf": ("var_5pct", "rating", 4, 0),
    "lrf": ("gamma", "rating", 4, 0),
    "rev": ("rev", "rating", 0, 4),
    "crf_var": ("rating", "var_5pct", 4, 0),
    "crf_illiq": ("rating", "gamma", 4, 0),
    "crf_rev": ("rating", "xret", 4, 0),
}
#: The credit factor is the equal mean of these, in months that have all of them.
CREDIT_PARTS = ("crf_var", "crf_illiq", "crf_rev")


def factor_book(name: str, **changes: object) -> Rulebook:
    """The rulebook of a named factor: independent 5 x 5 groups, weighted by size."""
    if name not in FACTORS:
        raise GuardError(f"unknown factor {name!r}")
    score, control, long, short = FACTORS[name]
    return Rulebook(**({"score": score, "control": control, "long_group": long, "short_group": short} | changes))


def credit_factor(panel: DataFrame, lag: int = 0) -> DataFrame:
    """(date, strategy_ret, n_parts): the composite of the credit sorts."""
    parts = [characteristic_sort(panel, factor_book(name, lag=lag)) for name in CREDIT_PARTS]
    return composite(parts, "date", "strategy_ret", complete=True)
