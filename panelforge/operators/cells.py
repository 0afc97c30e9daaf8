"""Strategies as legs of sorts, and every cell of a grid of corrections run at once.

A panel has two families of columns, as published (``raw``) and corrected (``corr``).  A cell is a bit mask over CHOICES;
a bit that is set is the corrected side of its choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from . import lattice
from .guards import GuardError, require_unique
from .percentiles import percentiles
from .ranks import quantile_group
from .screens import clip
from .signals import stale_mask
from .sorts import Rulebook, characteristic_sort, composite, overlapping_sort

#: Prices of the corrected family; stale prices masked; terminal rows of distressed entities kept; scores a month older;
#: no trim of realised returns.
CHOICES = ("meas_err", "stale_price", "survivorship", "lib_gap", "lab_trim")
FAMILIES = ("raw", "corr")


@dataclass(frozen=True)
class Strategy:
    """Legs and how they become one series: one leg alone, or the equal mean of several, of those that a month has
    (``equal_average``) or only in months that all have (``complete_average``).  ``refused`` says why it can't be run."""

    name: str
    legs: tuple[Rulebook, ...]
    combiner: str = "single_leg"
    months: int = 1
    refused: str | None = None

    def __post_init__(self) -> None:
        if self.combiner not in ("single_leg", "equal_average", "complete_average"):
            raise GuardError(f"unknown combiner {self.combiner!r}")
        if not self.refused and (not self.legs or (self.combiner == "single_leg") != (len(self.legs) == 1)):
            raise GuardError(f"{self.combiner} of {len(self.legs)} legs")
        if self.months > 1 and any(leg.control for leg in self.legs):
            raise GuardError("overlapping holds have no control axis")


def runnable(strategy: Strategy) -> Strategy:
    """The strategy, or an error if it is refused."""
    if strategy.refused:
        raise GuardError(f"{strategy.name} is refused: {strategy.refused}")
    return strategy


def run(panel: DataFrame, strategy: Strategy) -> DataFrame:
    """(date, strategy_ret and more) of a strategy on a panel, each leg by what it is: a plain sort, or one with
    overlapping holds."""
    runnable(strategy)
    legs = [characteristic_sort(panel, b) if strategy.months == 1 else overlapping_sort(panel, b, strategy.months) for b in strategy.legs]
    if len(legs) == 1:
        return legs[0]
    return composite(legs, strategy.legs[0].date, "strategy_ret", complete=strategy.combiner == "complete_average")


def _bit(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << CHOICES.index(name))) != 0


def preflight(panel: DataFrame, signals: DataFrame, strategy: Strategy) -> DataFrame:
    """(choice, runnable, reason) for each choice: whether the tables have what it needs."""
    names = {*panel.columns, *signals.columns}
    needs = {
        "meas_err": {f"ret_{f}" for f in FAMILIES} | {f"{b.score}_{f}" for b in strategy.legs for f in FAMILIES},
        "stale_price": {f"last_trade_date_{f}" for f in FAMILIES},
        "survivorship": {"exit_reason"},
        "lib_gap": set(),
        "lab_trim": set(),
    }
    rows = [(c, not (gap := sorted(n - names)), f"no {', '.join(gap)}" if gap else None) for c, n in needs.items()]
    return panel.sparkSession.createDataFrame(rows, "choice string, runnable boolean, reason string")


def _views(panel: DataFrame, signals: DataFrame, book: Rulebook, stale_days: int, exits: Sequence[str]) -> DataFrame:
    """Rows of all 8 views of the panel (the first three choices): view, entity, date, size, ret, score and control.

    Prices go stale on the whole panel, before terminal rows are dropped; each family is masked once, and the views take
    their columns from the four variants, so the panel is read and shuffled once."""
    keys = [book.entity, book.date]
    extra = [book.control] if book.control else []
    joined = panel.join(require_unique(signals, keys), keys, "left")
    columns = set(joined.columns)
    named = lambda base, f: F.col(f"{base}_{f}" if f"{base}_{f}" in columns else base)
    rows = joined.filter("universe_eligible") if "universe_eligible" in columns else joined
    reason = F.col("exit_reason") if "exit_reason" in columns else F.lit(None).cast("string")
    rows = rows.select(
        *keys, book.size, reason.alias("exit_reason"),
        *[named("last_trade_date", f).alias(f"last_{f}") for f in FAMILIES],
        *[named(book.ret, f).alias(f"{kind}_{f}") for f in FAMILIES for kind in ("plain", "masked")],
        *[named(n, f).alias(f"{n}_{f}") for n in [book.score, *extra] for f in FAMILIES],
    )
    for f in FAMILIES:
        rows = stale_mask(rows.withColumn("__price__", F.lit(1.0)), *keys, f"last_{f}", stale_days, "__price__", [f"masked_{f}"]).drop("__price__")
    view = F.col("view")
    pick = lambda raw, corr: F.when(_bit(view, "meas_err"), F.col(corr)).otherwise(F.col(raw))
    rows = rows.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = rows.filter(_bit(view, "survivorship") | ~F.coalesce(F.col("exit_reason").isin(*exits), F.lit(False)))
    ret = F.when(_bit(view, "stale_price"), pick("masked_raw", "masked_corr")).otherwise(pick("plain_raw", "plain_corr"))
    return rows.select("view", *keys, book.size, ret.alias("ret"), *[pick(f"{n}_raw", f"{n}_corr").alias(n) for n in [book.score, *extra]])


def _leg_cells(panel: DataFrame, signals: DataFrame, book: Rulebook, stale_days: int, exits: Sequence[str]) -> DataFrame:
    """(mask, date, strategy_ret, n_rows) of one leg in all cells."""
    rows = _views(panel, signals, book, stale_days, exits)
    months = Window.partitionBy("view", book.entity).orderBy(dates.month_index(F.col(book.date)))
    at = lambda c, k: F.first(c).over(months.rangeBetween(k, k)) if k else F.col(c)
    gap = _bit(F.col("mask"), "lib_gap")
    rows = rows.withColumns({"next_ret": at("ret", 1), "score_now": at(book.score, -book.lag), "score_before": at(book.score, -1)})
    rows = rows.withColumn("mask", F.explode(F.array(*[F.col("view") + F.lit(k << 3) for k in range(4)]))).withColumn("ranking_score", F.when(gap, F.col("score_before")).otherwise(F.col("score_now")))
    ok = F.col("ranking_score").isNotNull() & F.col(book.size).isNotNull() & F.col("next_ret").isNotNull()
    ok = ok & F.col(book.control).isNotNull() if book.control else ok
    cell_month = ["mask", book.date]
    count = F.count("*").over(Window.partitionBy(*cell_month))
    rows = rows.filter(ok)
    if book.trim != "none":
        # the trim is resolved once for a cell, over all its returns; corrected cells have none
        given = [p for p in (book.trim_low, book.trim_high) if p is not None]
        if book.trim_percentile and given:
            told = percentiles(rows.filter(~_bit(F.col("mask"), "lab_trim")), "next_ret", given, "mask")
        else:
            told = {mask: given for mask in range(1 << len(CHOICES))}
        bounds = [(mask, *[None if p is None else float(own[given.index(p)]) for p in (book.trim_low, book.trim_high)]) for mask, own in told.items()]
        bounds = panel.sparkSession.createDataFrame(bounds, "mask int, __low__ double, __high__ double")
        rows = rows.join(F.broadcast(bounds), "mask", "left").withColumn("__n__", count).filter(F.col("__n__") >= book.min_rows)
        inside = F.coalesce(F.col("next_ret") >= F.col("__low__"), F.lit(True)) & F.coalesce(F.col("next_ret") <= F.col("__high__"), F.lit(True))
        trimmed = clip(F.col("next_ret"), F.coalesce("__low__", F.lit(float("-inf"))), F.coalesce("__high__", F.lit(float("inf")))) if book.trim == "winsorise" else F.when(inside, F.col("next_ret"))
        rows = rows.withColumn("next_ret", F.when(_bit(F.col("mask"), "lab_trim"), F.col("next_ret")).otherwise(trimmed)).filter("next_ret is not null")
    rows = rows.withColumn("__n__", count).filter(F.col("__n__") >= book.min_rows)
    rows = rows.withColumn("score_group", quantile_group("ranking_score", book.entity, book.groups, cell_month))
    stripe = quantile_group(book.control, book.entity, book.control_groups, cell_month) if book.control else F.lit(0)
    rows = rows.withColumn("stripe", stripe).filter(F.col("score_group").isin(book.long_group, book.short_group))

    def leg(group: int) -> Column:
        inside = F.col("score_group") == group
        if not book.by_size:
            return F.avg(F.when(inside, F.col("next_ret")))
        total = F.sum(F.when(inside, F.col(book.size)))
        return F.when(total > 0, F.sum(F.when(inside, F.col(book.size) * F.col("next_ret"))) / total)

    legs = rows.groupBy(*cell_month, "stripe").agg(leg(book.long_group).alias("long"), leg(book.short_group).alias("short"), F.count("*").alias("n")).dropna(subset=["long", "short"])
    out = legs.groupBy(*cell_month).agg(F.avg(F.col("long") - F.col("short")).alias("strategy_ret"), F.sum("n").alias("n_rows"))
    return out.select("mask", dates.shift_month_end(F.col(book.date), 1).alias(book.date), "strategy_ret", "n_rows")


def strategy_cells(panel: DataFrame, signals: DataFrame, strategy: Strategy, stale_days: int = 14, exits: Sequence[str] = ("defaulted",)) -> DataFrame:
    """(mask, date, strategy_ret, n_rows) of a strategy in all 2 ** 5 cells, by the month in which returns are realised.

    One plan a leg: the panel becomes rows of views, lags and trims, and windows run by cell, so there is no loop over
    cells.  ``panel`` has entity and date, size, ``ret_raw``, ``ret_corr`` and, as far as the choices need them,
    ``last_trade_date_*``, ``exit_reason`` and ``universe_eligible``; ``signals`` has the scores of both families.  A
    corrected score is that of the month before formation (lag 1), an uncorrected one has the leg's own lag.  A choice
    without an effect leaves its cells equal.  Trims at percentiles are resolved at once, by jobs of their own."""
    runnable(strategy)
    if strategy.months != 1:
        raise GuardError("cells are run for monthly holds")
    legs = [_leg_cells(panel, signals, replace(b), stale_days, exits) for b in strategy.legs]
    if len(legs) == 1:
        return legs[0]
    date = strategy.legs[0].date
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    out = rows.groupBy("mask", date).agg(F.avg("strategy_ret").alias("strategy_ret"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("__n__"))
    return (out.filter(F.col("__n__") == len(legs)) if strategy.combiner == "complete_average" else out).drop("__n__")


def on_common_months(cells: DataFrame, date: str, k: int = len(CHOICES)) -> DataFrame:
    """Rows of the months that all 2 ** k cells have."""
    months = cells.groupBy(date).agg(F.count_distinct("mask").alias("__n__")).filter(F.col("__n__") == (1 << k)).select(date)
    return cells.join(F.broadcast(months), date)


def scope(facts: DataFrame) -> DataFrame:
    """One row: scope, and the choices that are run, held, refused and not applicable, from a row for each of CHOICES with
    runnable, not_applicable and fixed (the state at which one that can't be run is held, or null).

    REFUSED if a choice that applies can neither be run nor held, else PARTIAL if one is held, else COMPLETE.  A choice
    without an estimand is left out before that."""
    if sorted(r.choice for r in facts.select("choice").collect()) != sorted(CHOICES):
        raise GuardError(f"there has to be a fact for each of {CHOICES}")
    place = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(CHOICES) for x in (c, k)]), F.col("choice"))
    applies = ~F.col("not_applicable")
    of = lambda c, what=F.col("choice"): F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(place.alias("k"), what.alias("c"))))), lambda x: x["c"])
    out = facts.agg(
        of(applies & F.col("runnable")).alias("run"),
        of(applies & ~F.col("runnable") & F.col("fixed").isNotNull(), F.concat_ws("=", "choice", "fixed")).alias("held"),
        of(applies & ~F.col("runnable") & F.col("fixed").isNull()).alias("refused"),
        of(F.col("not_applicable")).alias("not_applicable"),
    )
    return out.withColumn("scope", F.when(F.size("refused") > 0, "REFUSED").when(F.size("held") > 0, "PARTIAL").otherwise("COMPLETE"))


def audit(panel: DataFrame, signals: DataFrame, strategy: Strategy, facts: DataFrame | None = None, **options: object) -> dict[str, DataFrame]:
    """Everything that an audit of a strategy says: scope, cells, common support, the effect of each set of choices with
    its t and p, and each choice's Shapley share; an error if the scope is REFUSED.  ``facts`` as for ``scope`` (those of
    ``preflight`` if none are given)."""
    told = facts if facts is not None else preflight(panel, signals, strategy).select("choice", "runnable", F.lit(False).alias("not_applicable"), F.lit(None).cast("string").alias("fixed"))
    verdict = scope(told)
    if verdict.first().scope == "REFUSED":
        raise GuardError(f"{strategy.name}: {verdict.first().refused} can neither be run nor held")
    date = strategy.legs[0].date
    found = strategy_cells(panel, signals, strategy, **options)
    common = on_common_months(found, date)
    means = common.groupBy("mask").agg(F.avg("strategy_ret").alias("value"))
    effects = lattice.infer_effects(lattice.monthly_effects(common, date, "strategy_ret", len(CHOICES)), date)
    return {"scope": verdict, "cells": found, "support": lattice.support(found, date, len(CHOICES)), "effects": effects, "shapley": lattice.shapley(means, len(CHOICES))}
