"""Synthetic panels whose truth is known, and five biases to plant in them: fixtures for audits.

A clean panel has both families of columns alike.  Each bias changes what the uncorrected side of one choice sees.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .guards import GuardError

RISK_FREE = 0.001
RETURNS = ("ret_raw", "ret_corr", "xret_raw", "xret_corr")


@dataclass(frozen=True)
class Recipe:
    """Returns are ``alpha`` times an entity's characteristic, uniform from -1 to 1, plus normal noise.  With ``gap`` the
    score is new each month, and a return is ``alpha`` times the score of the month before."""

    entities: int = 60
    months: int = 72
    alpha: float = 0.01
    noise: float = 0.015
    seed: int = 0
    gap: bool = False
    start: str = "2005-01-31"


def month_ends(start: str, n: int) -> list[dt.date]:
    first = dt.date.fromisoformat(start)
    out = []
    for k in range(1, n + 1):
        year, month = divmod(first.year * 12 + first.month - 1 + k, 12)
        out.append(dt.date(year, month + 1, 1) - dt.timedelta(1))
    return out


def clean_panel(spark: SparkSession, recipe: Recipe = Recipe()) -> tuple[DataFrame, DataFrame]:
    """(panel, signals): the numbers come from numpy's generator, entity by entity and month by month, so a seed gives
    the same panel everywhere; there are as many as the recipe says, a fixture's worth."""
    rng = np.random.default_rng(recipe.seed)
    days = month_ends(recipe.start, recipe.months)
    names = [f"BOND{k:04d}" for k in range(recipe.entities)]
    if recipe.gap:
        scores, returns = np.empty((recipe.entities, recipe.months)), np.empty((recipe.entities, recipe.months))
        for k in range(recipe.entities):
            scores[k] = rng.uniform(-1.0, 1.0, recipe.months)
            returns[k] = recipe.alpha * np.concatenate(([0.0], scores[k, :-1])) + rng.normal(0.0, recipe.noise, recipe.months)
    else:
        own = rng.uniform(-1.0, 1.0, recipe.entities)
        scores = np.repeat(own[:, None], recipe.months, 1)
        returns = recipe.alpha * scores + rng.normal(0.0, recipe.noise, scores.shape)
    rows = [(e, d, float(s), float(r)) for e, ss, rs in zip(names, scores, returns, strict=True) for d, s, r in zip(days, ss, rs, strict=True)]
    made = spark.createDataFrame(rows, "cusip string, date date, score double, ret double")
    both = lambda column, name: [column.alias(f"{name}_{f}") for f in ("raw", "corr")]
    panel = made.select(
        "cusip", "date", F.lit(1.0).alias("size"), F.lit(RISK_FREE).alias("rf_monthly"), F.lit(None).cast("string").alias("exit_reason"), F.lit(True).alias("universe_eligible"),
        *both(F.lit(100.0), "price_eom"), *both(F.col("ret"), "ret"), *both(F.col("ret") - RISK_FREE, "xret"), *both(F.lit(5), "n_trades"), *both(F.lit(1e6), "total_vol"), *both(F.col("date"), "last_trade_date"),
    )
    return panel, made.select("cusip", "date", *both(F.col("score"), "score"))


def _means(signals: DataFrame) -> DataFrame:
    return signals.groupBy("cusip").agg(F.avg("score_raw").alias("__q__"))


def _marked(panel: DataFrame, signals: DataFrame, share: float = 0.3) -> DataFrame:
    """``panel`` with __place__: for the highest ``share`` of entities by mean score their place by name from 0, else
    null.  The entities are few, as in every fixture."""
    ranked = _means(signals).withColumn("__n__", F.row_number().over(Window.orderBy(F.desc("__q__"), "cusip")))
    most = ranked.agg(F.greatest(F.lit(1), F.bround(F.count("*") * share).cast("int")).alias("__m__"))
    high = ranked.join(F.broadcast(most), F.col("__n__") <= F.col("__m__")).withColumn("__place__", F.row_number().over(Window.orderBy("cusip")) - 1)
    return panel.join(F.broadcast(high.select("cusip", "__place__")), "cusip", "left")


def _set(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({n: F.when(where, v).otherwise(F.col(n)) for n, v in values.items()})


def plant(panel: DataFrame, signals: DataFrame, bias: str, size: float, seed: int = 0) -> DataFrame:
    """The panel with one bias: ``meas_err``, raw returns move with the characteristic; ``stale_price``, the long side's
    last trades are 45 days old and its returns higher, in both families; ``survivorship``, the long side's entities
    default one after another in the second half, with a crash in the month of default and no rows after it;
    ``lab_trim``, a quarter of the long side's returns are crashes beyond what a trim lets through.  (``lib_gap`` is a
    recipe of its own, ``Recipe(gap=True)``.)"""
    if bias == "meas_err":
        moved = panel.join(F.broadcast(_means(signals)), "cusip")
        return moved.withColumns({c: F.col(c) + size * F.col("__q__") for c in ("ret_raw", "xret_raw")}).select(panel.columns)
    rows = _marked(panel, signals)
    high = F.col("__place__").isNotNull()
    if bias == "stale_price":
        old = {f"last_trade_date_{f}": F.date_sub("date", 45) for f in ("raw", "corr")}
        return _set(rows, high, **old, **{c: F.col(c) + size for c in RETURNS}).select(panel.columns)
    crash = lambda v: {c: v if c.startswith("ret") else v - F.col("rf_monthly") for c in RETURNS}
    if bias == "survivorship":
        months = panel.select("date").distinct().withColumn("__t__", F.row_number().over(Window.orderBy("date")) - 1)
        n = months.count()
        rows = rows.join(F.broadcast(months), "date")
        exit_ = F.lit(n // 2) + F.col("__place__") % max(1, n - n // 2 - 1)
        rows = rows.filter(~F.coalesce(F.col("__t__") > exit_, F.lit(False)))
        return _set(rows, F.col("__t__") == exit_, exit_reason=F.lit("defaulted"), **crash(F.lit(-size))).select(panel.columns)
    if bias == "lab_trim":
        hit = high & (F.pmod(F.xxhash64("cusip", "date", F.lit(seed)), F.lit(1 << 20)) < (1 << 18))
        return _set(rows, hit, **crash(F.lit(-(0.5 + size)))).select(panel.columns)
    raise GuardError(f"unknown bias {bias!r}")
