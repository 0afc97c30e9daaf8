"""Grids of on/off choices: cells numbered by bit masks, and how a result depends on each choice.

A cell's mask has bit b set if choice b is on.  Tables are long: (mask, value), 2 ** k rows for k choices.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guards import GuardError


def masks(spark: SparkSession, k: int) -> DataFrame:
    if not 0 <= k <= 16:
        raise GuardError(f"{k} choices make too many cells")
    return spark.range(1 << k).select(F.col("id").cast("int").alias("mask"))


def on(bit: int, mask: str = "mask") -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << bit)) != 0


def cells(df: DataFrame, screens: Sequence[Column], keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Aggregates of ``df`` in every cell: a row counts in the cells whose switched-on screens it all passes.

    The screens' results are one number a row; rows are first aggregated by it, and only those partial rows meet the
    masks, so the input is read and shuffled once whatever the number of cells.  ``values`` are sums or counts, under
    their names.
    """
    k = len(screens)
    passed = F.lit(0)
    for b, screen in enumerate(screens):
        passed = passed.bitwiseOR(F.when(F.coalesce(screen, F.lit(False)), F.lit(1 << b)).otherwise(F.lit(0)))
    part = df.withColumn("__passed__", passed).groupBy(*keys, "__passed__").agg(*[c.alias(n) for n, c in values.items()])
    every = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: m.bitwiseAND(F.col("__passed__")) == m)
    return part.withColumn("mask", F.explode(every)).groupBy(*keys, "mask").agg(*[F.sum(n).alias(n) for n in values])


def marginals(table: DataFrame, k: int) -> DataFrame:
    """(bit, base, marginal): what switching a choice on adds, at every setting of the others."""
    a = table.select(F.col("mask").alias("base"), F.col("value").alias("off"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("bit"))
    a = a.filter(F.expr("base & shiftleft(1, bit)") == 0).withColumn("__m__", F.expr("base | shiftleft(1, bit)"))
    both = a.join(table.select(F.col("mask").alias("__m__"), F.col("value").alias("on")), "__m__")
    return both.select("bit", "base", (F.col("on") - F.col("off")).alias("marginal"))


def dividends(table: DataFrame) -> DataFrame:
    """Harsanyi dividends: h(U) = sum over T in U of (-1) ** |U - T| * value(T)."""
    u, t = table.select(F.col("mask").alias("u")), table.select(F.col("mask").alias("t"), "value")
    sign = F.when(F.bit_count(F.col("u").bitwiseXOR(F.col("t"))) % 2 == 0, 1.0).otherwise(-1.0)
    inside = F.col("t").bitwiseAND(F.bitwise_not("u")) == 0
    return u.join(F.broadcast(t), inside).groupBy(F.col("u").alias("mask")).agg(F.sum(sign * F.col("value")).alias("dividend"))


def walsh(table: DataFrame) -> DataFrame:
    """Walsh coefficients: the mean over cells S of (-1) ** |T - S| * value(S), and twice them, the effects."""
    t, s = table.select(F.col("mask").alias("t")), table.select(F.col("mask").alias("s"), "value")
    sign = F.when(F.bit_count(F.col("t").bitwiseAND(F.bitwise_not("s"))) % 2 == 0, 1.0).otherwise(-1.0)
    out = t.join(F.broadcast(s), F.lit(True)).groupBy(F.col("t").alias("mask")).agg(F.avg(sign * F.col("value")).alias("coefficient"))
    return out.withColumn("effect", 2 * F.col("coefficient"))


def shapley(table: DataFrame, k: int) -> DataFrame:
    """(bit, share): each dividend dealt out equally to the choices in it; shares add up to full less empty."""
    h = dividends(table).filter("mask > 0").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return h.filter(F.expr("mask & shiftleft(1, bit)") != 0).groupBy("bit").agg(F.sum(F.col("dividend") / F.bit_count("mask")).alias("share"))


def partition_gap(table: DataFrame, second: int) -> DataFrame:
    """Full less empty in three parts: dividends of choices outside the mask ``second`` alone, of those inside it alone,
    and of both; a part without any is null."""
    h = dividends(table).filter("mask > 0")
    inside, outside = F.col("mask").bitwiseAND(F.lit(second)) != 0, F.col("mask").bitwiseAND(F.bitwise_not(F.lit(second))) != 0
    part = lambda c: F.sum(F.when(c, F.col("dividend")))
    return h.agg(part(outside & ~inside).alias("first"), part(inside & ~outside).alias("second"), part(inside & outside).alias("both"), F.sum("dividend").alias("gap"))


def invariance(cells_: DataFrame, bit: int, hash_: Column) -> DataFrame:
    """For each pair of cells that differ in one choice whether their rows are the same bag."""
    hashed = cells_.groupBy("mask").agg(hash_.alias("h"), F.count("*").alias("n"))
    off = hashed.filter(~on(bit)).select(F.col("mask").alias("base"), F.col("h").alias("h0"), F.col("n").alias("n0"))
    with_ = hashed.filter(on(bit)).select((F.col("mask") - (1 << bit)).alias("base"), F.col("h").alias("h1"), F.col("n").alias("n1"))
    return off.join(with_, "base", "full").select("base", (F.col("h0").eqNullSafe(F.col("h1")) & F.col("n0").eqNullSafe(F.col("n1"))).alias("same"))


def compression(effects: DataFrame) -> DataFrame:
    """The part of the effects' squares that belongs to three choices or more; null if there is nothing to divide."""
    order, square = F.bit_count("mask"), F.col("effect") * F.col("effect")
    total = F.sum(F.when(order >= 1, square))
    return effects.agg(F.when(total >= 1e-18, F.coalesce(F.sum(F.when(order >= 3, square)), F.lit(0.0)) / total).alias("compression"))


def support(series: DataFrame, date: str, k: int, least_months: int = 60, least_share: float = 0.5) -> DataFrame:
    """(n_common, n_reference, passes): months that all cells have, against those of the full cell."""
    per = series.select("mask", date).distinct()
    common = per.groupBy(date).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == (1 << k)).alias("n_common"))
    reference = per.agg(F.count_if(F.col("mask") == (1 << k) - 1).alias("n_reference"))
    both = common.join(F.broadcast(reference), F.lit(True))
    return both.withColumn("passes", (F.col("n_common") >= least_months) & (F.col("n_common") >= least_share * F.col("n_reference")))


def multiple_testing_flag(df: DataFrame, label: str, t: str, free_parameters: str, band: tuple[float, float], most_parameters: int, names: DataFrame | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with t_in_band (the size of t is in the band, both ends included), many_parameters (more than
    ``most_parameters``), known_name (the label, or what ``aliases`` says for it, is a ``name`` of the table ``names``,
    blanks around and case aside) and flag, whether one of them holds.

    Null means not evaluated: a missing t or count, or no table of names.  The flag informs and is never null."""
    low, high = band
    if not low < high:
        raise GuardError(f"the band has to be (low, high), not {band}")
    key = lambda c: F.lower(F.trim(c))
    size = F.abs(F.col(t))
    out = df.withColumns({"t_in_band": (size >= low) & (size <= high), "many_parameters": F.col(free_parameters) > most_parameters})
    if names is None:
        out = out.withColumn("known_name", F.lit(None).cast("boolean"))
    else:
        other = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.strip().lower(), v.strip().lower())])[key(F.col(label))] if aliases else F.lit(None).cast("string")
        known = names.select(key(F.col("name")).alias("__name__")).distinct()
        out = out.withColumns({"__label__": key(F.col(label)), "__alias__": other})
        for own in ("__label__", "__alias__"):
            out = out.join(known.select(F.col("__name__").alias(f"{own}k")), F.col(own) == F.col(f"{own}k"), "left")
        out = out.withColumn("known_name", F.col("__label__k").isNotNull() | F.col("__alias__k").isNotNull()).drop("__label__", "__alias__", "__label__k", "__alias__k")
    met = [F.coalesce(F.col(c), F.lit(False)) for c in ("t_in_band", "many_parameters", "known_name")]
    return out.withColumn("flag", met[0] | met[1] | met[2])


def sweep(base: DataFrame, grid: DataFrame, value: Column) -> DataFrame:
    """An aggregate at every row of a small grid of parameters."""
    return base.join(F.broadcast(grid), F.lit(True)).groupBy(*grid.columns).agg(value.alias("value"))


def classify_curve(points: DataFrame, at: str, effect: str, nothing: float = 1e-12) -> DataFrame:
    """One row: class and crossings of an effect over a grid, in its order.  Values next to nothing have no sign.
    Without a crossing the curve is sign_stable if it is monotone, else non_monotone_sign_stable; with one it is
    one_crossover, else multiple_crossings.  ``crossings`` has where each is, on the line between its two points."""
    line = points.agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("x"), F.col(effect).cast("double").alias("y")))).alias("p"))
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    line = line.withColumn("signed", F.filter("p", lambda q: F.abs(q["y"]) > nothing)).withColumns({"steps": pairs(F.col("p"))})
    line = line.withColumn("turns", F.filter(pairs(F.col("signed")), lambda s: F.signum(s["a"]["y"]) != F.signum(s["b"]["y"])))
    monotone = F.forall("steps", lambda s: s["b"]["y"] >= s["a"]["y"]) | F.forall("steps", lambda s: s["b"]["y"] <= s["a"]["y"])
    kind = F.when(F.size("turns") > 1, "multiple_crossings").when(F.size("turns") == 1, "one_crossover").when(monotone, "sign_stable").otherwise("non_monotone_sign_stable")
    zero = F.transform("turns", lambda s: s["a"]["x"] - s["a"]["y"] * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"]))
    return line.select(kind.alias("class"), zero.alias("crossings"))


def monthly_effects(series: DataFrame, date: str, value: str, k: int) -> DataFrame:
    """(mask, date, value): the effects of each month's cells, in months that all 2 ** k cells have."""
    s = series.filter(F.col(value).isNotNull()).select(F.col("mask").alias("s"), date, F.col(value).alias("__v__"))
    t = F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("mask")
    sign = F.when(F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("s"))) % 2 == 0, 1.0).otherwise(-1.0)
    out = s.select("s", date, "__v__", t).groupBy("mask", date).agg(F.count("*").alias("__n__"), (2 * F.avg(sign * F.col("__v__"))).alias("value"))
    return out.filter(F.col("__n__") == (1 << k)).drop("__n__")


def infer_effects(effects: DataFrame, date: str, inert_below: float = 1e-12) -> DataFrame:
    """By coordinate: months, mean effect, t and p of its monthly series; an effect that is nothing in every month, next
    to the largest of any coordinate, isn't tested (t 0, p 1)."""
    from .stats import mean_p_value, summary

    out = summary(effects, ["mask"], date, "value")
    size = effects.groupBy(F.col("mask").alias("__m__")).agg(F.max(F.abs("value")).alias("__size__"))
    size = size.join(F.broadcast(size.agg(F.max("__size__").alias("__most__"))), F.lit(True))
    out = out.join(size, F.col("mask") == F.col("__m__")).withColumn("inert", F.col("__size__") <= inert_below * F.greatest(F.lit(1e-300), F.col("__most__")))
    t = F.when(F.col("inert"), 0.0).otherwise(F.col("t_stat"))
    return out.select("mask", "n_months", F.col("average").alias("effect"), t.alias("t_stat"), F.when(F.col("inert"), 1.0).otherwise(mean_p_value(F.col("t_stat"))).alias("p_value"), "inert")


def bootstrap_effects(effects: DataFrame, date: str, replicates: int = 1000, block: int = 6, seed: int = 0, statistic: str = "mean") -> DataFrame:
    """By coordinate: the interval and p of a statistic of its monthly series (mean, or sharpe, which isn't a mean of
    monthly numbers and so has no HAC error), on months that are resampled together for all coordinates.  A p is at
    least 1 / replicates, below which draws can't tell."""
    from .resample import block_bootstrap, intervals

    find = {"mean": lambda m: m.mean(0), "sharpe": lambda m: m.mean(0) / np.where(m.std(0, ddof=1) > 0, m.std(0, ddof=1), np.nan) * math.sqrt(12)}[statistic]
    out = intervals(block_bootstrap(effects, "mask", date, "value", replicates, block, seed, statistic=find))
    return out.select(F.col("series").cast("int").alias("mask"), "n", "mean", "low", "high", F.greatest(F.lit(1.0) / F.col("n"), "p_value").alias("p_value"))
