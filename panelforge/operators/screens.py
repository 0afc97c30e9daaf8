"""Row screens: predicates by name, their conjunction, decimal shifts, universes, trims and clips."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .percentiles import percentiles

Screen = Callable[[], Column]


def between(column: str, low: float, high: float) -> Column:
    """Null isn't between."""
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def at_least(column: str, low: float) -> Column:
    return F.coalesce(F.col(column) >= low, F.lit(False))


def positive(column: str) -> Column:
    return F.coalesce(F.col(column) > 0, F.lit(False))


def not_code(column: str, code: str = "Y") -> Column:
    """Null isn't the code."""
    return F.coalesce(F.col(column), F.lit("")) != code


def code_in(column: str, codes: Sequence[str], or_null: bool = True) -> Column:
    inside = F.coalesce(F.col(column).isin(*codes), F.lit(False))
    return inside | F.col(column).isNull() if or_null else inside


def at_most_or_null(column: str, high: float) -> Column:
    return F.col(column).isNull() | (F.col(column) <= high)


#: Fixed codes of trade records: normal status; reversals before and from the day that reporting changed; as-of codes.
NORMAL, REVERSED_BEFORE, REVERSED_AFTER, REGIME_DAY = "T", ("W",), ("R", "X"), "2012-02-06"
ASOF_LATE, ASOF_REVERSAL = "A", "R"


def normal_record(status: str) -> Column:
    """A trade that was carried out as reported; null isn't."""
    return F.coalesce(F.col(status) == NORMAL, F.lit(False))


def reversal_record(day: str, status: str, asof: str) -> Column:
    """A record that reverses another one, by the codes of its day; without a day those of the later regime hold."""
    early = F.coalesce(F.col(day) < F.lit(REGIME_DAY).cast("date"), F.lit(False))
    told = F.when(early, F.col(status).isin(*REVERSED_BEFORE)).otherwise(F.col(status).isin(*REVERSED_AFTER))
    return F.coalesce(told, F.lit(False)) | F.coalesce(F.col(asof) == ASOF_REVERSAL, F.lit(False))


def asof_keep(asof: str, late: bool = True) -> Column:
    """On-time records, late ones if they are wanted, and reversals, which the matcher still needs; not delayed ones and
    cancellations."""
    return code_in(asof, ["", ASOF_REVERSAL, *([ASOF_LATE] if late else [])])


def regular_sale(condition: str, special_price: str) -> Column:
    """Regular-way trades without a special price."""
    return code_in(condition, ["", "@"]) & not_code(special_price)


def status_keep(status: str, day: str, normal: str = "T", early: str | None = None, until: str | None = None) -> Column:
    """The normal status; with ``early``, that status too before the day ``until``."""
    keep = F.col(status) == normal
    if early is not None:
        keep = keep | ((F.col(status) == early) & (F.col(day) < F.lit(until)))
    return F.coalesce(keep, F.lit(False))


def apply_screens(df: DataFrame, screens: Mapping[str, Column], names: Sequence[str] | None = None) -> DataFrame:
    """Rows that pass all named screens; the order of names doesn't matter."""
    chosen = [screens[n] for n in (screens if names is None else names)]
    return df.filter(reduce(lambda a, b: a & b, chosen, F.lit(True)))


def cascade_counts(df: DataFrame, screens: Mapping[str, Column]) -> DataFrame:
    """For each screen in order: rows that fail it alone, and rows left after it and those before it; one pass."""
    kept = F.lit(True)
    columns = [F.count("*").alias("all_rows")]
    for name, screen in screens.items():
        kept = kept & screen
        columns += [F.count_if(~screen).alias(f"fail_{name}"), F.count_if(kept).alias(f"left_{name}")]
    wide = df.agg(*columns)
    rows = [F.struct(F.lit(k).alias("step"), F.lit(n).alias("screen"), F.col(f"fail_{n}").alias("fails"), F.col(f"left_{n}").alias("left")) for k, n in enumerate(screens)]
    return wide.select("all_rows", F.inline(F.array(*rows)))


def one_flip(screens: Mapping[str, Column], base: Sequence[str]) -> dict[str, list[str]]:
    """Variants of a profile: the base, and for each screen the base without it or with it."""
    out = {"base": list(base)}
    for name in screens:
        out[f"flip_{name}"] = [n for n in base if n != name] if name in base else [*base, name]
    return out


def decimal_shift(price: Column, floor: float, ceiling: float, drop_above: float) -> tuple[Column, Column]:
    """The price, a tenth or a hundredth of it, the first that lies in (floor, ceiling], and how it came about:
    ``dropped`` above ``drop_above`` (null), ``kept``, ``tenth``, ``hundredth``, or ``outside`` (unchanged)."""
    fits = lambda p: (p > floor) & (p <= ceiling)
    kind = F.when(price > drop_above, "dropped").when(fits(price), "kept").when(fits(price / 10), "tenth").when(fits(price / 100), "hundredth").otherwise("outside")
    value = F.when(kind == "dropped", F.lit(None)).when(kind == "tenth", price / 10).when(kind == "hundredth", price / 100).otherwise(price)
    return value, kind


def near_round(value: Column, rounds: Sequence[float], tolerance: float) -> Column:
    """Whether a value is closer than ``tolerance`` to one of the round numbers; null isn't."""
    return F.coalesce(F.exists(F.array(*[F.lit(float(r)) for r in rounds]), lambda r: F.abs(value - r) < tolerance), F.lit(False))


def wide_intraday(low: Column, high: Column, price_below: float, range_above: float) -> Column:
    """A day with a low price whose range over its mean is too wide; false if an end is missing."""
    mean = (low + high) / 2
    return F.coalesce(((low < price_below) | (high < price_below)) & (mean > 0) & (F.try_divide(high - low, mean) > range_above), F.lit(False))


def universe(df: DataFrame, exclusions: Mapping[str, Column], inclusions: Mapping[str, Column] | None = None) -> DataFrame:
    """A flag ``not_<name>`` for each rule that leaves the row out, and ``eligible`` where none does.

    An exclusion leaves out what it says, null saying nothing; an inclusion leaves out all that it doesn't let in, so an
    unknown category, null or not listed, is never taken for a wanted one."""
    flags = {f"not_{n}": F.coalesce(c, F.lit(False)) for n, c in exclusions.items()}
    flags |= {f"not_{n}": ~F.coalesce(c, F.lit(False)) for n, c in (inclusions or {}).items()}
    return df.withColumns(flags).withColumn("eligible", ~reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def percentile_bounds(df: DataFrame, column: str, low: float | None, high: float | None) -> tuple[float | None, float | None]:
    """Exact percentiles (linear interpolation) of the whole column, nulls left out: two numbers for the driver."""
    levels = [p for p in (low, high) if p is not None]
    told = dict(zip(levels, percentiles(df, column, levels).get(None, []), strict=False)) if levels else {}
    return told.get(low), told.get(high)


def truncate(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows inside [low, high]; rows without a value go."""
    keep = F.col(column).isNotNull()
    keep = keep & (F.col(column) >= low) if low is not None else keep
    return df.filter(keep & (F.col(column) <= high) if high is not None else keep)


def clip(value: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Null stays null; a null bound doesn't bind."""
    out = value
    out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low) if low is not None else out
    out = F.least(out, F.lit(high) if not isinstance(high, Column) else high) if high is not None else out
    return F.when(value.isNotNull(), out)


def winsor_ex_post(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    bounds = percentile_bounds(df, column, low, high)
    return df.withColumn(out, clip(F.col(column), *bounds))


#: Values of a bin, about, and bins at most, when expanding percentiles are found.
BIN_VALUES, BINS = 4_096, 512


def _bin_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are below a value: first by every 64th cut, then among the 63 after it, so that a row meets 128 at
    most.  Plain comparisons, which plans that read the same counts twice can share."""
    if not cuts:
        return F.lit(0)
    coarse = cuts[63::64]
    block = sum(((value > F.lit(c)).cast("int") for c in coarse), F.lit(0))
    table = F.array(*[F.array(*[F.lit(float(c)) for c in [*cuts[k : k + 63], *[float("inf")] * (63 - len(cuts[k : k + 63]))]]) for k in range(0, len(cuts) + 1, 64)])
    row = F.get(table, block) if coarse else table[0]
    return block * 64 + sum(((value > row[k]).cast("int") for k in range(min(63, len(cuts)))), F.lit(0))


def past_percentiles(df: DataFrame, column: str, period: str, levels: Sequence[float]) -> DataFrame:
    """(later, p0, p1, ...): for each period the exact percentiles, linear between two values, of all values of
    strictly earlier periods; null without any.

    Values fall into bins by cuts near their quantiles, so that a bin has about BIN_VALUES of them, or one part in BINS if
    they are many.  Running sums of the bins' counts over periods, and then over bins, say which bin holds each wanted rank of a period; the values of that
    bin alone, counted by period, meet it on the bin."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(period).alias("k"), F.col(column).cast("double").alias("v"))
    counts = rows.groupBy("k", "v").agg(F.count("*").alias("n"))
    told = counts.agg(F.sum("n").alias("n"), F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 5_000).alias("q")).first()
    bins = min(BINS, max(16, (told.n or 0) // BIN_VALUES))
    quantiles = told.q or []
    cuts = sorted({quantiles[len(quantiles) * i // bins] for i in range(1, bins)}) if quantiles else []
    counts = counts.withColumn("bin", _bin_of(F.col("v"), cuts))
    periods = df.select(F.col(period).alias("later")).distinct()
    small = counts.groupBy(F.col("k").alias("later"), "bin").agg(F.sum("n").alias("n"))
    grid = periods.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(cuts))))).join(small, ["later", "bin"], "left")
    past = Window.partitionBy("bin").orderBy("later").rowsBetween(Window.unboundedPreceding, -1)
    held = grid.select("later", "bin", F.sum("n").over(past).alias("n")).filter("n > 0")
    held = held.withColumns({"upto": F.sum("n").over(Window.partitionBy("later").orderBy("bin")), "total": F.sum("n").over(Window.partitionBy("later"))}).withColumn("before", F.col("upto") - F.col("n"))
    ranks = [F.struct(F.lit(2 * i + j).alias("which"), F.least(F.floor((F.col("total") - 1) * p) + j, F.col("total") - 1).alias("rank")) for i, p in enumerate(levels) for j in (0, 1)]
    wanted = held.select("later", "bin", "before", "upto", "total", F.inline(F.array(*ranks))).filter("rank >= before and rank < upto")
    near = wanted.select("later", "which", "total", F.col("bin").alias("b"), (F.col("rank") - F.col("before")).alias("place"))
    met = near.join(counts, (F.col("b") == F.col("bin")) & (F.col("k") < F.col("later"))).groupBy("later", "which", "total", "place", "v").agg(F.sum("n").alias("n"))
    met = met.withColumn("upto", F.sum("n").over(Window.partitionBy("later", "which").orderBy("v"))).filter("upto > place")
    which = lambda k: F.min(F.when(F.col("which") == k, F.col("v")))
    found = met.groupBy("later", "total").agg(*[which(k).alias(f"v{k}") for k in range(2 * len(levels))])
    share = lambda p: (F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p)
    mixed = [(F.col(f"v{2 * i}") + (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")) * share(p)).alias(f"p{i}") for i, p in enumerate(levels)]
    return periods.join(found.select(F.col("later"), *mixed), "later", "left")


def winsor_ex_ante(df: DataFrame, column: str, period: str, low: float, high: float, out: str) -> DataFrame:
    """Values clipped at percentiles of all strictly earlier periods' values; without any they stay.  ``period`` is a
    number."""
    bounds = past_percentiles(df, column, period, [low, high])
    rows = df.join(bounds, F.col(period) == F.col("later"), "left")
    return rows.withColumn(out, clip(F.col(column), F.col("p0"), F.col("p1"))).drop("later", "p0", "p1")


def tercile(df: DataFrame, column: str, group: str, top: bool) -> DataFrame:
    """Rows whose percentile rank (ties averaged) within the group is over 2/3, or 1/3 at most."""
    from .ranks import average_rank

    ranked = average_rank(df, column, [group], "__rank__").withColumn("__n__", F.count(column).over(Window.partitionBy(group)))
    share = F.col("__rank__") / F.col("__n__")
    return ranked.filter(share > 2 / 3 if top else share <= 1 / 3).drop("__rank__", "__n__")


def segment(df: DataFrame, flag: str, wanted: int) -> DataFrame:
    """Rows whose 0/1 flag is the wanted one; null is in neither."""
    return df.filter(F.col(flag).cast("int") == wanted)


def scale_is_percent(df: DataFrame, column: str, above: float = 0.2) -> bool:
    """Whether the median size of a return column says that it is in per cent."""
    middle = df.agg(F.median(F.abs(column))).first()[0]
    return middle is not None and middle > above


def terminal_value(value: Column, terminal: Column, fill: Column) -> Column:
    """``fill`` where a terminal row has no value; a recovery of rho makes that rho - 1."""
    return F.when(F.coalesce(terminal, F.lit(False)) & value.isNull(), fill).otherwise(value)


def fill_terminal(df: DataFrame, value: str, terminal: Column, fill: float) -> DataFrame:
    """``df`` with ``terminal_value``."""
    return df.withColumn(value, terminal_value(F.col(value), terminal, F.lit(fill)))
