"""Price outliers: anomalies, spikes, plateaus, and the sequential bounce-back filter."""

from __future__ import annotations

import statistics
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import guarded_ratio, median
from .screens import near_round, wide_intraday


@dataclass(frozen=True)
class DistressRules:
    """Thresholds of the daily filters; prices are per cent of par."""

    ultra_low: float = 0.10
    normal_ratio: float = 3.0
    spike_above: float = 5.0
    spike_ratio: float = 3.0
    recovery: float = 2.0
    plateau_low: float = 0.15
    plateau_days: int = 2
    displacement: float = 3.0
    rounds: tuple[float, ...] = (0.001, 0.01, 0.05, 0.10, 0.25, 0.50, 1.0)
    tolerance: float = 0.0001
    back: int = 5
    ahead: int = 5
    intraday_price: float = 20.0
    intraday_range: float = 0.75


def distress_flags(daily: DataFrame, entity: str, day: str, price: str, low: str, high: str, rules: DistressRules = DistressRules()) -> DataFrame:
    """``daily`` with flagged_anomaly, flagged_spike, flagged_plateau, flagged_intraday and kept (none of them).

    Prices are rounded to four places, half to even.  An anomaly is an ultra-low or round price far under the median
    of the higher ones around it; a spike a high or round price far over the median of the lower ones before it that
    comes back soon; a plateau a run of equal ultra-low or round prices that is round or displaced from its
    neighbours.  Entities with fewer than three days have no anomalies or spikes.
    """
    p = F.col("__p__")
    rows = daily.withColumn("__p__", F.bround(price, 4)).withColumn("__round__", near_round(p, rules.rounds, rules.tolerance))
    w = Window.partitionBy(entity).orderBy(day)
    many = F.count("*").over(Window.partitionBy(entity)) >= 3
    around = lambda a, b: F.collect_list("__p__").over(w.rowsBetween(a, b))
    rows = rows.withColumns({"__before__": around(-rules.back, -1), "__after__": around(1, rules.ahead), "__many__": many})

    above = median(F.filter(F.concat("__before__", "__after__"), lambda x: x > p))
    anomaly = ((p < rules.ultra_low) | F.col("__round__")) & (guarded_ratio(above, p) >= rules.normal_ratio)
    below = median(F.filter("__before__", lambda x: x < p))
    spike = ((p > rules.spike_above) | (F.col("__round__") & (p > 0.5))) & (guarded_ratio(p, below) >= rules.spike_ratio)
    spike = spike & F.exists("__after__", lambda x: x <= below * rules.recovery)

    changed = F.coalesce(F.lag("__p__").over(w) != p, F.lit(True)) | p.isNull()
    rows = rows.withColumns({"__run__": F.sum(changed.cast("int")).over(w), "__left__": F.lag("__p__").over(w), "__right__": F.lead("__p__").over(w)})
    # a run's neighbours are what its first and last day see; windows by run keep the partitioning by entity
    own = Window.partitionBy(entity, "__run__")
    whole = own.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__n__": F.count("*").over(own), "__left__": F.first("__left__").over(whole), "__right__": F.last("__right__").over(whole)})
    beside = lambda x: F.coalesce((x > 0) & (guarded_ratio(x, p) >= rules.displacement), F.lit(False))
    odd = F.col("__round__") | beside(F.col("__left__")) | beside(F.col("__right__"))
    plateau = ((p < rules.plateau_low) | F.col("__round__")) & (F.col("__n__") >= rules.plateau_days) & odd
    rows = rows.withColumns(
        {
            "flagged_plateau": F.coalesce(plateau, F.lit(False)),
            "flagged_anomaly": F.col("__many__") & F.coalesce(anomaly, F.lit(False)),
            "flagged_spike": F.col("__many__") & F.coalesce(spike, F.lit(False)),
            "flagged_intraday": wide_intraday(F.bround(low, 4), F.bround(high, 4), rules.intraday_price, rules.intraday_range),
        }
    )
    flags = ["flagged_anomaly", "flagged_spike", "flagged_plateau", "flagged_intraday"]
    kept = ~(F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]) | F.col(flags[3]))
    return rows.select(*daily.columns, *flags, kept.alias("kept"))


@dataclass(frozen=True)
class BounceRules:
    threshold: float = 35.0
    ahead: int = 5
    window: int = 5
    tolerance: float = 0.25
    slack: float = 1.0
    par: float = 100.0
    par_band: float = 15.0
    par_run: int = 3
    par_cooldown: int = 2


class _Decider:
    """Decides on one segment's prices as they come, each as soon as ``ahead`` more are known, or the segment ends.

    What it holds doesn't grow: the prices that wait for those ahead of them, and ``window`` that were let through."""

    def __init__(self, rules: BounceRules) -> None:
        self.rules = rules
        self.waiting: deque[float] = deque()
        self.passed: list[float] = []  # neighbours differ; the latest last
        self.unchecked = 0  # prices that pass after a flag near par

    def feed(self, price: float) -> bool | None:
        """The decision on the price that now has enough ahead of it, if there is one."""
        self.waiting.append(price)
        return self.decide() if len(self.waiting) > self.rules.ahead else None

    def decide(self) -> bool:
        """Whether the price that has waited longest bounces; others move the anchor."""
        price = self.waiting.popleft()
        if self.unchecked:
            self.unchecked -= 1
        elif len(self.passed) > 1 and self._bounces(price):
            return True
        if self.passed[-1:] != [price]:
            self.passed = [*self.passed, price][-self.rules.window :]
        return False

    def _bounces(self, price: float) -> bool:
        rules, middle = self.rules, statistics.median(self.passed)
        near = self.passed[-rules.par_run :]
        par = len(near) == rules.par_run and all(rules.par - rules.par_band <= x <= rules.par + rules.par_band for x in near)
        away = abs(price - (rules.par if par else middle)) > rules.threshold
        back = away and any(abs(x - middle) <= rules.tolerance + rules.slack for x in self.waiting)
        if back and par:
            self.unchecked = rules.par_cooldown
        return back


def bounces(prices: Iterable[float | None], rules: BounceRules = BounceRules()) -> list[bool]:
    """For each price in order whether it bounces back.  A price that is missing (null or NaN) doesn't, moves no anchor
    and isn't among those ahead."""
    decider, out, open_ = _Decider(rules), [], deque()
    for price in prices:
        out.append(False)
        if price is None or price != price:
            continue
        open_.append(len(out) - 1)
        if (told := decider.feed(float(price))) is not None:
            out[open_.popleft()] = told
    while open_:
        out[open_.popleft()] = decider.decide()
    return out


def bounce_back(trades: DataFrame, segment: str | Column, price: str, order: Sequence[str], rules: BounceRules = BounceRules()) -> DataFrame:
    """``trades`` with ``bounced``.  Each decision depends on the ones before it in the segment, in the total order
    given (nulls last), so a segment stays in one partition, where it streams: Spark sorts it, spilling as it must, and
    a task holds some prices and the rows that wait for their decisions.  Rows without a price stay and don't count."""
    key = F.col(segment) if isinstance(segment, str) else segment
    names = [f"c{k}" for k in range(len(trades.columns))]
    rows = trades.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(trades.columns, names, strict=True)], key.alias("segment"), *[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)], F.col(f"`{price}`").cast("double").alias("price"))
    rows = rows.withColumn("part", F.xxhash64("segment"))
    rows = rows.repartition("part").sortWithinPartitions("part", "segment", *[F.col(f"o{k}").asc_nulls_last() for k in range(len(order))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows whose decisions may still be open
        told: list[bool] = []
        first, open_, now, decider = 0, deque(), object(), _Decider(rules)

        def close() -> None:
            while open_:
                told[open_.popleft() - first] = decider.decide()

        for batch in batches:
            for own, value in zip(batch.column("segment").to_pylist(), batch.column("price").to_pylist(), strict=True):
                if own != now:
                    close()
                    now, decider = own, _Decider(rules)
                told.append(False)
                if value is not None and value == value:
                    open_.append(first + len(told) - 1)
                    if (bounced := decider.feed(value)) is not None:
                        told[open_.popleft() - first] = bounced
            held.append(batch)
            while held and (not open_ or open_[0] - first >= held[0].num_rows):
                done = held.pop(0)
                yield done.select(names).append_column("bounced", pa.array(told[: done.num_rows], pa.bool_()))
                del told[: done.num_rows]
                first += done.num_rows
        close()
        for done in held:
            yield done.select(names).append_column("bounced", pa.array(told[: done.num_rows], pa.bool_()))
            del told[: done.num_rows]

    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, trades.schema.fields, strict=True)], T.StructField("bounced", T.BooleanType())])
    return rows.mapInArrow(run, schema).toDF(*trades.columns, "bounced")


def segment_key(first: str, fallback: str) -> Column:
    """The first id, trimmed, or the other where it is blank."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.col(fallback))
