"""Record matching: cancellations, multiset net-outs, as-of joins, keyed comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cancel(rows: DataFrame, cancels: DataFrame, scope: Sequence[str], own: str, refers: str) -> DataFrame:
    """Rows whose (scope, own number) no cancel record refers to; a blank number refers to nothing.

    Nulls in the scope are equal to each other, as they are when keys are compared as text."""
    named = cancels.filter(F.coalesce(F.trim(refers), F.lit("")) != "").select(*[F.col(c).alias(f"__{c}__") for c in scope], F.col(refers).alias("__ref__")).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}__")) for c in scope] + [F.col(own) == F.col("__ref__")]
    return rows.join(named, on, "left_anti")


def net_out(rows: DataFrame, consumers: DataFrame, keys: Sequence[str], order: Sequence[str], finite: Sequence[str] = ()) -> DataFrame:
    """Each consumer takes away one row with equal keys, the first in order; rows that are left stay.

    Rows whose ``finite`` columns are null, NaN or infinite neither match nor go.  The order has to be total within a
    key: ties of file order need a sequence column.
    """
    ok = lambda: [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in finite]
    every = F.lit(True)
    for c in [*ok(), *[F.col(k).isNotNull() for k in keys]]:
        every = every & c
    pool = consumers.filter(every).groupBy(*keys).agg(F.count("*").alias("__pool__"))
    placed = rows.withColumn("__can__", every).withColumn("__n__", F.row_number().over(Window.partitionBy(*keys, "__can__").orderBy(*order)))
    left = placed.join(pool, list(keys), "left")
    kept = left.filter(~F.col("__can__") | (F.col("__n__") > F.coalesce("__pool__", F.lit(0))))
    return kept.select(*rows.columns)


def dedupe_sides(rows: DataFrame, side: str, kept_side: str, keys: Sequence[str], order: Sequence[str], finite: Sequence[str] = ()) -> DataFrame:
    """Of records that both parties report, the kept side's stay: each cancels one record of the other side."""
    kept = rows.filter(F.col(side) == kept_side)
    others = rows.filter(~F.col(side).eqNullSafe(F.lit(kept_side)))
    return kept.unionByName(net_out(others, kept, keys, order, finite))


#: Seconds of a bucket of a key's times, some 48 days.
ASOF_BUCKET = 1 << 22


def asof(grid: DataFrame, events: DataFrame, key: str, grid_time: str, event_time: str, values: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Every grid row with the values of the key's latest event at or before it.

    An event with null values still wins over earlier ones; of events at one time the last in ``order`` does; a grid
    row without an event gets nulls, as one without a time does, and an event without a time is none.  A key's times are cut into buckets, and the latest event before a bucket comes from
    the buckets' own latest ones: a task sorts a bucket's rows, or a key's buckets, however many events a key has.
    """
    state = F.struct(*[F.col(v) for v in values])
    left = grid.withColumns({"__t__": F.col(grid_time).cast("timestamp"), "__kind__": F.lit(1), "__state__": F.lit(None).cast(events.select(state.alias("s")).schema["s"].dataType)})
    right = events.select(F.col(key), F.col(event_time).cast("timestamp").alias("__t__"), F.lit(0).alias("__kind__"), state.alias("__state__"), *[F.col(o).alias(f"__o{k}__") for k, o in enumerate(order)])
    right = right.filter("__t__ is not null")
    every = left.unionByName(right, allowMissingColumns=True).withColumn("__bucket__", F.floor(F.unix_seconds("__t__") / ASOF_BUCKET))
    last = [F.col("__t__"), F.col("__kind__"), *[F.col(f"__o{k}__") for k in range(len(order))]]
    before = Window.partitionBy(key, "__bucket__").orderBy(*last).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("__found__", F.last("__state__", ignorenulls=True).over(before)).filter("__kind__ = 1")
    buckets = every.groupBy(F.col(key).alias("__k__"), F.col("__bucket__").alias("__b__")).agg(F.max_by("__state__", F.when(F.col("__kind__") == 0, F.struct(*last))).alias("__s__"))
    past = Window.partitionBy("__k__").orderBy("__b__").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("__k__", "__b__", F.last("__s__", ignorenulls=True).over(past).alias("__carried__")).filter("__carried__ is not null")
    found = found.join(carried, F.col(key).eqNullSafe(F.col("__k__")) & (F.col("__bucket__") == F.col("__b__")), "left")
    best = F.coalesce("__found__", "__carried__")
    return found.select(*grid.columns, *[best[v].alias(v) for v in values])


def compare_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows only in either side, rows in both, and the largest difference of a value."""
    a, b = left.select(*keys, F.col(value).alias("__a__"), F.lit(1).alias("__l__")), right.select(*keys, F.col(value).alias("__b__"), F.lit(1).alias("__r__"))
    both = a.join(b, list(keys), "full")
    return both.agg(
        F.count_if(F.col("__r__").isNull()).alias("only_left"),
        F.count_if(F.col("__l__").isNull()).alias("only_right"),
        F.count_if(F.col("__l__").isNotNull() & F.col("__r__").isNotNull()).alias("in_both"),
        F.max(F.abs(F.col("__a__") - F.col("__b__"))).alias("max_abs_diff"),
    )


def pair_records(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Records of both sides under one concept key, in either order: (key, n_left, n_right, side)."""
    count = lambda df, n: df.select(key.alias("key")).groupBy("key").agg(F.count("*").alias(n))
    both = count(left, "n_left").join(count(right, "n_right"), "key", "full")
    side = F.when(F.col("n_right").isNull(), "left").when(F.col("n_left").isNull(), "right").otherwise("both")
    return both.select("key", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), side.alias("side"))
