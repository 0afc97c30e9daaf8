"""Views of a panel with several column families, events of an entity, cuts of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import GuardError, require_unique


def select_family(panel: DataFrame, family: str, families: Sequence[str]) -> DataFrame:
    """The columns ``<base>_<family>`` as ``<base>``, those of other families gone, shared ones kept."""
    if family not in families:
        raise GuardError(f"no family {family!r}")
    out = []
    for name in panel.columns:
        owner = next((f for f in sorted(families, key=len, reverse=True) if name.endswith(f"_{f}")), None)
        if owner is None:
            out.append(F.col(name))
        elif owner == family:
            out.append(F.col(name).alias(name[: -len(family) - 1]))
    return panel.select(*out)


def signal_column(columns: Sequence[str], signal: str, family: str, families: Sequence[str]) -> str:
    """The column of a signal in a family; an error if only other families have it."""
    if (name := f"{signal}_{family}") in columns:
        return name
    if others := [f for f in families if f"{signal}_{f}" in columns]:
        raise GuardError(f"{signal} is there for {others}, not for {family}")
    if signal in columns:
        return signal
    raise GuardError(f"no signal {signal}")


def drop_exits(panel: DataFrame, reason: str, dropped: Sequence[str]) -> DataFrame:
    """Without terminal rows of these reasons; other reasons and none stay."""
    return panel.filter(~F.coalesce(F.col(reason).isin(*dropped), F.lit(False)))


def with_signals(panel: DataFrame, signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return panel.join(require_unique(signals, keys), list(keys), "left")


def view(panel: DataFrame, family: str, families: Sequence[str], keys: Sequence[str], *, stale_days: int | None = None, drop_reasons: Sequence[str] = (), signals: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """One family of a panel, stale prices masked, exit rows dropped, and its signals joined."""
    from .signals import stale_mask

    out = select_family(panel, family, families)
    if stale_days is not None:
        out = stale_mask(out, keys[0], keys[1], "last_trade_date", stale_days, "price_eom", [c for c in ("ret", "xret") if c in out.columns])
    if drop_reasons:
        out = drop_exits(out, "exit_reason", drop_reasons)
    if signals is not None:
        chosen = [F.col(signal_column(signals.columns, n, family, families)).alias(n) for n in names]
        out = with_signals(out, signals.select(*keys, *chosen), keys)
    return out


def month_cut(panel: DataFrame, date: str, start: str, end: str, wall: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``; an error if ``end`` is past the wall."""
    if wall is not None and end > wall:
        raise GuardError(f"{end} is past {wall}")
    return panel.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def common_months(cells: DataFrame, cell: str, date: str) -> DataFrame:
    """Months that every cell has."""
    total = cells.agg(F.count_distinct(cell).alias("__all__"))
    return cells.groupBy(date).agg(F.count_distinct(cell).alias("__n__")).join(F.broadcast(total), F.col("__n__") == F.col("__all__")).select(date)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side with where they are: left, right or both."""
    a, b = left.select(key).distinct().withColumn("__a__", F.lit(1)), right.select(key).distinct().withColumn("__b__", F.lit(1))
    side = F.when(F.col("__b__").isNull(), "left").when(F.col("__a__").isNull(), "right").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


class Concepts:
    """Which column carries a concept: a function of the concept, and no column carries two."""

    def __init__(self, table: Mapping[str, str]) -> None:
        columns = list(table.values())
        if twice := sorted({c for c in columns if columns.count(c) > 1}):
            raise GuardError(f"columns of two concepts: {twice}")
        self.table = dict(table)

    def column(self, concept: str) -> str:
        if concept not in self.table:
            raise GuardError(f"no column carries {concept!r}")
        return self.table[concept]


def window_coverage(panel: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """One row: the months of a closed range, how many of them the panel has, and those that it lacks."""
    months = panel.sparkSession.range(1).select(F.explode(F.sequence(F.last_day(F.lit(start).cast("date")), F.last_day(F.lit(end).cast("date")), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("m"))
    there = panel.select(F.last_day(date).alias("m")).distinct().withColumn("there", F.lit(1))
    both = months.join(there, "m", "left")
    return both.agg(F.count("*").alias("expected"), F.count("there").alias("present"), F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.col("m")))).alias("missing"))
