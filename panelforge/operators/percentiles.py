"""Exact percentiles of columns whose distinct values don't fit into one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Values between two edges that are put in order by one task; the grid of a sketch, and its precision.
FEW, GRID, PRECISION = 1_000_000, 1_000, 5_000


def percentiles(df: DataFrame, column: str, levels: Sequence[float], by: str | None = None) -> dict[object, list[float]]:
    """By value of ``by`` (None without it): the exact percentiles of the column, linear between two values; nulls are
    left out, and a group without a value isn't in it.

    Sketches only propose edges.  How many values are equal to each edge and between two of them is counted, which says
    between which edges a wanted rank is; these are sketched again while more than FEW values are between them, and then
    put in order.  So the result doesn't depend on the sketches, and no task holds more than a sketch or sorts more than FEW
    values of a group at once.  The values (8 bytes a row, compressed) are kept on the executors' disks meanwhile."""
    group = F.lit(0) if by is None else F.col(by)
    values = df.filter(F.col(column).isNotNull()).select(group.alias("g"), F.col(column).cast("double").alias("v")).persist(StorageLevel.DISK_ONLY)
    try:
        totals = {r.g: r.n for r in values.groupBy("g").agg(F.count("*").alias("n")).collect()}
        ranks = {g: sorted({min(floor((n - 1) * p) + j, n - 1) for p in levels for j in (0, 1)}) for g, n in totals.items()}
        found = _values_at(values, totals, ranks)
    finally:
        values.unpersist()
    out = {g: [_between(found, g, (n - 1) * p, n - 1) for p in levels] for g, n in totals.items()}
    return out if by is not None else {None: x for x in out.values()}


def _between(found: dict, group: object, place: float, last: int) -> float:
    low, high = found[group, floor(place)], found[group, min(floor(place) + 1, last)]
    share = place - floor(place)
    return low + (high - low) * share if share and low != high else low


def _table(like: DataFrame, kinds: list[tuple[str, T.DataType]], rows: list[tuple]) -> DataFrame:
    """A small table of the driver, as a part of the plan.  Rows handed over as Python objects would start Python workers
    on the executors, beside the tasks' memory."""
    schema = to_arrow_schema(T.StructType([T.StructField(n, k) for n, k in kinds]))
    columns = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)]
    return like.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def _with_regions(values: DataFrame, edges: dict[object, list[float]]) -> DataFrame:
    """``region``: the edges below a value and those up to it, together: odd if it is an edge, even between two."""
    width = max(map(len, edges.values()))
    if not width:
        return values.withColumn("region", F.lit(0))
    rows = [(g, *e, *[None] * (width - len(e))) for g, e in edges.items()]
    table = _table(values, [("eg", values.schema["g"].dataType), *[(f"e{k}", T.DoubleType()) for k in range(width)]], rows)
    told = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    region = sum((told(F.col(f"e{k}") < F.col("v")) + told(F.col(f"e{k}") <= F.col("v")) for k in range(width)), F.lit(0))
    return values.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", region.alias("region"))


def _in(rows: DataFrame, wanted: list[tuple], *more: str) -> DataFrame:
    """Rows whose g, region (and more) are wanted."""
    names = ["g", "region", *more]
    table = _table(rows, [(f"w{k}", rows.schema[n].dataType) for k, n in enumerate(names)], wanted)
    same: Column = F.col("g").eqNullSafe(F.col("w0"))
    for k, n in enumerate(names[1:], 1):
        same = same & (F.col(n) == F.col(f"w{k}"))
    return rows.join(F.broadcast(table), same).drop(*[f"w{k}" for k in range(len(names))])


def _values_at(values: DataFrame, totals: dict, ranks: dict) -> dict[tuple, float]:
    """By group and rank (from 0) the value there."""
    edges: dict[object, list[float]] = {g: [] for g in totals}
    counts = {g: {0: n} for g, n in totals.items()}
    found: dict[tuple, float] = {}
    while True:
        wanted: dict[tuple, list[tuple[int, int]]] = {}
        for g, own in ranks.items():
            below = 0
            for region, n in sorted(counts[g].items()):
                for rank in [r for r in own if below <= r < below + n]:
                    if region % 2:
                        found[g, rank] = edges[g][region // 2]
                    else:
                        wanted.setdefault((g, region), []).append((rank, rank - below))
                below += n
        if not wanted:
            return found
        inside = _in(_with_regions(values, edges), list(wanted))
        if max(counts[g][region] for g, region in wanted) <= FEW:
            ranked = inside.withColumn("at", F.row_number().over(Window.partitionBy("g", "region").orderBy("v")))
            places = {(g, region, place + 1): rank for (g, region), own in wanted.items() for rank, place in own}
            told = _in(ranked, list(places), "at").collect()
            return found | {(r.g, places[r.g, r.region, r["at"]]): r.v for r in told}
        sketches = inside.groupBy("g", "region").agg(F.percentile_approx("v", [k / GRID for k in range(GRID + 1)], PRECISION).alias("q")).collect()
        for r in sketches:
            for _, place in wanted[r.g, r.region]:
                at = place * GRID // counts[r.g][r.region]
                edges[r.g] += [r.q[max(0, at - 1)], r.q[min(GRID, at + 2)]]
        edges = {g: sorted({x for x in e if x == x}) + [x for x in e if x != x][:1] for g, e in edges.items()}
        counts = {g: {} for g in totals}
        for r in _with_regions(values, edges).groupBy("g", "region").agg(F.count("*").alias("n")).collect():
            counts[r.g][r.region] = r.n
