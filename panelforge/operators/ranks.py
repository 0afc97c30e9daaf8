"""Ranks and groups within a cross-section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, column: str, group: Sequence[str], out: str) -> DataFrame:
    """1-based ranks of the values in each group, equal values sharing the mean of their ranks; null stays null."""
    order = Window.partitionBy(*group, F.col(column).isNull()).orderBy(column)
    equal = Window.partitionBy(*group, column)
    rank = F.rank().over(order) + (F.count("*").over(equal) - 1) / 2
    return df.withColumn(out, F.when(F.col(column).isNotNull(), rank))


def rank_map(df: DataFrame, column: str, group: Sequence[str], out: str, demean: bool = False) -> DataFrame:
    """Average ranks mapped to [-0.5, 0.5] by (rank - 1) / (largest rank - 1) - 0.5; a single value maps to 0."""
    rows = average_rank(df, column, group, "__rank__")
    most = F.max("__rank__").over(Window.partitionBy(*group))
    rows = rows.withColumn(out, F.when(F.col("__rank__").isNull(), F.lit(None)).when(most > 1, (F.col("__rank__") - 1) / (most - 1) - 0.5).otherwise(0.0)).drop("__rank__")
    return rows.withColumn(out, F.col(out) - F.avg(out).over(Window.partitionBy(*group))) if demean else rows


def quantile_group(value: str, entity: str, groups: int, within: Sequence[str], rows: Column | None = None) -> Column:
    """Group 0 to groups - 1 of each row: floor((rank - 1) * groups / rows), ranks by (value, entity).  This isn't
    ntile, which deals the rows that are left over to the first groups.  ``rows``: their number, if it is known."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(value, entity)) - 1
    return F.floor(place * groups / (F.count("*").over(Window.partitionBy(*within)) if rows is None else rows)).cast("int")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; the order has to be total."""
    return df.withColumn("__n__", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n__") <= k).drop("__n__")


def extremes(df: DataFrame, group: Sequence[str], value: str, entity: str, fraction: int) -> DataFrame:
    """``leg``: +1 for the highest n // fraction values of a group, -1 for the lowest, ties by entity."""
    n = F.count(value).over(Window.partitionBy(*group))
    up = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last(), entity))
    down = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), F.col(entity).desc()))
    legs = df.withColumns({"__n__": F.floor(n / fraction), "__up__": up, "__down__": down})
    return legs.withColumn("leg", F.when(F.col("__down__") <= F.col("__n__"), 1).when(F.col("__up__") <= F.col("__n__"), -1)).filter("leg is not null").drop("__n__", "__up__", "__down__")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a stated order (dropDuplicates takes any)."""
    return top_k(df, keys, order, 1)
