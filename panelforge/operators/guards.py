"""Checks that stop a job: unique keys, join cardinality, boundaries, additive counts, valid panels."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if found := duplicate_keys(df, keys).head(3):
        raise GuardError(f"keys {list(keys)} aren't unique: {[tuple(r) for r in found]}")
    return df


def join_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", both: bool = False) -> DataFrame:
    """A join whose right side has at most one row for a key (and the left side too, if ``both``)."""
    require_unique(right, keys)
    if both:
        require_unique(left, keys)
    return left.join(right, list(keys), how)


def require_range(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """No value before ``low`` or after ``high``."""
    seen = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if low is not None and seen.a is not None and seen.a < low or high is not None and seen.b is not None and seen.b > high:
        raise GuardError(f"{column} runs from {seen.a} to {seen.b}, outside {low} to {high}")
    return df


def require_additive(counts: Mapping[str, int], whole: str, parts: Sequence[str]) -> None:
    if counts[whole] != (total := sum(counts[p] for p in parts)):
        raise GuardError(f"{whole} has {counts[whole]} rows, its parts {total}")


def require_panel(df: DataFrame, entity: str, date: str, columns: Sequence[str], reserved: Sequence[str] = ()) -> DataFrame:
    """A panel with these columns, no reserved ones, month-end dates and unique (entity, date)."""
    if missing := [c for c in (entity, date, *columns) if c not in df.columns]:
        raise GuardError(f"the panel has no {missing}")
    if taken := [c for c in reserved if c in df.columns]:
        raise GuardError(f"the panel has reserved columns {taken}")
    if df.filter(F.col(date) != F.last_day(date)).head(1):
        raise GuardError(f"{date} has days that aren't month ends")
    return require_unique(df, [entity, date])


def seam(before: DataFrame, after: DataFrame, date: str, boundary: object) -> DataFrame:
    """All rows of both, the first strictly before the boundary and the second not."""
    require_range(after, date, low=boundary)
    if before.filter(F.col(date) >= F.lit(boundary)).head(1):
        raise GuardError(f"rows before the boundary {boundary} reach it")
    return before.unionByName(after)


def checked_write(df: DataFrame, path: str, rows: int | None = None, partition: Sequence[str] = (), mode: str = "error") -> int:
    """Writes Parquet beside ``path``, reads its row count again, compares, and only then moves it to ``path``; returns
    the count.  A table that fails its check is deleted, and what stood at ``path`` stays.  ``mode``: "error" if there is
    something, or "overwrite"."""
    spark = df.sparkSession
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode not in ("error", "overwrite"):
        raise GuardError(f"unknown mode {mode!r}")
    if mode == "error" and files.exists(at(path)):
        raise GuardError(f"{path} exists")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition).parquet(beside)
        found = spark.read.schema(df.schema).parquet(beside).count()
        if rows is not None and found != rows:
            raise GuardError(f"{path} would have {found} rows, not {rows}")
        files.delete(at(path), True)
        if not files.rename(at(beside), at(path)):
            raise GuardError(f"{beside} can't be moved to {path}")
    finally:
        files.delete(at(beside), True)
    return found


def row_set_hash(df: DataFrame) -> Column:
    """An aggregate that is equal for equal bags of rows, in any order."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
