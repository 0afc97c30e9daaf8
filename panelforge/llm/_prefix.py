"""Distributed prefix sums in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import free_name

#: Hash keys are whole numbers from 0 to under KEYS.
KEYS = 1 << 60
#: Rows of a bucket, on average: what one task sorts for one window at most, give or take the spread of the hash.
BUCKET_ROWS = 1_000


def hash_key(seed: str, *columns: Column) -> Column:
    """A uniform key of 60 bits from md5, which other engines compute alike; null counts as an empty string."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


#: Parts that the rows of one key are dealt to where they meet a table with a row a key.
SALTS = 1024
#: Buckets that one window adds up; more are themselves put in buckets, so that no window grows with the table.
LEVEL_ROWS = 4_096


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], key: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same group before this one (without a ``group``,
    of all rows).

    Rows stand by ``order``, which has to begin with the uniform hash ``key``: equal ranges of it are buckets of about
    equal size, whose sums are added up before the rows of each bucket are.  However large a group is, no task sorts
    more than a bucket, or more than LEVEL_ROWS sums of buckets: those are added up in two levels.  Groups are compared
    null-safe.  Columns of ``df`` may have any names: those made on the way avoid them.
    """
    n, bucket, part, offset, total = (free_name([*df.columns, out], x) for x in ("n", "bucket", "part", "offset", "total"))
    if group:
        dealt = df.withColumn(part, F.pmod(F.xxhash64(_col(key)), F.lit(SALTS)).cast("int"))
        some = dealt.groupBy(*_named(group), part).agg(F.count("*").alias(total))
        whole = some.groupBy(*_named(group)).agg(F.sum(total).alias(n))
        wide = _join(dealt, _join(some.drop(total), whole, group), [*group, part]).drop(part)
    else:
        wide = df.withColumn(n, F.lit(df.count()).cast("long"))
    buckets = F.ceil(F.col(n) / F.lit(BUCKET_ROWS))
    wide = wide.withColumn(bucket, F.least(F.floor(_col(key) / F.lit(float(KEYS)) * buckets), buckets - 1)).drop(n)
    sums = wide.groupBy(*_named(group), bucket).agg(F.sum(_col(value)).alias(total))
    sums = sums.withColumn(part, F.floor(F.col(bucket) / LEVEL_ROWS))
    over = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy(*_named(group), part).agg(F.sum(total).alias(n))
    parts = parts.withColumn(offset, F.coalesce(F.sum(n).over(over(_named(group), part)), F.lit(0))).drop(n)
    sums = sums.withColumn(total, F.coalesce(F.sum(total).over(over([*_named(group), part], bucket)), F.lit(0)))
    sums = _join(sums, parts, [*group, part]).withColumn(offset, F.col(offset) + F.col(total)).drop(part, total)
    wide = _join(wide, sums, [*group, bucket])
    inside = Window.partitionBy(*_named(group), bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return wide.withColumn(out, F.col(offset) + F.coalesce(F.sum(_col(value)).over(inside), F.lit(0))).drop(offset, bucket)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _named(names: list[str]) -> list[Column]:
    return [_col(n) for n in names]


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, null-safe."""
    keys = {c: free_name([*left.columns, *right.columns], f"on{k}") for k, c in enumerate(on)}
    right = right.select(*[_col(c).alias(keys.get(c, c)) for c in right.columns])
    return left.join(right, [_col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]).drop(*keys.values())


def attach(rows: DataFrame, table: DataFrame, by: list[str], salt: str) -> DataFrame:
    """``rows`` that have a row in ``table`` (one for each value of ``by``, none null), with its columns.

    Rows of one key are dealt to SALTS parts by ``salt``, and each part that occurs gets a copy of the key's row: so a
    key that a third of all rows have is no task's burden, and nothing is broadcast.
    """
    part = free_name([*rows.columns, *table.columns], "part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(_col(salt)), F.lit(SALTS)).cast("int"))
    places = dealt.select(*_named(by), part).distinct().join(table, by)
    return dealt.join(places, [*by, part]).drop(part)


def dealt_totals(rows: DataFrame, by: list[str], salt: str, parts: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with ``totals`` of their group, which are aggregates of ``parts``, aggregates of the group's rows of one
    salt: no task sees more of a group than that."""
    part = free_name([*rows.columns, *parts, *totals], "part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(_col(salt)), F.lit(SALTS)).cast("int"))
    some = dealt.groupBy(*_named(by), part).agg(*[c.alias(n) for n, c in parts.items()])
    whole = some.groupBy(*_named(by)).agg(*[c.alias(n) for n, c in totals.items()])
    places = some.select(*_named(by), part).join(whole, by)
    return dealt.join(places, [*by, part]).drop(part)
