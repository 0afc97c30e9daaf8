"""Reading and writing tables: raw record files, series, partitioned and split sinks, reports."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import year_month
from ..functions.numbers import nan_to_null
from ..functions.text import canonical_json
from ..operators.guards import GuardError, require_range
from ..operators.ranks import keep_one
from ..operators.views import view


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, sequence: str | None = None, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """CSV records with a header, gzipped or not, all or some of their columns (the reader parses no others); malformed
    lines are dropped.  ``sequence`` numbers the rows in file
    order, for steps where that order breaks ties: a gzipped file is one partition, so the numbers follow its lines."""
    rows = spark.read.schema(schema).options(header="true", mode="DROPMALFORMED", **options).csv(path)
    rows = rows.select(*columns) if columns else rows
    return rows.withColumn(sequence, F.monotonically_increasing_id()) if sequence else rows


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """Chosen columns of a Parquet table, NaN as null; with ``until`` an error if a date is past it."""
    rows = spark.read.parquet(path)
    rows = nan_to_null(rows.select(*columns) if columns else rows)
    return require_range(rows, until[0], high=until[1]) if until else rows


def read_series(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A dated series of two CSV columns, a dot for a missing value: (date, value)."""
    rows = spark.read.schema("date string, v string").option("header", "true").csv(path)
    return rows.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.col("v").try_cast("double").alias(value)).filter("date is not null")


def risk_free(annual_percent: DataFrame, value: str) -> DataFrame:
    """(year_month, rf_monthly) from a monthly series of yearly per cents."""
    return annual_percent.select(F.date_format("date", "yyyy-MM").alias("year_month"), (F.col(value) / 100 / 12).alias("rf_monthly")).filter("rf_monthly is not null")


def lower_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed and in small letters; an error if that makes two equal."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise GuardError(f"columns are equal but for case: {sorted(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names)


def sniff(raw: bytes) -> str:
    """What a payload is: parquet, xlsx, zip, gzip, csv or unknown."""
    if raw[:4] == b"PAR1":
        return "parquet"
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as box:
            return "xlsx" if any(n.startswith("xl/") for n in box.namelist()) else "zip"
    head = raw[:4096].split(b"\n", 1)[0]
    return "csv" if head.count(b",") or head.count(b"\t") else "unknown"


#: Names under which a date stands, in the order in which they are tried.
DATE_NAMES = ("date", "yyyymm", "year_month", "month", "observation_date", "time")


def by_month(df: DataFrame, date: str | None = None, until: str | None = None) -> DataFrame:
    """``df`` with year_month from a date or yyyymm column (the first of DATE_NAMES that it has, if none is named), the
    first row of each month in order of the other columns, up to ``until``."""
    date = date or find_column(df.columns, DATE_NAMES)
    rows = df.withColumn("year_month", year_month(F.col(date))).filter("year_month is not null")
    rows = rows.filter(F.col("year_month") <= until) if until else rows
    return keep_one(rows, ["year_month"], [F.col(c) for c in df.columns])


def write_by_period(df: DataFrame, path: str, date: str, boundary_year: int, end_year: int, names: tuple[str, str] = ("dev", "holdout")) -> None:
    """Partitions by whether the year is before the boundary; an error if one is past the end."""
    year = F.year(date)
    if df.filter(year > end_year).head(1):
        raise GuardError(f"{date} has years past {end_year}")
    df.withColumn("period", F.when(year < boundary_year, names[0]).otherwise(names[1])).write.partitionBy("period").parquet(path)


def split_write(df: DataFrame, keep: Column, kept_path: str, dropped_path: str) -> dict[str, int]:
    """Kept and dropped rows to two tables, and how many there are of each; a null condition drops.

    The input is computed once, to a table beside the first one with a folder for each kind, and the folders are moved."""
    spark = df.sparkSession
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    files = at(kept_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path in (kept_path, dropped_path):
        if files.exists(at(path)):
            raise GuardError(f"{path} exists")
    beside, flag = f"{kept_path.rstrip('/')}.{uuid.uuid4().hex}", "__kept__"
    seen, mark = Observation(beside), F.coalesce(keep, F.lit(False)).cast("int")
    try:
        counts = [F.count("*").alias("n"), F.coalesce(F.sum(flag), F.lit(0)).alias("kept")]
        df.withColumn(flag, mark).observe(seen, *counts).write.partitionBy(flag).parquet(beside)
        for path, value in ((kept_path, 1), (dropped_path, 0)):
            if files.exists(at(f"{beside}/{flag}={value}")):
                files.rename(at(f"{beside}/{flag}={value}"), at(path))
            else:
                df.limit(0).write.parquet(path)
    finally:
        files.delete(at(beside), True)
    found = seen.get
    return {"kept": found["kept"], "dropped": found["n"] - found["kept"]}


def with_metadata(df: DataFrame, column: str, values: Mapping[str, object]) -> DataFrame:
    """Key/value metadata on a column, which Parquet files keep."""
    return df.withColumn(column, F.col(column).alias(column, metadata=dict(values)))


def config_hash(config: Mapping[str, object]) -> str:
    """A hash that doesn't depend on the order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def stage_report(stage: str, counts: Mapping[str, int], config: Mapping[str, object]) -> str:
    """A stage's counts and configuration as canonical JSON; numbers that aren't finite are null."""
    return canonical_json({"stage": stage, "counts": dict(counts), "config_sha256": config_hash(config)})


def export_panel(panel: DataFrame, signals: DataFrame, path: str, columns: Sequence[str], families: Sequence[str] = ("raw", "corr"), exits: Sequence[str] = ("defaulted",)) -> int:
    """Writes the corrected view of a panel, without stale masks and without terminal rows of ``exits``, with its signals,
    one row of each entity and date and just ``columns``, of which none may be missing; returns its content hash."""
    keys = list(panel.columns[:2])
    names = [c.removesuffix(f"_{families[1]}") for c in signals.columns if c.endswith(f"_{families[1]}")]
    rows = view(panel, families[1], families, keys, drop_reasons=exits, signals=signals, names=names)
    if missing := [c for c in columns if c not in rows.columns]:
        raise GuardError(f"the view has no {missing}")
    rows = keep_one(rows, keys, [F.col(c) for c in columns]).select(*columns)
    rows.sortWithinPartitions(*keys).write.parquet(path)
    return content_hash(panel.sparkSession.read.parquet(path))


def find_column(columns: Sequence[str], wanted: Sequence[str]) -> str:
    """The first of the wanted names that a table has, blanks and case aside; an error if it has none."""
    named = {c.strip().lower(): c for c in columns}
    for name in wanted:
        if name.strip().lower() in named:
            return named[name.strip().lower()]
    raise GuardError(f"none of {list(wanted)} in {list(columns)}")


def content_hash(df: DataFrame) -> int:
    """A number that is equal for equal bags of rows."""
    from ..operators.guards import row_set_hash

    return int(df.agg(row_set_hash(df)).first()[0] or 0)
