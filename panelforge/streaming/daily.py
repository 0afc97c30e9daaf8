"""Streaming forms of the daily roll-up.  These go beyond batch panels: late records past the watermark are lost, so
batch stays the form for cancellations, which may refer to records of any age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_daily(events: DataFrame, entity: str, time: str, value: str, weight: str | None = None, late: str = "2 days") -> DataFrame:
    """By entity and day: weighted mean, rows, least and greatest value, as days close behind the watermark."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), entity)
    out = rows.agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("vwap"), F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.to_date("day.start").alias("day"), entity, "vwap", "n", "least", "most")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there now to Parquet and stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
