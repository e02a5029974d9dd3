"""Streaming counterparts of the zonal sums: windowed totals with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files as they arrive."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed_sums(events: DataFrame, zone: str, value: str, ts: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window start, zone, sums, counts); works on streams (with a watermark) and on tables."""
    # A watermark needs a time with a zone; on a table the column is taken as it is.
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    at = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(at.alias("_w"), F.col(zone).alias("zone")).agg(F.sum(value).alias("sums"), F.count(value).alias("counts"))
    return out.select(F.col("_w.start").alias("window_start"), "zone", "sums", "counts")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    """Start a Parquet sink that processes what is there and stops."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
