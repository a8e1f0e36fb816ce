"""Streams of readings and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_readings(spark: SparkSession, path: str, schema: str = "sensor_id string, ts timestamp, kw double", delay: str = "1 hour") -> DataFrame:
    """New Parquet files of a folder as they come, repeated readings dropped within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sensor_id", "ts"])


def stream_resample(df: DataFrame, every: str, delay: str | None = None) -> DataFrame:
    """First value of each bin; late readings count up to the watermark (``delay``, or the one that ``df`` has)."""
    df = df.withWatermark("ts", delay) if delay else df
    return df.groupBy("sensor_id", F.window("ts", every)).agg(F.min_by("kw", "ts").alias("kw")).select("sensor_id", F.col("window.start").alias("ts"), "kw")


def stream_pair(frames: DataFrame, pv: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Frames and power of exactly equal time; state is kept no longer than the watermarks."""
    f = frames.withWatermark("ts", delay).alias("f")
    p = pv.withWatermark("ts", delay).alias("p")
    return f.join(p, F.expr("f.camera_id = p.sensor_id and f.ts = p.ts")).select("f.camera_id", "f.ts", "f.path", "p.kw")
