"""Streams that are stopped and go on: deliveries, runs from a checkpoint, and a sink that a repeated batch doesn't double."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a replay's state; a stream keeps the number that it began with.
STATE_PARTITIONS = 4


def deliver(df: DataFrame, inbox: str) -> None:
    """Add files with the rows of ``df`` to the folder that a stream reads."""
    df.write.mode("append").parquet(inbox)


def run_available(stream: DataFrame, sink: str, checkpoint: str, before_commit: Callable[[int], None] | None = None, state_partitions: int = STATE_PARTITIONS) -> None:
    """Take in what is there from where the checkpoint ends, then stop.

    Each micro-batch is written to a folder of its own number, in place of what an interrupted try left there: a batch that is
    repeated after a failure isn't doubled. ``before_commit`` is called with a batch's number between its writing and its commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if before_commit:
            before_commit(number)

    spark = stream.sparkSession
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    query.awaitTermination()


def read_sink(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """All rows of the sink; batches without a row leave nothing."""
    return spark.read.schema(f"{schema}, batch int").parquet(sink).drop("batch")


def replay(streams: Callable[[], DataFrame], deliveries: Iterable[list[tuple[DataFrame, str]]], sink: str, checkpoint: str, schema: str) -> DataFrame:
    """The sink after a run for each delivery (tables with their inboxes): the stream is built anew and goes on each time."""
    spark = None
    for tables in deliveries:
        for df, inbox in tables:
            deliver(df, inbox)
            spark = df.sparkSession
        run_available(streams(), sink, checkpoint)
    return read_sink(spark, sink, schema)


def slices(df: DataFrame, cuts: list[str], ts: str = "ts") -> list[DataFrame]:
    """``df`` cut by time: before the first cut, from each cut to the next, and from the last on."""
    ends = [None, *cuts, None]
    between = lambda a, b: F.lit(True) if a is None else F.col(ts) >= F.lit(a).cast("timestamp")
    return [df.where(between(a, b) & (F.lit(True) if b is None else F.col(ts) < F.lit(b).cast("timestamp"))) for a, b in zip(ends, ends[1:], strict=False)]
