"""Streaming sources and queries over chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tracewell.session import ROCKSDB, scratch_path


def read_stream(
    spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    """Rows appended as parquet files; the checkpoint replaces polling and retrying."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


# Sample 0 sits one day after the epoch: a stream's first watermark is the epoch itself,
# and rows at or before the watermark count as late.
ORIGIN_MS = 86_400_000


def event_time(sample: Column, fs: float) -> Column:
    """Sample index as a timestamp, for watermarks only."""
    return F.timestamp_micros((sample * F.lit(1e6 / fs) + F.lit(ORIGIN_MS * 1000)).cast("bigint"))


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_turns(start: Callable[[], StreamingQuery], turns: Iterable[Callable[[], None]]) -> None:
    """After each step that adds input, runs the query that `start` starts over what it added."""
    for turn in turns:
        turn()
        start().awaitTermination()


def run_available(stream: DataFrame, mode: str = "append", turns: Iterable[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """Processes everything available, exactly once, and returns the written result.

    `turns`: steps that add input; the query goes on from its checkpoint after each.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    writer: DataStreamWriter = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    run_turns(writer.start, turns)
    return spark.read.schema(stream.schema).parquet(out)
