"""Trigger sink: decision rows and output pulses from one streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.intervals import merge_intervals


def write_triggers(decisions: DataFrame, folder: str, checkpoint: str, pulse: int):
    """Starts a query that writes both outputs per batch.

    A batch overwrites its own folder, so a replayed batch leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch_id}")
        high = kept.where("outcome = 'TRIGGER'").select(
            "recording_id", F.col("trigger_sample").alias("start"), (F.col("trigger_sample") + pulse).alias("end")
        )
        high.write.mode("overwrite").parquet(f"{folder}/pulses/batch={batch_id}")
        kept.unpersist()

    return (
        decisions.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def output_line(spark: SparkSession, folder: str) -> DataFrame:
    """High intervals of the output line over all batches: overlapping pulses merged."""
    pulses = spark.read.parquet(f"{folder}/pulses").drop("batch")
    return merge_intervals(pulses, ["recording_id"], F.col("start"), F.col("end"))
