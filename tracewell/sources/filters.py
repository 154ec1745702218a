"""Filter tables: parquet partitioned by target bucket, legacy three-file import, threshold update."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import cut_lineage


# Targets share this many partitions, so a table of millions of filters stays in few files.
BUCKETS = 16


def _bucketed(filters: DataFrame) -> DataFrame:
    bucketed = filters.withColumn("target_bucket", F.pmod(F.col("target_id"), F.lit(BUCKETS)).cast("int"))
    return bucketed.repartition("target_bucket")


def write_filters(filters: DataFrame, path: str) -> None:
    _bucketed(filters).write.mode("overwrite").partitionBy("target_bucket").parquet(path)


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("target_bucket")


def update_thresholds(spark: SparkSession, path: str, thresholds: DataFrame) -> None:
    """Replaces the threshold of the given (recording_id, target_id); taps stay as they are.

    Only the partitions that hold those targets are rewritten.
    """
    new = thresholds.select("recording_id", "target_id", F.col("threshold").alias("_new"))
    buckets = new.select(F.pmod(F.col("target_id"), F.lit(BUCKETS)).cast("int").alias("target_bucket")).distinct()
    touched = spark.read.parquet(path).join(F.broadcast(buckets), "target_bucket", "left_semi").drop("target_bucket")
    updated = touched.join(new, ["recording_id", "target_id"], "left")
    columns = [c for c in touched.columns if c != "threshold"]
    fresh = cut_lineage(updated.select(*columns, F.coalesce("_new", "threshold").alias("threshold")))
    (
        _bucketed(fresh)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("target_bucket")
        .parquet(path)
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _doubles(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.frombuffer(b, dtype="<f8").tolist())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ints(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.frombuffer(b, dtype="<i4").tolist())


def sized(content: Column, item: int) -> Column:
    """The bytes, or an error when they are not a whole number of items."""
    return F.when(F.length(content) % item == 0, content).otherwise(
        F.raise_error("file size is not a multiple of the value size").cast("binary")
    )


def import_legacy(spark: SparkSession, folder: str, template_length: int) -> DataFrame:
    """channels_<id>.bin (int32), filter_<id>.bin and threshold_<id>.bin (float64) per target.

    Sizes are validated: whole values, taps = template length x channels, one threshold.
    """
    pattern = r"(channels|filter|threshold)_(\d+)\.bin$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.regexp_extract("path", pattern, 1).alias("kind"),
        F.regexp_extract("path", pattern, 2).cast("bigint").alias("target_id"),
        "content",
    ).where("kind <> ''")

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("content"))).alias(kind)

    per_target = files.groupBy("target_id").agg(of("channels"), of("filter"), of("threshold"))
    decoded = per_target.select(
        "target_id",
        _ints(sized(F.col("channels"), 4)).alias("channels"),
        _doubles(sized(F.col("filter"), 8)).alias("taps"),
        _doubles(sized(F.col("threshold"), 8)).alias("_thr"),
    )
    ok = (F.size("taps") == F.size("channels") * template_length) & (F.size("_thr") == 1)
    return decoded.select(
        "target_id",
        "channels",
        F.when(ok, F.col("taps")).otherwise(F.raise_error("filter files do not fit together").cast("array<double>")).alias("taps"),
        F.col("_thr")[0].alias("threshold"),
        F.lit(left_margin(template_length)).alias("left_margin"),
    )


def left_margin(template_length: int) -> int:
    """Samples before the scored one in a centred window."""
    return (template_length - 1) - (template_length - 1) // 2
