"""Session construction, shared scratch space and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tracewell", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Chunk rows are megabytes each: few of them per Arrow batch.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Call-site capture costs a round trip per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` when the cluster sets it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context = spark.sparkContext
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared folder and continues from the files.

    Computed once however often it is used afterwards, independent of executors, and
    columnar with known sizes, so later joins are planned on facts.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """cut_lineage, and the shuffle files behind it go now.

    Spark deletes them once the driver has collected its garbage, which may be after the job; a
    chain of stages would have all of them on disk at a time.
    """
    out = cut_lineage(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: rows of one key that one task takes in a salted join
SALTED = 100_000


def join_dimension(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = 20_000,
    spread: str | Column | None = None,
    salts: int = 64,
    stage: bool = True,
    largest: int | None = None,
) -> DataFrame:
    """Join a dimension table; broadcast only when its counted size proves it small.

    The dimension is computed once into a stage (skip with `stage=False` when it already
    is one), so counting it costs a look at file footers. Beyond `max_rows` the big side is
    salted by `spread` (anything well distributed) and the dimension copied per salt, so one
    hot key is still handled by many tasks. The big side's largest key (`largest` rows,
    counted if not given) tells how many salts it takes: where no key is hot nothing is copied.
    """
    if stage:
        small = cut_lineage(small)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    if spread is None or how not in ("inner", "left", "left_semi"):
        return big.join(small, on, how)
    if largest is None:
        largest = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    salts = min(salts, 1 + largest // SALTED)
    if salts == 1:
        return big.join(small, on, how)
    by = spread if isinstance(spread, Column) else F.col(spread)
    salted = big.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
