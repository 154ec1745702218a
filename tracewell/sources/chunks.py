"""Chunk rows: the dense form of a recording.

A chunk row holds all channels of a short stretch, time-major:
`recording_id, chunk_id, start_sample, n_samples, channels ARRAY<INT>, values ARRAY<DOUBLE>`
with `chunk_id = start_sample div chunk length`. Rows with a halo also carry `lead` and
`trail`: how many samples of neighbouring chunks were added on each side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.blocks import block_of
from tracewell.session import join_dimension

COLUMNS = ["recording_id", "chunk_id", "start_sample", "n_samples", "channels", "values"]


def pack(
    long: DataFrame,
    length: int,
    sample: str = "sample",
    channel: str = "channel",
    value: str = "value",
) -> DataFrame:
    """(recording_id, sample, channel, value) -> chunk rows of up to `length` samples.

    A chunk must be a full rectangle; a hole inside one is an error, a missing chunk is a
    gap that every operator treats as a restart.
    """
    cell = F.struct(F.col(sample).cast("bigint").alias("s"), F.col(channel).cast("int").alias("c"), F.col(value).cast("double").alias("v"))
    grouped = long.groupBy("recording_id", block_of(sample, length).alias("chunk_id")).agg(
        F.array_sort(F.collect_list(cell)).alias("_cells"),
        F.sort_array(F.collect_set(F.col(channel).cast("int"))).alias("channels"),
    )
    start = F.col("_cells")[0]["s"]
    n = (F.element_at("_cells", -1)["s"] - start + 1).cast("int")
    full = F.size("_cells") == n * F.size("channels")
    return grouped.select(
        "recording_id",
        "chunk_id",
        start.alias("start_sample"),
        F.when(full, n).otherwise(F.raise_error("hole inside a chunk").cast("int")).alias("n_samples"),
        "channels",
        F.transform("_cells", lambda cell: cell["v"]).alias("values"),
    )


def unpack(chunks: DataFrame, value: str = "value") -> DataFrame:
    """Chunk rows -> (recording_id, sample, channel, value), without leaving the JVM."""
    width = F.size("channels")
    return chunks.select("recording_id", "start_sample", "channels", F.posexplode("values").alias("_i", value)).select(
        "recording_id",
        (F.col("start_sample") + F.floor(F.col("_i") / width)).cast("bigint").alias("sample"),
        F.element_at("channels", (F.col("_i") % width + 1).cast("int")).alias("channel"),
        value,
    )


def unpack_scores(scored: DataFrame) -> DataFrame:
    """Score chunks (recording_id, target_id, start_sample, scores) -> one row per sample."""
    return scored.select(
        "recording_id", "target_id", "start_sample", F.posexplode("scores").alias("_i", "score")
    ).select("recording_id", "target_id", (F.col("start_sample") + F.col("_i")).alias("sample"), "score")


def attach_halo(chunks: DataFrame, length: int, before: int, after: int) -> DataFrame:
    """Extends `values` by up to `before`/`after` samples of the contiguous neighbours.

    Only the border pieces are grouped and shuffled by chunk key; the chunk payload moves
    at most once, and not at all when the table is bucketed by (recording_id, chunk_id) or
    when the scan already delivered the halo. A halo shorter than requested therefore
    always means the recording starts, ends or has a gap there.
    """
    width = F.size("channels")
    end = F.col("start_sample") + F.col("n_samples")
    backs = -(-before // length)
    fronts = -(-after // length)
    hops = [h for h in range(-fronts, backs + 1) if h != 0]

    def piece(hop: int) -> Column:
        border = (F.col("chunk_id") + hop) * F.lit(length)
        if hop > 0:  # goes to a later chunk: the samples just before its border
            first = F.greatest(F.col("start_sample"), border - before)
            last = end
        else:  # goes to an earlier chunk: the samples just after its end
            first = F.col("start_sample")
            last = F.least(end, border + length + after)
        count = F.greatest(last - first, F.lit(0)).cast("int")
        offset = (first - F.col("start_sample")).cast("int")
        return F.struct(
            (F.col("chunk_id") + hop).alias("to"),
            first.alias("first"),
            (first + count).alias("last"),
            F.slice("values", offset * width + 1, count * width).alias("v"),
        )

    if not hops:
        return chunks.withColumn("lead", F.lit(0)).withColumn("trail", F.lit(0))
    pieces = (
        chunks.select("recording_id", F.explode(F.array(*[piece(h) for h in hops])).alias("p"))
        .where("p.last > p.first")
        .groupBy("recording_id", F.col("p.to").alias("chunk_id"))
        .agg(F.array_sort(F.collect_list(F.struct("p.first", "p.last", "p.v"))).alias("_pieces"))
    )
    joined = chunks.join(pieces, ["recording_id", "chunk_id"], "left")
    none = F.array().cast("array<double>")
    left = F.reverse(F.filter("_pieces", lambda p: p["last"] <= F.col("start_sample")))
    right = F.filter("_pieces", lambda p: p["first"] >= end)

    def grown(side: Column, at: Column, backwards: bool) -> Column:
        zero = F.struct(at.cast("bigint").alias("at"), none.alias("v"))

        def step(acc: Column, p: Column) -> Column:
            if backwards:
                joins, at_next, v = p["last"] == acc["at"], p["first"], F.concat(p["v"], acc["v"])
            else:
                joins, at_next, v = p["first"] == acc["at"], p["last"], F.concat(acc["v"], p["v"])
            return F.when(joins, F.struct(at_next.alias("at"), v.alias("v"))).otherwise(acc)

        return F.aggregate(F.coalesce(side, F.array()), zero, step)

    shaped = joined.withColumn("_l", grown(left, F.col("start_sample"), True)).withColumn(
        "_r", grown(right, end, False)
    )
    others = [c for c in chunks.columns if c != "values"]
    return shaped.select(
        *others,
        F.concat("_l.v", "values", "_r.v").alias("values"),
        (F.col("start_sample") - F.col("_l.at")).cast("int").alias("lead"),
        (F.col("_r.at") - end).cast("int").alias("trail"),
    )


def fetch(
    chunks: DataFrame,
    start: int | Column,
    max_samples: int,
    channels: list[int] | None = None,
    downsample: int = 1,
) -> DataFrame:
    """Long rows of [start, start + max_samples), every `downsample`-th counted from start.

    Chunks outside the range are pruned on `start_sample` before any value is unpacked.
    """
    first = start if isinstance(start, Column) else F.lit(start)
    inside = chunks.where(
        (F.col("start_sample") < first + max_samples)
        & (F.col("start_sample") + F.col("n_samples") > first)
    )
    rows = unpack(inside).where(
        (F.col("sample") >= first) & (F.col("sample") < first + max_samples)
    )
    if downsample > 1:
        rows = rows.where((F.col("sample") - first) % downsample == 0)
    if channels is not None:
        rows = rows.where(F.col("channel").isin([int(c) for c in channels]))
    return rows


def fetch_latest(
    chunks: DataFrame, n: int, channels: list[int] | None = None, downsample: int = 1
) -> DataFrame:
    """The last `n` samples of every recording, or all of them when it is shorter."""
    ends = chunks.groupBy("recording_id").agg(
        F.max(F.col("start_sample") + F.col("n_samples")).alias("_end"),
        F.min("start_sample").alias("_first"),
    )
    from_sample = F.greatest(F.col("_end") - n, F.col("_first"))
    bounded = join_dimension(chunks, ends.select("recording_id", from_sample.alias("_from")), ["recording_id"], spread="chunk_id")
    late = bounded.where(F.col("start_sample") + F.col("n_samples") > F.col("_from"))
    rows = late.select(
        "recording_id", "start_sample", "channels", "_from", F.posexplode("values").alias("_i", "value")
    )
    width = F.size("channels")
    rows = rows.select(
        "recording_id",
        (F.col("start_sample") + F.floor(F.col("_i") / width)).cast("bigint").alias("sample"),
        F.element_at("channels", (F.col("_i") % width + 1).cast("int")).alias("channel"),
        "value",
        "_from",
    ).where("sample >= _from")
    if downsample > 1:
        rows = rows.where((F.col("sample") - F.col("_from")) % downsample == 0)
    if channels is not None:
        rows = rows.where(F.col("channel").isin([int(c) for c in channels]))
    return rows.drop("_from")


def to_volts(long: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Counts -> volts with one multiplier per channel (channel, volts_per_count)."""
    return join_dimension(long, multipliers, ["channel"], spread="sample").withColumn(
        "volts", F.col("value") * F.col("volts_per_count")
    ).drop("volts_per_count")


def threshold_counts(volts: Column, volts_per_count: Column) -> Column:
    """A threshold in volts expressed in counts."""
    return volts / volts_per_count


def decode_int16(data: bytes, n_channels: int) -> np.ndarray:
    """Raw time-major int16 bytes -> (n, n_channels); a trailing partial sample is dropped."""
    usable = len(data) // (2 * n_channels) * n_channels
    return np.frombuffer(data, dtype="<i2", count=usable).reshape(-1, n_channels)


def write_bucketed(chunks: DataFrame, table: str, buckets: int) -> None:
    """Chunk table bucketed by chunk key: later joins on it shuffle only the small side."""
    (
        chunks.write.mode("overwrite")
        .bucketBy(buckets, "recording_id", "chunk_id")
        .sortBy("recording_id", "chunk_id")
        .saveAsTable(table)
    )
