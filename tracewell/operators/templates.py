"""Snippets, mean waveforms, channel and interferer selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.signal import arrow_schema, blocks_of, emit, map_blocks
from tracewell.blocks import block_of
from tracewell.session import join_dimension
from tracewell.sources.chunks import attach_halo

SNIPPETS = "recording_id string, unit_id bigint, spike_time bigint, values array<double>"
PARTIALS = "recording_id string, unit_id bigint, channels array<int>, sums array<double>, n bigint"
# Partial sums held by one task before they are passed on.
HELD = 8_000_000


def lengths_of(chunks: DataFrame) -> DataFrame:
    """Samples per recording, from the chunk headers only."""
    return chunks.groupBy("recording_id").agg(
        F.max(F.col("start_sample") + F.col("n_samples")).alias("n_samples")
    )


def clip_length(chunks: DataFrame, spikes: DataFrame, fs: float) -> DataFrame:
    """Usable length per recording: up to one second after the last spike."""
    last = spikes.groupBy("recording_id").agg(F.max("spike_time").alias("_last"))
    return lengths_of(chunks).join(last, "recording_id").select(
        "recording_id",
        F.least(F.col("n_samples"), F.floor(F.col("_last") + F.lit(float(fs))).cast("bigint")).alias("n_samples"),
    )


def clip_chunks(long: DataFrame, limits: DataFrame) -> DataFrame:
    """Long rows below the usable length of their recording."""
    return (
        join_dimension(long, limits.select("recording_id", F.col("n_samples").alias("_n")), ["recording_id"], spread="sample")
        .where(F.col("sample") < F.col("_n"))
        .drop("_n")
    )


def split_at(lengths: DataFrame, fraction: float | Column) -> DataFrame:
    """Train/test boundary per recording: floor(fraction * n)."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return lengths.select("recording_id", F.floor(F.col("n_samples") * share).cast("bigint").alias("split"))


def train_part(rows: DataFrame, splits: DataFrame, time: str) -> DataFrame:
    return join_dimension(rows, splits, ["recording_id"], spread=time).where(F.col(time) < F.col("split")).drop("split")


def test_part(rows: DataFrame, splits: DataFrame, time: str) -> DataFrame:
    """Rows from the split on, with times counted from the split."""
    late = join_dimension(rows, splits, ["recording_id"], spread=time).where(F.col(time) >= F.col("split"))
    return late.withColumn(time, F.col(time) - F.col("split")).drop("split")


def valid_spikes(spikes: DataFrame, lengths: DataFrame, template_length: int, offset: int) -> DataFrame:
    """Spikes far enough from both recording ends: t > offset and t < n - length + offset."""
    n = lengths.select("recording_id", F.col("n_samples").alias("_n"))
    t = F.col("spike_time")
    return (
        join_dimension(spikes, n, ["recording_id"], spread="spike_time")
        .where((t > offset) & (t < F.col("_n") - template_length + offset))
        .drop("_n")
    )


def cap_per_group(
    df: DataFrame, keys: Sequence[str], limit: int, order: Column, salts: int = 64
) -> DataFrame:
    """At most `limit` rows per group, the first ones by `order`.

    Two stages: the first ones of every salted part, then the first ones of those, so a
    group holding most of the rows is still ranked by many tasks.
    """
    ranked = df.withColumn("_order", order).withColumn(
        "_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    )
    part = Window.partitionBy(*keys, "_salt").orderBy("_order")
    first = ranked.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= limit)
    whole = Window.partitionBy(*keys).orderBy("_order")
    return (
        first.withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= limit)
        .drop("_rank", "_salt", "_order")
    )


def hash_order(seed: int, *columns: str) -> Column:
    """The default order for sampling: reproducible and independent of partitioning."""
    return F.xxhash64(F.lit(seed), *columns)


def with_spikes(chunks: DataFrame, spikes: DataFrame, length: int) -> DataFrame:
    """Chunk rows joined with the spikes that fall into them; chunks without spikes drop out.

    A chunk covers a few seconds, so its spike list is bounded by time, not by data size.
    """
    lists = spikes.groupBy("recording_id", block_of("spike_time", length).alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("spike_time", F.col("unit_id").cast("bigint").alias("unit_id")))).alias("spikes")
    )
    return chunks.join(lists, ["recording_id", "chunk_id"])


def snippets(
    chunks: DataFrame,
    length: int,
    spikes: DataFrame,
    template_length: int,
    offset: int,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """One row per valid spike: its window, flattened channel by channel."""
    lengths = lengths_of(chunks) if lengths is None else lengths
    valid = valid_spikes(spikes, lengths, template_length, offset)
    ready = with_spikes(attach_halo(chunks, length, offset, template_length), valid, length)

    def cut(block):
        for spike in block.row["spikes"]:
            at = spike["spike_time"] - block.start + block.lead - offset
            if 0 <= at <= len(block.x) - template_length:
                window = block.x[at : at + template_length]
                yield (block.recording_id, spike["unit_id"], spike["spike_time"], window.T.ravel())

    return map_blocks(ready, cut, SNIPPETS)


def mean_waveforms(
    chunks: DataFrame,
    length: int,
    spikes: DataFrame,
    template_length: int,
    offset: int,
    max_spikes: int | None = None,
    order: Column | None = None,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Spike-triggered average per unit: (recording_id, unit_id, k, channel, value, n_used).

    Windows are summed inside the task that holds the chunk; only one partial sum per unit
    and task is shuffled, never the windows.
    """
    lengths = lengths_of(chunks) if lengths is None else lengths
    used = valid_spikes(spikes, lengths, template_length, offset)
    if max_spikes is not None:
        by = hash_order(0, "spike_time") if order is None else order
        used = cap_per_group(used, ["recording_id", "unit_id"], max_spikes, by)
    ready = with_spikes(attach_halo(chunks, length, offset, template_length), used, length)
    schema = arrow_schema(PARTIALS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for block in blocks_of(batch):
                for spike in block.row["spikes"]:
                    at = spike["spike_time"] - block.start + block.lead - offset
                    if not 0 <= at <= len(block.x) - template_length:
                        continue
                    key = (block.recording_id, spike["unit_id"])
                    window = block.x[at : at + template_length]
                    if key in held:
                        held[key][1] += window
                        held[key][2] += 1
                    else:
                        held[key] = [block.channels, window.astype(float).copy(), 1]
                        size += window.size
                if size > HELD:
                    yield from emit(((*k, v[0], v[1].ravel(), v[2]) for k, v in held.items()), schema)
                    held, size = {}, 0
        yield from emit(((*k, v[0], v[1].ravel(), v[2]) for k, v in held.items()), schema)

    cells = ready.mapInArrow(add, PARTIALS).select(
        "recording_id", "unit_id", "channels", "n", F.posexplode("sums").alias("_i", "v")
    )
    width = F.size("channels")
    return (
        cells.select(
            "recording_id", "unit_id", F.floor(F.col("_i") / width).cast("int").alias("k"),
            (F.col("_i") % width).alias("_c"), F.element_at("channels", (F.col("_i") % width + 1).cast("int")).alias("channel"),
            "n", "v",
        )
        .groupBy("recording_id", "unit_id", "k", "channel")
        .agg(F.sum("v").alias("_sum"), F.sum("n").alias("n_used"))
        .select("recording_id", "unit_id", "k", "channel", (F.col("_sum") / F.col("n_used")).alias("value"), "n_used")
    )


def channel_energy(waveforms: DataFrame) -> DataFrame:
    """Sum of squares and peak-to-peak per unit and channel."""
    return waveforms.groupBy("recording_id", "unit_id", "channel").agg(
        F.sum(F.col("value") * F.col("value")).alias("energy"),
        (F.max("value") - F.min("value")).alias("peak_to_peak"),
    )


def select_channels(
    energies: DataFrame, interferers: DataFrame, n_channels: int, targets: DataFrame
) -> DataFrame:
    """The channels where a target stands out most against its interferers.

    Ratio of target energy to the strongest interferer's energy; channels below 5 % of the
    target's best energy rank last. Ties go to the lower channel.
    `targets` (recording_id, target_id), `interferers` (recording_id, target_id, unit_id).
    """
    own = targets.join(
        energies.withColumnRenamed("unit_id", "target_id"), ["recording_id", "target_id"]
    ).select("recording_id", "target_id", "channel", "energy")
    rival = (
        interferers.join(energies, ["recording_id", "unit_id"])
        .groupBy("recording_id", "target_id", "channel")
        .agg(F.max("energy").alias("_rival"))
    )
    per_target = Window.partitionBy("recording_id", "target_id")
    eps, floor = 1e-9, 0.05  # fixed values
    ratio = F.col("energy") / (F.coalesce("_rival", F.lit(0.0)) + F.lit(eps))
    scored = own.join(rival, ["recording_id", "target_id", "channel"], "left").withColumn(
        "ratio",
        F.when(F.col("energy") >= F.lit(floor) * F.max("energy").over(per_target), ratio).otherwise(
            F.lit(float("-inf"))
        ),
    )
    order = per_target.orderBy(F.col("ratio").desc(), F.col("channel"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_channels)
        .select("recording_id", "target_id", "channel", "rank", "ratio")
    )


def activity(spikes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Spike count and activity rank per unit; units labelled noise are left out."""
    from tracewell.sources.metadata import not_noise

    counts = spikes.groupBy("recording_id", "unit_id").agg(F.count(F.lit(1)).alias("n_spikes"))
    if labels is not None:
        on = [c for c in ("recording_id", "unit_id") if c in labels.columns]
        counts = counts.join(labels, on, "left").where(not_noise(F.col("label"))).drop("label")
    order = Window.partitionBy("recording_id").orderBy(F.col("n_spikes").desc(), F.col("unit_id"))
    return counts.withColumn("activity_rank", F.row_number().over(order))


def most_active(ranked: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The n most active other units for every target."""
    near = targets.join(ranked.where(F.col("activity_rank") <= n + 1), "recording_id").where(
        F.col("unit_id") != F.col("target_id")
    )
    order = Window.partitionBy("recording_id", "target_id").orderBy("activity_rank")
    return near.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def peak_channels(waveforms: DataFrame) -> DataFrame:
    """Channel with the largest peak-to-peak of the mean waveform; the first one on ties."""
    best = F.max_by("channel", F.struct(F.col("peak_to_peak"), -F.col("channel")))
    return channel_energy(waveforms).groupBy("recording_id", "unit_id").agg(best.alias("channel"))


def nearest_units(
    ranked: DataFrame,
    targets: DataFrame,
    peaks: DataFrame,
    positions: DataFrame,
    n: int,
    pool: int | None = None,
) -> DataFrame:
    """The n units closest to a target; with `pool` only among so many most active others.

    `positions` (recording_id, channel, x, y); units without a waveform drop out, equal
    distances keep the order of activity.
    """
    if pool is None:
        shortlist = targets.join(ranked, "recording_id").where(F.col("unit_id") != F.col("target_id"))
    else:
        shortlist = most_active(ranked, targets, pool)
    where = peaks.join(positions, ["recording_id", "channel"]).select("recording_id", "unit_id", "x", "y")
    own = where.select("recording_id", F.col("unit_id").alias("target_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    placed = shortlist.join(where, ["recording_id", "unit_id"]).join(own, ["recording_id", "target_id"])
    placed = placed.withColumn("distance", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")))
    order = Window.partitionBy("recording_id", "target_id").orderBy("distance", "activity_rank")
    return (
        placed.withColumn("pick", F.row_number().over(order))
        .where(F.col("pick") <= n)
        .select("recording_id", "target_id", "unit_id", "pick", "distance")
    )
