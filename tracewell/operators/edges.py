"""Ordered operators on digital streams: edges, code onsets, level toggles, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.blocks import BLOCK, Running, block_of, ordinal, runs, scan
from tracewell.session import cut_lineage


def rising_edges(
    stream: DataFrame,
    keys: Sequence[str],
    bit: Column,
    sample: str = "sample",
    block: int = BLOCK,
) -> DataFrame:
    """Samples where the bit goes 0 -> 1, numbered from 1 by `edge_seq`.

    The first sample of a stream is never an edge. Only edges, which are sparse, reach
    the numbering pass.
    """
    bits = stream.select(*keys, sample, bit.cast("int").alias("_bit"))
    seen = scan(bits, keys, sample, {"_before": Running("last", F.col("_bit"), False)}, block)
    edges = seen.where((F.col("_before") == 0) & (F.col("_bit") != 0)).select(*keys, sample)
    edges = cut_lineage(edges)
    return ordinal(edges, keys, sample, "edge_seq", block)


def last_edge(
    events: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    sample: str = "sample",
    fs: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """As-of join: the last edge at or before each event (null when there is none yet).

    `edges` has the shape `rising_edges` returns; `sample` names the events' position. With a rate `fs`, `time_rel_s` is the time since that edge in seconds.
    """
    carried = [c for c in events.columns if c not in keys]
    left = events.select(
        *keys,
        F.col(sample).cast("bigint").alias("_at"),
        F.struct(*carried).alias("_row"),
        F.lit(None).cast("bigint").alias("_seq"),
    )
    right = edges.select(
        *keys, F.col("sample").cast("bigint").alias("_at"), F.col("edge_seq").alias("_seq")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.withColumn("_late", F.col("_seq").isNull())
    # Edges sort before events of the same sample; both running values only grow.
    running = scan(
        both,
        keys,
        "_at",
        {
            "edge_sample": Running("max", F.when(F.col("_seq").isNotNull(), F.col("_at"))),
            "edge_seq": Running("max", F.col("_seq")),
        },
        block,
        ties=["_late"],
    )
    out = running.where(F.col("_late")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in carried], "edge_sample", "edge_seq"
    )
    if fs is not None:
        out = out.withColumn("time_rel_s", (F.col(sample) - F.col("edge_sample")) / F.lit(fs))
    return out


def code_onsets(
    stream: DataFrame,
    keys: Sequence[str],
    code: Column,
    debounce: int,
    sample: str = "sample",
    block: int = BLOCK,
) -> DataFrame:
    """Debounced onsets of non-zero codes.

    A code counts once it is stable for `debounce` samples and differs from the last
    stable one; the event sits at the start of the stable stretch. A stable zero emits
    nothing but re-arms.
    """
    codes = stream.select(*keys, sample, code.cast("int").alias("code"))
    stable = (
        runs(codes, keys, sample, "code", block)
        .where(F.col("run_length") >= debounce)
        .select(*keys, F.col("run_start").alias(sample), "code")
    )
    stable = cut_lineage(stable)
    seen = scan(stable, keys, sample, {"_last": Running("last", F.col("code"), False)}, block)
    return seen.where(
        (F.col("code") != F.coalesce("_last", F.lit(0))) & (F.col("code") != 0)
    ).select(*keys, sample, "code")


def usable_onsets(
    onsets: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    fs: float,
    debounce: int,
    sample: str = "sample",
    seen_at: str = "onset",
    block: int = BLOCK,
) -> DataFrame:
    """Onsets stamped with the sync edge they refer to; those without an edge are dropped.

    `seen_at="onset"` needs the edge at or before the onset itself; `"confirmation"` also
    accepts an edge that arrives while the code is being debounced, which yields a
    negative relative time.
    """
    if seen_at == "onset":
        return last_edge(onsets, edges, keys, sample, fs, block).where("edge_sample is not null")
    confirmed = onsets.withColumn("_confirmed", F.col(sample) + F.lit(debounce - 1))
    stamped = last_edge(confirmed, edges, keys, "_confirmed", None, block)
    return (
        stamped.where("edge_sample is not null")
        .withColumn("time_rel_s", (F.col(sample) - F.col("edge_sample")) / F.lit(fs))
        .drop("_confirmed")
    )


def level_toggles(
    series: DataFrame,
    keys: Sequence[str],
    chunk: int,
    threshold: float,
    sample: str = "sample",
    value: str = "value",
    block: int = BLOCK,
) -> DataFrame:
    """Hysteresis on the change across each chunk of samples.

    Last minus first value of the chunk above the threshold while low switches high,
    below minus the threshold while high switches low. Chunks of one sample are ignored.
    """
    deltas = (
        series.groupBy(*keys, block_of(sample, chunk).alias("chunk_id"))
        .agg(
            (F.max_by(value, sample) - F.min_by(value, sample)).alias("delta"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where("_n >= 2")
    )
    crossing = (
        F.when(F.col("delta") > threshold, 1).when(F.col("delta") < -threshold, 0)
    )
    crossings = deltas.withColumn("level", crossing).where("level is not null").drop("_n")
    seen = scan(
        crossings, keys, "chunk_id", {"_held": Running("last", F.col("level"), False)}, block
    )
    return seen.where(F.col("level") != F.coalesce("_held", F.lit(0))).drop("_held")


def map_samples(
    events: DataFrame,
    source_edges: DataFrame,
    target_edges: DataFrame,
    keys: Sequence[str],
    fs_source: float,
    fs_target: float,
    sample: str = "sample",
    block: int = BLOCK,
) -> DataFrame:
    """Sample index in one stream -> sample index in another, via shared sync edges.

    Edges of both streams pair up by their number; the offset since the edge is scaled
    by the ratio of the rates.
    """
    stamped = last_edge(events, source_edges, keys, sample, None, block)
    target = target_edges.select(*keys, "edge_seq", F.col("sample").alias("_target_edge"))
    offset = (F.col(sample) - F.col("edge_sample")) * F.lit(fs_target) / F.lit(fs_source)
    return (
        stamped.join(target, [*keys, "edge_seq"])
        .withColumn("mapped_sample", F.col("_target_edge") + F.round(offset).cast("bigint"))
        .drop("_target_edge")
    )


def continuity(
    chunks: DataFrame, keys: Sequence[str], start: str = "start_sample", n: str = "n_samples"
) -> DataFrame:
    """Places where a chunk does not start where the previous one ended."""
    spans = chunks.select(*keys, F.col(start).alias("_at"), F.col(n).cast("bigint").alias("_n"))
    seen = scan(
        spans, keys, "_at", {"_end": Running("max", F.col("_at") + F.col("_n"), False)}, 1 << 28
    )
    return seen.where(F.col("_end") != F.col("_at")).select(
        *keys, F.col("_end").alias("expected"), F.col("_at").alias("found")
    )
