"""Half-open integer intervals: free segments, merged pulses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.blocks import BLOCK, Running, scan
from tracewell.session import cut_lineage


def _covered_until(
    intervals: DataFrame, keys: Sequence[str], lo: Column, hi: Column, block: int
) -> DataFrame:
    """Distinct starts with the furthest end of everything that starts earlier."""
    spans = intervals.select(*keys, lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    merged = spans.where("hi > lo").groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    return scan(merged, keys, "lo", {"covered": Running("max", F.col("hi"), False)}, block)


def free_segments(
    points: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    lengths: DataFrame,
    min_length: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Stretches not touched by any [p - before, p + after), as (start, end) half-open.

    `lengths` has one row per key with `n_samples`; keys without any point are free from
    end to end. The dense presence mask is never built: a gap opens at every interval
    start beyond the furthest end seen so far.
    """
    limits = lengths.select(*keys, F.col("n_samples").cast("bigint").alias("_n"))
    inside = points.join(limits, list(keys)).select(
        *keys,
        F.greatest(F.col(position) - before, F.lit(0)).alias("_lo"),
        F.least(F.col(position) + after, F.col("_n")).alias("_hi"),
    )
    seen = _covered_until(inside, keys, F.col("_lo"), F.col("_hi"), block)
    gaps = seen.select(
        *keys, F.coalesce("covered", F.lit(0)).cast("bigint").alias("start"), F.col("lo").alias("end")
    ).where("end > start")
    ends = inside.where("_hi > _lo").groupBy(*keys).agg(F.max("_hi").alias("_covered"))
    tails = limits.join(ends, list(keys), "left").select(
        *keys, F.coalesce("_covered", F.lit(0)).cast("bigint").alias("start"), F.col("_n").alias("end")
    )
    return (
        gaps.unionByName(tails)
        .where(F.col("end") - F.col("start") >= min_length)
        .withColumn("length", F.col("end") - F.col("start"))
    )


def merge_intervals(
    intervals: DataFrame, keys: Sequence[str], lo: Column, hi: Column, block: int = BLOCK
) -> DataFrame:
    """Union of overlapping or touching intervals as (start, end).

    Every island start carries the end of the island before it; shifting those ends back
    by one start and adding the overall last end gives the islands.
    """
    starts = _covered_until(intervals, keys, lo, hi, block).where(
        F.col("covered").isNull() | (F.col("lo") > F.col("covered"))
    )
    starts = cut_lineage(starts.select(*keys, "lo", "covered"))
    last = (
        intervals.select(*keys, hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))
        .where("hi > lo")
        .groupBy(*keys)
        .agg(F.max("hi").alias("_last"))
    )
    ahead = scan(
        starts,
        keys,
        "lo",
        {"_end": Running("last", F.col("covered"), False)},
        block,
        reverse=True,
    )
    return ahead.join(last, list(keys)).select(
        *keys, F.col("lo").alias("start"), F.coalesce("_end", "_last").alias("end")
    )


def pulse_intervals(
    triggers: DataFrame, keys: Sequence[str], sample: str, pulse: int, block: int = BLOCK
) -> DataFrame:
    """Output line as high intervals: each trigger holds it for `pulse` samples, retriggerable."""
    return merge_intervals(triggers, keys, F.col(sample), F.col(sample) + F.lit(pulse), block)
