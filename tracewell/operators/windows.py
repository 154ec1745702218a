"""Events counted in windows that follow other events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.blocks import BLOCK, Running, block_of, ordinal, scan
from tracewell.session import cut_lineage


def interval_join(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor: str,
    event: str,
    start: int,
    end: int,
) -> DataFrame:
    """Pairs with start <= event - anchor <= end, both ends closed.

    Both sides are bucketed by the window length, so the join is an equi-join on
    (keys, bucket) and an anchor meets at most two buckets. To count or rank events per
    window use `window_counts`, which produces no pairs.
    """
    width = end - start + 1
    low = F.col(anchor) + F.lit(start)
    left = anchors.withColumn(
        "_bucket",
        F.explode(F.array_distinct(F.array(block_of(low, width), block_of(low + (width - 1), width)))),
    )
    right = events.withColumn("_bucket", block_of(event, width))
    lag = F.col(event) - F.col(anchor)
    return left.join(right, [*keys, "_bucket"]).where(lag.between(start, end)).drop("_bucket")


def window_counts(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor: str,
    event: str,
    start: int,
    end: int,
    k: int,
    block: int = BLOCK,
) -> DataFrame:
    """Per anchor: events in its closed window and the sample of the k-th one.

    Events get a running number. The number reached just before the window opens and at
    its end gives the count, and the k-th event is looked up by its number: one row per
    anchor at every step, however many windows and events overlap.
    """
    at = events.select(*keys, F.col(event).cast("bigint").alias("_at"))
    numbered = cut_lineage(ordinal(at, keys, "_at", "_n", block))
    carried = [c for c in anchors.columns if c not in keys]
    row = F.struct(*carried).alias("_row")
    base = F.col(anchor).cast("bigint")
    opens = anchors.select(*keys, (base + start - 1).alias("_at"), row, F.lit(0).alias("_side"))
    closes = anchors.select(*keys, (base + end).alias("_at"), row, F.lit(1).alias("_side"))
    axis = (
        numbered.select(*keys, "_at", F.col("_n"))
        .withColumn("_late", F.lit(0))
        .unionByName(
            opens.unionByName(closes).withColumn("_late", F.lit(1)), allowMissingColumns=True
        )
    )
    seen = scan(axis, keys, "_at", {"_upto": Running("max", F.col("_n"))}, block, ties=["_late"])
    reached = F.coalesce(F.col("_upto"), F.lit(0))
    per_anchor = (
        seen.where("_late = 1")
        .groupBy(*keys, "_row")
        .agg(
            F.max(F.when(F.col("_side") == 0, reached)).alias("_open"),
            F.max(F.when(F.col("_side") == 1, reached)).alias("_close"),
        )
        .withColumn("n_events", F.col("_close") - F.col("_open"))
        .withColumn("_n", F.when(F.col("n_events") >= k, F.col("_open") + k))
    )
    found = numbered.select(*keys, "_n", F.col("_at").alias("trigger_sample"))
    return per_anchor.join(found, [*keys, "_n"], "left").select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in carried], "n_events", "trigger_sample"
    )


def decisions(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor: str,
    event: str,
    start: int,
    end: int,
    k: int,
    block: int = BLOCK,
) -> DataFrame:
    """`window_counts` as decision records: a trigger reports the count it fired at."""
    counted = window_counts(anchors, events, keys, anchor, event, start, end, k, block)
    fired = F.col("trigger_sample").isNotNull()
    return counted.withColumn(
        "outcome", F.when(fired, F.lit("TRIGGER")).otherwise(F.lit("NO_TRIGGER"))
    ).withColumn("n_events", F.when(fired, F.lit(k).cast("bigint")).otherwise(F.col("n_events")))
