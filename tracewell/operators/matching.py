"""Tolerance matching between two point sets on an integer axis.

The reference side is reduced to one row per bucket (its largest and smallest position)
before any join, so a query point meets exactly one row: no neighbour pairs are ever
produced, however many points share a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.blocks import BLK, BLOCK, CORE, block_of, with_halo

NEAR = "_near"


def bucket_bounds(
    reference: DataFrame, keys: Sequence[str], position: str, width: int
) -> DataFrame:
    """Per bucket `b`: the last position inside it and the first one inside the next."""
    own = block_of(position, width)
    sides = F.array(
        F.struct(own.alias("b"), F.col(position).alias("last_here"), F.lit(None).cast("bigint").alias("first_next")),
        F.struct((own - 1).alias("b"), F.lit(None).cast("bigint").alias("last_here"), F.col(position).alias("first_next")),
    )
    return (
        reference.where(F.col(position).isNotNull())
        .select(*keys, F.explode(sides).alias("_side"))
        .groupBy(*keys, F.col("_side.b").alias("_bucket"))
        .agg(
            F.max("_side.last_here").alias("_last_here"),
            F.min("_side.first_next").alias("_first_next"),
        )
    )


def mark_near(
    query: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    query_position: str,
    reference_position: str,
    before: int,
    after: int,
    name: str = NEAR,
) -> DataFrame:
    """Adds `name`: is there a reference point in [q - before, q + after]?"""
    width = before + after + 1
    bounds = bucket_bounds(reference, keys, reference_position, width)
    low = F.col(query_position) - F.lit(before)
    keyed = query.withColumn("_bucket", block_of(low, width))
    joined = keyed.join(bounds, [*keys, "_bucket"], "left")
    hit = (F.col("_last_here") >= low) | (
        F.col("_first_next") <= F.col(query_position) + F.lit(after)
    )
    return joined.select(*query.columns, F.coalesce(hit, F.lit(False)).alias(name))


def match_within(query, reference, keys, query_position, reference_position, tolerance) -> DataFrame:
    """Semi join: query rows with a reference point at distance <= tolerance."""
    marked = mark_near(query, reference, keys, query_position, reference_position, tolerance, tolerance)
    return marked.where(F.col(NEAR)).drop(NEAR)


def unmatched(query, reference, keys, query_position, reference_position, tolerance) -> DataFrame:
    """Anti join: query rows without a reference point at distance <= tolerance."""
    marked = mark_near(query, reference, keys, query_position, reference_position, tolerance, tolerance)
    return marked.where(~F.col(NEAR)).drop(NEAR)


def attribute(
    detections: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    position: str,
    other_position: str,
    other_id: str,
    tolerance: int,
) -> DataFrame:
    """One row per detection and per other unit that has a point within the tolerance.

    The bounds are kept per unit, so each (detection, unit) appears once no matter how
    often the unit fires nearby.
    """
    width = 2 * tolerance + 1
    bounds = bucket_bounds(others, [*keys, other_id], other_position, width)
    low = F.col(position) - F.lit(tolerance)
    keyed = detections.withColumn("_bucket", block_of(low, width))
    hit = (F.col("_last_here") >= low) | (F.col("_first_next") <= F.col(position) + F.lit(tolerance))
    return (
        keyed.join(bounds, [*keys, "_bucket"], "inner")
        .where(hit)
        .select(*detections.columns, other_id)
    )


def best_nearby(
    query: DataFrame,
    scored: DataFrame,
    keys: Sequence[str],
    query_position: str,
    scored_position: str,
    score: str,
    tolerance: int,
    name: str = "best",
    block: int = BLOCK,
) -> DataFrame:
    """Adds the largest score within the tolerance of each query row (null when none).

    Both sides are laid on one axis and a RANGE frame looks around each point, one
    shuffle by (keys, block) and no pairs.
    """
    carried = [c for c in query.columns if c not in keys]
    left = query.select(
        *keys,
        F.col(query_position).cast("bigint").alias("_at"),
        F.lit(None).cast("double").alias("_score"),
        F.lit(True).alias("_asks"),
        F.struct(*carried).alias("_row"),
    )
    # Only the best point of a position can matter.
    right = scored.groupBy(*keys, F.col(scored_position).cast("bigint").alias("_at")).agg(
        F.max(F.col(score).cast("double")).alias("_score")
    )
    both = left.unionByName(right.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    spread = with_halo(both, "_at", tolerance, tolerance, block).where(F.col(CORE) | ~F.col("_asks"))
    frame = Window.partitionBy(*keys, BLK).orderBy("_at").rangeBetween(-tolerance, tolerance)
    return (
        spread.withColumn(name, F.max("_score").over(frame))
        .where(F.col("_asks"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in carried], name)
        .select(*query.columns, name)
    )
