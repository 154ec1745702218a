"""Two ways to run ordered operators without putting a whole recording in one task.

`with_halo`   bounded reach: rows near a block border are replicated into the
              neighbouring block, a window runs per block, replicas are dropped.
`scan`        unbounded reach, small carried state: one summary row per block is
              produced by partial aggregation, the summaries are scanned, and the
              incoming state is joined back to the rows of each block.

Blocks are fixed-width ranges of the integer order column, so the parallelism of one
hot recording is its length divided by the block width.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16
BLK = "_block"
CORE = "_core"


def block_of(order: str | Column, width: int) -> Column:
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(width)).cast("bigint")


def with_halo(
    df: DataFrame, order: str, before: int, after: int, block: int = BLOCK
) -> DataFrame:
    """Adds `_block` and `_core`; each block also sees `before`/`after` neighbours."""
    own = block_of(order, block)
    first = block_of(F.col(order) - F.lit(after), block)
    last = block_of(F.col(order) + F.lit(before), block)
    return df.withColumn(BLK, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(BLK) == own
    )


def block_window(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLK).orderBy(order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(BLK, CORE)


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is sum, max, min or last (nulls are skipped)."""

    kind: str
    value: Column
    inclusive: bool = True


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: dict[str, Running],
    block: int = BLOCK,
    reverse: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running aggregates along `order` within `keys`, blocked in two passes.

    `reverse` runs from the end, which turns an exclusive `last` into a lead. `ties`
    are extra order columns for rows that share the same position.
    """
    staged = df.withColumn(BLK, block_of(order, block))
    for i, running in enumerate(outputs.values()):
        staged = staged.withColumn(f"_v{i}", running.value)

    def directed(name: str) -> Column:
        return F.col(name).desc() if reverse else F.col(name).asc()

    ordering = [directed(order), *[directed(t) for t in ties]]
    rank = F.struct(order, *ties) if ties else F.col(order)
    pick = F.min_by if reverse else F.max_by

    def summarise(kind: str, value: Column) -> Column:
        if kind == "last":
            return pick(value, F.when(value.isNotNull(), rank))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)

    def along(kind: str, value: Column, window: WindowSpec) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)

    def merge(kind: str, inner: Column, carried: Column) -> Column:
        if kind == "sum":
            return F.coalesce(inner, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if kind == "last":
            return F.coalesce(inner, carried)
        return (F.greatest if kind == "max" else F.least)(inner, carried)

    kinds = [r.kind for r in outputs.values()]
    summary = staged.groupBy(*keys, BLK).agg(
        *[summarise(k, F.col(f"_v{i}")).alias(f"_s{i}") for i, k in enumerate(kinds)]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(directed(BLK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(
        *keys, BLK, *[along(k, F.col(f"_s{i}"), before).alias(f"_c{i}") for i, k in enumerate(kinds)]
    )
    joined = staged.join(carried, [*keys, BLK], "inner")
    window = Window.partitionBy(*keys, BLK).orderBy(*ordering)
    results = []
    for i, (name, running) in enumerate(outputs.items()):
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if running.inclusive else -1)
        inner = along(running.kind, F.col(f"_v{i}"), frame)
        results.append(merge(running.kind, inner, F.col(f"_c{i}")).alias(name))
    return joined.select(*df.columns, *results)


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    block: int = BLOCK,
    ties: Sequence[str] = (),
) -> DataFrame:
    """A 1-based position along `order`, without a single-task window per key."""
    return scan(df, keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}, block, ties=ties)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    block: int = BLOCK,
) -> DataFrame:
    """Maximal stretches of equal `value` over consecutive integer positions.

    A position minus its rank among the rows of the same value is constant inside a
    stretch, so one blocked scan and one aggregate find all of them. A missing position
    ends a stretch.
    """
    ranked = ordinal(df.select(*keys, order, value), [*keys, value], order, "_rank", block)
    return (
        ranked.groupBy(*keys, value, (F.col(order) - F.col("_rank")).alias("_run"))
        .agg(
            F.min(order).alias("run_start"),
            F.max(order).alias("run_end"),
            F.count(F.lit(1)).alias("run_length"),
        )
        .drop("_run")
    )
