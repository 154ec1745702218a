"""Peak picking on score traces (recording_id, sample, score)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.blocks import BLK, BLOCK, CORE, block_window, drop_halo, ordinal, runs, with_halo
from tracewell.operators.matching import unmatched
from tracewell.session import cut_lineage


def above(score: str, threshold: Column | float) -> Column:
    """The detection predicate: strictly greater."""
    return F.col(score) > (threshold if isinstance(threshold, Column) else F.lit(threshold))


def local_maxima(
    trace: DataFrame,
    keys: Sequence[str],
    sample: str = "sample",
    score: str = "score",
    block: int = BLOCK,
) -> DataFrame:
    """Points higher than both neighbours; a flat top counts once, at its middle.

    Neighbours are the adjacent positions; a row without one on either side (recording
    ends, gaps) never counts.
    Flat stretches are rare, so only their rows go through run grouping.
    """
    w = block_window(keys, sample)
    seen = drop_halo(
        with_halo(trace.select(*keys, sample, score), sample, 1, 1, block)
        .withColumn("_prev", F.max(score).over(w.rangeBetween(-1, -1)))
        .withColumn("_next", F.max(score).over(w.rangeBetween(1, 1)))
    )
    v = F.col(score)
    sharp = seen.where((v > F.col("_prev")) & (v > F.col("_next"))).select(*keys, sample, score)
    flat = seen.where((v == F.col("_prev")) | (v == F.col("_next"))).select(
        *keys, sample, score, (v > F.col("_prev")).alias("rises"), (v > F.col("_next")).alias("falls")
    )
    return sharp.unionByName(flat_tops(flat, keys, sample, score, block))


def flat_tops(
    flat: DataFrame, keys: Sequence[str], sample: str = "sample", score: str = "score", block: int = BLOCK
) -> DataFrame:
    """Middles of flat stretches between a rise and a fall; `flat` has their rows, `rises` and `falls`."""
    flat = cut_lineage(flat)
    # Rows of one flat top share the position of the row that starts it.
    tops = runs(flat, keys, sample, score, block)
    rising = flat.where("rises").select(*keys, F.col(sample).alias("run_start"))
    falling = flat.where("falls").select(*keys, F.col(sample).alias("run_end"))
    middles = (
        tops.join(rising, [*keys, "run_start"], "left_semi")
        .join(falling, [*keys, "run_end"], "left_semi")
        .select(*keys, F.floor((F.col("run_start") + F.col("run_end")) / 2).alias(sample), score)
    )
    return middles


def window_peaks(
    trace: DataFrame,
    keys: Sequence[str],
    reach: int,
    sample: str = "sample",
    score: str = "score",
    threshold: Column | float | None = None,
    complete: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Rows strictly greater than every other value within `reach` samples.

    Ties reject both. `complete=False` reports only points whose right neighbourhood has
    been seen in full, as a live stream would. A threshold is applied before the window
    (a lower point can never suppress a higher one, so the result is the same), except
    for the end-of-data test, which needs the whole trace.
    """
    source = trace.select(*keys, sample, score)
    kept = source if threshold is None else source.where(above(score, threshold))
    w = block_window(keys, sample)
    seen = (
        with_halo(kept, sample, reach, reach, block)
        .withColumn("_left", F.max(score).over(w.rangeBetween(-reach, -1)))
        .withColumn("_right", F.max(score).over(w.rangeBetween(1, reach)))
    )
    top = F.col(score) > F.greatest(
        F.coalesce("_left", F.lit(float("-inf"))), F.coalesce("_right", F.lit(float("-inf")))
    )
    peaks = drop_halo(seen.where(top)).drop("_left", "_right")
    if complete:
        return peaks
    newest = source.groupBy(*keys).agg(F.max(sample).alias("_newest"))
    return (
        peaks.join(newest, list(keys))
        .where(F.col(sample) + reach <= F.col("_newest"))
        .drop("_newest")
    )


def run_peaks(
    trace: DataFrame,
    keys: Sequence[str],
    threshold: Column | float,
    sample: str = "sample",
    score: str = "score",
    block: int = BLOCK,
) -> DataFrame:
    """One peak per maximal run above the threshold: the first maximum of the run."""
    high = ordinal(
        trace.select(*keys, sample, score).where(above(score, threshold)), keys, sample, "_n", block
    )
    return (
        high.groupBy(*keys, (F.col(sample) - F.col("_n")).alias("_run"))
        .agg(
            F.min_by(sample, F.struct(-F.col(score), F.col(sample))).alias("_peak"),
            F.max(score).alias(score),
            F.min(sample).alias("run_start"),
            F.count(F.lit(1)).alias("run_length"),
        )
        .select(*keys, F.col("_peak").alias(sample), score, "run_start", "run_length")
    )


def settle(at: np.ndarray, score: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, distance: int):
    """Decide the peaks of blocks that do not depend on anything outside [low, high) of their block.

    Highest first, later index first among equals: a peak is kept, and removes its
    neighbours closer than `distance`, when it sees its whole neighbourhood and no higher
    neighbour is still open. Returns 1 kept, 0 removed, -1 open.
    """
    state = np.full(len(at), -1)
    is_open = np.zeros(len(at), dtype=bool)
    first = np.searchsorted(at, at - distance, side="right")
    last = np.searchsorted(at, at + distance, side="left")
    visible = (at - distance >= low) & (at + distance <= high)
    for i in np.lexsort((at, score))[::-1]:
        if state[i] == 0:
            continue
        if visible[i] and not is_open[first[i] : last[i]].any():
            state[first[i] : last[i]] = 0
            state[i] = 1
        else:
            is_open[i] = True
    return state


def block_changes(rows: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Whether each row but the first begins another block than the row before; nulls are equal."""
    n = rows.num_rows
    out = np.zeros(max(n - 1, 0), bool)
    for name in by:
        now, before = rows[name].slice(1), rows[name].slice(0, max(n - 1, 0))
        out |= pc.fill_null(pc.not_equal(now, before), False).to_numpy()
        out |= pc.is_null(now).to_numpy() != pc.is_null(before).to_numpy()
    return out


#: rows that are settled together, in whole blocks
TOGETHER = 16_384


def whole_blocks(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """Rows sorted by block in stretches of whole blocks: at most one block is held besides."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        seen = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch])
        ends = np.flatnonzero(block_changes(seen, by)) + 1 - (seen.num_rows - batch.num_rows)
        if len(ends) and rows + ends[-1] >= TOGETHER:
            cut = int(ends[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def priority_peaks(
    peaks: DataFrame,
    keys: Sequence[str],
    distance: int,
    sample: str = "sample",
    score: str = "score",
    min_height: float | None = None,
    block: int = BLOCK,
    halo: int | None = None,
) -> DataFrame:
    """Highest-first suppression of peaks closer than `distance`.

    A decision depends on a chain of ever higher neighbours. Each block sees a halo of
    several distances, settles every peak whose chain ends inside it, and leaves the few
    others to the next round; rounds go on until nothing is open, so the result equals
    the sequential procedure however long the chains are.
    """
    if min_height is not None:
        peaks = peaks.where(F.col(score) >= min_height)
    reach = max(halo if halo is not None else 16 * distance, distance)
    columns = [*keys, sample, score]
    schema = peaks.select(*columns).schema.simpleString()[7:-1] + ",_state int"

    def decide(rows: pa.Table) -> pa.Table:
        """The core rows of whole blocks with their states; blocks stand apart on one axis."""
        at = rows[sample].to_numpy().astype(np.int64)
        number = np.cumsum(np.concatenate([[0], block_changes(rows, [*keys, BLK])]))
        start = rows[BLK].to_numpy() * block
        moved = number * (block + 2 * reach + distance) - start
        low = start - reach + moved
        state = settle(at + moved, rows[score].to_numpy(), low, low + block + 2 * reach, distance)
        core = rows.append_column("_state", pa.array(state, pa.int32())).filter(rows[CORE])
        return core.select([*columns, "_state"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches, [*keys, BLK]):
            yield from decide(rows).to_batches()

    accepted = None
    waiting = peaks.select(*columns)
    while True:
        spread = with_halo(waiting, sample, reach, reach, block)
        dealt = spread.repartition(*keys, BLK).sortWithinPartitions(*keys, BLK, sample)
        decided = cut_lineage(dealt.mapInArrow(run, schema))
        kept = decided.where("_state = 1").drop("_state")
        accepted = kept if accepted is None else accepted.unionByName(kept)
        undecided = decided.where("_state = -1").drop("_state")
        if undecided.isEmpty():
            return accepted
        # Neighbours kept by another block remove the open peaks around them.
        points = kept.select(*keys, F.col(sample).alias("_at"))
        waiting = cut_lineage(unmatched(undecided, points, keys, sample, "_at", distance - 1))
