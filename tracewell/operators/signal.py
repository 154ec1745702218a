"""Dense signal operators: narrow Arrow maps over chunk rows with a halo.

Every operator states how far it looks to each side. `attach_halo` (or a scan that reads
overlapping ranges) supplies those samples once; kernels then run on the extended block
and only the chunk's own samples are kept. What the kernels assume beyond the extended
block (zeros, zero state) is true at recording ends and gaps, and elsewhere only touches
samples that are thrown away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.functions.kernels import (
    SharedCorrelation,
    correlate,
    highpass_coefficients,
    median_reference,
    recursive_filter,
    settling_samples,
    window_peak_mask,
    zero_phase_filter,
)
from tracewell.operators.matching import mark_near
from tracewell.operators.peaks import flat_tops
from tracewell.session import cut_lineage, join_dimension
from tracewell.sources.chunks import attach_halo, decode_int16, unpack_scores

CHUNK_SCHEMA = (
    "recording_id string, chunk_id bigint, start_sample bigint, n_samples int, "
    "channels array<int>, values array<double>"
)
SCORE_SCHEMA = "recording_id string, target_id bigint, chunk_id bigint, start_sample bigint, scores array<double>"
PEAK_SCHEMA = "recording_id string, target_id bigint, sample bigint, score double"


@dataclass
class Block:
    """One chunk row inside a task; `x` includes `lead` and `trail` halo samples."""

    recording_id: str
    chunk_id: int
    start: int
    n: int
    channels: np.ndarray
    x: np.ndarray
    lead: int
    trail: int
    row: dict[str, Any]

    def core(self, array: np.ndarray) -> np.ndarray:
        return array[self.lead : self.lead + self.n]

    def as_row(self, values: np.ndarray, channels: np.ndarray | None = None) -> tuple:
        chosen = self.channels if channels is None else channels
        return (self.recording_id, self.chunk_id, self.start, self.n, chosen, values.ravel())


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    names = batch.schema.names
    packed = "data" in names
    extra = [c for c in names if c not in ("values", "data", "channels")]
    values, channels = batch.column("data" if packed else "values"), batch.column("channels")
    rows = {c: batch.column(c).to_pylist() for c in extra}
    for i in range(batch.num_rows):
        row = {c: rows[c][i] for c in extra}
        ids = channels[i].values.to_numpy(zero_copy_only=False)
        if packed:
            x = decode_int16(values[i].as_buffer(), len(ids)).astype(float)
        else:
            x = values[i].values.to_numpy(zero_copy_only=False).reshape(-1, len(ids))
        yield Block(
            row["recording_id"], row["chunk_id"], row["start_sample"], row["n_samples"],
            ids, x, row.get("lead") or 0, row.get("trail") or 0, row,
        )


def emit(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    if rows:
        columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def map_blocks(chunks: DataFrame, fn: Callable[[Block], Iterable[tuple]], ddl: str) -> DataFrame:
    """Narrow map: `fn` turns one block into output rows; one block in memory at a time."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch):
                yield from emit(fn(block), schema)

    return chunks.mapInArrow(run, ddl)


def column_index(channels: np.ndarray, wanted: Iterable[int]) -> np.ndarray:
    """Positions of channel ids inside a block; a missing one is an error."""
    where = {int(c): i for i, c in enumerate(channels)}
    missing = [int(c) for c in wanted if int(c) not in where]
    if missing:
        raise ValueError(f"channels {missing} are not in the recording's channel group")
    return np.array([where[int(c)] for c in wanted], dtype=int)


@dataclass(frozen=True)
class Cleaning:
    """The fixed preprocessing order: high-pass, then median reference, then subset.

    `highpass` is "causal", "zero_phase" or None; `keep` lists the channels to keep after
    the reference was taken over the whole group.
    """

    fs: float = 30_000.0
    fc: float = 300.0
    highpass: str | None = "causal"
    reference: bool = True
    keep: tuple[int, ...] | None = None

    def reach(self) -> tuple[int, int]:
        if self.highpass is None:
            return 0, 0
        settle = settling_samples(highpass_coefficients(self.fc, self.fs)[1])
        return settle, settle if self.highpass == "zero_phase" else 0

    def apply(self, block: Block, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        x, channels = block.x, block.channels
        if self.highpass is not None:
            b, a = highpass_coefficients(self.fc, self.fs)
            if self.highpass == "causal":
                x = recursive_filter(x, b, a)[0]
            else:
                x = zero_phase_filter(x, b, a, block.lead < before, block.trail < after)
        if self.reference:
            x = median_reference(x)
        if self.keep is not None:
            x = x[:, column_index(channels, self.keep)]
            channels = np.array(self.keep, dtype=np.int32)
        return x, channels


def clean(chunks: DataFrame, length: int, cleaning: Cleaning) -> DataFrame:
    """Preprocessed chunk rows."""
    before, after = cleaning.reach()

    def run(block: Block):
        x, channels = cleaning.apply(block, before, after)
        yield block.as_row(block.core(x), channels)

    return map_blocks(attach_halo(chunks, length, before, after), run, CHUNK_SCHEMA)


def highpass_carried(chunks: DataFrame, length: int, fc: float, fs: float) -> DataFrame:
    """Causal high-pass with the filter state carried across chunks instead of a halo.

    Pass 1 keeps only the end state of each chunk started from zero. The state entering a
    chunk is the sum of earlier end states, each decayed over the samples in between;
    states older than the settling time are below rounding, so a bounded look-back is
    exact. Pass 2 filters with the right incoming state.
    """
    b, a = highpass_coefficients(fc, fs)
    settle = settling_samples(a)
    back = -(-settle // length) + 1

    def end_state(block: Block):
        state = recursive_filter(block.x, b, a)[1]
        yield (block.recording_id, block.chunk_id, block.start, block.n, state.ravel())

    ends = map_blocks(
        chunks.select("recording_id", "chunk_id", "start_sample", "n_samples", "channels", "values"),
        end_state,
        "recording_id string, chunk_id bigint, start_sample bigint, n_samples int, state array<double>",
    )
    later = F.transform(F.sequence(F.lit(1), F.lit(back)), lambda h: F.col("chunk_id") + h)
    incoming = (
        ends.select(
            "recording_id",
            F.explode(later).alias("chunk_id"),
            F.struct("start_sample", (F.col("start_sample") + F.col("n_samples")).alias("end"), "state").alias("_e"),
        )
        .groupBy("recording_id", "chunk_id")
        .agg(F.array_sort(F.collect_list("_e")).alias("history"))
    )
    joined = chunks.join(incoming, ["recording_id", "chunk_id"], "left")
    move = np.array([[-a[1], 1.0], [-a[2], 0.0]])

    def run(block: Block):
        state = np.zeros((2, block.x.shape[1]))
        at = block.start
        for past in reversed(block.row["history"] or []):
            if past["end"] != at:  # a gap restarts the filter
                break
            decay = np.linalg.matrix_power(move, block.start - past["end"])
            state += decay @ np.array(past["state"]).reshape(2, -1)
            at = past["start_sample"]
        yield block.as_row(recursive_filter(block.x, b, a, state)[0])

    return map_blocks(joined, run, CHUNK_SCHEMA)


#: bytes of filters that one broadcast may hold
BANK_BYTES = 64 << 20


def with_filters(chunks: DataFrame, filters: DataFrame, bank_bytes: int = BANK_BYTES) -> DataFrame:
    """Attaches to every chunk the filters of its recording as one array column.

    `filters`: recording_id, target_id, channels, taps (flat, time-major), left_margin,
    threshold. A probe has a bounded number of targets, so the array is bounded too. The signal
    stays where it is: banks are sent to it, in as many parts as their measured bytes ask for, and
    each part meets the chunks of its own recordings only.
    """
    more = [c for c in ("from_sample",) if c in filters.columns]
    spec = F.struct("target_id", F.col("channels").alias("chs"), "taps", "left_margin", "threshold", *more)
    size = F.sum(8 * F.size("taps") + 4 * F.size("channels") + 64)
    bank = cut_lineage(filters.groupBy("recording_id").agg(F.collect_list(spec).alias("filters"), size.alias("_bytes")))
    parts = 1 + (bank.agg(F.sum("_bytes")).first()[0] or 0) // bank_bytes
    bank = bank.drop("_bytes")
    if parts == 1:
        return chunks.join(F.broadcast(bank), "recording_id")
    of = F.pmod(F.xxhash64("recording_id"), F.lit(parts))
    joined = [chunks.where(of == k).join(F.broadcast(bank.where(of == k)), "recording_id") for k in range(parts)]
    return reduce(DataFrame.unionByName, joined)


def _filter_arrays(spec: dict, channels: np.ndarray):
    columns = column_index(channels, spec["chs"])
    taps = np.array(spec["taps"], dtype=float).reshape(-1, len(columns))
    return columns, taps


def score(
    chunks: DataFrame,
    length: int,
    filters: DataFrame,
    template_length: int,
    cleaning: Cleaning | None = None,
    edge: str = "zero",
    method: str = "direct",
) -> DataFrame:
    """Score chunks of every filter: sum over taps and channels around each sample.

    `method="fft"` shares the transforms of a chunk's channels among all filters of its recording: for
    many targets; equal to "direct" up to rounding.

    `edge="zero"` pads recording ends with zeros and scores every sample; `"valid"` keeps
    only samples whose whole window exists; `"open"` also leaves out the last of those, as
    the sliding learned score does. Cleaning runs in the same task.
    """
    if method not in ("direct", "fft"):
        raise ValueError(f"unknown method {method}")
    step = cleaning or Cleaning(highpass=None, reference=False)
    before, after = step.reach()

    def run(block: Block):
        x, channels = step.apply(block, before, after)
        shared = SharedCorrelation(x, template_length) if method == "fft" else None
        for spec in block.row["filters"]:
            columns, taps = _filter_arrays(spec, channels)
            left = spec["left_margin"]
            d = shared(columns, taps, left) if shared else correlate(x[:, columns], taps, left)
            lo, hi = block.lead, block.lead + block.n
            if edge != "zero":
                lo = max(lo, left)
                hi = min(hi, len(x) - (len(taps) - 1 - left) - (edge == "open"))
            if hi > lo:
                yield (block.recording_id, spec["target_id"], block.chunk_id, block.start + lo - block.lead, d[lo:hi])

    reach = template_length
    haloed = attach_halo(chunks, length, before + reach, after + reach)
    return map_blocks(with_filters(haloed, filters), run, SCORE_SCHEMA)


def score_trace(chunks, length, filters, template_length, cleaning=None, edge="zero", method="direct") -> DataFrame:
    """`score` as one row per (recording, target, sample)."""
    return unpack_scores(score(chunks, length, filters, template_length, cleaning, edge, method))


CANDIDATES = "recording_id string, target_id bigint, sample bigint, score double, flat boolean, rises boolean, falls boolean"


def candidates(
    chunks: DataFrame,
    length: int,
    filters: DataFrame,
    template_length: int,
    cleaning: Cleaning | None = None,
    minimum: float | None = None,
) -> DataFrame:
    """Local maxima of every filter's score, as `peaks.local_maxima` of the whole trace gives them.

    Found where the score is made, so only points higher than both neighbours leave a task, and rows
    of flat stretches, whose ends may lie in other chunks. `minimum` leaves out lower points. A filter
    with `from_sample` sees zeros before that sample and has no scores there.
    """
    step = cleaning or Cleaning(highpass=None, reference=False)
    before, after = step.reach()

    def run(block: Block):
        x, channels = step.apply(block, before, after)
        at = block.start - block.lead + np.arange(len(x))
        for spec in block.row["filters"]:
            columns, taps = _filter_arrays(spec, channels)
            begin = spec.get("from_sample") or 0
            own = x[:, columns]
            if begin > at[0]:
                own = np.where((at >= begin)[:, None], own, 0.0)
            d = correlate(own, taps, spec["left_margin"])
            d[at < begin] = np.nan  # comparisons with what is not there are false
            around = np.concatenate([[np.nan], d, [np.nan]])
            rises, falls = d > around[:-2], d > around[2:]
            flat = (d == around[:-2]) | (d == around[2:])
            chosen = (rises & falls) | flat
            if minimum is not None:
                chosen &= d >= minimum
            lo, hi = block.lead, block.lead + block.n
            for i in np.flatnonzero(chosen[lo:hi]) + lo:
                yield (
                    block.recording_id, spec["target_id"], int(at[i]), float(d[i]), bool(flat[i]), bool(rises[i]), bool(falls[i])
                )

    reach = template_length + 1
    haloed = attach_halo(chunks, length, before + reach, after + reach)
    found = map_blocks(with_filters(haloed, filters), run, CANDIDATES)
    keys = ["recording_id", "target_id"]
    rows = cut_lineage(found)
    sharp = rows.where("not flat").select(*keys, "sample", "score")
    return sharp.unionByName(flat_tops(rows.where("flat").drop("flat"), keys))


def detect_blocks(
    block: Block,
    cleaning: Cleaning,
    before: int,
    after: int,
    suppress: int,
    edge: str,
    complete: bool,
    thresholded: bool,
):
    """Peaks of one block for all its filters: clean, correlate, suppress, threshold."""
    x, channels = cleaning.apply(block, before, after)
    for spec in block.row["filters"]:
        columns, taps = _filter_arrays(spec, channels)
        left = spec["left_margin"]
        right = len(taps) - 1 - left
        d = correlate(x[:, columns], taps, left)
        if edge == "valid":
            d[:left] = -np.inf
            d[len(d) - right :] = -np.inf
        mask = window_peak_mask(d, suppress) & np.isfinite(d)
        if not complete:
            newest = len(d) - 1 - (right if edge == "valid" else 0)
            mask[max(newest - suppress + 1, 0) :] = False
        if thresholded:
            mask &= d > spec["threshold"]
        for i in np.flatnonzero(mask[block.lead : block.lead + block.n]):
            yield (block.recording_id, spec["target_id"], block.start + int(i), float(d[block.lead + i]))


def detect(
    chunks: DataFrame,
    length: int,
    filters: DataFrame,
    template_length: int,
    cleaning: Cleaning | None = None,
    suppress: int | None = None,
    edge: str = "valid",
    complete: bool = True,
    thresholded: bool = True,
    haloed: bool = False,
) -> DataFrame:
    """Chunk rows straight to detections in one narrow stage.

    Cleaning, correlation and windowed suppression share one pass over the block and only
    the sparse peaks leave the task; no dense trace is ever shuffled or stored. With
    `haloed` the input already carries its halo (overlapping scan or stream).
    """
    step = cleaning or Cleaning(highpass=None, reference=False)
    before, after = step.reach()
    m = template_length // 2 if suppress is None else suppress
    reach = template_length - 1 + m

    def run(block: Block):
        yield from detect_blocks(block, step, before, after, m, edge, complete, thresholded)

    ready = chunks if haloed else attach_halo(chunks, length, before + reach, after + reach)
    return map_blocks(with_filters(ready, filters), run, PEAK_SCHEMA)


def common_reference(long: DataFrame, value: str = "value") -> DataFrame:
    """Median reference on long rows: one exact median per sample, channels are few."""
    per_sample = Window.partitionBy("recording_id", "sample")
    return long.withColumn(value, F.col(value) - F.median(value).over(per_sample))


def impulse_trace(trace: DataFrame, spikes: DataFrame, before: int, after: int) -> DataFrame:
    """Score rows around spikes with the spike indicator: 1 at spike samples, else 0."""
    keys = ["recording_id"]
    close = mark_near(trace, spikes, keys, "sample", "spike_time", after, before, "_close")
    exact = mark_near(close.where("_close").drop("_close"), spikes, keys, "sample", "spike_time", 0, 0, "_is")
    return exact.withColumn("impulse", F.col("_is").cast("int")).drop("_is")


def diagnostic_window(
    trace: DataFrame, detections: DataFrame, spikes: DataFrame, from_sample: int, reach: int
) -> DataFrame:
    """Trace, detections and truth within `reach` samples of the first spike at or after
    `from_sample`, as tagged rows (kind, recording_id, sample, score)."""
    first = (
        spikes.where(F.col("spike_time") >= from_sample)
        .groupBy("recording_id")
        .agg(F.min("spike_time").alias("_t0"))
    )
    rows = (
        trace.select(F.lit("trace").alias("kind"), "recording_id", "sample", F.col("score").cast("double").alias("score"))
        .unionByName(detections.select(F.lit("detection").alias("kind"), "recording_id", "sample", F.col("score").cast("double").alias("score")))
        .unionByName(spikes.select(F.lit("truth").alias("kind"), "recording_id", F.col("spike_time").alias("sample"), F.lit(None).cast("double").alias("score")))
    )
    return (
        join_dimension(rows, first, ["recording_id"], spread="sample")
        .where(F.abs(F.col("sample") - F.col("_t0")) <= reach)
        .drop("_t0")
    )
