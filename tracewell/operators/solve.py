"""Noise covariance and the constrained linear filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.blocks import block_of
from tracewell.operators.intervals import free_segments
from tracewell.operators.signal import arrow_schema, blocks_of, column_index, emit
from tracewell.session import cut_lineage, join_dimension
from tracewell.sources.chunks import attach_halo
from tracewell.sources.filters import left_margin

KEYS = ["recording_id", "target_id"]
SUMS = "recording_id string, target_id bigint, seg_start bigint, n bigint, sums array<double>"
PRODUCTS = "recording_id string, target_id bigint, channels array<int>, products array<double>, rests array<double>"


def quiet_segments(
    spikes: DataFrame, lengths: DataFrame, template_length: int, offset: int, max_samples: int | None = None
) -> DataFrame:
    """Stretches of at least two templates without a spike of the given (target's) units.

    `spikes`: recording_id, target_id, spike_time. `lengths`: recording_id, target_id, n_samples.
    """
    limit = F.col("n_samples") if max_samples is None else F.least(F.col("n_samples"), F.lit(max_samples))
    return free_segments(
        spikes, KEYS, "spike_time", offset, template_length - 1 + offset,
        lengths.select(*KEYS, limit.alias("n_samples")), 2 * template_length,
    )


def _pieces(segments: DataFrame, length: int) -> DataFrame:
    """Segments per chunk they overlap, as bounded lists (a chunk is a few seconds)."""
    last = block_of(F.col("end") - 1, length)
    spread = segments.withColumn("chunk_id", F.explode(F.sequence(block_of("start", length), last)))
    columns = [c for c in segments.columns if c != "recording_id"]
    return spread.groupBy("recording_id", "chunk_id").agg(
        F.collect_list(F.struct(*columns)).alias("segments")
    )


def segment_sums(chunks: DataFrame, length: int, segments: DataFrame) -> DataFrame:
    """Adds `sums`, each of the target's channels over the segment, and `samples`, how many it has."""
    schema = arrow_schema(SUMS)
    ready = chunks.join(_pieces(segments, length), ["recording_id", "chunk_id"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch):
                rows = []
                for s in block.row["segments"]:
                    a, b = max(s["start"], block.start), min(s["end"], block.start + block.n)
                    x = block.x[a - block.start : b - block.start, column_index(block.channels, s["channels"])]
                    rows.append((block.recording_id, s["target_id"], s["start"], len(x), x.sum(axis=0)))
                yield from emit(rows, schema)

    at = [*KEYS, "seg_start"]
    cells = ready.mapInArrow(add, SUMS).select(*at, "n", F.posexplode("sums").alias("i", "v"))
    totals = (
        cells.groupBy(*at, "i")
        .agg(F.sum("v").alias("v"), F.sum("n").alias("samples"))
        .groupBy(*KEYS, F.col("seg_start").alias("start"))
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"),
            F.first("samples").alias("samples"),
        )
    )
    return segments.join(totals, [*KEYS, "start"])


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles of 26 significant bits, whose sums are exact, and what is left of each value."""
    v = values.astype(np.float64)
    scaled = v * 134217729.0  # 2**27 + 1
    high = scaled - (scaled - v)
    return high, (values - high).astype(np.float64)


def lagged_products(
    chunks: DataFrame, length: int, segments: DataFrame, template_length: int
) -> DataFrame:
    """Covariance statistics: (recording_id, target_id, lag, early, late, value).

    `value` = sum over quiet segments of (x_early[n] - mean)(x_late[n + lag] - mean), divided
    by the total quiet length, for lags 0 .. T-1; negative lags are the swapped pair.
    `segments` needs the target's `channels`. Each chunk contributes the products whose
    earlier sample it owns, so long segments split freely; tasks pass on one small array
    per target.

    Samples are centred as n x - sum, which is exact for integers, and sums travel as two halves, so
    the result does not depend on how chunks and tasks cut a segment.
    """
    centred = segment_sums(chunks, length, segments)
    haloed = attach_halo(chunks, length, 0, template_length - 1)
    ready = haloed.join(_pieces(centred, length), ["recording_id", "chunk_id"])
    schema = arrow_schema(PRODUCTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for block in blocks_of(batch):
                for s in block.row["segments"]:
                    first = max(s["start"], block.start) - block.start
                    own = min(s["end"], block.start + block.n) - block.start
                    seen = min(s["end"] - block.start, len(block.x))
                    x = block.x[first:seen, column_index(block.channels, s["channels"])]
                    z = s["samples"] * x - np.array(s["sums"])
                    n = own - first
                    width = z.shape[1]
                    total = np.zeros((template_length, width, width), np.longdouble)
                    for lag in range(template_length):
                        m = min(n, len(z) - lag)
                        if m > 0:
                            total[lag] = z[:m].T @ z[lag : lag + m]
                    total /= np.longdouble(s["samples"]) ** 2
                    key = (block.recording_id, s["target_id"])
                    if key in held:
                        held[key][1] += total
                    else:
                        held[key] = [s["channels"], total]
                if len(held) > 2000:
                    yield from emit(((*k, c, *halves(p.ravel())) for k, (c, p) in held.items()), schema)
                    held = {}
        yield from emit(((*k, c, *halves(p.ravel())) for k, (c, p) in held.items()), schema)

    pairs = F.posexplode(F.arrays_zip("products", "rests")).alias("i", "v")
    cells = ready.mapInArrow(add, PRODUCTS).select(*KEYS, "channels", pairs)
    width = F.size("channels")
    sums = (
        cells.select(
            *KEYS,
            F.floor(F.col("i") / (width * width)).cast("int").alias("lag"),
            F.element_at("channels", (F.floor(F.col("i") / width) % width + 1).cast("int")).alias("early"),
            F.element_at("channels", (F.col("i") % width + 1).cast("int")).alias("late"),
            "v",
        )
        .groupBy(*KEYS, "lag", "early", "late")
        .agg((F.sum("v.products") + F.sum("v.rests")).alias("_sum"))
    )
    totals = segments.groupBy(*KEYS).agg(F.sum("length").alias("_total"))
    return sums.join(totals, KEYS).select(*KEYS, "lag", "early", "late", (F.col("_sum") / F.col("_total")).alias("value"))


def assemble(products: np.ndarray, orientation: str) -> np.ndarray:
    """(lag, early, late) statistics -> block-Toeplitz matrix, channel-major.

    Entry (a, b) of block (i, k) is the covariance of channels i and k at lag b - a
    ("reference") or a - b ("flattened", the covariance of the flattened window). The
    covariance at lag m is E[x_i(n + m) x_k(n)].
    """
    taps, width, _ = products.shape
    lag = np.subtract.outer(np.arange(taps), np.arange(taps))
    if orientation == "reference":
        lag = -lag
    ahead = products.transpose(0, 2, 1)[np.abs(lag)]  # lag >= 0: earlier sample in k
    behind = products[np.abs(lag)]  # lag < 0: earlier sample in i
    full = np.where((lag >= 0)[:, :, None, None], ahead, behind)
    # Cross blocks of the upper half are the transposes of those below.
    lower = full.transpose(2, 0, 3, 1)
    out = np.empty((width, taps, width, taps))
    for i in range(width):
        for k in range(i + 1):
            out[i, :, k, :] = lower[i, :, k, :]
            out[k, :, i, :] = lower[i, :, k, :].T
    return out.reshape(width * taps, width * taps)


class BlockToeplitz:
    """The noise matrix as its lag products: products with vectors by Fourier transforms.

    Holds (2 taps) x channels x channels numbers, never the (channels x taps) squared of the matrix.
    """

    def __init__(self, products: np.ndarray, orientation: str, ridge: float):
        taps, width, _ = products.shape
        self.taps, self.width, self.size = taps, width, 2 * taps
        # by_lag[d][i, k]: the entry of block (i, k) at row - column = d
        ahead, behind = products.transpose(0, 2, 1), products
        by_lag = np.zeros((self.size, width, width))
        lags = np.arange(taps)
        sign = 1 if orientation != "reference" else -1
        for d in lags:
            high, low = (ahead[d], behind[d]) if sign > 0 else (behind[d], ahead[d])
            by_lag[d] = high
            if d:
                by_lag[-d] = low
        # blocks above the diagonal are the transposes of those below
        lower = np.tril(np.ones((width, width), bool))
        mirrored = by_lag[-np.arange(self.size)].transpose(0, 2, 1)
        by_lag = np.where(lower, by_lag, mirrored)
        by_lag[taps] = 0
        trace = taps * np.trace(by_lag[0])
        by_lag[0] += np.eye(width) * (ridge * trace / (width * taps))
        self.spectrum = np.fft.rfft(by_lag, axis=0)
        # nearest circulant of every block, solved one frequency at a time
        share = np.arange(taps)[:, None, None] / taps
        ring = (1 - share) * by_lag[:taps]
        ring[1:] += share[1:] * by_lag[taps + 1 :]
        symbol = np.fft.rfft(ring, axis=0)
        symbol = (symbol + symbol.conj().transpose(0, 2, 1)) / 2
        values, vectors = np.linalg.eigh(symbol)
        values = np.maximum(values, 1e-6 * values.max())
        self.inverse = (vectors / values[:, None, :]) @ vectors.conj().transpose(0, 2, 1)

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        """Products with the columns of `v`, channel-major."""
        x = np.fft.rfft(v.reshape(self.width, self.taps, -1).transpose(1, 0, 2), self.size, axis=0)
        out = np.fft.irfft(self.spectrum @ x, self.size, axis=0)[: self.taps]
        return out.transpose(1, 0, 2).reshape(v.shape)

    def precondition(self, v: np.ndarray) -> np.ndarray:
        x = np.fft.rfft(v.reshape(self.width, self.taps, -1).transpose(1, 0, 2), axis=0)
        out = np.fft.irfft(self.inverse @ x, self.taps, axis=0)
        return out.transpose(1, 0, 2).reshape(v.shape)

    def solve(self, b: np.ndarray, tolerance: float = 1e-12, most: int = 2000) -> np.ndarray:
        """Conjugate gradients for all columns at once; an error if they do not converge."""
        x, r = np.zeros_like(b), b.copy()
        z = self.precondition(r)
        p, rz = z.copy(), (r * z).sum(0)
        goal = tolerance * np.linalg.norm(b, axis=0)
        for _ in range(most):
            if (np.linalg.norm(r, axis=0) <= goal).all():
                return x
            q = self @ p
            curve = (p * q).sum(0)
            step = np.where(curve > 0, rz / np.where(curve > 0, curve, 1), 0.0)
            x, r = x + step * p, r - step * q
            z = self.precondition(r)
            new = (r * z).sum(0)
            p, rz = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0) * p, new
        raise np.linalg.LinAlgError("no convergence: the matrix is not positive definite")


#: unknowns from which the matrix is never built (3000 squared doubles are 72 MB)
DENSE = 3000


def constrained_filter_of(products: np.ndarray, C: np.ndarray, ridge: float, orientation: str, dense: int = DENSE) -> np.ndarray:
    """`constrained_filter` from lag products, in a memory that follows them beyond `dense` unknowns.

    A matrix that is not positive definite is solved as a whole.
    """
    if len(C) > dense:
        try:
            whitened = BlockToeplitz(products, orientation, ridge).solve(C)
        except np.linalg.LinAlgError:
            dense = len(C)
    if len(C) <= dense:
        return constrained_filter(assemble(products, orientation), C, ridge)
    wanted = np.eye(C.shape[1])[0]
    return whitened @ np.linalg.solve(C.T @ whitened, wanted)


def constrained_filter(R: np.ndarray, C: np.ndarray, ridge: float) -> np.ndarray:
    """Minimum output noise with gain 1 on the first column of C and 0 on the others."""
    loaded = R + np.eye(len(R)) * (ridge * np.trace(R) / len(R))
    whitened = np.linalg.solve(loaded, C)
    wanted = np.eye(C.shape[1])[0]
    return whitened @ np.linalg.solve(C.T @ whitened, wanted)


def solve_filters(
    waveforms: DataFrame,
    selected: DataFrame,
    interferers: DataFrame,
    products: DataFrame,
    template_length: int,
    ridge: float = 1e-3,
    orientation: str = "reference",
) -> DataFrame:
    """One small dense solve per target, all targets in parallel.

    Returns the filter table: recording_id, target_id, channels, taps (time-major),
    left_margin, threshold (null).
    """
    ids = [*KEYS, "unit_id"]
    wanted = (
        selected.select(*KEYS, F.col("target_id").alias("unit_id")).distinct().withColumn("_first", F.lit(0))
        .unionByName(interferers.select(*ids).distinct().withColumn("_first", F.lit(1)))
    )
    cells = (
        wanted.join(selected.select(*KEYS, "channel", "rank"), KEYS)
        .join(waveforms.select("recording_id", "unit_id", "k", "channel", "value"), ["recording_id", "unit_id", "channel"])
    )
    columns = cells.groupBy(*ids, "_first").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "k", "value"))), lambda s: s["value"]).alias("w")
    )
    per_target = columns.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", "unit_id", "w"))), lambda s: s["w"]).alias("columns")
    )
    order = selected.select(*KEYS, "channel", "rank")
    early = order.select(*KEYS, F.col("channel").alias("early"), F.col("rank").alias("_e"))
    late = order.select(*KEYS, F.col("channel").alias("late"), F.col("rank").alias("_l"))
    noise = (
        products.join(early, [*KEYS, "early"]).join(late, [*KEYS, "late"])
        .groupBy(*KEYS)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "_e", "_l", "value"))), lambda s: s["value"]).alias("noise"))
    )
    chans = order.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel"))), lambda s: s["channel"]).alias("channels")
    )

    @F.pandas_udf("array<double>")
    def solve(columns: pd.Series, noise: pd.Series, channels: pd.Series) -> pd.Series:
        def one(cols, values, chs) -> list[float]:
            width = len(chs)
            C = np.array([np.asarray(c) for c in cols]).T
            lagged = np.asarray(values).reshape(template_length, width, width)
            flat = constrained_filter_of(lagged, C, ridge, orientation)
            return flat.reshape(width, template_length).T.ravel().tolist()

        return pd.Series([one(*row) for row in zip(columns, noise, channels)])

    return (
        per_target.join(noise, KEYS).join(chans, KEYS)
        .select(
            *KEYS, "channels", solve("columns", "noise", "channels").alias("taps"),
            F.lit(left_margin(template_length)).alias("left_margin"), F.lit(None).cast("double").alias("threshold"),
        )
    )


def gains(filters: DataFrame, waveforms: DataFrame, interferers: DataFrame) -> DataFrame:
    """Response of each filter to its target's and interferers' mean waveforms (1 and 0)."""
    width = F.size("channels")
    taps = filters.select(*KEYS, "channels", F.posexplode("taps").alias("_i", "tap")).select(
        *KEYS, F.floor(F.col("_i") / width).cast("int").alias("k"),
        F.element_at("channels", (F.col("_i") % width + 1).cast("int")).alias("channel"), "tap",
    )
    units = interferers.select(*KEYS, "unit_id").unionByName(
        filters.select(*KEYS, F.col("target_id").alias("unit_id"))
    ).distinct()
    return (
        units.join(waveforms, ["recording_id", "unit_id"])
        .join(taps, [*KEYS, "k", "channel"])
        .groupBy(*KEYS, "unit_id")
        .agg(F.sum(F.col("tap") * F.col("value")).alias("gain"))
    )
