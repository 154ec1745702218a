"""Stateful processors for live streams, keyed by recording.

They use the kernels of the batch operators, so a stream and a batch over the same rows
agree whatever the chunking. Where chunks arrive with a halo (overlapping fetches) the
batch `detect` runs on the stream as a stateless map and scales with the chunks of one
recording; the processor here serves chunks without one, whose volume per recording is
bounded by the acquisition rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.kernels import correlate, highpass_coefficients, recursive_filter, median_reference, window_peak_mask
from tracewell.operators.signal import PEAK_SCHEMA, Cleaning, column_index, with_filters
from tracewell.streaming.chunks import use_rocksdb


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


class Detector(StatefulProcessor):
    """Clean, correlate and suppress chunk by chunk; with `sync`, stamp with the last edge.

    State: the recursive filter's registers, the cleaned samples still needed, the first
    sample that is not decided yet, and chunks that came before an earlier one. These are held
    until the gap before them is filled or the newest sample is more than `lateness` samples
    past it; only then the gap restarts the signal state. A recording that falls silent for
    `idle_ms` gives up its gaps, so nothing stays held. A chunk that comes later still is
    given up and put out as a row of its first sample without target and score.

    `sync`: chunks carry the sync bit of each sample. Edges are kept from the last one before
    the first undecided sample on, as a point is decided after later edges may have come.
    """

    def __init__(
        self, cleaning: Cleaning, template_length: int, suppress: int, thresholded: bool, lateness: int = 0,
        sync: bool = False, idle_ms: int | None = None,
    ):
        self.cleaning, self.taps = cleaning, template_length
        self.suppress, self.thresholded, self.lateness = suppress, thresholded, lateness
        self.sync, self.idle_ms = sync, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signal = handle.getValueState(
            "signal", "next bigint, decided bigint, first bigint, registers array<double>, tail array<double>"
        )
        self.edges = handle.getValueState("edges", "bit int, seq bigint, edges array<bigint>")
        self.held = handle.getListState(
            "held", "start_sample bigint, channels array<int>, values array<double>, sync array<int>"
        )
        self.bank = handle.getValueState("bank", FILTERS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, ["start_sample"])
        if batch.empty:
            return
        filters = batch["filters"].iloc[0]
        sync = batch["sync"] if self.sync else [None] * len(batch)
        fresh = list(zip(batch["start_sample"].tolist(), batch["channels"], batch["values"], sync))
        yield from self.advance(key, fresh, filters, self.lateness)
        if self.idle_ms is not None and self.held.exists():
            plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
            self.bank.update(([tuple(plain(f[c]) for c in FILTER_FIELDS) for f in filters],))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No chunk came for a while: what is held goes on behind its gap."""
        if self.held.exists():
            filters = [dict(zip(FILTER_FIELDS, f)) for f in self.bank.get()[0]]
            yield from self.advance(key, [], filters, -1)

    def advance(self, key, fresh: list, filters: list, lateness: int) -> Iterator[pd.DataFrame]:
        waiting = fresh
        if self.held.exists():
            waiting = sorted([*fresh, *self.held.get()], key=lambda c: c[0])
            self.held.clear()
        if not waiting:
            return
        newest_end = max(start + len(values) // len(channels) for start, channels, values, _ in waiting)
        state = self.signal.get() if self.signal.exists() else None
        width = len(waiting[0][1])
        upcoming, decided, first = (state[0], state[1], state[2]) if state else (None, -1, 0)
        registers = np.array(state[3]).reshape(2, width) if state else np.zeros((2, width))
        tail = np.array(state[4], dtype=float).reshape(-1, width) if state else np.empty((0, width))
        bit, seq, edges = self.edges.get() if self.edges.exists() else (None, 0, [])
        edges = list(edges)  # the last of them is number seq
        b, a = highpass_coefficients(self.cleaning.fc, self.cleaning.fs)
        m, T = self.suppress, self.taps
        out: list[tuple] = []
        for k, (start, channels, values, sync) in enumerate(waiting):
            x = np.asarray(values, dtype=float).reshape(-1, width)
            if upcoming is not None and start < upcoming:
                out.append(("late", None, start, None, None, None))
                continue
            if upcoming != start:
                # a recording begins at sample 0
                if start > (upcoming or 0) and newest_end - (upcoming or 0) <= lateness:
                    self.held.put([
                        (s, [int(c) for c in cs], [float(v) for v in vs], None if bits is None else [int(v) for v in bits])
                        for s, cs, vs, bits in waiting[k:]
                    ])
                    break
                registers, tail, first = np.zeros((2, width)), np.empty((0, width)), start
                decided, bit = max(decided, start - 1), None
            upcoming = start + len(x)
            if sync is not None:
                bits = np.concatenate([[-1 if bit is None else bit], np.asarray(sync) != 0]).astype(np.int8)
                for at in (np.flatnonzero((bits[:-1] == 0) & (bits[1:] == 1)) + start).tolist():
                    seq += 1
                    edges.append(at)
                    out.append(("edge", None, at, None, at, seq))
                bit = int(bits[-1])
            if self.cleaning.highpass is not None:
                x, registers = recursive_filter(x, b, a, registers)
            if self.cleaning.reference:
                x = median_reference(x)
            tail = np.concatenate([tail, x])
            reached = decided
            for spec in filters:
                columns = column_index(np.asarray(channels), spec["chs"])
                taps = np.asarray(spec["taps"], dtype=float).reshape(T, len(columns))
                left = spec["left_margin"]
                if len(tail) < T:
                    continue
                d = correlate(tail[:, columns], taps, left)
                lo, hi = left, len(tail) - (T - 1 - left)
                mask = window_peak_mask(d[lo:hi], m)
                at = first + lo + np.arange(hi - lo)
                newest = first + hi - 1
                mask &= (at > decided) & (at + m <= newest)
                if self.thresholded:
                    mask &= d[lo:hi] > spec["threshold"]
                found = np.flatnonzero(mask)
                last = np.searchsorted(edges, at[found], side="right")
                for i, e in zip(found, last.tolist()):
                    stamp = (edges[e - 1], seq - len(edges) + e) if e else (None, None)
                    out.append(("peak", spec["target_id"], int(at[i]), float(d[lo + i]), *stamp))
                reached = max(reached, newest - m)
            decided = reached
            # The next undecided sample looks back over m scores of T samples each.
            keep_from = max(first, decided + 1 - m - T)
            tail, first = tail[keep_from - first :], keep_from
        self.signal.update((upcoming, decided, first, registers.ravel().tolist(), tail.ravel().tolist()))
        if self.sync:
            passed = int(np.searchsorted(edges, decided + 1, side="right"))
            self.edges.update((bit, seq, edges[max(0, passed - 1) :]))
        if out:
            frame = pd.DataFrame(
                [(key[0], *row) for row in out],
                columns=["recording_id", "kind", "target_id", "sample", "score", "edge_sample", "edge_seq"],
            )
            whole = {c: "Int64" for c in ("target_id", "edge_sample", "edge_seq")}
            frame = frame.astype({**whole, "score": float})
            yield frame if self.sync else frame[["recording_id", "target_id", "sample", "score"]]

    def close(self) -> None:
        pass


FILTER_FIELDS = ["target_id", "chs", "taps", "left_margin", "threshold"]
FILTERS = "filters array<struct<target_id: bigint, chs: array<int>, taps: array<double>, left_margin: int, threshold: double>>"
STAMPED = "recording_id string, kind string, target_id bigint, sample bigint, score double, edge_sample bigint, edge_seq bigint"


def detect_stream(
    chunks: DataFrame, filters: DataFrame, template_length: int, cleaning: Cleaning,
    suppress: int | None = None, thresholded: bool = True, lateness: int = 0,
    sync: bool = False, idle_ms: int | None = None,
) -> DataFrame:
    """Detections of a stream of chunk rows; a point is decided once its right side is seen.

    Chunks may come out of order by up to `lateness` samples; later ones give a row without
    target and score, so that nothing goes unseen. With `idle_ms` a recording that stays silent for
    so long gives up its gaps; without, held chunks wait for the next one.
    A zero-phase filter needs the samples to come, so it is an error here.

    `sync`: chunks have a column `sync`, the sync bit of each sample. Rows then have a `kind`: "edge"
    with its number, "peak" with the edge at or before it (none before the first), "late".
    """
    if cleaning.highpass == "zero_phase":
        raise ValueError("a stream cannot be filtered with zero phase; use highpass='causal'")
    use_rocksdb(chunks.sparkSession)
    m = template_length // 2 if suppress is None else suppress
    return with_filters(chunks, filters).groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=Detector(cleaning, template_length, m, thresholded, lateness, sync, idle_ms),
        outputStructType=STAMPED if sync else PEAK_SCHEMA, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def usable_spikes(stamped: DataFrame, fs: float) -> DataFrame:
    """Peaks that have an edge, with the seconds since it."""
    since = ((F.col("sample") - F.col("edge_sample")) / fs).alias("time_rel_s")
    return stamped.where("kind = 'peak' and edge_seq is not null").select(
        "recording_id", "target_id", "sample", "score", "edge_sample", "edge_seq", since
    )


WORD_EVENTS = "recording_id string, kind string, sample bigint, code int, edge_sample bigint, edge_seq bigint"


class WordDecoder(StatefulProcessor):
    """Sync edges and debounced code onsets of a digital word stream.

    Rows carry `sample`, `bit` and `code`. Onsets are stamped with the last edge at or
    before the onset; one without an edge keeps null there and is still remembered as the
    last code.
    """

    def __init__(self, debounce: int):
        self.debounce = debounce

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "words",
            "bit int, edge bigint, seq bigint, code int, n bigint, start bigint, "
            "start_edge bigint, start_seq bigint, last int, next bigint",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, ["sample"])
        if batch.empty:
            return
        if self.state.exists():
            bit, edge, seq, code, n, start, start_edge, start_seq, last, upcoming = self.state.get()
        else:
            bit, edge, seq, code, n, start, start_edge, start_seq, last, upcoming = (
                None, None, 0, 0, 0, 0, None, None, 0, None)
        sample = batch["sample"].to_numpy(np.int64)
        bits, codes = (batch["bit"].to_numpy() != 0).astype(np.int8), batch["code"].to_numpy(np.int64)
        before = np.concatenate([[-1 if bit is None else int(bit != 0)], bits[:-1]])
        rises = np.flatnonzero((before == 0) & (bits == 1))
        found = sample[rises]
        out = [(key[0], "edge", s, None, s, seq + k) for k, s in enumerate(found.tolist(), 1)]
        # runs of one code without a missing sample; the first may go on from the last batch
        new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (sample[1:] != sample[:-1] + 1)])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(codes)))
        counts = np.searchsorted(rises, starts, side="right")
        for k, (i, length, e) in enumerate(zip(starts.tolist(), lengths.tolist(), counts.tolist())):
            goes_on = k == 0 and codes[0] == code and (upcoming is None or upcoming == sample[0])
            seen = n if goes_on else 0
            if not goes_on:
                code, start = int(codes[i]), int(sample[i])
                start_edge = int(found[e - 1]) if e else edge
                start_seq = seq + e if start_edge is not None else None
            n = seen + length
            if seen < self.debounce <= n and code != last:
                if code != 0:
                    out.append((key[0], "onset", start, code, start_edge, start_seq))
                last = code
        if len(found):
            edge, seq = int(found[-1]), seq + len(found)
        bit, upcoming = int(bits[-1]), int(sample[-1]) + 1
        self.state.update((bit, edge, seq, code, n, start, start_edge, start_seq, last, upcoming))
        if out:
            frame = pd.DataFrame(out, columns=["recording_id", "kind", "sample", "code", "edge_sample", "edge_seq"])
            for c in ("code", "edge_sample", "edge_seq"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def decode_stream(words: DataFrame, debounce: int) -> DataFrame:
    """Edges and onsets from a stream with columns recording_id, sample, bit, code."""
    use_rocksdb(words.sparkSession)
    return words.select("recording_id", "sample", "bit", "code").groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=WordDecoder(debounce),
        outputStructType=WORD_EVENTS, outputMode="Append", timeMode="None",
    )


DECISIONS = "recording_id string, sample bigint, code int, outcome string, n_events bigint, trigger_sample bigint"
LATE = "LATE"


def in_samples(lateness: str | int, fs: float) -> int:
    """Samples of an interval such as "50 milliseconds"; numbers are samples."""
    if isinstance(lateness, int):
        return lateness
    number, unit = lateness.split()
    return math.ceil(float(number) * {"m": 0.001, "s": 1.0}[unit[0]] * fs)


class WindowDecider(StatefulProcessor):
    """Counts events in the window after every anchor and fires at the k-th one.

    Time is the newest sample that all of `sources` inputs have passed (rows carry their `source`),
    kept per recording. A row more than `lateness` samples behind its time is late: it is put out with
    the outcome LATE and changes nothing. A window fires as soon as its k-th event is known and
    expires when time has passed its end by the lateness; a recording that is silent for `idle_ms`
    closes its windows by the clock.

    State is keyed finely, so a batch writes what it touches: an open anchor with its first events,
    and recent events in stretches of a window's length (an anchor may come after its events). What
    a batch brings and time passes at once is never written.
    """

    def __init__(self, start: int, end: int, k: int, lateness: int, sources: int = 1, idle_ms: int | None = None):
        self.start, self.end, self.k, self.lateness = start, end, k, lateness
        self.sources, self.idle_ms = sources, idle_ms
        self.stretch = max(1, end - start + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchors = handle.getMapState("anchors", "sample bigint, code int", "events array<bigint>")
        self.recent = handle.getMapState("recent", "stretch bigint", "events array<bigint>")
        self.newest = handle.getMapState("newest", "source int", "sample bigint")

    def time(self) -> int | None:
        """What all inputs have passed; None while one has not begun."""
        found = [v[0] for _, v in self.newest.iterator()]
        return min(found) if len(found) >= self.sources else None

    def prepare(self, key, batch: pd.DataFrame) -> tuple[pd.DataFrame, dict[int, int], list[tuple]]:
        """Rows of kind anchor and event with samples of one clock, what each source says of time, and
        rows that are late already."""
        return batch, batch.groupby("source")["clock"].max().dropna().to_dict(), []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if not parts:
            return
        batch, clocks, out = self.prepare(key, pd.concat(parts))
        before = self.time()
        if before is not None:
            is_late = batch["kind"].isin(["anchor", "event"]) & (batch["sample"] < before - self.lateness)
            for s, code in batch.loc[is_late, ["sample", "code"]].itertuples(index=False):
                out.append((key[0], int(s), None if pd.isna(code) else int(code), LATE, None, None))
            batch = batch[~is_late]
        for source, newest in clocks.items():
            known = self.newest.getValue((int(source),))
            if known is None or known[0] < newest:
                self.newest.updateValue((int(source),), (int(newest),))
        events = np.sort(batch.loc[batch["kind"] == "event", "sample"].to_numpy(np.int64))
        now = self.time()
        passed = None if now is None else now - self.lateness
        known = {tuple(anchor): found for anchor, (found,) in self.anchors.iterator()}
        touched: dict[tuple, list[int]] = {}
        recent = {at: list(found) for (at,), (found,) in self.recent.iterator()}
        changed = []
        if len(events):
            for anchor, found in known.items():
                low, high = np.searchsorted(events, [anchor[0] + self.start, anchor[0] + self.end + 1])
                if high > low:
                    touched[anchor] = sorted([*found, *events[low:high].tolist()])[: self.k]
            stretch = events // self.stretch
            changed, first = np.unique(stretch, return_index=True)
            changed = changed.tolist()
            for at, more in zip(changed, np.split(events, first[1:])):
                recent.setdefault(at, []).extend(more.tolist())
        fresh = batch[batch["kind"] == "anchor"]
        for a, code in zip(fresh["sample"].astype("int64").tolist(), fresh["code"].astype("int64").tolist()):
            low, high = a + self.start, a + self.end
            found = (recent.get(at, ()) for at in range(low // self.stretch, high // self.stretch + 1))
            touched[a, code] = sorted(e for f in found for e in f if low <= e <= high)[: self.k]
        for anchor, found in touched.items():
            if len(found) >= self.k:
                out.append((key[0], *anchor, "TRIGGER", self.k, found[-1]))
            elif passed is not None and anchor[0] + self.end < passed:
                out.append((key[0], *anchor, "NO_TRIGGER", len(found), None))
            else:
                self.anchors.updateValue(anchor, (found,))
                continue
            if anchor in known:
                self.anchors.removeKey(anchor)
        for at in changed:
            if passed is None or not self.forgets(at, passed):
                self.recent.updateValue((at,), (recent[at],))
        if passed is not None:
            out += self.expired(key, passed)
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield self.frame(out)

    def forgets(self, at: int, passed: int) -> bool:
        """Whether no later anchor can ask for the events of a stretch."""
        return (at + 1) * self.stretch <= passed + min(self.start, 0)

    def expired(self, key, passed: int) -> list[tuple]:
        """Windows that end before `passed`; forgets events that no later anchor can ask for."""
        out = []
        for (a, code), (found,) in list(self.anchors.iterator()):
            if a + self.end < passed:
                out.append((key[0], a, code, "NO_TRIGGER", len(found), None))
                self.anchors.removeKey((a, code))
        for (at,) in list(self.recent.keys()):
            if self.forgets(at, passed):
                self.recent.removeKey((at,))
        return sorted(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A silent recording: its windows are over by the clock, unless rows came in between."""
        latest = max(self.handle.listTimers(), default=0)
        if latest <= expiredTimerInfo.getExpiryTimeInMs():
            out = self.expired(key, 1 << 62)
            if out:
                yield self.frame(out)

    def frame(self, out: list) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["recording_id", "sample", "code", "outcome", "n_events", "trigger_sample"])
        return made.astype({c: "Int64" for c in ("sample", "code", "n_events", "trigger_sample")})

    def close(self) -> None:
        pass


class AlignedDecider(WindowDecider):
    """Decides on events of one stream and onsets of another, whose clocks only share sync edges.

    Rows of source 0: "edge" with number and sample, and "event". Rows of source 1: "onset" with the
    number of its last edge and the samples since, already at the first stream's rate, and "mark",
    which only moves time. Their place on the first clock is counted from the edge with the same
    number; they wait until that edge is known. An edge is forgotten once time has passed the next one
    by the lateness: what still names it is late, and has no place.

    Edges, and what waits for them, are kept in blocks of edge numbers: every call on the state costs a
    round trip, and there are about as many edges as samples.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.edges = handle.getMapState("edges", "block bigint", "seqs array<bigint>, samples array<bigint>")
        self.waiting = handle.getMapState("waiting", "block bigint", "seqs array<bigint>, since array<bigint>, codes array<int>")
        self.forgotten = handle.getValueState("forgotten", "seq bigint")

    def prepare(self, key, batch: pd.DataFrame) -> tuple[pd.DataFrame, dict[int, int], list[tuple]]:
        blocks: dict[int, tuple[dict[int, int], dict[int, list]]] = {}  # new edges, what names them
        new = batch[batch["kind"] == "edge"]
        for seq, s in zip(new["edge_seq"].astype("int64").tolist(), new["sample"].astype("int64").tolist()):
            blocks.setdefault(seq // SEQS, ({}, {}))[0][seq] = s
        second = batch[batch["kind"].isin(["onset", "mark"])]
        codes = second["code"].fillna(MARK).astype("int64").tolist()
        for seq, since, code in zip(second["edge_seq"].astype("int64").tolist(), second["sample"].astype("int64").tolist(), codes):
            blocks.setdefault(seq // SEQS, ({}, {}))[1].setdefault(seq, []).append((since, code))
        gone = self.forgotten.get()[0] if self.forgotten.exists() else 0
        placed, late = [], []
        for block in sorted(blocks):
            fresh, came = blocks[block]
            before = self.edges.getValue((block,))
            edges = {**(dict(zip(*before)) if before else {}), **fresh}
            if fresh:
                self.edges.updateValue((block,), (list(edges), list(edges.values())))
            held = self.waiting.getValue((block,))
            waiting: dict[int, list] = {}
            for seq, since, code in zip(*held) if held else ():
                waiting.setdefault(seq, []).append((since, code))
            for seq, found in came.items():
                waiting.setdefault(seq, []).extend(found)
            for seq in sorted(waiting):
                if seq in edges:
                    placed += [(edges[seq] + since, code) for since, code in waiting.pop(seq)]
                elif seq <= gone and seq in came:
                    late += [(key[0], None, code, LATE, None, None) for _, code in waiting.pop(seq) if code != MARK]
            if waiting:
                left = [(seq, since, code) for seq, found in waiting.items() for since, code in found]
                self.waiting.updateValue((block,), tuple(list(c) for c in zip(*left)))
            elif held:
                self.waiting.removeKey((block,))
        clocks = batch.groupby("source")["clock"].max().dropna().to_dict()
        if placed:
            clocks[1] = max(clocks.get(1, -(1 << 62)), max(s for s, _ in placed))
        anchors = pd.DataFrame([("anchor", s, c) for s, c in placed if c != MARK], columns=["kind", "sample", "code"])
        return pd.concat([batch.loc[batch["kind"] == "event", ["kind", "sample", "code"]], anchors]), clocks, late

    def expired(self, key, passed: int) -> list[tuple]:
        blocks = {block: dict(zip(*found)) for (block,), found in list(self.edges.iterator())}
        known = sorted(edge for edges in blocks.values() for edge in edges.items())
        over = [seq for (seq, _), (_, following) in zip(known, known[1:]) if following < passed]
        for block in sorted({seq // SEQS for seq in over}):
            rest = {seq: s for seq, s in blocks[block].items() if seq > over[-1]}
            if rest:
                self.edges.updateValue((block,), (list(rest), list(rest.values())))
            else:
                self.edges.removeKey((block,))
        if over:
            self.forgotten.update((over[-1],))
        return super().expired(key, passed)


#: stands for the code of a mark in the state
MARK = -(1 << 31)
#: edge numbers of one block of the state
SEQS = 256


def _timed(rows: DataFrame, *more: str) -> DataFrame:
    has = rows.columns
    source = F.col("source").cast("int") if "source" in has else F.lit(0)
    clock = F.col("clock") if "clock" in has else F.col("sample")
    return rows.select(
        "recording_id", "kind", F.col("sample").cast("long").alias("sample"), F.col("code").cast("int").alias("code"),
        source.alias("source"), clock.cast("long").alias("clock"), *more,
    )


def decide_stream(
    rows: DataFrame, start: int, end: int, k: int, fs: float, lateness: str | int = "50 milliseconds",
    sources: int = 1, idle_ms: int | None = None,
) -> DataFrame:
    """Decisions from one stream of anchors and events, and the rows that came too late.

    `rows`: recording_id, kind ("anchor", "event", anything else only moves time), sample, code;
    optionally source (0, 1, ... of `sources` inputs that move time together) and clock (what a row
    says of time, its sample unless given). Late rows have the outcome LATE: see `late_rows`.
    """
    use_rocksdb(rows.sparkSession)
    return _timed(rows).groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=WindowDecider(start, end, k, in_samples(lateness, fs), sources, idle_ms),
        outputStructType=DECISIONS, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def decide_aligned_stream(
    rows: DataFrame, start: int, end: int, k: int, fs: float, lateness: str | int = "50 milliseconds",
    idle_ms: int | None = None,
) -> DataFrame:
    """Decisions on two streams with clocks of their own: `stamped_rows` and `onset_rows` in one."""
    use_rocksdb(rows.sparkSession)
    decider = AlignedDecider(start, end, k, in_samples(lateness, fs), sources=2, idle_ms=idle_ms)
    return _timed(rows, "edge_seq").groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=decider, outputStructType=DECISIONS, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


LIVE_ROWS = "recording_id string, kind string, sample bigint, code int, source int, clock bigint, edge_seq bigint"


def stamped_rows(stamped: DataFrame, delay: int) -> DataFrame:
    """Edges and usable peaks of `detect_stream(sync=True)` as rows of the first input.

    A peak is put out up to `delay` samples (template and suppression) after an edge behind it, so
    an edge moves time less far by that.
    """
    kind = F.when(F.col("kind") == "edge", "edge").when(F.col("edge_seq").isNotNull(), "event").otherwise("early")
    return stamped.where("kind != 'late'").select(
        "recording_id", kind.alias("kind"), "sample", F.lit(None).cast("int").alias("code"), F.lit(0).alias("source"),
        (F.col("sample") - F.when(F.col("kind") == "edge", delay).otherwise(0)).alias("clock"), "edge_seq",
    )


def onset_rows(decoded: DataFrame, fs: float, fs_events: float) -> DataFrame:
    """Edges and stamped onsets of `decode_stream` as rows of the second input, at the first's rate."""
    since = F.round((F.col("sample") - F.col("edge_sample")) * F.lit(float(fs_events)) / F.lit(float(fs))).cast("long")
    return decoded.where("edge_seq is not null").select(
        "recording_id", F.when(F.col("kind") == "edge", "mark").otherwise("onset").alias("kind"), since.alias("sample"),
        "code", F.lit(1).alias("source"), F.lit(None).cast("long").alias("clock"), "edge_seq",
    )


def decided(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("outcome") != LATE)


def late_rows(rows: DataFrame) -> DataFrame:
    """The side table: sample and code of what came too late."""
    return rows.where(F.col("outcome") == LATE).select("recording_id", "sample", "code")
