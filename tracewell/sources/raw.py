"""Batch data sources for raw int16 recordings and one-dimensional npy arrays.

Both plan byte ranges on the driver (sizes and headers only) and read them in tasks. The
raw scan reads overlapping ranges when a halo is asked for, so dense operators need no
shuffle at all: `spark.read.format("interleaved16")`.
"""

from __future__ import annotations

import ast
import json
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracewell.sources.chunks import decode_int16
from tracewell.sources.files import read_range, resolve, sizes

RAW_SCHEMA = (
    "recording_id string, chunk_id bigint, start_sample bigint, n_samples int, "
    "channels array<int>, {payload}, lead int, trail int"
)
# The samples of a chunk row as doubles, or as the int16 bytes they were on disk: a
# quarter of the size, and copied as one block on the way to a kernel.
PAYLOADS = {"values": "values array<double>", "int16": "data binary"}


@dataclass
class Piece:
    """A file that holds samples [start, start + n) of a recording."""

    path: str
    start: int
    n: int


@dataclass
class ChunkRange(InputPartition):
    recording_id: str
    first_chunk: int
    last_chunk: int
    first_sample: int
    end_sample: int
    pieces: list

    def __init__(self, recording_id, first_chunk, last_chunk, first_sample, end_sample, pieces):
        super().__init__(None)
        self.recording_id = recording_id
        self.first_chunk, self.last_chunk = first_chunk, last_chunk
        self.first_sample, self.end_sample = first_sample, end_sample
        self.pieces = pieces


@dataclass
class Layout:
    """How a recording lies on disk and what is wanted of it."""

    width: int
    ids: list
    columns: list


class RawReader(DataSourceReader):
    """Plans byte ranges of the wanted samples only, and reads them with their halo.

    `recordings` (comma-separated), `from_sample` and `to_sample` choose what is planned: chunks that
    overlap the range. They are options and no pushed filters, since Spark keeps what was pushed to a
    Python source with the DataFrame, and a second query on it would miss rows. `layout`: JSON by recording of n_channels, and if they differ from all, channel_ids and
    columns (which of the stored channels to deliver); other recordings take the options.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.length = int(options.get("chunk_samples", 65536))
        self.before = int(options.get("halo_before", 0))
        self.after = int(options.get("halo_after", 0))
        self.per_task = int(options.get("chunks_per_task", 16))
        self.suffix = options.get("suffix", ".bin")
        self.payload = options.get("payload", "values")
        numbers = lambda text: [int(c) for c in text.split(",")] if text else None
        width = options.get("n_channels")
        self.common = None if width is None else layout_of(
            int(width), numbers(options.get("channel_ids")), numbers(options.get("columns"))
        )
        given = json.loads(options.get("layout", "{}"))
        self.layouts = {k: layout_of(v["n_channels"], v.get("channel_ids"), v.get("columns")) for k, v in given.items()}
        self.wanted = set(options["recordings"].split(",")) if "recordings" in options else None
        low, high = options.get("from_sample"), options.get("to_sample")
        self.first_chunk = None if low is None else int(low) // self.length
        self.end_chunk = None if high is None else -(-int(high) // self.length)

    def layout(self, name: str) -> Layout:
        found = self.layouts.get(name, self.common)
        if found is None:
            raise ValueError(f"recording {name}: neither n_channels nor a layout is given")
        return found

    def recordings(self) -> dict[str, list[Piece]]:
        """`X.bin` is a whole recording; `X/part-<start>.bin` are consecutive parts of one."""
        found: dict[str, list[Piece]] = {}
        for path, size in sizes(self.path, self.suffix):
            stem = os.path.basename(path)[: -len(self.suffix)]
            part = re.fullmatch(r"part-(\d+)", stem)
            name = os.path.basename(os.path.dirname(path)) if part else stem
            if self.wanted is not None and name not in self.wanted:
                continue
            start = int(part.group(1)) if part else 0
            found.setdefault(name, []).append(Piece(path, start, size // (2 * self.layout(name).width)))
        return {k: sorted(v, key=lambda p: p.start) for k, v in found.items()}

    def partitions(self) -> list[InputPartition]:
        plan = []
        for name, pieces in self.recordings().items():
            first, end = pieces[0].start, pieces[-1].start + pieces[-1].n
            step = self.per_task
            starts, ends = [p.start for p in pieces], [p.start + p.n for p in pieces]
            lowest, highest = first // self.length, -(-end // self.length)
            if self.first_chunk is not None:
                lowest = max(lowest, self.first_chunk)
            if self.end_chunk is not None:
                highest = min(highest, self.end_chunk)
            for chunk in range(lowest, highest, step):
                last = min(chunk + step, highest)
                low = chunk * self.length - self.before
                high = last * self.length + self.after
                # parts are in order and do not overlap
                near = pieces[bisect_right(ends, low) : bisect_left(starts, high)]
                if near:
                    plan.append(ChunkRange(name, chunk, last, first, end, near))
        return plan

    def stretch(self, system, pieces, low: int, high: int, layout: Layout) -> np.ndarray:
        """Samples [low, high) from the parts that hold them."""
        parts = []
        for p in pieces:
            a, b = max(low, p.start), min(high, p.start + p.n)
            if a < b:
                row = 2 * layout.width
                data = read_range(system, p.path, (a - p.start) * row, (b - a) * row)
                parts.append(decode_int16(data, layout.width)[:, layout.columns])
        return np.concatenate(parts) if parts else np.empty((0, len(layout.columns)))

    def samples(self, x: np.ndarray) -> dict:
        if self.payload == "int16":
            return {"data": pa.array([x.astype("<i2").tobytes()], pa.binary())}
        return {"values": pa.array([x.astype(float).ravel()], pa.list_(pa.float64()))}

    def read(self, partition: ChunkRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        system, _ = resolve(self.path)
        layout = self.layout(partition.recording_id)
        ids = [layout.ids[c] for c in layout.columns]
        # Stretches without a missing sample; a halo never reaches across a hole.
        runs: list[list[int]] = []
        for p in partition.pieces:
            if runs and runs[-1][1] == p.start:
                runs[-1][1] = p.start + p.n
            else:
                runs.append([p.start, p.start + p.n])
        for chunk in range(partition.first_chunk, partition.last_chunk):
            for low, high in runs:
                start = max(chunk * self.length, low)
                end = min((chunk + 1) * self.length, high)
                if start >= end:
                    continue
                lead = min(self.before, start - low)
                trail = min(self.after, high - end)
                x = self.stretch(system, partition.pieces, start - lead, end + trail, layout)
                row = {
                    "recording_id": [partition.recording_id],
                    "chunk_id": [chunk],
                    "start_sample": [start],
                    "n_samples": pa.array([end - start], pa.int32()),
                    "channels": pa.array([ids], pa.list_(pa.int32())),
                    **self.samples(x),
                    "lead": pa.array([lead], pa.int32()),
                    "trail": pa.array([trail], pa.int32()),
                }
                yield pa.RecordBatch.from_pydict(row)


def layout_of(width: int, ids: list[int] | None, columns: list[int] | None) -> Layout:
    return Layout(width, ids or list(range(width)), columns if columns is not None else list(range(width)))


def layouts(table: DataFrame) -> str:
    """The `layout` option from a table: recording_id, n_channels, and optionally channel_ids, columns.

    One row per recording of the folder: as many as the plan lists files anyway.
    """
    more = [c for c in ("channel_ids", "columns") if c in table.columns]
    rows = table.select("recording_id", "n_channels", *more).collect()
    fields = ["n_channels", *more]
    return json.dumps({r.recording_id: {f: r[f] for f in fields if r[f] is not None} for r in rows})


@dataclass
class Fetch:
    """Samples [first, end) of a recording and the files that hold them."""

    recording_id: str
    first: int
    end: int
    pieces: list


@dataclass
class Fetches(InputPartition):
    """What one task reads: a long stretch of one recording, or short ones of many."""

    fetches: list

    def __init__(self, fetches):
        super().__init__(None)
        self.fetches = fetches


#: a task takes further stretches up to so many bytes and files, so that many short recordings are few tasks
TASK_BYTES, TASK_FILES = 8 << 20, 64


class RawStreamReader(DataSourceStreamReader):
    """Chunk rows of growing recordings; the offset is the next sample of each recording.

    A poll looks at file sizes only; ranges are read in tasks. What a poll cannot list keeps its
    offset and is asked for again; a task that fails reads the same range again, and so does a
    query that starts from its checkpoint. Samples that are gone before they were read (old parts
    are removed) are skipped to the first that is left; a recording that starts anew is followed
    from its new head. `max_samples` bounds what a poll adds per recording; the first poll after a start
    is not bounded, as nothing tells it where the query stands. `start`: "earliest" or "head".
    """

    def __init__(self, options: dict):
        self.raw = RawReader(options)
        self.fetch = int(options.get("fetch_samples", self.raw.length))
        self.most = int(options.get("max_samples", 0))
        self.start = options.get("start", "earliest")
        #: offsets as of the last poll
        self.at: dict[str, int] | None = None

    def recordings(self) -> dict[str, list[Piece]]:
        """What there is now; nothing if the folder cannot be listed, so that offsets stay."""
        try:
            return self.raw.recordings()
        except OSError:
            return {}

    def heads(self) -> dict[str, int]:
        return {k: parts[-1].start + parts[-1].n for k, parts in self.recordings().items()}

    def initialOffset(self) -> dict:
        at = self.heads() if self.start == "head" else {}
        self.at = dict(at) if self.at is None else self.at
        return at

    def latestOffset(self) -> dict:
        bounded, self.at = self.most > 0 and self.at is not None, self.at or {}
        for name, parts in self.recordings().items():
            head = parts[-1].start + parts[-1].n
            here = self.at.get(name, parts[0].start)
            self.at[name] = min(head, max(here, parts[0].start) + self.most) if bounded else head
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end) if self.at is None else self.at
        plan: list[InputPartition] = []
        held: list[Fetch] = []
        held_bytes = held_files = 0
        for name, pieces in self.raw.recordings().items():  # an error here fails the batch, which runs again
            low, high = start.get(name, pieces[0].start), end.get(name, 0)
            step = self.fetch * self.raw.per_task
            row = 2 * self.raw.layout(name).width
            starts, ends = [p.start for p in pieces], [p.start + p.n for p in pieces]
            for first in range(max(low, pieces[0].start), high, step):
                last = min(high, first + step)
                # parts are in order and do not overlap
                near = pieces[bisect_right(ends, first) : bisect_left(starts, last)]
                if not near:
                    continue
                size = (last - first) * row
                if held and (held_bytes + size > TASK_BYTES or held_files + len(near) > TASK_FILES):
                    plan.append(Fetches(held))
                    held, held_bytes, held_files = [], 0, 0
                held.append(Fetch(name, first, last, near))
                held_bytes, held_files = held_bytes + size, held_files + len(near)
        if held:
            plan.append(Fetches(held))
        return plan

    def read(self, partition: Fetches) -> Iterator[pa.RecordBatch]:
        system, _ = resolve(self.raw.path)
        for wanted in partition.fetches:
            yield from self.fetched(system, wanted)

    def fetched(self, system, wanted: Fetch) -> Iterator[pa.RecordBatch]:
        layout = self.raw.layout(wanted.recording_id)
        ids = [layout.ids[c] for c in layout.columns]
        for p in wanted.pieces:
            low, high = max(wanted.first, p.start), min(wanted.end, p.start + p.n)
            for at in range(low, high, self.fetch):
                x = self.raw.stretch(system, [p], at, min(high, at + self.fetch), layout)
                yield pa.RecordBatch.from_pydict({
                    "recording_id": [wanted.recording_id],
                    "chunk_id": [at // self.raw.length],
                    "start_sample": [at],
                    "n_samples": pa.array([len(x)], pa.int32()),
                    "channels": pa.array([ids], pa.list_(pa.int32())),
                    **self.raw.samples(x),
                    "lead": pa.array([0], pa.int32()),
                    "trail": pa.array([0], pa.int32()),
                })


class RawRecordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "interleaved16"

    def schema(self) -> str:
        return RAW_SCHEMA.format(payload=PAYLOADS[self.options.get("payload", "values")])

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RawStreamReader(self.options)


@dataclass
class ValueRange(InputPartition):
    path: str
    first: int
    n: int
    data_start: int
    dtype: str

    def __init__(self, path, first, n, data_start, dtype):
        super().__init__(None)
        self.path, self.first, self.n = path, first, n
        self.data_start, self.dtype = data_start, dtype


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = int(options.get("values_per_task", 4_000_000))

    def header(self, system, path: str) -> tuple[int, str, int]:
        """(offset of the data, dtype, number of values)."""
        start = read_range(system, path, 0, 12)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is not an npy file")
        size, at = (int.from_bytes(start[8:10], "little"), 10) if start[6] == 1 else (
            int.from_bytes(start[8:12], "little"), 12)
        fields = ast.literal_eval(read_range(system, path, at, size).decode("latin1"))
        shape, dtype = fields["shape"], fields["descr"]
        if dtype not in ("<i4", "<i8", "<u4", "<u8") or sum(d > 1 for d in shape) > 1:
            raise ValueError(f"{path}: expected one dimension of integers, found {dtype} {shape}")
        return at + size, dtype, int(np.prod(shape))

    def partitions(self) -> list[InputPartition]:
        system, inner = resolve(self.path)
        data_start, dtype, n = self.header(system, inner)
        return [
            ValueRange(inner, first, min(self.per_task, n - first), data_start, dtype)
            for first in range(0, n, self.per_task)
        ]

    def read(self, partition: ValueRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        system, _ = resolve(self.path)
        item = int(partition.dtype[-1])
        data = read_range(
            system, partition.path, partition.data_start + partition.first * item, partition.n * item
        )
        values = np.frombuffer(data, dtype=partition.dtype).astype(np.int64)
        pos = np.arange(partition.first, partition.first + partition.n)
        yield pa.RecordBatch.from_pydict({"pos": pos, "value": values})


class NpyColumn(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy1d"

    def schema(self) -> str:
        return "pos bigint, value bigint"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Makes both formats available to `spark.read.format(...)`."""
    spark.dataSource.register(RawRecordings)
    spark.dataSource.register(NpyColumn)
    return spark
