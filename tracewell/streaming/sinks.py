"""Line files of streams: every line of a finished batch once, whatever failed on the way.

Tasks write files under names of their own; a batch's commit writes one manifest of the files that
its successful tasks named, and readers only read what manifests name. A batch that runs again
replaces its manifest. `dataframe.writeStream.format("event_lines")`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from tracewell.sources.files import resolve
from tracewell.sources.sinks import decision_lines

MANIFESTS, FILES = "_batches", "lines"


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    lines: int


class LineWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of a task's lines; none for no lines."""
        system, inner = resolve(self.folder)
        out, path, n = None, f"{FILES}/{uuid.uuid4().hex}.txt", 0
        for batch in iterator:
            lines = [v for v in batch.column(0).to_pylist() if v is not None]
            if lines and out is None:
                system.create_dir(f"{inner}/{FILES}", recursive=True)
                out = system.open_output_stream(f"{inner}/{path}")
            if lines:
                out.write(("\n".join(lines) + "\n").encode())
                n += len(lines)
        if out is not None:
            out.close()
        return Written(path if n else None, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, inner = resolve(self.folder)
        system.create_dir(f"{inner}/{MANIFESTS}", recursive=True)
        named = [[m.path, m.lines] for m in messages if m is not None and m.path]
        with system.open_output_stream(f"{inner}/{MANIFESTS}/{batchId:012d}.json") as out:
            out.write(json.dumps(named).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Files of a batch that failed are named by no manifest; those that are known go."""
        system, inner = resolve(self.folder)
        for m in messages:
            if m is not None and m.path:
                try:
                    system.delete_file(f"{inner}/{m.path}")
                except OSError:
                    pass


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


def spike_lines(spikes: DataFrame) -> DataFrame:
    """One sample index per line."""
    return spikes.select(F.col("sample").cast("string").alias("value"))


def code_lines(onsets: DataFrame) -> DataFrame:
    """`code,sample` per line."""
    return onsets.select(F.concat_ws(",", "code", "sample").alias("value"))


def outcome_lines(decisions: DataFrame, fs: float) -> DataFrame:
    """A line per decision, its times in seconds."""
    seconds = lambda c: (F.col(c) / fs).cast("string")
    return decision_lines(decisions.select(
        "code", "outcome", "n_events", seconds("sample").alias("syllable_t"), seconds("trigger_sample").alias("trigger_t")
    ))


def start_lines(lines: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Starts the query that appends `lines` (one string column) to the folder."""
    lines.sparkSession.dataSource.register(EventLines)
    writer = lines.writeStream.format("event_lines").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(folder)


def manifest(spark: SparkSession, folder: str) -> list[str]:
    """Files of finished batches: a short list, one entry per task and batch."""
    system, inner = resolve(folder)
    found = system.get_file_info(fs.FileSelector(f"{inner}/{MANIFESTS}", allow_not_found=True))
    names = []
    for info in sorted(found, key=lambda f: f.path):
        with system.open_input_stream(info.path) as source:
            names += [path for path, _ in json.loads(source.read())]
    return names


def read_lines(spark: SparkSession, folder: str, line: str | Column = "value") -> DataFrame:
    names = manifest(spark, folder)
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.read.text([f"{folder}/{name}" for name in names]).select(line)
